import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscope.llm import exact_search as S

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k):
    fine = [(i, np.array([int(np.floor(1024 * float(np.float32(x)))) for x in v], object)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {i: a for i, a in sorted(fine, key=lambda r: (r[0], [-int(x) for x in r[1]])) if i % 100 == 0}.items():
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q and len(a) == len(b))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("n_pivots", [0, 5, 48])
def test_equals_brute_force(spark, n_pivots):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]                       # ties
    rows += [(2000, None), (2100, []), (2101, []), (2200, [1.0, None] + [0.0] * 6), (2300, [float("nan")] * 8),
             (2400, [float("inf")] * 8), (2501, [-1e8] + [1e5] * 7), (None, [1.0] * 8), (2600, [1.0, 2.0]), (2601, [0.5, 0.5]),
             (2700, [0.0] * 8), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(5)
    got = S.top_k(df, F.col("vec_id") % 100 == 0, n_pivots=n_pivots).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10)
    assert got[0].__fields__ == ["query_id", "rank", "vec_id", "score"]


def test_bounds_eliminate_on_clustered_vectors():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16)) * 3000
    data = np.floor(centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 100).astype(np.int64)
    pivots = data[:40]
    table = S._distances(data, pivots)
    ids = np.arange(3000)
    _, evaluated = S.pivot_search(ids, data, table, ids[:50], data[:50], table[:50], np.full(50, np.iinfo(np.int64).min), 10)
    assert evaluated < 0.6 * 50 * 3000


def test_large_finite_components_take_part(spark):
    rows = [(0, [1.0, 1.0]), (1, [100000.0, 1.0]), (2, [2.0, 2.0]), (100, [70000.0, 0.0])]
    rows += [(200 + i, [1e5 * (-1) ** i, 3.0 * i]) for i in range(0, 30)] + [(300, [-2.0, 1.0]), (400, [1e5, -7e4])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(3)
    is_query = F.col("vec_id") % 100 == 0
    assert sorted(map(tuple, S.top_k(df, is_query).collect())) == brute(rows, 10)
    # a vector whose scores leave the range of long counts, as long as it is not among the best
    far = rows[:3] + [(5 + i, [1.5 * i, 0.5]) for i in range(20)] + [(31, [-1e30, 2.0]), (32, [-3e38, -1.0]), (100, [0.5, 1e5])]
    df = spark.createDataFrame([(*r, 0) for r in far], SCHEMA).repartition(3)
    assert sorted(map(tuple, S.top_k(df, is_query).collect())) == brute(far, 10)
    df = spark.createDataFrame([(*r, 0) for r in far + [(33, [1e30, 0.0])]], SCHEMA)
    with pytest.raises(Exception, match="range of long"):
        S.top_k(df, is_query).collect()


def test_huge_components_stay_exact():
    a = np.array([[1 << 26, 3], [-(1 << 26), 1]], np.int64)
    assert S._dot(a, a).tolist() == [[(1 << 52) + 9, -(1 << 52) + 3], [-(1 << 52) + 3, (1 << 52) + 1]]


def test_empty_and_few(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.top_k(df, F.col("vec_id") % 100 == 0).count() == 0
    df = spark.createDataFrame([(0, [1.0], 0), (1, [0.5], 0), (2, [0.5], 0)], SCHEMA)
    assert [tuple(r) for r in S.top_k(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [
        (0, 1, 1, 512 * 1024), (0, 2, 2, 512 * 1024)]


def test_tight_negative_bounds_are_kept():
    import numpy as np
    from claimscope.llm import exact_search as E
    q = np.full((1, 8), 1 << 26, np.int64)
    rows = np.array([[-(1 << 26) + 1000 * i] * 8 for i in range(10)], np.int64)
    ids = np.arange(10)
    scores = (rows @ q.T)[:, 0]
    found, _ = E.pivot_search(ids, rows, E._distances(rows, rows), np.array([-1]), q, E._distances(q, rows),
                              np.array([scores.min()]), 10)
    assert found[0][1].tolist() == ids[::-1].tolist() and found[0][2].tolist() == scores[::-1].tolist()


def test_nothing_is_broadcast_and_tiles_give_the_same(spark, monkeypatch):
    # queries were copied once per shuffle partition and the copies broadcast, through the driver
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(2400, rows[7][1]), (3001, rows[100][1]), (3002, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(3)
    got = S.top_k(df, F.col("vec_id") % 100 == 0)
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    want = brute(rows, 10)
    assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(S, "QUERY_BYTES", 4000)
    monkeypatch.setattr(S, "TILE_BYTES", 200_000)
    monkeypatch.setattr(S, "BLOCK", 100)
    assert sorted(map(tuple, S.top_k(df, F.col("vec_id") % 100 == 0).collect())) == want
