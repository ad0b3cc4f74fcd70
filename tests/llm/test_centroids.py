import hashlib

import numpy as np
import pytest

from claimscope.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance string"


def brute(rows, k=40, rounds=5, dim=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(256 * float(x))) for x in v]))
    mark = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cent = [v for _, v in sorted(kept, key=mark)[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cent]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(rounds):
        of = assign()
        for c in range(len(cent)):
            own = [v for (_, v), (_, x) in zip(kept, of) if x == c]
            if own:
                cent[c] = [sum(col) // len(own) for col in zip(*own)]
    of = assign()
    per = {c: sum(d for d, x in of if x == c) for c in range(len(cent))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted(((i, c, d, per[c], sum(per.values()), sha[c]) for (i, _), (d, c) in zip(kept, of)), key=str)


def found(spark, rows, **given):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).repartition(4)
    out = C.summary(*C.cluster(df, **given)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("n_pivots", [1, 12])
def test_equals_brute_force(spark, n_pivots):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=4) * rng.choice([0.01, 1, 5]) + rng.integers(-1, 2)).tolist()) for i in range(200)]
    rows += [(900 + i, [0.5, -0.25, 0.0, 1.0]) for i in range(90)]                            # copies, ties
    rows += [(5, rows[5][1]), (None, [1.0, 2.0, 3.0, 4.0]), (None, [0.0] * 4), (2000, None), (2001, []), (2002, [1.0] * 5),
             (2003, [1.0, None, 1.0, 1.0]), (2004, [float("nan")] * 4), (2005, [float("-inf")] * 4)]
    assert found(spark, rows, k=9, dim=4, n_pivots=n_pivots) == brute(rows, 9, dim=4)


def test_large_finite_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 7)).tolist()) for i in range(60)]
    assert found(spark, rows, k=6, dim=3) == brute(rows, 6, dim=3)
    with pytest.raises(Exception, match="range of long"):
        found(spark, rows + [(99, [1e30, 0.0, 0.0])], k=6, dim=3)
    v = np.array([[(1 << 31) + 1, 0], [3, 4]], np.int64)
    c = np.array([[0, 0], [(1 << 31), 0]], np.int64)
    best, distance, _ = C.nearest(v, C._roots(v, c), c, C._roots(c, c))
    assert best.tolist() == [1, 0] and distance.tolist() == [1, 25]


def test_few_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    assert found(spark, rows, k=40, dim=2) == brute(rows, dim=2)
    assert found(spark, [], dim=2) == [] and found(spark, [(1, [1.0])], dim=2) == []


def test_bounds_spare_centroids():
    rng = np.random.default_rng(6)
    centre = rng.integers(-2000, 2000, (40, 16))
    v = centre[rng.integers(0, 40, 3000)] + rng.integers(-50, 50, (3000, 16))
    pivots = v[:12]
    _, distance, evaluated = C.nearest(v, C._roots(v, pivots), centre, C._roots(centre, pivots))
    assert evaluated < 0.2 * 40 * 3000
    assert distance.tolist() == ((v[:, None, :] - centre[None]) ** 2).sum(2).min(1).tolist()
