import re

import pytest

from claimscope.llm import mixing

DOC = "doc_id long, source string, text string"


def targets(sizes):
    """Stop at the bound and share again, step by step."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, left, out = 1.5 * sum(sizes.values()), set(order), {}
    while left:
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            out |= share
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, "d": 700, None: 300}, {"x": 7}, {"a": 0, "b": 0},
                                   {"a": 0, "b": 9}, {f"s{i}": 10 + i * i for i in range(40)}, {"a": 6, "b": 2, "c": 4}])
def test_targets_equal_step_by_step_sharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s], abs=1e-9) for s in want)


def test_mix(spark):
    rows = [(i, ["hot", "b", None, "c"][0 if i % 3 else i % 4], "w " * (1 + i * i % 90)) for i in range(1200)]
    rows += [(None, "b", None), (7, "b", ""), (7, "b", ""), (8, "zero", None), (2000, "c", "x y　z " * 40)]
    df = spark.createDataFrame([(*r, 5, "t") for r in rows], DOC + ", copies int, target string").repartition(7)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "source", "text", "size", "source_size", "target", "copies"]
    by = {}
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.copies <= 2
        by.setdefault(r.source, []).append(r)
    want = targets({s: sum(r.size for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert rs[0].target == pytest.approx(want[s])
        assert abs(sum(r.copies for r in rs) - len(rs) * (want[s] / max(1, rs[0].source_size))) <= 1 + 1e-6
        assert abs(sum(r.size * r.copies for r in rs) - want[s]) <= max(r.size for r in rs)
    # reruns agree, whatever the partitions
    again = mixing.mix(df.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.emitted(mixing.mix(df)).count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_own_columns_pass_and_hot_sizes_are_split(spark):
    rows = [(i, "hot", "a b", i, -i, "x", 7) for i in range(900)] + [(i, "s", "w " * (i % 9), i, -i, "y", 8) for i in range(200)]
    names = "_src string, text string, _class int, _cell int, _k0 string, _i int"
    df = spark.createDataFrame(rows, f"doc_id long, {names}").repartition(6)
    got = mixing.mix(df, source="_src", cell_rows=50).collect()
    assert got[0].__fields__ == ["doc_id", "_src", "text", "_class", "_cell", "_k0", "_i", "size", "source_size", "target", "copies"]
    assert sorted(tuple(r[:7]) for r in got) == sorted(rows)
    want = targets({"hot": 1800, "s": sum(len(r[2].split()) for r in rows if r[1] == "s")})
    for s in want:
        taken = sum(r.size * r.copies for r in got if r._src == s)
        assert abs(taken - want[s]) <= max(r.size for r in got if r._src == s)
    # one offset: the copies of the hot source are those of a plain systematic sample
    hot = [r.copies for r in got if r._src == "hot"]
    assert abs(sum(hot) - want["hot"] / 2) < 1 + 1e-9 and max(hot) - min(hot) <= 1


def test_many_sources_and_long_texts(spark):
    rows = [(i, f"host{i % 3000}", "w " * (i % 7)) for i in range(6000)] + [(9999, "host1", "w " * 300_000)]
    df = spark.createDataFrame(rows, DOC).repartition(5)
    mixed = mixing.mix(df)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    got = mixed.select("source", "size", "target").collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = targets(sizes)
    assert all(r.target == pytest.approx(want[r.source], abs=1e-6) for r in got)


def test_rows_are_shuffled_once(spark, capsys):
    docs = spark.createDataFrame([(i, "abc"[i % 3], "w " * (i % 5)) for i in range(90)], "doc_id long, source string, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        mixing.mix(docs).explain()
        plan = capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    above = plan[plan.index("SortMergeJoin"):]
    window = above[:above.index("Window [row_number()")]
    assert "Exchange" not in window and "SortMergeJoin" in window
