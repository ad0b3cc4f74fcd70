import pytest
from pyspark.sql import functions as F

from claimscope.llm import line_dedup as L

BLANK = " \t\n\x0b\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(texts, least, chars=1):
    count = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    often = {k for k, n in count.items() if n >= least and len(k) >= chars}
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in often]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def sample():
    texts = []
    for i in range(60):
        lines = [f"own {i}", ["Common Line", " common line\t", "COMMON LINE\r"][i % 3] if i % 2 else "", "É só" if i % 5 == 0 else "é só",
                 " nbsp " if i % 4 == 0 else "nbsp", "rare" if i < 9 else "often" if i < 19 else "", f"own {i}"]
        texts.append("\n".join(lines))
    return texts + [None, "", "\n", "\n\n", "common line", "Common Line\ncommon line", "x\n" * 30_000 + "common line", "é só"] + ["twin\nrow"] * 11


@pytest.mark.parametrize("batches", [1, 5])
def test_against_brute_force(spark, batches):
    texts = sample()
    ids = list(range(len(texts) - 12)) + [None] + [500] * 11
    want = {}
    for i, t, w in zip(ids, texts, brute(texts, 10)):
        want.setdefault((i, t), []).append(w)
    df = spark.createDataFrame(list(zip(ids, texts, ["n"] * len(ids))), "doc_id long, text string, n_lines string").repartition(4)
    got = {}
    df = df.withColumn("was", F.col("text"))
    out = L.dedup_lines(df, batches=batches)
    assert out.columns == ["doc_id", "was", "text", "n_lines", "n_dropped"]
    for r in out.collect():
        got.setdefault((r.doc_id, r.was), []).append((r.n_lines, r.n_dropped, r.text))
    assert got == want


def test_runs_are_levelled_and_count_once(spark):
    runs = L.LineRuns(spark, threshold=3, fanout=2, buckets=3)
    for b in range(5):
        rows = [("hot", 2), (f"b{b}", 1), ("slow", 1 if b % 2 else 0)]
        runs.add(spark.createDataFrame([r for r in rows if r[1]], "k string, n long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]  # 5 batches in binary
    # saturated keys are not counted again: the last run knows nothing of "hot"
    assert "hot" not in {r.k for r in runs.runs()[0].collect()}
    counts = {r.k: r.n for r in runs.counts().collect()}
    assert counts["hot"] == 3 and counts["slow"] == 2 and counts["b4"] == 1
    runs.close()


def test_empty(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_own_columns_with_inner_names_pass(spark):
    names = ["_text", "_h", "_drop", "_key", "id", "k", "c0"]
    rows = [(i, f"same line\nown {i}", *[f"{n}{i}" for n in names]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    got = L.dedup_lines(df).collect()
    assert got[0].__fields__ == ["doc_id", *names, "text", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got)) == sorted((i, *[f"{n}{i}" for n in names], f"own {i}", 2, 1) for i in range(12))
