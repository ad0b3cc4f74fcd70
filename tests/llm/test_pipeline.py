import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from test_ngram_join import brute as near_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    from claimscope.llm.staging import staged
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10 ** 6, None, "en", "src0", 0), (10 ** 6 + 1, "123 !?", None, None, 6), (10 ** 6 + 2, "", "en", "src1", 0),
             (None, "the text of no number and of the others", "en", "src1", 4)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs = docs.unionByName(docs.where("doc_id = 5"))
    out = [staged(docs, "t")]
    for name, f in P.STAGES:
        out.append(staged(f(spark, out[-1], SF), f"t-{name}"))
    return out


def rows(df):
    return sorted((str(tuple(r)) for r in df.collect()))


def test_names_and_columns(spark, steps):
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "shard"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_language_rejects_only_texts_without_one(steps):
    gone = steps[0].exceptAll(steps[1]).collect()
    assert {r.doc_id for r in gone} == {10 ** 6, 10 ** 6 + 1, 10 ** 6 + 2}


def test_one_document_of_each_group_stays(steps):
    before = [(r.doc_id, r.text) for r in steps[1].collect()]
    want = {i for i, _, top in near_brute([b for b in before if b[0] is not None]) if i == top}
    after = steps[2].collect()
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in after) == 1


def test_no_document_with_a_benchmark_window_stays(spark, steps):
    from test_decontamination import brute
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(str(tuple(r)) for r in steps[2].collect() if not brute(r.text, bench)[1])
    assert rows(steps[3]) == want


def test_mix_takes_effect(steps):
    from claimscope.llm import mixing
    mixed = mixing.mix(steps[3]).where("copies > 0").select("doc_id", F.col("copies").cast("long").alias("n"))
    assert rows(steps[4].groupBy("doc_id").agg(F.count("*").alias("n"))) == rows(mixed)


def test_every_row_has_a_shard(steps):
    assert steps[5].count() == steps[4].count() and not steps[5].where("shard is null").count()


def test_empty_table(spark, steps):
    docs = steps[0].limit(0)
    for _, f in P.STAGES:
        docs = f(spark, docs, SF)
    assert docs.count() == 0


def test_columns_of_the_operators_names_pass_unchanged(spark):
    names = ["hits", "copies", "score", "lang_pred", "size", "source_size", "target", "component_id", "n_shingles",
             "_row", "_src", "a.b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    own = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, f in P.STAGES[:-1]:
        out, plain = f(spark, own, SF), f(spark, docs, SF)
        assert out.columns == own.columns, name
        got = out.collect()
        assert got and all(r[n] == f"{n} {r.doc_id}" for r in got for n in names), name
        assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in plain.collect()), name


def test_rows_with_equal_or_no_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(3, a), (7, a), (7, b), (None, c), (None, c + " more"), (None, d), (None, d), (9, d), (5, "x y"), (5, "x y"),
            (6, ""), (6, ""), (8, ""), (6, None), (None, " "), (None, " "), (2, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in P.near_duplicates(spark, docs, SF).collect()]
    assert got.count((None, c)) + got.count((None, c + " more")) == 1
    want = [(3, a), (7, b), (9, d), (5, "x y"), (6, ""), (8, ""), (6, None), (None, " "), (2, " ")]
    assert sorted(map(str, (r for r in got if not (r[1] or "").startswith("c")))) == sorted(map(str, want))


def test_without_labels_no_text_with_a_letter_goes(spark):
    rows = [(1, "some words", None), (2, "é", None), (3, "12 !", None), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in P.language(spark, docs, SF).collect()} == {1, 2}


def test_language_rejects_what_no_language_codes(spark):
    import random
    r = random.Random(2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = ["".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(300)), "".join(chr(r.randint(33, 126)) for _ in range(500)),
            "qx", "0123456789" * 50]
    fields = [f.name for f in docs.schema.fields]
    rows = [tuple({"doc_id": 10 ** 7 + i, "text": t}.get(n) for n in fields) for i, t in enumerate(junk)]
    kept = P.language(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF)
    ids = {x.doc_id for x in kept.select("doc_id").collect()}
    assert {i - 10 ** 7 for i in ids if i >= 10 ** 7} == {2}           # too short to tell
    clean = {x.doc_id for x in docs.where("text rlike '\\\\p{L}'").select("doc_id").collect()}
    assert clean <= ids
