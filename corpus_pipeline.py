"""A training-data pipeline of five stages over ``documents``.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.

1. language: documents that language identification rejects go: those without a
   language (null text, no letter), and those whose code length is far above what the
   training texts need (``language_id.readable``). A document between two languages
   stays, and a short one; so does any text with a letter if no row is labelled.
2. near_duplicates: of each group of near-duplicates the document with the smallest
   id stays, null ids last. Documents without words are no near-duplicates of anything.
3. decontaminate: documents that hold a passage of a benchmark item go.
4. mix: documents are repeated or left out so that sources reach their weights.
5. shard: every remaining row gets its shard.

Repeated rows: rows with equal ids, or without one, are documents of their own and
told apart by their text; of rows equal in both, all are treated alike by stages 1
and 3, and one stays in stage 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm import decontamination, language_id, mixing, ngram_join, sharding
from claimscope.llm.staging import staged
from claimscope.llm.warc import likely_copies

#: Bits of the table that marks the rows a stage drops: so many a row, at most.
BITS_EACH, MOST_BITS = 16, 1 << 27


def _apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list]:
    """``docs`` with the columns that a stage does not use under internal names, so
    that no column of an operator clashes with them; and the columns back."""
    inner = [c if c in used else f"_own{i}" for i, c in enumerate(docs.columns)]
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    return (docs.select(*[F.col(x).alias(n) for x, n in zip(quoted, inner)]),
            [F.col(n).alias(c) for n, c in zip(inner, docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, back = _apart(docs, "doc_id", "text", "lang")
    model = language_id.train(docs, F.lit(True))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*back)
    named = language_id.predict(docs, model)
    known = (F.col("lang_pred") != language_id.UNKNOWN) & language_id.readable(model)
    return named.where(known).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # ids may repeat or be null, so each row is a vertex of its own
    docs, back = _apart(docs, "doc_id", "text")
    docs = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    groups = ngram_join.near_duplicates(docs.select("_row", "text"), key="_row")
    ids = docs.select("_row", "doc_id", F.xxhash64("text").alias("_text"))
    # documents without words are near nothing, only rows equal in id and text count once
    words = F.col("n_shingles") > 0
    group = F.struct(F.when(words, F.col("component_id")).alias("a"), F.when(~words, F.col("doc_id")).alias("b"),
                     F.when(~words, F.col("_text")).alias("c"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_text", "_row"))
    members = staged(groups.join(ids, "_row").select(group.alias("_group"), "doc_id", "_text", "_row"), "pipeline-members")
    stays = members.groupBy("_group").agg(first.alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    goes = members.join(stays, "_group").where(F.col("_row") != F.col("_first._row")).select("_row")
    return _without(docs, staged(goes, "pipeline-goes")).select(*back)


def _without(docs: DataFrame, goes: DataFrame) -> DataFrame:
    """``docs`` but the rows of ``goes`` (``_row``). Only rows that a bit table marks, those
    and few others, are shuffled with their texts."""
    place = F.sha1(F.col("_row").cast("string"))
    bits = min(max(goes.count() * BITS_EACH, 1 << 15), MOST_BITS)
    marked = likely_copies(docs.withColumn("sha1", place), goes.withColumn("sha1", place), bits).drop("sha1")
    return marked.where(~F.col("likely")).unionByName(
        marked.where("likely").join(goes, "_row", "left_anti")).drop("likely")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs, back = _apart(docs, "text")
    return decontamination.decontaminated(docs, benchmark).select(*back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, back = _apart(docs, "doc_id", "source", "text")
    return mixing.emitted(mixing.mix(docs)).select(*back)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shards(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("mix", mix), ("shard", shard)]

#: SQL cannot express language identification; the tests hold each stage
#: against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
