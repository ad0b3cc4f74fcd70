"""Line dedup with levelled sorted runs of line hashes.

:class:`LineRuns` is a log-structured store in the shared folder. A run is a
table of ``k`` (128-bit line hash) and ``n`` (documents that have the line,
counted up to a threshold), hash-bucketed and sorted by ``k``; all runs have the
same buckets, so they merge without a shuffle. Each new batch of documents is
merge-anti-joined with the runs - keys that already reached the threshold need
no further counting - and its own counts become a run of level 0. When a level
has ``fanout`` runs they are compacted into one run of the next level.

A line's key is the line without the bytes 09-0D and 20 at both ends and with
A-Z lower-cased. The lines of keys found in at least ``least_docs`` documents
are dropped from every document; keys of no code points are never dropped.

Hot lines are counted per task before they are shuffled. To drop lines, only
(document, line number, key) go through the joins; an over-full key is split by
the adaptive skew join. Texts are shuffled once, to meet their line flags.

Defined cases: null and empty texts are one empty line; each row is a document
of its own (repeated rows count as often as they occur); an empty table gives
an empty result.
"""

from __future__ import annotations

import uuid
from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm.staging import stage_path, staged, utf8_buffer

#: The bytes stripped from both ends of a line.
BLANKS = b" \t\n\x0b\f\r"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def line_hashes(text: bytes, least_chars: int = 1) -> list[bytes | None]:
    """The hash of each line's key; None for keys of fewer code points."""
    keys = [x.strip(BLANKS) for x in text.translate(_LOWER).split(b"\n")]
    return [md5(x).digest() if x and (least_chars <= 1 or len(x.decode()) >= least_chars) else None for x in keys]


def _document_keys(least_chars: int):
    """mapInArrow function: ``batch, text`` → ``batch, k``, a row per document and key."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw, off = utf8_buffer(b.column("text"))
            keys, n = [], []
            for i in range(b.num_rows):
                own = set(line_hashes(raw[off[i]:off[i + 1]].tobytes(), least_chars)) - {None}
                keys += own
                n.append(len(own))
            at = np.repeat(b.column("batch").to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys, pa.binary())], names=["batch", "k"])
    return run


def _numbered_keys(least_chars: int):
    """mapInArrow function: ``id, h, text`` → ``id, h, i, k``, a row per line with a key."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw, off = utf8_buffer(b.column("text"))
            rows, lines, keys = [], [], []
            for r in range(b.num_rows):
                for i, k in enumerate(line_hashes(raw[off[r]:off[r + 1]].tobytes(), least_chars)):
                    if k is not None:
                        rows.append(r)
                        lines.append(i)
                        keys.append(k)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(at), b.column("h").take(at), pa.array(lines, pa.int32()), pa.array(keys, pa.binary())],
                names=["id", "h", "i", "k"])
    return run


class LineRuns:
    """Counts of line keys, kept as levelled sorted runs.

    Tables are external and bucketed, under the shared folder; their catalogue
    names carry a random part, and :meth:`close` drops the names.
    """

    def __init__(self, spark: SparkSession, threshold: int, fanout: int = 2,
                 buckets: int | None = None):
        self.spark, self.threshold, self.fanout = spark, threshold, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root, self.name = stage_path(spark, "line-runs"), f"line_runs_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, counts: DataFrame) -> str:
        table = f"{self.name}_{self.made}"
        self.made += 1
        (counts.repartition(self.buckets, "k").write.format("parquet")
               .bucketBy(self.buckets, "k").sortBy("k")
               .option("path", f"{self.root}/{self.made}").saveAsTable(table))
        return table

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _capped(self, df: DataFrame) -> DataFrame:
        """Counts need no more than the threshold to decide."""
        total = F.sum("n")
        return df.groupBy("k").agg(F.least(total, F.lit(self.threshold).cast("long")).alias("n"))

    def add(self, keys: DataFrame) -> None:
        """A batch: ``keys`` has one row ``k, n`` per key and task or finer."""
        new = self._capped(keys)
        for run in self.runs():
            # a run holds a key at the threshold once it needs no more counting
            new = new.join(run.where(F.col("n") >= self.threshold), "k", "left_anti")
        self._put(0, self._write(new))

    def _put(self, level: int, table: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merge([self.spark.table(t) for t in self.levels[level]])
            self.levels[level] = []
            self._put(level + 1, self._write(merged))

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """The runs' counts added up: a full join of sorted runs on their common buckets."""
        out = runs[0]
        for run in runs[1:]:
            out = (out.join(run.withColumnRenamed("n", "m"), "k", "full_outer")
                      .select("k", F.least(F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)),
                                           F.lit(self.threshold)).cast("long").alias("n")))
        return out

    def counts(self) -> DataFrame:
        """All keys with their counts (the threshold stands for more)."""
        return self._merge(self.runs())

    def close(self) -> None:
        for i in range(self.made):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{i}")


def frequent_keys(docs: DataFrame, text: str = "text", least_docs: int = 10, batches: int = 4,
                  least_chars: int = 1) -> DataFrame:
    """The keys ``k`` found in at least ``least_docs`` documents, staged."""
    spark = docs.sparkSession
    # counted per batch of documents; the batch is a hash of the text
    batch = F.pmod(F.xxhash64(F.col(text)), F.lit(batches)).cast("int")
    per_doc = docs.select(batch.alias("batch"), F.col(text).alias("text")).mapInArrow(
        _document_keys(least_chars), "batch int, k binary")
    counted = staged(per_doc.groupBy("batch", "k").agg(F.count(F.lit(1)).alias("n")), "line-batches", "batch")
    runs = LineRuns(spark, least_docs)
    for b in range(batches):
        runs.add(counted.where(F.col("batch") == b).select("k", "n"))
    out = staged(runs.counts().where(F.col("n") >= least_docs).select("k"), "line-keys")
    runs.close()
    return out


def drop_lines(docs: DataFrame, keys: DataFrame, key: str = "doc_id", text: str = "text",
               least_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` without the lines of ``keys``, and ``n_lines``
    (before) and ``n_dropped``."""
    rest = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    col = lambda c: F.col("`" + c.replace("`", "``") + "`")
    own = [f"c{i}" for i in range(len(rest))]  # no own column clashes with the names used here
    d = docs.select(*[col(c).alias(n) for c, n in zip(rest, own)], col(key).alias("_key"),
                    F.coalesce(col(text), F.lit("")).alias("_text"))
    d = d.withColumn("_h", F.xxhash64("_text"))
    lines = d.select(F.col("_key").alias("id"), F.col("_h").alias("h"), F.col("_text").alias("text"))
    id_type = docs.schema[key].dataType.simpleString()
    lines = lines.mapInArrow(_numbered_keys(least_chars), f"id {id_type}, h long, i int, k binary")
    gone = lines.join(keys, "k", "left_semi")
    # sorted line numbers of a document's dropped lines; equal rows have equal ones
    dropped = gone.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h2")).agg(
        F.array_sort(F.collect_set("i")).alias("_drop"))
    joined = d.join(dropped, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_h2")), "left")
    return joined.select(*[F.col(n).alias(c) for c, n in zip(rest, own)], *kept_text(F.col("_text"), F.col("_drop"), text))


def kept_text(text: Column, drop: Column, name: str) -> list[Column]:
    """The text without the lines numbered in the sorted array ``drop``.

    Each gap between neighbours of ``drop`` becomes as many true flags and one
    false, so the flags fall in step with the lines; the work is linear."""
    lines = F.split(text, "\n", -1)
    n = F.size(lines)
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), drop), F.concat(drop, F.array(n)), lambda a, b: b - a - 1)
    keep = F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(True), g), F.array(F.lit(False)))))
    left = F.filter(F.arrays_zip(lines.alias("line"), keep.alias("keep")), lambda z: z["keep"])
    kept = F.when(drop.isNull(), text).otherwise(F.array_join(F.transform(left, lambda z: z["line"]), "\n"))
    return [kept.alias(name), n.cast("long").alias("n_lines"),
            F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped")]


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int = 10,
                least_chars: int = 1, batches: int = 4) -> DataFrame:
    keys = frequent_keys(docs, text, least_docs, batches, least_chars)
    return drop_lines(docs, keys, key, text, least_chars)
