"""Sharding by extendible hashing.

Rows are hashed to bit strings. A bucket is a prefix of bits; one that holds
more bytes than a shard may is split on its next bit, others stay as they are.
The directory has one entry per occupied prefix of the global depth and names
the bucket (its local depth) that the prefix belongs to.

Bytes are summed per prefix before the shuffle; the directory is found on these
sums alone, and each row meets it in one equi-join. Prefixes that are still too
heavy at the global depth go through another round on their own next bits. The
first 60 bits come from the key, later ones from a number given to each row
once, so rows of one key, however many, spread over shards as well. Everything
is DataFrame expressions.

Defined cases: null text has 0 bytes; null keys hash as the empty string;
repeated rows are separate rows; a single row above the limit has a shard of
its own (``oversize``); an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.staging import staged

#: Most bytes of text in a shard.
SHARD_BYTES = 64 << 20
#: Bits of the key hash and of the row number hash that can be used.
BITS = 60
#: Bits that one round may use.
ROUND_BITS = 20


def _bits(hex_digest: Column) -> Column:
    """The first 60 bits of an md5 hex digest."""
    return F.conv(F.substring(hex_digest, 1, 15), 16, 10).cast("long")


def _chunk(start: int, width: int) -> Column:
    """Bits ``start`` .. ``start + width`` of the row's 120-bit string."""
    out = F.lit(0).cast("long")
    for i, name in ((0, "_h"), (1, "_r")):
        lo, hi = max(start, i * BITS), min(start + width, (i + 1) * BITS)
        if lo < hi:
            part = F.shiftright(F.col(name), (i + 1) * BITS - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
            out = F.shiftleft(out, hi - lo) + part
    return out


def directory(cells: DataFrame, width: int, limit: int) -> DataFrame:
    """Cells ``_base, _cell, _bytes, _rows`` of ``width`` bits → for each the
    local depth ``_depth`` of its bucket, its bytes and whether it still has
    to be split.

    The tree of all prefixes is one aggregate over the cells. A prefix is a
    bucket if it fits, or cannot be split, while no shorter one does.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(width)))
    tree = (cells.select("_base", "_cell", "_bytes", "_rows", level.alias("_level"))
                 .select("_base", "_cell", "_bytes", "_rows", "_level", F.expr(
                     f"shiftright(_cell, {width} - _level)").alias("_node")))
    sums = tree.groupBy("_base", "_level", "_node").agg(F.sum("_bytes").alias("_sum"),
                                                        F.sum("_rows").alias("_count"))
    fits = sums.where((F.col("_sum") <= limit) | (F.col("_count") == 1) | (F.col("_level") == width))
    # the shortest prefix of each cell that fits
    best = (tree.select("_base", "_cell", "_level", "_node")
                .join(fits, ["_base", "_level", "_node"])
                .groupBy("_base", "_cell")
                .agg(F.min(F.struct("_level", "_sum", "_count")).alias("_b")))
    return best.select("_base", "_cell", F.col("_b._level").alias("_depth"), F.col("_b._sum").alias("_sum"),
                       ((F.col("_b._sum") > limit) & (F.col("_b._count") > 1)).alias("_over"))


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text",
           limit: int = SHARD_BYTES, carry: tuple = ()) -> DataFrame:
    """``docs`` columns ``key`` → ``key, n_bytes, shard, depth, shard_bytes,
    oversize``: the shard is the bit string of the row's bucket. The columns in
    ``carry`` come along.

    Fixed rounds of the driver: each looks only at the sums of prefixes, and a
    further one runs only while some prefix is above the limit.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(key).alias("_key"),
                       F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("_n"),
                       _bits(digest).alias("_h"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    rows = staged(rows.withColumn("_r", _bits(F.md5(
        F.monotonically_increasing_id().cast("string").cast("binary")))), "shard-rows")
    total = rows.agg(F.sum("_n")).first()[0] or 0
    start, out = 0, []
    left = rows.withColumn("_base", F.lit(""))
    width = min(ROUND_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + 3))
    while start < 2 * BITS:
        width = min(width, 2 * BITS - start)
        left = left.withColumn("_cell", _chunk(start, width))
        cells = left.groupBy("_base", "_cell").agg(F.sum("_n").alias("_bytes"),
                                                   F.count(F.lit(1)).alias("_rows"))
        found = staged(directory(cells, width, limit), "shard-directory")
        named = left.join(found, ["_base", "_cell"])
        bits = F.substring(F.lpad(F.bin(F.col("_cell")), width, "0"), F.lit(1), F.col("_depth"))
        named = named.withColumn("_shard", F.concat(F.col("_base"), bits))
        last = start + width >= 2 * BITS
        done = named if last else named.where(~F.col("_over"))
        out.append(done.select(
            F.col("_key").alias(key), F.col("_n").alias("n_bytes"), F.col("_shard").alias("shard"),
            F.length("_shard").alias("depth"), F.col("_sum").alias("shard_bytes"),
            (F.col("_sum") > limit).alias("oversize"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)]))
        if last or not found.where("_over").limit(1).count():
            break
        left = named.where("_over").select(*rows.columns, F.col("_shard").alias("_base"))
        start += width
        width = 8
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> None:
    """Write ``docs`` with one folder ``shard=...`` per shard, every row once, whatever
    their keys. Rows are numbered first, and meet their shard by that number; an own
    column called ``shard`` is left out."""
    kept = docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != "shard"])
    rows = staged(kept.withColumn("_number", F.monotonically_increasing_id()), "shard-docs")
    assigned = shards(rows, key, text, limit, carry=("_number",)).select("_number", "shard")
    (rows.join(assigned, "_number").drop("_number")
         .repartition("shard").write.partitionBy("shard").parquet(path))
