"""Rows by their position in a total order, without sorting the table.

A page needs the rows between two positions of the order. Where these lie is
found by counting: the rows are counted per value range of the first sort column
(one column is read, a few thousand ranges come back), the range that holds the
position is cut finer while it has too many rows, and where it is a single value
the next sort column goes on. The two ends become a filter that is pushed into
the Parquet scan, so only about as many rows as the page has are sorted.

The counts of the first column can be stored with a build (:func:`counted`), and
a whole table can be stored in the order itself (:func:`write_ordered`): then a
page at any offset reads the one or two ranges it lies in, and a run of many pages is
listed in one pass over its ranges (:func:`ordered_pages`).
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges per doubling of an amount in the first count; ranges of a finer one;
#: characters that a finer range of texts adds.
PER_OCTAVE, FINER, CHARACTERS = 64, 4096, 2
#: A range is cut finer if it has more rows than this and than the page has.
ENOUGH = 4096


@dataclass(frozen=True)
class Key:
    """A sort column. Nulls come last either way."""
    column: str
    ascending: bool = True

    def order(self) -> Column:
        c = F.col(self.column)
        return c.asc_nulls_last() if self.ascending else c.desc_nulls_last()

    def reverse(self) -> Column:
        c = F.col(self.column)
        return c.desc_nulls_first() if self.ascending else c.asc_nulls_first()

    def same(self, value) -> Column:
        return F.col(self.column).isNull() if value is None else F.col(self.column) == value

    def earlier(self, value, equal: bool = False) -> Column:
        c = F.col(self.column)
        if value is None:
            return F.lit(True) if equal else c.isNotNull()
        if equal:
            return c <= value if self.ascending else c >= value
        return c < value if self.ascending else c > value

    def later(self, value, equal: bool = False) -> Column:
        c = F.col(self.column)
        if value is None:
            return c.isNull() if equal else F.lit(False)
        if equal:
            return (c >= value if self.ascending else c <= value) | c.isNull()
        return (c > value if self.ascending else c < value) | c.isNull()


@dataclass(frozen=True)
class Range:
    """Rows of one value range of ``key``: how many, and its first and last value
    in the order. A null range has null values."""
    n: int
    first: object
    last: object


@dataclass(frozen=True)
class Place:
    """Where a position lies: in the rows that have the values of ``above`` in the
    earlier sort columns and are in ``range`` of ``key``; ``before`` rows precede them."""
    above: tuple[tuple[Key, object], ...]
    key: Key
    range: Range
    before: int

    def from_here(self) -> Column:
        return beyond([*self.above, (self.key, self.range.first)], Key.later, True)

    def up_to_here(self) -> Column:
        return beyond([*self.above, (self.key, self.range.last)], Key.earlier, True)


def beyond(path: list[tuple[Key, object]], side, equal: bool) -> Column:
    """Rows on one side (``Key.later`` or ``Key.earlier``) of the values in ``path``,
    compared column by column; those equal in all of them if ``equal``."""
    terms, same = [], []
    for i, (key, value) in enumerate(path):
        terms.append(functools.reduce(operator.and_, [*same, side(key, value, equal and i == len(path) - 1)]))
        same.append(key.same(value))
    out = functools.reduce(operator.or_, terms)
    # the first column by itself as well, which a scan can use
    return out if len(path) == 1 else side(*path[0], True) & out


def _numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def coarse(df: DataFrame, column: str) -> Column:
    """A range number that never falls while the value rises."""
    if not _numeric(df, column):
        return F.substring(column, 1, CHARACTERS)
    x = F.col(column).cast("double")
    return F.signum(x) * F.floor(F.log2(F.abs(x) * 100 + 1) * PER_OCTAVE)


def _finer(df: DataFrame, column: str, found: Range) -> Column:
    if not _numeric(df, column):
        both = [found.first, found.last]
        shared = next((i for i, (a, b) in enumerate(zip(*both)) if a != b), min(map(len, both)))
        return F.substring(column, 1, shared + CHARACTERS)
    low, high = sorted((float(found.first), float(found.last)))
    if low == high:
        return F.col(column)
    return F.floor((F.col(column).cast("double") - low) / (high - low) * FINER)


def _ranges(df: DataFrame, key: Key, number: Column) -> DataFrame:
    c = F.col(key.column)
    ends = (F.min(c), F.max(c)) if key.ascending else (F.max(c), F.min(c))
    return (df.groupBy(number.alias("_range"))
              .agg(F.count(F.lit(1)).alias("n"), ends[0].alias("first"), ends[1].alias("last")).drop("_range"))


def counted(df: DataFrame, key: Key) -> DataFrame:
    """The rows of ``df`` counted per value range of ``key``: ``n, first, last``. A few
    thousand rows; one column is read, and each task counts before the shuffle."""
    return _ranges(df, key, coarse(df, key.column))


def _in_order(counts: DataFrame, key: Key) -> list[Range]:
    found = [Range(r.n, r["first"], r["last"]) for r in counts.collect()]
    known = sorted((r for r in found if r.first is not None), key=lambda r: r.first, reverse=not key.ascending)
    return known + [r for r in found if r.first is None]


def _holding(ranges: list[Range], position: int, before: int) -> tuple[Range, int] | None:
    for r in ranges:
        if position < before + r.n:
            return r, before
        before += r.n
    return None


def locate(df: DataFrame, keys: list[Key], position: int, enough: int = ENOUGH,
           ranges: list[Range] | None = None) -> Place | None:
    """Where the row at ``position`` (from 0) of the order lies: a range of at most
    ``enough`` rows, or of rows equal in all keys. None beyond the last row.
    ``ranges`` are the counts of the first key, if they are known."""
    above: list[tuple[Key, object]] = []
    before, scope = 0, df
    for key in keys:
        if ranges is None:
            ranges = _in_order(counted(scope, key), key)
        while True:
            held = _holding(ranges, position, before)
            if held is None:
                return None
            found, before = held
            place = Place(tuple(above), key, found, before)
            if found.n <= enough:
                return place
            if found.first == found.last:
                break
            scope = df.where(place.from_here() & place.up_to_here())
            ranges = _in_order(_ranges(scope, key, _finer(df, key.column, found)), key)
        above.append((key, found.first))
        scope = df.where(functools.reduce(operator.and_, [k.same(v) for k, v in above]))
        ranges = None
    return place


def page(df: DataFrame, keys: list[Key], offset: int, limit: int, counts: DataFrame | None = None,
         enough: int = ENOUGH) -> DataFrame:
    """The rows at ``offset`` to ``offset + limit`` of the order. Eager in part: the two
    ends are located first. ``counts`` are stored counts of all rows of ``df`` by the
    first key (:func:`counted`)."""
    order = [k.order() for k in keys]
    if not limit:
        return df.limit(0)
    ranges = _in_order(counted(df, keys[0]) if counts is None else counts, keys[0])
    enough = max(enough, limit)
    if offset >= sum(r.n for r in ranges):
        return df.limit(0)
    first = locate(df, keys, offset, enough, ranges) if offset else None
    last = locate(df, keys, offset + limit - 1, enough, ranges)
    skip = offset - first.before if first else 0
    if first and first.before:
        df = df.where(first.from_here())
    if last:
        df = df.where(last.up_to_here())
    rows = df.orderBy(*order).limit(skip + limit)
    return rows.offset(skip) if skip else rows


def after(df: DataFrame, keys: list[Key], last: dict, seen: int, limit: int, enough: int = ENOUGH) -> DataFrame:
    """The ``limit`` rows that follow ``seen`` rows equal to ``last`` in all keys."""
    path = [(k, last[k.column]) for k in keys]
    return page(df.where(beyond(path, Key.later, True)), keys, seen, limit, enough=enough)


# ---------------------------------------------------------------- tables in order

def write_ordered(df: DataFrame, keys: list[Key], path: str, rows_per_range: int = 1_000_000) -> None:
    """Store ``df`` in the order of ``keys``: ``path/rows`` in folders ``range=i`` of
    about ``rows_per_range`` rows, each with the rows before it in its range (``at``);
    ``path/ranges`` with ``range, n, before``. The second is written last."""
    n = max(1, -(-df.count() // rows_per_range))
    order = [k.order() for k in keys]
    placed = df.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id())
    # a partition is a range; the lower bits of this id count the rows of a partition
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    (placed.sortWithinPartitions("range", *order).withColumn("at", at).write.mode("overwrite").option("compression", "zstd")
           .partitionBy("range").parquet(f"{path}/rows"))
    rows = df.sparkSession.read.schema("range int").parquet(f"{path}/rows").groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    (rows.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
         .write.mode("overwrite").parquet(f"{path}/ranges"))


def ordered_ranges(spark: SparkSession, path: str) -> list:
    """The ranges of a table stored by :func:`write_ordered`, in order: a row per
    range, for callers that read many pages."""
    return spark.read.parquet(f"{path}/ranges").orderBy("range").collect()


def _ranges_at(spark: SparkSession, path: str, schema: T.StructType, first: int, end: int,
               ranges: list | None) -> tuple[DataFrame, int]:
    """The rows of the ranges that hold the positions from ``first`` to before ``end``,
    and the position of the first of these rows. Only their folders are listed."""
    inside = [r for r in (ordered_ranges(spark, path) if ranges is None else ranges)
              if r.before < end and r.before + r.n > first]
    if not inside:
        return spark.createDataFrame([], schema), first
    stored = T.StructType([*schema.fields, T.StructField("range", T.IntegerType())])
    rows = spark.read.schema(stored).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/range={r['range']}" for r in inside])
    return rows.where(F.col("range").isin([r["range"] for r in inside])).drop("range"), inside[0].before


def ordered_page(spark: SparkSession, path: str, schema: T.StructType, keys: list[Key], offset: int, limit: int,
                 ranges: list | None = None) -> DataFrame:
    """A page of a table stored by :func:`write_ordered`: only the ranges it lies in
    are read, those of ``limit`` rows. ``ranges`` are its :func:`ordered_ranges`, if they
    are known."""
    rows, before = _ranges_at(spark, path, schema, offset, offset + limit, ranges)
    skip = offset - before
    return rows.orderBy(*[k.order() for k in keys]).limit(skip + limit).offset(skip)


def ordered_after(spark: SparkSession, path: str, schema: T.StructType, keys: list[Key], last: dict, seen: int,
                  listed: int, limit: int, ranges: list | None = None) -> DataFrame:
    """:func:`after` on a table stored by :func:`write_ordered`, of which ``listed`` rows
    precede the page, ``seen`` of them equal to ``last``: only the ranges from the first
    row equal to ``last`` to the end of the page are read. Equal rows share a range."""
    rows, _ = _ranges_at(spark, path, schema, listed - seen, listed + limit, ranges)
    later = beyond([(k, last[k.column]) for k in keys], Key.later, True)
    return rows.where(later).orderBy(*[k.order() for k in keys]).limit(seen + limit).offset(seen)


def ordered_place(spark: SparkSession, path: str, schema: T.StructType, keys: list[Key], position: int,
                  ranges: list | None = None) -> tuple[dict, int]:
    """The row at ``position`` (below the number of rows) of a table stored by
    :func:`write_ordered`, and how many rows up to it are equal to it."""
    row = ordered_page(spark, path, schema, keys, position, 1, ranges).first().asDict()
    rows, before = _ranges_at(spark, path, schema, position, position + 1, ranges)
    earlier = rows.where(beyond([(k, row[k.column]) for k in keys], Key.earlier, False)).count()
    return row, position + 1 - before - earlier


def ordered_pages(spark: SparkSession, path: str, schema: T.StructType, keys: list[Key], last: dict, listed: int,
                  end: int, limit: int, ranges: list) -> DataFrame:
    """The rows that follow ``last`` in a table stored by :func:`write_ordered`, of which
    ``listed`` rows precede them, to the one before position ``end``: with the page of
    ``limit`` rows that each is on (``page``) and its position (``place``). A page begins
    with the row after the last one's end; the rows before a range say on which page its
    first rows go on, so each task reads its own ranges, and a row per range is sent to it."""
    inside = [r["range"] for r in ranges if r.before < end and r.before + r.n > listed]
    stored = T.StructType([*schema.fields, T.StructField("at", T.LongType()), T.StructField("range", T.IntegerType())])
    rows = spark.read.schema(stored).parquet(f"{path}/rows").where(F.col("range").between(inside[0], inside[-1]))
    later = beyond([(k, last[k.column]) for k in keys], Key.later, True)
    at = F.coalesce("at", F.raise_error(F.lit("stored without places, write the table again")).cast("long"))
    before = spark.read.parquet(f"{path}/ranges").select("range", "before")
    placed = rows.where(later).join(F.broadcast(before), "range").withColumn("place", F.col("before") + at)
    # of the rows equal to the last one those that were listed are left out
    placed = placed.where((F.col("place") >= listed) & (F.col("place") < end))
    return placed.select(*schema.fieldNames(), F.expr(f"place div {limit}").alias("page"), "place")


def typed(values: dict, schema: T.StructType) -> dict:
    """Row values as a caller holds them (amounts as doubles) in the types of the table."""
    out = {}
    for f in schema.fields:
        v = values.get(f.name)
        if v is not None and isinstance(f.dataType, T.DecimalType):
            v = Decimal(str(v)).quantize(Decimal(1).scaleb(-f.dataType.scale))
        out[f.name] = v
    return out
