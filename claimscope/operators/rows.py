"""Raw-row listings: ordered pages, the page after a row, and the largest rows."""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.functions.expressions import money
from claimscope.functions.filters import NO_FILTER, ROWS_SCOPE, Filter
from claimscope.operators import order
from claimscope.operators.order import Key
from claimscope.schema import ROW_COLUMNS, SPENDING

DEFAULT_SORT = "paid"
#: Walkers that list pages at the same time.
WALKERS = 8
STORED = type(SPENDING)([SPENDING[c] for c in ROW_COLUMNS])


def sort_keys(sort: str = DEFAULT_SORT, direction: str | None = "desc") -> list[Key]:
    """A total order: the sort column (one that is unknown falls back to the amount),
    then all others ascending, so pages never overlap."""
    first = sort if sort in ROW_COLUMNS else DEFAULT_SORT
    return [Key(first, (direction or "").lower() == "asc"), *[Key(c) for c in ROW_COLUMNS if c != first]]


def _listed(fact: DataFrame, flt: Filter) -> DataFrame:
    return flt.scoped(*ROWS_SCOPE).apply(fact).select(*ROW_COLUMNS)


def _out(rows: DataFrame) -> DataFrame:
    return rows.withColumn("paid", money("paid"))


def _count(name: str, value) -> int:
    n = int(value)
    if n < 0:
        raise ValueError(f"{name} must not be negative")
    return n


def rows_page(fact: DataFrame, flt: Filter = NO_FILTER, sort: str = DEFAULT_SORT,
              direction: str = "desc", limit=50, offset=0, counts: DataFrame | None = None) -> DataFrame:
    """One page of filtered rows in a total order; nulls come last.

    ``limit`` and ``offset`` are taken as they are. Eager in part: where the page
    begins and ends is counted first (:mod:`claimscope.operators.order`), so that
    only about ``limit`` rows are sorted, at any offset. ``counts`` are the stored
    counts of the sort column, for an unfiltered page."""
    limit, offset = _count("limit", limit), _count("offset", offset)
    if not flt.scoped(*ROWS_SCOPE).is_empty():
        counts = None
    return _out(order.page(_listed(fact, flt), sort_keys(sort, direction), offset, limit, counts))


def rows_after(fact: DataFrame, last: dict, seen: int = 1, flt: Filter = NO_FILTER, sort: str = DEFAULT_SORT,
               direction: str = "desc", limit=50) -> DataFrame:
    """The page that follows the row ``last`` (its eight columns, as a page returned
    them), however deep. Equal rows have no order among them: ``seen`` is how many
    rows equal to ``last`` have been listed so far."""
    listed = _listed(fact, flt)
    return _out(order.after(listed, sort_keys(sort, direction), order.typed(last, listed.schema),
                            _count("seen", seen), _count("limit", limit)))


def next_place(page: DataFrame, sort: str = DEFAULT_SORT, direction: str = "desc", last: dict | None = None,
               seen: int = 0) -> tuple[dict, int] | None:
    """``last`` and ``seen`` for the page after ``page`` (one that is stored or
    cached); ``last`` and ``seen`` are those ``page`` was asked with. None if it
    has no rows."""
    rows = page.groupBy(*page.columns).agg(F.count(F.lit(1)).alias("_n"))
    end = rows.orderBy(*[k.reverse() for k in sort_keys(sort, direction)]).first()
    if end is None:
        return None
    end = end.asDict()
    equal = end.pop("_n")
    return end, equal + (seen if last == end else 0)


def write_ordered_rows(fact: DataFrame, path: str, sort: str = DEFAULT_SORT, direction: str = "desc",
                       rows_per_range: int = 1_000_000) -> None:
    """Store all rows in the order of the pages of ``sort``."""
    order.write_ordered(fact.select(*ROW_COLUMNS), sort_keys(sort, direction), path, rows_per_range)


def ordered_rows_page(spark: SparkSession, path: str, sort: str = DEFAULT_SORT, direction: str = "desc",
                      limit=50, offset=0, ranges: list | None = None) -> DataFrame:
    """An unfiltered page from the table written by :func:`write_ordered_rows` with
    the same order: the one or two ranges it lies in are read. ``ranges`` are those of
    the table (:func:`claimscope.operators.order.ordered_ranges`), if they are known."""
    return _out(order.ordered_page(spark, path, STORED, sort_keys(sort, direction), _count("offset", offset),
                                   _count("limit", limit), ranges))


def ordered_rows_after(spark: SparkSession, path: str, last: dict, seen: int, listed: int, sort: str = DEFAULT_SORT,
                       direction: str = "desc", limit=50, ranges: list | None = None) -> DataFrame:
    """:func:`rows_after` from the table written by :func:`write_ordered_rows` with the
    same order; ``listed`` is how many rows precede the page. The ranges it lies in are
    read, and no row before the first one equal to ``last`` is sorted."""
    return _out(order.ordered_after(spark, path, STORED, sort_keys(sort, direction), order.typed(last, STORED),
                                    _count("seen", seen), _count("listed", listed), _count("limit", limit), ranges))


def walk(spark: SparkSession, path: str, out: str, sort: str = DEFAULT_SORT, direction: str = "desc", limit: int = 50,
         walkers: int = WALKERS) -> int:
    """All pages of the table written by :func:`write_ordered_rows`, each from where the
    last one ended, to ``out/page=n``; returns how many. The pages are dealt to
    ``walkers`` in runs that follow each other: a walker looks up the row before its
    first page and goes on from there, so the walkers need not wait for each other.
    The pages after its first one are listed by tasks, each on its own ranges, from where
    that one ended: the number of jobs grows with the walkers, not with the pages."""
    ranges, keys = order.ordered_ranges(spark, path), sort_keys(sort, direction)
    pages = max(1, -(-sum(r.n for r in ranges) // _count("limit", limit)))

    def run(first: int, end: int) -> DataFrame | None:
        last, seen = None, 0
        if first:
            last, seen = order.ordered_place(spark, path, STORED, keys, first * limit - 1, ranges)
            last["paid"] = None if last["paid"] is None else float(last["paid"])  # as pages have it
        page = (ordered_rows_after(spark, path, last, seen, first * limit, sort, direction, limit, ranges) if first
                else ordered_rows_page(spark, path, sort, direction, limit, 0, ranges))
        page.write.parquet(f"{out}/page={first}")
        if first + 1 == end:
            return None
        stored = spark.read.schema(page.schema).parquet(f"{out}/page={first}")
        last, _ = next_place(stored, sort, direction, last, seen)
        return order.ordered_pages(spark, path, STORED, keys, order.typed(last, STORED), (first + 1) * limit,
                                   end * limit, limit, ranges)

    each = -(-pages // walkers)
    starts = range(0, pages, each)
    with ThreadPoolExecutor(walkers) as pool:
        runs = [pool.submit(run, first, min(first + each, pages)) for first in starts]
        rest = [df for df in (done.result() for done in runs) if df is not None]
    if rest:
        listed = functools.reduce(DataFrame.unionByName, rest).sortWithinPartitions("page", "place").drop("place")
        _out(listed).write.mode("append").partitionBy("page").parquet(out)
    return pages


def top_rows(fact: DataFrame, k: int = 2000, counts: DataFrame | None = None) -> DataFrame:
    """The ``k`` largest rows by paid."""
    return rows_page(fact, limit=k, counts=counts)
