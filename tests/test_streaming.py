"""Incremental ingest: two CSV drops give the same table as one batch build."""

import tempfile

from pyspark.sql import functions as F

from claimscope.schema import SOURCE_COLUMNS
from claimscope.sources import fixture
from claimscope.sources.tables import dedupe_lookup, write_table
from claimscope.operators import cubes, dictionary, stats
from claimscope.streaming import (compact_cubes, finished_batches, read_stream_cube, read_stream_fact, read_stream_index,
                                  start_ingest, write_batch)
from conftest import SF_SMALL


def test_two_drops_then_restart(spark):
    base = tempfile.mkdtemp(prefix="claimscope-test-stream-", dir="/tmp")
    landing, out, ckpt = f"{base}/landing", f"{base}/fact", f"{base}/ckpt"
    once = fixture.npi_lookup(spark, SF_SMALL)
    write_table(once.unionByName(once), f"{base}/lookup")          # the registry lists each provider twice
    raw = fixture.spending_raw(spark, SF_SMALL)
    as_csv = raw.select(*[F.col(dst).cast("string").alias(src) for src, dst in SOURCE_COLUMNS])
    early, late = as_csv.where("CLAIM_FROM_MONTH < '1998-01'"), as_csv.where(
        "CLAIM_FROM_MONTH >= '1998-01' or CLAIM_FROM_MONTH is null")
    early.coalesce(2).write.option("header", True).csv(f"{landing}/drop1")

    q = start_ingest(spark, f"{landing}/*", f"{base}/lookup", out, ckpt)
    q.awaitTermination(300)
    first = read_stream_fact(spark, out).count()
    assert first == early.count() > 0
    same_cubes(spark, out)
    indexes = {key: dict(read_stream_index(spark, out, key).collect()) for key in ("hcpcs", "month", "billing_state")}

    late.coalesce(2).write.option("header", True).csv(f"{landing}/drop2")
    q = start_ingest(spark, f"{landing}/*", f"{base}/lookup", out, ckpt)  # resumes
    q.awaitTermination(300)
    got = read_stream_fact(spark, out).drop("hcpcs_norm")
    want = fixture.spending(spark, SF_SMALL)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(got.columns)).count() == 0
    same_cubes(spark, out)
    for key, first in indexes.items():
        # no index changed, new keys follow, the sorted view is that of the whole table
        index = read_stream_index(spark, out, key)
        grown = dict(index.collect())
        assert first.items() <= grown.items() and sorted(grown.values()) == list(range(len(grown)))
        assert first and sorted(set(grown) - set(first)) == sorted(set(grown) - set(first), key=grown.get)
        view = dictionary.sorted_view(index, key).select(key, F.col("position").alias("idx"))
        assert sorted(map(tuple, view.collect())) == sorted(map(tuple, stats.distinct_values(got, key).select(key, "idx").collect()))
    assert compact_cubes(spark, out) == finished_batches(spark, out)[-1]
    same_cubes(spark, out)


def same_cubes(spark, out):
    """The maintained cubes equal those of the whole fact, which they do not read."""
    fact = read_stream_fact(spark, out)
    for name in cubes.ROLLED:
        got, want = read_stream_cube(spark, out, name), getattr(cubes, name)(fact)
        got = got.select(want.columns)
        assert got.dtypes == want.dtypes
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        assert not any(f"{out}/fact/" in f for f in got.inputFiles())


def test_retried_and_unfinished_batches(spark, monkeypatch):
    import pytest
    from claimscope.streaming import ingest
    out = tempfile.mkdtemp(prefix="claimscope-test-batches-", dir="/tmp") + "/out"
    raw, lookup = fixture.spending_raw(spark, SF_SMALL).cache(), fixture.npi_lookup(spark, SF_SMALL)
    assert read_stream_fact(spark, out).count() == 0 == read_stream_cube(spark, out, "cube_month_code").count()
    write_batch(raw.limit(0), 0, lookup, out)
    write_batch(raw.where("month < '1996'"), 1, lookup, out)
    write_batch(raw.where("month < '1996'"), 1, lookup, out)        # a retry
    before = read_stream_fact(spark, out).count()
    assert before == raw.where("month < '1996'").count()
    compact_cubes(spark, out)
    monkeypatch.setattr(ingest, "mark", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        write_batch(raw.where("month >= '1996'"), 2, lookup, out)
    monkeypatch.undo()
    assert read_stream_fact(spark, out).count() == before           # written, but not finished
    same_cubes(spark, out)
    write_batch(raw.where("month >= '1996'"), 2, lookup, out)
    assert read_stream_fact(spark, out).count() == raw.count()
    same_cubes(spark, out)


def test_checkpoint_is_required(spark):
    import pytest
    with pytest.raises(ValueError):
        start_ingest(spark, "/tmp/none", "/tmp/none", "/tmp/none", "")
