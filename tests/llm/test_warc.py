import base64
import gzip
import hashlib

import pyarrow.fs as fs
import pytest

from claimscope.llm import warc
from claimscope.llm.staging import stage_path

PAGE = "page_id long, url string, html string, type string"
ROWS = [(3, "http://a/x", "same", "t"), (1, "http://b/\r\nX: y", "same", "t"), (2, None, "same", "t"), (4, "u", "", None),
        (5, "u", None, None), (6, "é漢", "WARC/1.1\r\n\r\nbody\r\n\r\n", None), (7, "u", "long " * 50_000, None),
        (None, "n", "same", None), (None, "n", "alone", None), (8, "a b", "é😀", None), (9, "w", "x", None), (9, "w", "x", None)]


def expected(rows, least):
    data = lambda h: (h or "").encode()
    first = {}
    for i, _, h, _ in rows:
        if i is not None and len(data(h)) >= least:
            first[data(h)] = min(i, first.get(data(h), i))
    out = []
    for i, _, h, _ in rows:
        f = first.get(data(h))
        kind = "response" if f is None or f == i else "revisit"
        out.append((str(i), len(data(h)), base64.b32encode(hashlib.sha1(data(h)).digest()).decode(), kind,
                    f if kind == "revisit" else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,archive_bytes", [(0, 1 << 20), (3, 2000), (10 ** 9, 1 << 20)])
def test_round_trip(spark, least, archive_bytes):
    df = spark.createDataFrame(ROWS + [(i, "u", f"page {i % 90}", None) for i in range(100, 300)], PAGE).repartition(3)
    path = stage_path(spark, "warc-test")
    warc.write_archives(df, path, archive_bytes, least_bytes=least)
    index = warc.read_index(spark, path)
    got = warc.read_records(index).collect()
    rows = [tuple(r) for r in df.collect()]
    assert sorted(((str(r.page_id), r.payload_bytes, r.digest, r.type, r.refers_to) for r in got), key=str) == expected(rows, least)
    # the index alone finds each record, and the records fill the archives
    total = 0
    for file in {r.file for r in index.collect()}:
        store, name = fs.FileSystem.from_uri(file)
        data = store.open_input_file(name).read()
        own = sorted(index.where(index.file == file).collect(), key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == len(data)
        for r in own:
            assert warc.parse_record(data[r.offset:r.offset + r.length])[0] == r.page_id
        total += len(own)
    assert total == len(rows)


@pytest.mark.parametrize("bits", [None, 64])
def test_only_likely_copies_are_shuffled(spark, monkeypatch, bits):
    """Beyond the digests that are broadcast, and with a bit table that is nearly full."""
    if bits:
        monkeypatch.setattr(warc, "MOST_BITS", bits)
    rows = ROWS + [(i, "u", f"page {i if i < 1000 else i % 90}", None) for i in range(100, 1300)]
    df = spark.createDataFrame(rows, PAGE).repartition(3)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = warc.typed(df, least_bytes=3, broadcast_copies=0)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, warc.typed(df, least_bytes=3).collect()), key=str)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [sha1" in plan and "Union" in plan
        copies = df.selectExpr("sha1(cast(html as binary)) as sha1").groupBy("sha1").count().where("count > 1")
        marked = warc.likely_copies(df.selectExpr("page_id", "sha1(cast(html as binary)) as sha1"), copies, bits or 1 << 16)
        repeated = {r.sha1 for r in copies.collect()}
        found = marked.collect()
        assert len(found) == len(rows) and all(r.likely for r in found if r.sha1 in repeated)
        assert bits or sum(r.likely for r in found) <= sum(r.sha1 in repeated for r in found) + 20
    finally:
        spark.conf.set(key, before)


def test_selected_records_read_in_few_ranges(spark):
    df = spark.createDataFrame([(i, "u", f"{i} " * 200, None) for i in range(300)], PAGE).coalesce(1)
    path = stage_path(spark, "warc-test")
    warc.write_archives(df, path)
    some = warc.read_index(spark, path).where("page_id % 7 = 0")
    ranges = warc.coalesced(some, gap=1 << 20).collect()
    assert len(ranges) == 1 and len(ranges[0].parts) == 43
    assert len(warc.coalesced(some, gap=0).collect()) == 43
    got = warc.read_records(some).collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in got} == {(i, f"{i} " * 200) for i in range(0, 300, 7)}


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_damaged_record():
    with pytest.raises(ValueError):
        warc.parse_record(gzip.compress(b"HTTP/1.1\r\n\r\nx\r\n\r\n"))
