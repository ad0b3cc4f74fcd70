"""WARC archives: index first, then coalesced byte-range reads.

Each task writes the pages of its partition to archives of its own (``.warc.gz``, a
gzip member per record, a new archive after ``archive_bytes``) and returns the index
rows of its records: archive, offset, length, URL, digest. The index is a table that
Spark commits; archives of failed or repeated attempts are named by no index row.
Reading selects records from the index, sorts the byte ranges of each archive,
coalesces neighbours and reads each coalesced range once.

Of records with the same payload the one with the smallest id is a response and
the others are revisits without payload. They are found by the smallest id per
digest, aggregated before the shuffle; only digests with several pages are kept. Up to
``BROADCAST_COPIES`` of these are joined by broadcast. Beyond, their hashes set bits in a
table of bounded size, which is broadcast instead: pages whose bit is not set are no
copies and stay where they are, only the others go through a shuffle.

Archives are written and read through ``pyarrow.fs``, in the shared folder.

Defined cases: null html is empty; a null id comes after all others and is
written as an empty id; null or odd URLs are percent-encoded in the header and
kept in the index; rows that repeat the smallest id of a payload are all
responses; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.staging import stage_path, staged

#: The ends of a record and of a header.
RECORD_END = b"\r\n\r\n"
HEADER_END = b"\r\n\r\n"
#: Bytes of an archive, of the largest coalesced read and of a gap read over.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 4 << 20
GAP_BYTES = 16 << 10
#: Fast compression; payloads are read once.
LEVEL = 1
#: Repeated digests that are broadcast themselves (some 80 bytes each); of more, 16 bits
#: each are, up to so many.
BROADCAST_COPIES = 200_000
BITS_EACH, MOST_BITS = 16, 1 << 30

INDEX = T.StructType([T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()),
                      T.StructField("length", T.LongType()), T.StructField("page_id", T.LongType()),
                      T.StructField("url", T.StringType()), T.StructField("digest", T.StringType()),
                      T.StructField("payload_bytes", T.LongType()), T.StructField("type", T.StringType())])


def _bit(bits: int):
    """The position of a digest (hex SHA-1) in a table of ``bits`` bits."""
    return F.pmod(F.conv(F.substring("sha1", 1, 15), 16, 10).cast("long"), F.lit(bits))


def likely_copies(pages: DataFrame, copies: DataFrame, bits: int) -> DataFrame:
    """``pages`` with ``likely``: true for every page whose digest is among ``copies``,
    and for few others. Joined by broadcast: the table has ``bits`` bits."""
    at = _bit(bits)
    table = (copies.groupBy(F.bitmap_bucket_number(at).alias("_bucket"))
                   .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits")))
    place = F.bitmap_bit_position(at)
    found = pages.withColumn("_bucket", F.bitmap_bucket_number(at)).join(F.broadcast(table), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0
    return found.withColumn("likely", F.coalesce(set_, F.lit(False))).drop("_bucket", "_bits")


def typed(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
          least_bytes: int = 0, broadcast_copies: int = BROADCAST_COPIES) -> DataFrame:
    """A row per page: ``id, url, html, sha1`` (hex) and ``refers``, the id that a
    revisit refers to."""
    p = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"),
                     F.coalesce(F.col(html), F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least_bytes
    first = staged(p.where(large).groupBy("sha1").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1").select("sha1", "first"), "warc-copies")
    n = first.count()
    if n <= broadcast_copies:
        p = p.join(F.broadcast(first), "sha1", "left")
    else:
        bits = min(1 << (BITS_EACH * n).bit_length(), MOST_BITS)
        marked = likely_copies(p, first, bits)
        single = marked.where(~F.col("likely")).withColumn("first", F.lit(None).cast("long"))
        p = marked.where("likely").join(first, "sha1", "left").unionByName(single)
    other = large & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return p.select("id", "url", "html", "sha1", F.when(other, F.col("first")).alias("refers"))


def render_record(ident, url: str | None, body: bytes, digest: str, refers) -> bytes:
    """A record; a revisit has no body but states its payload's length."""
    from urllib.parse import quote

    kind = "response" if refers is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if ident is None else ident}>",
             f"WARC-Target-URI: {quote(url or '', safe=_PLAIN)}", f"WARC-Payload-Digest: sha1:{digest}",
             f"X-Payload-Length: {len(body)}"]
    if refers is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers}>")
        body = b""
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + HEADER_END + body + RECORD_END


# printable ASCII stays as it is in a header
_PLAIN = "".join(map(chr, range(33, 127)))


def _writer(root: str, archive_bytes: int):
    """mapInArrow function: pages → index rows, writing archives."""
    def run(batches):
        import base64
        import uuid
        import zlib

        import pyarrow as pa
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        out, name, at = None, None, 0
        try:
            for b in batches:
                rows = []
                for ident, url, html, sha1, refers in zip(*(b.column(c).to_pylist() for c in
                                                            ("id", "url", "html", "sha1", "refers"))):
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    body = html.encode()
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    pack = zlib.compressobj(LEVEL, wbits=31)
                    data = pack.compress(render_record(ident, url, body, digest, refers)) + pack.flush()
                    out.write(data)
                    rows.append((f"{root}/{name}", at, len(data), ident, url, digest, len(body),
                                 "response" if refers is None else "revisit"))
                    at += len(data)
                    if at >= archive_bytes:
                        out.close()
                        out = None
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), pa.string() if f.dataType == T.StringType() else pa.int64())
                         for c, f in zip(zip(*rows), INDEX.fields)], names=INDEX.fieldNames())
        finally:
            if out is not None:
                out.close()
    return run


def _make_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, **columns) -> None:
    """Write ``path/archives/*.warc.gz`` and ``path/index`` (Parquet)."""
    root = f"{path}/archives"
    _make_folder(pages.sparkSession, root)
    (typed(pages, **columns).select("id", "url", "html", "sha1", "refers")
     .mapInArrow(_writer(root, archive_bytes), INDEX).write.parquet(f"{path}/index"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def coalesced(selected: DataFrame, read_bytes: int = READ_BYTES, gap: int = GAP_BYTES) -> DataFrame:
    """Index rows → byte ranges ``file, start, stop, parts`` to read at once;
    ``parts`` are the records in it (offset, length).

    A record joins the range before it if the gap is small and both start in
    the same stretch of ``read_bytes``; ranges are at most that and a record."""
    w = Window.partitionBy("file").orderBy("offset")
    prior = F.lag(F.col("offset") + F.col("length")).over(w)
    stretch = F.floor(F.col("offset") / read_bytes)
    new = (prior.isNull() | (F.col("offset") - prior > gap)
           | (stretch != F.floor(F.lag("offset").over(w) / read_bytes)))
    rows = selected.withColumn("_new", new.cast("int")).withColumn("_range", F.sum("_new").over(w))
    return (rows.groupBy("file", "_range")
                .agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"),
                     F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("parts"))
                .drop("_range"))


RECORD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("type", T.StringType()),
                       T.StructField("refers_to", T.LongType()), T.StructField("uri", T.StringType()),
                       T.StructField("digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
                       T.StructField("payload", T.BinaryType())])


def parse_record(data: bytes) -> tuple:
    """A compressed record's fields; the digest and length of a response are those of its
    payload as read, and must agree with the header."""
    import base64
    import hashlib
    import zlib

    head, _, rest = zlib.decompress(data, 31).partition(HEADER_END)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1" or not rest.endswith(RECORD_END):
        raise ValueError(f"no WARC record at this offset: {data[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[:-len(RECORD_END)]
    if len(body) != int(fields["Content-Length"]):
        raise ValueError(f"record of {len(body)} bytes, {fields['Content-Length']} stated")
    ident = lambda x: int(x) if (x := x[len("<urn:page:"):-1]) else None
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if (found, len(body)) != (digest, size):
            raise ValueError(f"payload digest {found}, header {digest}")
    refers = ident(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return (ident(fields["WARC-Record-ID"]), fields["WARC-Type"], refers, fields["WARC-Target-URI"], digest,
            size, body)


def _reader(payload: bool):
    """mapInArrow function: ranges → records, a read per range."""
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for r in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(r["file"])
                with store.open_input_file(name) as f:
                    data = f.read_at(r["stop"] - r["start"], r["start"])
                rows = [parse_record(data[p["offset"] - r["start"]:][:p["length"]]) for p in r["parts"]]
                cols = list(zip(*rows))
                if not payload:
                    cols[-1] = [None] * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                                 names=RECORD.fieldNames())
    return run


def read_records(selected: DataFrame, payload: bool = True) -> DataFrame:
    """The records that rows of the index select, read in coalesced ranges."""
    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(total / READ_BYTES))
    ranges = coalesced(selected.select("file", "offset", "length"))
    return ranges.repartition(tasks, "file", "start").mapInArrow(_reader(payload), RECORD)


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to new archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = stage_path(spark, "warc")
    write_archives(pages, path, archive_bytes)
    return read_records(read_index(spark, path), payload=False)
