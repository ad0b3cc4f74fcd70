"""Benchmark decontamination with an Aho-Corasick automaton.

Benchmark texts and documents are normalised alike: A-Z lower-cased, words are
runs of digits, a-z and characters above 7F, one blank between words. A window
is ``window`` consecutive words of an item (an item with fewer words is one
window). All windows form one automaton; a document is scanned once, and every
word inside an occurrence of a window is hit. Hits are mapped back to code point
offsets of the original text.

The windows are a table: made by tasks, equal ones are one row with the ids of their
items. The automaton is built on the executors from the broadcast windows. Its size is
bounded: by running size the windows are dealt into blocks of at most ``block_chars``
bytes, and the driver sees one block at a time. Usual benchmarks are one block;
documents then never leave their partition. With more, each block is a pass of its
own over the texts, with its automaton alone; its hits are written before the next
block, and joined in the end to the documents that have any.

Defined cases: null text has no words; items without words have no windows; a
benchmark row without an id marks words but is not named among the items;
repeated benchmark rows count once; an empty benchmark hits nothing; repeated
documents are each scanned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.prefix_trie import running
from claimscope.llm.staging import staged, utf8_buffer

#: Words in a window, and most characters of the windows of one automaton.
WINDOW = 10
BLOCK_CHARS = 16 << 20

# every byte of a word stands for itself, A-Z for a-z, all others for a blank
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
               for b in range(256))


def normalised(text: bytes) -> str:
    """The words of a text with one blank around each, a character per byte;
    a text without words gives a single blank."""
    words = text.translate(_TABLE).split()
    return f" {b' '.join(words).decode('latin-1')} " if words else " "


def item_windows(text: str | None, window: int) -> list[str]:
    # one blank between words and one on either side; str.split() would also split at
    # the bytes 85 and A0 inside a letter
    words = normalised((text or "").encode()).split(" ")[1:-1]
    if not words:
        return []
    spans = [words] if len(words) < window else [words[i:i + window] for i in range(len(words) - window + 1)]
    return [f" {' '.join(w)} " for w in spans]


def _windows(window: int):
    """mapInArrow function: ``i, t`` → ``w, i``, a row per window of an item."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist()):
                found = [w.encode("latin-1") for w in item_windows(t, window)]
                for a in range(0, len(found), 10_000):
                    part = found[a:a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([i] * len(part), pa.string())],
                                                     names=["w", "i"])
    return run


def window_blocks(benchmark: DataFrame, item: str, text: str, window: int, block_chars: int) -> tuple[DataFrame, int]:
    """``(windows, blocks)``: a staged table ``w, items, block`` of the distinct windows
    and the number of blocks, each of at most ``block_chars`` bytes (or one window)."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).distinct()
    each = rows.mapInArrow(_windows(window), "w binary, i string")
    table = staged(each.groupBy("w").agg(F.sort_array(F.collect_set("i")).alias("items")), "windows")
    size = F.octet_length("w") + F.octet_length(F.array_join("items", ","))
    total = table.agg(F.sum(size)).first()[0] or 0
    if total <= block_chars:
        return table.withColumn("block", F.lit(0).cast("long")), 1
    placed = running(table.withColumn("_all", F.lit(0)), "_all", [F.col("w")], {"_at": size.cast("long")}, "window-sizes")
    dealt = staged(placed.select("w", "items", F.expr(f"_at div {block_chars}").alias("block")), "window-blocks")
    return dealt, dealt.agg(F.max("block")).first()[0] + 1


def _block(windows: DataFrame, n: int) -> list[tuple[str, list[str]]]:
    return [(bytes(r.w).decode("latin-1"), r["items"]) for r in windows.where(F.col("block") == n).collect()]


def _automaton(block):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, items in block:
        a.add_word(w, (w.count(" ") - 1, tuple(sorted(items))))
    if len(a):
        a.make_automaton()
    return a


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point offsets at which the words of a UTF-8 text start and end."""
    word = np.frombuffer(raw.tobytes().translate(_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points[edge[::2]], points[edge[1::2]]


def _merge(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [T.StructField("_n", T.LongType()), T.StructField("_words", SPAN),
         T.StructField("_items", T.ArrayType(T.StringType())), T.StructField("_spans", SPAN)]


def _hits(automaton, norm: str) -> tuple[list[dict], list[str]]:
    """Runs of word numbers inside occurrences of windows, and the items of these."""
    ends = list(automaton.iter(norm)) if len(automaton) and norm != " " else []
    if not ends:
        return [], []
    blanks = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32)
    at = np.searchsorted(blanks, [e for e, _ in ends]).tolist()
    return _merge([(k - m, k) for k, (_, (m, _)) in zip(at, ends)]), sorted({x for _, (_, xs) in ends for x in xs})


def _scan(block, text: str, drop: tuple):
    """mapInArrow function: adds the number of words ``_n`` and the hits of one block,
    ``_words`` (runs of word numbers), ``_items`` and ``_spans`` (the runs as code
    point offsets of the text). Without a block the rows bring ``_words`` and
    ``_items`` with them."""
    def run(batches):
        import pyarrow as pa

        automaton = None if block is None else _automaton(block.value)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            raw, off = utf8_buffer(batch.column(batch.schema.get_field_index(text)))
            rows = batch.num_rows
            norm = [normalised(raw[off[i]:off[i + 1]].tobytes()) for i in range(rows)]
            if automaton is None:
                had = zip(batch.column("_words").to_pylist(), batch.column("_items").to_pylist())
                found = [(_merge([(s["start"], s["end"]) for s in w or []]), sorted(set(x or []))) for w, x in had]
            else:
                found = [_hits(automaton, x) for x in norm]
            new = {"_n": pa.array([x.count(" ") - 1 for x in norm], pa.int64()), "_words": pa.array([w for w, _ in found], span),
                   "_items": pa.array([x for _, x in found], pa.list_(pa.string())),
                   "_spans": pa.array([_located(raw[off[i]:off[i + 1]], w) for i, (w, _) in enumerate(found)], span)}
            names = [x for x in batch.schema.names if x not in new and x not in drop]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in names] + list(new.values()),
                                             names=names + list(new))
    return run


def _scan_block(block):
    """mapInArrow function: ``_row, t`` → ``_row, _words, _items`` of the rows that a block hits."""
    def run(batches):
        import pyarrow as pa

        automaton = _automaton(block.value)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            raw, off = utf8_buffer(batch.column("t"))
            found = [(r, *_hits(automaton, normalised(raw[off[i]:off[i + 1]].tobytes())))
                     for i, r in enumerate(batch.column("_row").to_pylist())]
            found = [x for x in found if x[1]]
            if found:
                row, words, items = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(words, span), pa.array(items, pa.list_(pa.string()))],
                                                 names=["_row", "_words", "_items"])
    return run


def _located(raw: np.ndarray, runs: list[dict]) -> list[dict]:
    if not runs:
        return []
    start, end = word_bounds(raw)
    return [{"start": int(start[r["start"]]), "end": int(end[r["end"] - 1])} for r in runs]


def _joined(spark, rows: DataFrame, at: str, windows: DataFrame, n: int) -> DataFrame:
    """``rows`` with the hits of all blocks (``_words``, ``_items``; not yet merged): a
    pass for each block, whose hits are written."""
    hits = None
    for b in range(n):
        block = spark.sparkContext.broadcast(_block(windows, b))
        found = staged(rows.select("_row", F.col(at).alias("t")).mapInArrow(_scan_block(block), T.StructType(
            [T.StructField("_row", T.LongType()), FOUND[1], FOUND[2]])), "block-hits")
        block.unpersist()
        hits = found if hits is None else hits.unionByName(found)
    # at most a row per block and document
    each = hits.groupBy("_row").agg(F.flatten(F.collect_list("_words")).alias("_words"),
                                    F.flatten(F.collect_list("_items")).alias("_items"))
    return rows.join(each, "_row", "left").drop("_row")


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS,
         keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of ``docs`` with ``hits``: struct
    of ``n_words``, ``n_hit``, ``items`` (sorted ids as strings) and ``spans``
    (hit passages, code points, end exclusive). A column called ``hits`` is
    replaced."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c != "hits"]
    rest = list(dict.fromkeys([*keep, text]))
    out = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    at = f"c{rest.index(text)}"
    drop = () if text in keep else (at,)
    left = [f for f in out.schema.fields if f.name not in drop]
    schema = T.StructType([*left, *FOUND])
    windows, n = window_blocks(benchmark, item, item_text, window, block_chars)
    if n == 1:
        block = spark.sparkContext.broadcast(_block(windows, 0))
    else:
        block, out = None, _joined(spark, staged(out.withColumn("_row", F.monotonically_increasing_id()), "scanned"), at, windows, n)
    out = out.mapInArrow(_scan(block, at, drop), schema)
    n_hit = F.aggregate("_words", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest) if c in keep], F.struct(
        F.col("_n").alias("n_words"), n_hit.alias("n_hit"), F.col("_items").alias("items"),
        F.col("_spans").alias("spans")).alias("hits"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **kw) -> DataFrame:
    """``docs`` without documents that hold a window of the benchmark."""
    return mark(docs, benchmark, text, **kw).where(F.col("hits.n_hit") == 0).drop("hits")
