"""Secret scans: patterns, and strings that zstandard cannot explain.

Base patterns find assigned values, access keys and long hex strings. Beside them,
every string of the alphabet of secrets that stands in a sensitive context - after a
word like ``password``, ``key`` or ``bearer`` on its line - is a candidate. A candidate
is measured by its marginal compressed bytes: with a compressor primed with a
dictionary of the corpus's identifiers, the text around the candidate is compressed
without it and with it; the bytes it adds, per byte of its own, are its novelty. Words,
paths and names that the surroundings or the dictionary know add little; keys add
about their length. Candidates of at least ``novelty`` are found as well (``novel``).

The dictionary holds the alphabetic parts of identifiers that are in the most texts,
counted over the whole texts of all documents, up to ``dictionary_bytes``; parts in a
single text tell nothing and stay out. It is the only thing that is sent to the tasks;
documents are not shuffled. Tasks count parts per batch before the counts are.

Defined cases: null text is empty; repeated rows have equal spans each, and equal texts
count once each in the dictionary; very long texts are scanned whole, in linear time;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The patterns, in the order of their kinds.
PATTERNS = {
    "assign": r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
KINDS = [*PATTERNS, "novel"]
#: Least length of an assigned value.
ASSIGNED = 6
#: What the lower-cased text must hold for a look at ``assign``, and words that make a context sensitive.
NEEDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = r"(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|key|credentials?|auth(?:orization)?|bearer|private)(?![A-Za-z])"
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "private")
#: A candidate: at least 16 characters of the alphabet of secrets, letters and digits,
#: at most 64 characters after the end of a sensitive word on its line.
CANDIDATE = r"[A-Za-z0-9+/_.=-]{16,}"
REACH = 64
#: Marginal bytes per byte from which a candidate is reported; characters of the
#: surroundings on either side that prime the compressor; its level.
NOVELTY, AROUND, LEVEL = 0.95, 512, 3
#: Size of the dictionary, and the most parts that can be in it.
DICTIONARY_BYTES, PARTS = 64 << 10, 16_000
#: A task's counter is passed on once it holds so many parts.
HELD = 200_000

_BASE = {kind: re.compile(p) for kind, p in PATTERNS.items()}
_SENSITIVE, _CANDIDATE, _PART = re.compile(SENSITIVE), re.compile(CANDIDATE), re.compile(r"[^\W\d_]{3,32}")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType()), T.StructField("novelty", T.DoubleType())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, number of kind, end`` of the base spans, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in NEEDS):
        out += [(m.start(), 0, m.end()) for m in _BASE["assign"].finditer(text) if m.end(1) - m.start(1) >= ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _BASE["access"].finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _BASE["hex"].finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Strings in a sensitive context that no base span covers."""
    low = text.lower()
    if not any(w in low for w in HINTS):
        return []
    ends = [m.end() for m in _SENSITIVE.finditer(text)]
    if not ends:
        return []
    starts = [a for a, _, _ in base]
    reached = list(itertools.accumulate((b for _, _, b in base), max))
    out = []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        at = bisect.bisect_right(ends, a) - 1
        if at < 0 or a - ends[at] > REACH or "\n" in text[ends[at]:a]:
            continue
        near = bisect.bisect_left(starts, b) - 1
        if near >= 0 and reached[near] > a:
            continue
        said = text[a:b]
        if any(c.isdigit() for c in said) and any(c.isalpha() for c in said):
            out.append((a, b))
    return out


class Gauge:
    """Novelty of strings under a dictionary."""

    def __init__(self, dictionary: bytes, around: int = AROUND, level: int = LEVEL):
        import zstandard as z

        self.around = around
        primed = {}
        if len(dictionary) >= 8:
            data = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            primed["dict_data"] = data
        self.compressor = z.ZstdCompressor(level=level, write_content_size=False, write_checksum=False,
                                           write_dict_id=False, **primed)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "replace")))

    def novelty(self, text: str, start: int, end: int) -> float:
        """The bytes that ``text[start:end]`` adds to its surroundings, per byte."""
        before, after = text[max(0, start - self.around):start], text[end:end + self.around]
        own = text[start:end]
        added = self.size(before + after + "\n" + own) - self.size(before + after + "\n")
        return added / len(own.encode("utf-8", "replace"))


def _parts(held: int):
    """mapInArrow function: ``text`` → ``part, n``, in how many texts of the task."""
    def run(batches):
        import pyarrow as pa

        seen: Counter = Counter()

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                              names=["part", "n"])

        for b in batches:
            for t in b.column("text"):
                t = t.as_py()
                if t:
                    seen.update(set(_PART.findall(t)))
                if len(seen) >= held:
                    yield batch()
                    seen = Counter()
        if seen:
            yield batch()
    return run


def identifier_parts(docs: DataFrame, text: str = "text", most: int = PARTS, held: int = HELD) -> DataFrame:
    """``part, n``: the parts in the most texts (at least two), ``most`` at the most."""
    counted = docs.select(F.col(text).alias("text")).mapInArrow(_parts(held), "part string, n long")
    total = counted.groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") >= 2)
    return total.orderBy(F.col("n").desc(), "part").limit(most)


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY_BYTES) -> bytes:
    """The priming dictionary of a corpus: its commonest parts, the commonest last,
    where the compressor finds them at the shortest distance."""
    out, length = [], 0
    for r in identifier_parts(docs, text).orderBy(F.col("n").desc(), "part").toLocalIterator():
        part = r.part.encode("utf-8", "replace") + b" "
        if length + len(part) > size:
            break
        out.append(part)
        length += len(part)
    return b"".join(reversed(out))


def _scan(known: bytes, least: float, around: int):
    """mapInArrow function: adds ``spans`` to ``key, text`` and drops the text."""
    def run(batches):
        import pyarrow as pa

        gauge = Gauge(known, around)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                   ("novelty", pa.float64())]))
        for b in batches:
            spans = []
            for t in b.column("text"):
                t = t.as_py() or ""
                base = base_spans(t)
                found = [(a, n, e, gauge.novelty(t, a, e)) for a, n, e in base]
                for a, e in candidates(t, base):
                    new = gauge.novelty(t, a, e)
                    if new >= least:
                        found.append((a, len(PATTERNS), e, new))
                spans.append([{"kind": KINDS[n], "start": a, "end": e, "novelty": new}
                              for a, n, e, new in sorted(found)])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(spans, kind)], names=["key", "spans"])
    return run


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", novelty: float = NOVELTY, around: int = AROUND,
         known: bytes | None = None) -> DataFrame:
    """A row per document: ``key`` and ``spans``, an array of structs ``kind, start,
    end`` (code points, end exclusive) and ``novelty``, by start and then kind in the
    order of ``KINDS``. ``known`` is a dictionary to use instead of the corpus's own."""
    spark = docs.sparkSession
    known = dictionary(docs, text) if known is None else known
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("spans", SPANS)])
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_scan(known, novelty, around), schema).withColumnRenamed("key", key)


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
