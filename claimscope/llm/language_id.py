"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes. A byte seen in
its context costs its share of the counts; an unseen one costs an escape (its
probability is the share of distinct followers, as in PPM method C) and is then
predicted from the next shorter context, with the bytes that the longer one
knows excluded. Statistics are frozen after training, so the code length of a
text is a sum over its bytes of a fixed cost that depends on the longest kept
context; a text belongs to the language that codes it shortest.

Frozen costs make scoring array work: the contexts of all languages form one
tree, each byte finds its node by two table lookups, and its cost in every
language by one more. Costs are integers (1/256 bit), so sums do not depend on
how a text is cut up.

Training counts the byte windows of all training texts on the executors and adds them
up in Spark. A context of two or three bytes is kept from a stated count and a stated
share of its language's bytes on; the shares bound the trees. Which ones are kept is
found in Spark too, and windows are cut to their longest kept context and added up
again, so what the driver sees is bounded as the trees are. Prediction covers whole
texts and reads nothing but them. :func:`readable` tells texts that are coded far
worse than the training texts, by the median of all of them.

Defined cases: a text that is null or without a letter is ``und`` with score 0;
ties go to the smaller language name; without training rows every text is
``und``; repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.staging import discard, row_chunks, staged, utf8_buffer

UNKNOWN = "und"
#: The least count of a context, and its least share of a language's bytes.
LEAST_CONTEXT = 24
LEAST_SHARE = 1 / 30_000
#: A text is unreadable if it takes this many times the usual bits per byte, and
#: this many bits more: short texts are always readable.
WORSE, SLACK_BITS = 2.0, 256
#: Costs are in this part of a bit.
UNIT = 256
CHUNK_BYTES = 1 << 18
#: Distinct windows that a training task holds before it passes them on.
HELD_WINDOWS = 1 << 20
ROWS = 1000
ORDER = 3
#: Above all windows.
CUT = 1 << 32

# A-Z count as a-z
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _windows(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte, itself and the three before it in its row (zero before
    the start) packed into 32 bits, the byte itself lowest."""
    folded = _FOLD[raw].astype(np.uint32)
    place = np.arange(len(raw)) - np.repeat(off[:-1], np.diff(off))
    out = folded.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros_like(folded)
        before[k:] = folded[:-k]
        before[place < k] = 0
        out |= before << np.uint32(8 * k)
    return out


def _count(batches):
    import pyarrow as pa

    held: dict[str, list] = {}

    def out(lang):
        windows, n = _added(held.pop(lang))
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(n), pa.string()), pa.array(windows.astype(np.int64)),
             pa.array(n.astype(np.int64))], names=["lang", "win", "n"])

    for b in batches:
        raw, off = utf8_buffer(b.column("text"))
        langs = np.array(b.column("lang").to_pylist(), object)
        for i, j in row_chunks(off, CHUNK_BYTES):
            windows = _windows(raw[off[i]:off[j]], off[i:j + 1] - off[i])
            of_row = np.repeat(np.arange(i, j), np.diff(off[i:j + 1]))
            for lang in sorted(set(langs[i:j])):
                own = windows if (langs[i:j] == lang).all() else windows[langs[of_row] == lang]
                held.setdefault(lang, []).append(np.unique(own, return_counts=True))
            for lang in [k for k, parts in held.items() if sum(len(w) for w, _ in parts) > HELD_WINDOWS]:
                held[lang] = [_added(held[lang])]
                if len(held[lang][0][0]) > HELD_WINDOWS // 2:
                    yield out(lang)
    for lang in sorted(held):
        yield out(lang)


def _added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows and counts of several such pairs."""
    windows, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
    return windows, np.bincount(at, np.concatenate([n for _, n in parts]), len(windows)).astype(np.int64)


@dataclass
class Model:
    """Frozen statistics: symbols of bytes, node tables and costs."""

    langs: list[str]
    symbol: np.ndarray      # byte → symbol
    size: int               # number of symbols
    second: np.ndarray      # symbol, symbol before → node
    third: np.ndarray       # node, symbol before → node
    costs: np.ndarray       # language, node * size + symbol → cost
    usual: float = 0.0      # median bits per byte of the training texts

    def bits(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code lengths (rows × languages) in units, of the rows of a buffer."""
        out = np.zeros((len(off) - 1, len(self.langs)), np.int64)
        for i, j in self._cuts(off):
            self._add(raw, off, i, j, out)
        return out

    @staticmethod
    def _cuts(off):
        """Stretches of the buffer, independent of where rows end."""
        for a in range(0, int(off[-1]), CHUNK_BYTES):
            yield a, min(a + CHUNK_BYTES, int(off[-1]))

    def _add(self, raw, off, a, b, out):
        first = int(np.searchsorted(off, a, "right")) - 1
        last = int(np.searchsorted(off, b, "left"))
        starts = off[first:last]
        lead = min(a, ORDER)
        s = self.symbol[raw[a - lead:b]].astype(np.int32)
        zero = int(self.symbol[0])
        place = np.arange(a, b) - np.repeat(starts, np.diff(np.clip(off[first:last + 1], a, b)))
        before = []
        for k in range(1, ORDER + 1):
            x = np.full(b - a, zero, np.int32)
            have = min(lead, k)
            x[k - have:] = s[lead - have:len(s) - k]
            x[place < k] = zero
            before.append(x)
        node = self.second[before[0] * self.size + before[1]]
        node = self.third[node * self.size + before[2]]
        at = node * self.size + s[lead:]
        inner = np.maximum(starts, a) - a
        some = np.flatnonzero(np.diff(np.append(inner, b - a)) > 0)
        for lang in range(len(self.langs)):
            out[first + some, lang] += np.add.reduceat(self.costs[lang][at], inner[some], dtype=np.int64)


def _blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Followers' counts of contexts and the shorter contexts' distributions →
    distributions: seen followers share the counts, the escape is shared among
    the others as the shorter context has them."""
    seen = counts > 0
    n, q = counts.sum(-1, keepdims=True), seen.sum(-1, keepdims=True)
    rest = np.maximum(1 - (shorter * seen).sum(-1, keepdims=True), 1e-9)
    escaped = q / np.maximum(n + q, 1) * shorter / rest
    return np.where(n == 0, shorter, np.where(seen, counts / np.maximum(n + q, 1), escaped))


def build(rows: list[tuple[str, np.ndarray, np.ndarray]], least_context: int = LEAST_CONTEXT,
          least_share: float = LEAST_SHARE) -> Model:
    """Model of ``(language, windows, counts)``. A window plus ``CUT`` is without its
    third byte before, one plus twice ``CUT`` also without the second."""
    rows = sorted(rows, key=lambda r: r[0])
    langs = [r[0] for r in rows]
    used = np.unique(np.concatenate([[0], *[w & 255 for _, w, _ in rows]])).astype(int)
    size = len(used) + 1  # the last symbol: bytes never seen
    symbol = np.full(256, size - 1, np.int16)
    symbol[used] = np.arange(len(used))
    symbol = symbol[_FOLD]
    per = []
    for _, w, n in rows:
        s = [symbol[(w >> (8 * k)) & 255].astype(np.int64) for k in range(ORDER + 1)]
        per.append((s, n.astype(np.float64), ORDER - w // CUT))
    # kept contexts: of two and three bytes, frequent in some language
    def kept(depth: int):
        found = [np.zeros(0, np.int64)]
        for s, n, deep in per:
            key = s[1] * size + s[2] if depth == 2 else (s[1] * size + s[2]) * size + s[3]
            ids, at = np.unique(key[deep >= depth], return_inverse=True)
            found.append(ids[np.bincount(at, n[deep >= depth], len(ids)) >= max(least_context, least_share * n.sum())])
        return np.unique(np.concatenate(found))

    two, three = kept(2), kept(3)
    three = three[np.isin(three // size, two)]
    second = np.repeat(np.arange(size), size).astype(np.int32)
    second[two] = size + np.arange(len(two))
    third = np.repeat(np.arange(size + len(two)), size).astype(np.int32)
    parent = np.searchsorted(two, three // size)
    third[(size + parent) * size + three % size] = size + len(two) + np.arange(len(three))
    costs = []
    for s, n, deep in per:
        def table(ctx, m):
            at = ctx * size + s[0]
            fine = ctx >= 0
            return np.bincount(at[fine], n[fine], m * size).reshape(m, size)

        def number(keys, full, depth):
            if not len(keys):
                return np.full(len(full), -1)
            at = np.minimum(np.searchsorted(keys, full), len(keys) - 1)
            return np.where((keys[at] == full) & (deep >= depth), at, -1)

        zero = np.bincount(s[0], n, size)
        q = (zero > 0).sum()
        p0 = np.where(zero > 0, zero / (n.sum() + q), q / (n.sum() + q) / (256 - q))
        p1 = _blend(table(s[1], size), np.broadcast_to(p0, (size, size)))
        p2 = _blend(table(number(two, s[1] * size + s[2], 2), len(two)), p1[two // size])
        p3 = _blend(table(number(three, (s[1] * size + s[2]) * size + s[3], 3), len(three)), p2[parent])
        p = np.concatenate((p1, p2, p3))
        costs.append(np.minimum(np.round(-np.log2(np.maximum(p, 1e-30)) * UNIT), 32767).astype(np.int16).ravel())
    return Model(langs, symbol, size, second, third, np.array(costs))


def _cut(counts: DataFrame) -> DataFrame:
    """``lang, win, n``, the windows cut to their longest kept context (see
    :func:`build`) and added up: what the trees of the kept contexts need."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("_all"))
    least = F.greatest(F.lit(float(LEAST_CONTEXT)), F.lit(LEAST_SHARE) * F.col("_all"))

    def kept(context: Column) -> DataFrame:
        of = counts.groupBy("lang", context.alias("c")).agg(F.sum("n").alias("n"))
        return of.join(F.broadcast(totals), "lang").where(F.col("n") >= least).select("c").distinct()

    two = kept(F.shiftright("win", 8).bitwiseAND(0xFFFF)).select(F.col("c").alias("_two"))
    three = kept(F.shiftright("win", 8)).select(F.col("c").alias("_three"))
    w = F.col("win")
    marked = (counts.join(F.broadcast(two), F.shiftright(w, 8).bitwiseAND(0xFFFF) == F.col("_two"), "left")
                    .join(F.broadcast(three), F.shiftright(w, 8) == F.col("_three"), "left"))
    cut = (F.when(F.col("_two").isNull(), w.bitwiseAND(0xFFFF) + 2 * CUT)
            .when(F.col("_three").isNull(), w.bitwiseAND(0xFFFFFF) + CUT).otherwise(w))
    return marked.groupBy("lang", cut.alias("win")).agg(F.sum("n").alias("n"))


def train(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang") -> Model | None:
    """A model of all rows where ``training`` holds; None if there are none."""
    rows = docs.where(training & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = staged(rows.mapInArrow(_count, "lang string, win long, n long")
                        .groupBy("lang", "win").agg(F.sum("n").alias("n")), "language-windows")
    parts = [(name, t["win"].to_numpy(np.int64), t["n"].to_numpy(np.int64)) for name, t in _cut(counts).toPandas().groupby("lang")]
    discard(counts)
    if not parts:
        return None
    model = build(parts)
    rates = predict(rows, model, "text", [])
    model.usual = rates.where("bits_per_byte > 0").agg(F.percentile_approx("bits_per_byte", 0.5)).first()[0] or 0.0
    return model


def readable(model: Model, text: str = "text", worse: float = WORSE, slack: float = SLACK_BITS) -> Column:
    """Whether rows of :func:`predict` are texts as a model knows them: their code
    length is at most ``worse`` times the usual one, and ``slack`` bits."""
    n = F.octet_length(F.col(text))
    return F.col("bits_per_byte") * n <= F.lit(model.usual * worse) * n + F.lit(float(slack))


def _predict(model, text: str, keep: list[str]):
    def run(batches):
        import pyarrow as pa

        m = Model(*model.value) if model.value else None
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            raw, off = utf8_buffer(b.column(text))
            letters = np.array(b.column("_letters").to_pylist(), bool)
            preds, scores, rate = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows)
            if m is not None and b.num_rows:
                bits = m.bits(raw, off)
                best = bits.argmin(1)
                gap = (bits - bits.min(1, keepdims=True)) / UNIT
                scores = np.where(letters, 1 / np.exp2(-np.minimum(gap, 1000)).sum(1), 0.0)
                rate = bits.min(1) / UNIT / np.maximum(np.diff(off), 1)
                preds = [m.langs[i] if ok else UNKNOWN for i, ok in zip(best, letters)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(preds, pa.string()), pa.array(scores, pa.float64()),
                                              pa.array(rate, pa.float64())], names=[*keep, "lang_pred", "score", "bits_per_byte"])
    return run


def predict(docs: DataFrame, model: Model | None, text: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``lang_pred``, ``score``, the share of
    the language's likelihood among all, and ``bits_per_byte``, the text's code length in
    that language per byte. Columns of these names are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "bits_per_byte")]
    parts = None if model is None else tuple(getattr(model, f.name) for f in fields(model))
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("_text"),
                       F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    out = rows.mapInArrow(_predict(shared, "_text", names), schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "lang_pred", "score", "bits_per_byte")
