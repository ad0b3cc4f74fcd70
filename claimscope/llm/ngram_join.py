"""Near-duplicates: n-gram sets joined by Jaccard similarity with prefix trees.

Shingles (``n`` consecutive words, hashed to 64 bits) have one global order, from
rare to frequent. Frequency is read from a fixed-size sketch of counts over all
documents; any function of the shingle is a valid order, so the sketch decides
only how fast the join is. Two sets that reach the threshold share a shingle
within the first ``n - ceil(t n) + 1`` of both.

1. Documents with equal sets are one class (128-bit signature), with its smallest id.
2. Each class sends the shingles of its prefix; the smallest class that has a
   shingle is the shingle's home. Classes that share a shingle meet at its home.
   Minima are aggregated before the shuffle.
3. What meets at a home is mostly unlike. Each class is there with a parity bitmap
   of its set, a few bits per shingle: bits that differ bound the overlap from above.
   Pairs that the bound lets through connect classes into clusters, so that
   each set has to be sent only once, to its cluster.
4. Each cluster stores its sets in a radix trie, frequent shingles first. A probe
   descends once, sharing the overlap of common paths; a subtree is cut off when
   its shortest and longest sets can no longer reach the threshold with what is
   left. Sets already connected are not looked at again: the output is links that
   connect, not all pairs.
5. A home or cluster with more members, or larger ones, than a task may hold is cut into
   blocks, by number and by bytes. First its smallest member alone probes the blocks; what it links is connected.
   Only members that it does not link then probe all blocks, block by block. So a
   family of near copies takes work in proportion, and no task holds more than two
   blocks.
6. Links connect classes into components.

Texts are never shuffled. Shingles are recomputed where they are needed, which is
cheaper than keeping them. The driver sees the sketch and a bit table, both of fixed
size.

Defined cases: null and empty texts have the empty set, size 0, and link with
nothing; a row without an id links with nothing and has no component; rows with
equal ids are one vertex; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.components import components
from claimscope.llm.staging import discard, row_chunks, staged, utf8_buffer

#: Words in a shingle; similarity as a fraction.
WORDS = 5
SIMILARITY = (75, 100)
#: Counters of the sketch, bits of the table of clustered ids, sets and bitmaps in a block.
SKETCH = 1 << 17
TABLE_BITS = 1 << 25
BLOCK = 256
MAP_BLOCK = 1024
#: Bytes of sets or bitmaps in a block, and what a shingle takes in either at most.
BLOCK_BYTES = 16 << 20
SET_BYTES, MAP_BYTES = 8.0, 0.5
#: Bytes of text, rows of an Arrow batch that are looked at together.
CHUNK_BYTES = 1 << 19
ROWS = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(12345).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of a buffer; a blank or the end of
    the buffer ends a word."""
    word = ~_BLANK[raw]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start
    size = end - start
    inner = raw[start[0]:]
    place = np.arange(len(inner)) - np.repeat(start - start[0], np.diff(np.append(start, len(raw))))
    power = np.cumprod(np.full(int(size.max()) + 1, _MULT, np.uint64))
    value = np.where(_BLANK[inner], np.uint64(0), _BYTE[_LOWER[inner]] * power[np.minimum(place, len(power) - 1)])
    return _mix(np.add.reduceat(value, start - start[0]) + size.astype(np.uint64) * _MULT), start


def shingle_sets(raw: np.ndarray, off: np.ndarray, words: int = WORDS):
    """For each row of a buffer, its sorted distinct shingle hashes."""
    for a, b in row_chunks(off, CHUNK_BYTES):
        hashes, first = _row_words(raw, off, a, b)
        s = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words):
            s = s * _MULT + hashes[k:k + len(s)]
        s = _mix(s)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= words:
                yield np.unique(s[lo:hi - words + 1])
            elif hi > lo:
                whole = np.full(1, hi - lo, np.uint64)
                for k in range(lo, hi):
                    whole = whole * _MULT + hashes[k:k + 1]
                yield _mix(whole)
            else:
                yield np.zeros(0, np.uint64)


def _row_words(raw, off, a, b) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of rows ``a`` .. ``b`` and where each row's begin. Rows are
    set apart by a blank; a very long row is cut at blanks."""
    if b - a > 1 or off[b] - off[a] <= 4 * CHUNK_BYTES:
        size = np.diff(off[a:b + 1])
        apart = np.full(int(size.sum()) + b - a, 32, np.uint8)
        to = np.arange(int(size.sum())) + np.repeat(np.arange(b - a), size)
        apart[to] = raw[off[a]:off[b]]
        hashes, start = _word_hashes(apart)
        rows = np.concatenate(([0], np.cumsum(size + 1)))
        return hashes, np.searchsorted(start, rows)
    parts, at = [], int(off[a])
    while at < off[b]:
        end = min(at + CHUNK_BYTES, int(off[b]))
        while end < off[b] and not _BLANK[raw[end]]:
            end += 1
        parts.append(_word_hashes(raw[at:end])[0])
        at = end
    hashes = np.concatenate(parts)
    return hashes, np.array([0, len(hashes)])


def prefix_size(n: int, similarity=SIMILARITY) -> int:
    return n - -(-similarity[0] * n // similarity[1]) + 1


def order_classes(counts: np.ndarray) -> np.ndarray:
    """Sketch counts → 16-bit classes in their order, finer than 2 %."""
    return np.minimum(np.round(np.log2(counts.astype(np.float64) + 1) * 64), 65535).astype(np.uint16)


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - int(math.log2(SKETCH)))).astype(np.int64)


def ordered(shingles: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Sorted hashes → the global order: by class, then by hash."""
    return shingles[np.argsort(classes[_slot(shingles)], kind="stable")]


# ------------------------------------------------------------------ passes over texts
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()),
                    T.StructField("sig", T.LongType()), T.StructField("sig2", T.LongType()),
                    T.StructField("bits", T.BinaryType()), T.StructField("sketch", T.BinaryType())])


def _signature(s: np.ndarray) -> int:
    return int(_mix(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64))


def _signature2(s: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(_mix(s ^ _MULT), initial=np.uint64(0)).astype(np.int64))


def parity_bits(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles per slot, packed: two to four slots a shingle,
    a power of two, at least 64. Halves folded by XOR are the next smaller map."""
    slots = 1 << max(6, (2 * len(s) - 1).bit_length())
    at = (_mix(s + _MULT) & np.uint64(slots - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=slots).astype(np.uint8) & 1)


def _signatures(words: int):
    def run(batches):
        import zlib

        import pyarrow as pa

        sketch = np.zeros(SKETCH, np.int64)
        for b in batches:
            raw, off = utf8_buffer(b.column("text"))
            n, sig, sig2, bits, held = [], [], [], [], []
            for s in shingle_sets(raw, off, words):
                n.append(len(s))
                sig.append(_signature(s))
                bits.append(parity_bits(s).tobytes() if len(s) else None)
                sig2.append(_signature2(s))
                held.append(s)
                if len(held) >= 128:
                    sketch += np.bincount(_slot(np.concatenate(held)), minlength=SKETCH)
                    held = []
            if held:
                sketch += np.bincount(_slot(np.concatenate(held)), minlength=SKETCH)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, sig, sig2)],
                 pa.array(bits, pa.binary()), pa.nulls(b.num_rows, pa.binary())], names=DOC.fieldNames())
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.binary()),
                                          pa.array([zlib.compress(sketch.tobytes(), 1)], pa.binary())],
                                         names=DOC.fieldNames())
    return run


def _sum_sketches(batches):
    import zlib

    import pyarrow as pa

    total = np.zeros(SKETCH, np.int64)
    for b in batches:
        for x in b.column("sketch").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["sketch"])


def _total_sketch(sketches: DataFrame, n: int) -> np.ndarray:
    """Sketches added up by sixteens, on the executors."""
    import zlib

    while n > 1:
        n = -(-n // 16)
        sketches = sketches.repartition(n).mapInArrow(_sum_sketches, "sketch binary")
    total = np.zeros(SKETCH, np.int64)
    for r in sketches.collect():
        total += np.frombuffer(zlib.decompress(r.sketch), np.int64)
    return total


def _prefixes(classes, words: int, similarity):
    """``token, node`` of each row's prefix; a node is sent once per task (or
    a little more often)."""
    def run(batches):
        import pyarrow as pa

        seen: set = set()
        for b in batches:
            raw, off = utf8_buffer(b.column("text"))
            tokens, nodes = [], []
            for s in shingle_sets(raw, off, words):
                if not len(s):
                    continue
                # different sets of one signature both send their prefix, under one node
                node = _signature(s)
                if (both := (node, _signature2(s))) in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(both)
                head = ordered(s, classes.value)[:prefix_size(len(s), similarity)]
                tokens.append(head)
                nodes.append(np.full(len(head), node, np.int64))
            if tokens:
                tokens, nodes = np.concatenate(tokens).view(np.int64), np.concatenate(nodes)
                for i in range(0, len(tokens), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i:i + (1 << 18)]) for x in (tokens, nodes)],
                                                     names=["token", "node"])
    return run


def _bit(ids: np.ndarray) -> np.ndarray:
    return (_mix(ids.astype(np.int64).view(np.uint64) * _MULT) >> np.uint64(64 - int(math.log2(TABLE_BITS)))).astype(np.int64)


def _sets(bits, words: int):
    """``doc_id, sig, n, payload`` (sorted hashes) of rows in the bit table; a
    repeated row is sent once per task."""
    def run(batches):
        import pyarrow as pa

        table = np.frombuffer(bits.value, np.uint8)
        seen: set = set()
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            at = _bit(ids)
            rows = np.flatnonzero((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if not len(rows):
                continue
            raw, off = utf8_buffer(b.column("text").take(pa.array(rows)))
            out = []
            for i, s in zip(ids[rows].tolist(), shingle_sets(raw, off, words)):
                if len(s) and (i, sig := _signature(s)) not in seen:
                    seen.add((i, sig))
                    out.append((i, sig, len(s), s.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
                    zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "sig", "n", "payload"])
    return run


def _set_bits(batches):
    import pyarrow as pa

    for b in batches:
        at = _bit(b.column("doc_id").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.left_shift(1, at & 31))], names=["w", "v"])


def _bit_table(ids: DataFrame) -> bytes:
    """A bit for each id, a table of fixed size; more ids only make it less
    selective."""
    words = (ids.mapInArrow(_set_bits, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v"))
                .toPandas())
    table = np.zeros(TABLE_BITS // 32, np.uint32)
    table[words["w"].to_numpy()] = words["v"].to_numpy().astype(np.uint32)
    return table.tobytes()


# ------------------------------------------------------------------ the trie
class Trie:
    """Radix trie of non-empty sets of local token numbers (sorted arrays)."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.order = np.array(order)
        runs, parent, depth, spans, leaves = [], [], [], [], []
        path: list[int] = []  # edges from the root to the last set

        def edge(tokens, up, end, first):
            path.append(len(runs))
            runs.append(tokens)
            parent.append(up)
            depth.append(end)
            spans.append([first, first])

        last = np.zeros(0, np.int64)
        for where, i in enumerate(order):
            s = sets[i]
            m = min(len(s), len(last))
            diff = np.flatnonzero(s[:m] != last[:m])
            common = int(diff[0]) if len(diff) else m
            while path and depth[path[-1]] - len(runs[path[-1]]) >= common:
                path.pop()
            if path and depth[path[-1]] > common:  # cut the edge where the new set leaves it
                e = path.pop()
                keep = len(runs[e]) - (depth[e] - common)
                edge(runs[e][:keep], parent[e], common, spans[e][0])
                runs[e], parent[e] = runs[e][keep:], path[-1]
            if common < len(s):
                edge(s[common:], path[-1] if path else -1, len(s), where)
            leaves.append(path[-1])
            for e in path:
                spans[e][1] = where + 1
            last = s
        self.parent, self.depth = np.array(parent), np.array(depth)
        self.spans, self.leaf = np.array(spans), np.array(leaves)
        self.size = np.array([len(r) for r in runs])
        self.tokens = np.concatenate(runs)
        self.start = np.cumsum(self.size) - self.size
        self.last_token = np.array([r[-1] for r in runs])
        self.lengths = np.array([len(sets[i]) for i in order])
        self.shortest = np.array([self.lengths[a:b].min() for a, b in spans])
        self.longest = np.array([self.lengths[a:b].max() for a, b in spans])
        # edges by level, from the root
        level = np.zeros(len(runs), np.int64)
        for e in np.argsort(self.depth - self.size, kind="stable"):
            level[e] = 0 if parent[e] < 0 else level[parent[e]] + 1
        self.levels = [np.flatnonzero(level == k) for k in range(int(level.max()) + 1)]

    def linked(self, x: np.ndarray, member: np.ndarray, wanted: np.ndarray, similarity) -> np.ndarray:
        """Positions (in ``order``) of wanted sets that link with the sorted set
        ``x``; ``member`` marks its tokens."""
        num, den = similarity
        n = len(x)
        need = lambda m: -(-num * (n + m) // (num + den))  # overlap that links sizes n and m
        lo, hi = -(-num * n // den), den * n // num
        ahead = np.concatenate(([0], np.cumsum(wanted & (self.lengths >= lo) & (self.lengths <= hi))))
        overlap = np.zeros(len(self.parent) + 1, np.int64)  # the last: above the root
        alive = np.zeros(len(self.parent) + 1, bool)
        alive[-1] = True
        useful = ahead[self.spans[:, 1]] > ahead[self.spans[:, 0]]
        for edges in self.levels:
            e = edges[alive[self.parent[edges]] & useful[edges]]
            if not len(e):
                break
            size = self.size[e]
            at = np.repeat(self.start[e] - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(size.sum())
            hits = np.concatenate(([0], np.cumsum(member[self.tokens[at]])))
            ends = np.cumsum(size)
            o = overlap[self.parent[e]] + hits[ends] - hits[ends - size]
            overlap[e] = o
            short, long = np.maximum(self.shortest[e], lo), np.minimum(self.longest[e], hi)
            passed = np.searchsorted(x, self.last_token[e], "right")
            # what the longest sets below may miss, what x may miss against the shortest
            alive[e] = (self.depth[e] - o <= long - need(long)) & (passed - o <= n - need(short))
        leaf = self.leaf
        o = overlap[leaf]
        ok = wanted & alive[leaf] & (den * o >= num * (n + self.lengths - o))
        return np.flatnonzero(ok)


def _find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


class Connected:
    """What the members of a group are connected to."""

    def __init__(self, groups):
        known: dict[int, int] = {}
        self.root = [known.setdefault(g, i) for i, g in enumerate(groups)]
        self.links: list[tuple[int, int]] = []

    def others(self, p: int, members) -> np.ndarray:
        mine = _find(self.root, p)
        return np.array([_find(self.root, i) != mine for i in members], bool)

    def link(self, p: int, i: int) -> None:
        a, b = _find(self.root, p), _find(self.root, i)
        if a != b:
            self.root[a] = b
            self.links.append((p, i))


def _group_trie(payloads, store, classes):
    """A group's sets as local numbers, the trie of the stored ones, their
    positions in the trie's order, and an empty mark of all numbers."""
    sets = [np.frombuffer(x, np.uint64) for x in payloads]
    every = np.unique(np.concatenate(sets))
    # frequent first: paths are shared near the root
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, -classes[_slot(every)].astype(np.int64)))] = np.arange(len(every))
    local = [np.sort(rank[np.searchsorted(every, s)]) for s in sets]
    inside = np.flatnonzero(store)
    trie = Trie([local[i] for i in inside])
    members = inside[trie.order]
    return local, trie, members, np.zeros(len(every), bool)


def trie_links(groups, lengths, payloads, probe, store, classes, similarity=SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect the sets of a group. ``payloads`` are hash arrays as
    bytes, ``groups`` what each set is already connected to; ``probe`` and
    ``store`` say which are probes and which are in the trie."""
    local, trie, members, mark = _group_trie(payloads, store, classes)
    state = Connected(groups)
    for p in np.flatnonzero(probe):
        wanted = state.others(p, members)
        if wanted.any():
            mark[local[p]] = True
            for at in trie.linked(local[p], mark, wanted, similarity):
                state.link(p, members[at])
            mark[local[p]] = False
    return state.links


def trie_pairs(groups, lengths, payloads, probe, store, classes, similarity=SIMILARITY) -> list[tuple[int, int]]:
    """All links between probes and stored sets, a pair of sets that are both
    only once. Parameters as for :func:`trie_links`."""
    local, trie, members, mark = _group_trie(payloads, store, classes)
    links = []
    for p in np.flatnonzero(probe):
        wanted = (members > p) | ~np.asarray(probe)[members]
        if store[p]:
            wanted &= members != p
        if wanted.any():
            mark[local[p]] = True
            links += [(p, int(members[at])) for at in trie.linked(local[p], mark, wanted, similarity)]
            mark[local[p]] = False
    return links


def _folded(maps: np.ndarray, width: int) -> np.ndarray:
    while maps.shape[-1] > width:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


def bitmap_links(groups, lengths, payloads, probe, store, classes, similarity=SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect the members of a group whose parity bitmaps do not
    rule out the similarity."""
    num, den = similarity
    lengths = np.array(lengths, np.int64)
    maps = [np.frombuffer(x, np.uint8) for x in payloads]
    inside = np.flatnonzero(store)
    by_width: dict[int, np.ndarray] = {}
    for width in sorted({len(maps[i]) for i in inside}):
        by_width[width] = np.array([i for i in inside if len(maps[i]) == width])
    stacked = {width: np.stack([maps[i] for i in rows]) for width, rows in by_width.items()}
    state = Connected(groups)
    for p in np.flatnonzero(probe):
        n, own = int(lengths[p]), maps[p]
        for width, rows in by_width.items():
            m = lengths[rows]
            near = np.flatnonzero((den * m >= num * n) & (den * n >= num * m))
            near = near[state.others(p, rows[near])]
            if not len(near):
                continue
            common = min(width, len(own))
            apart = np.bitwise_count(_folded(stacked[width][near], common) ^ _folded(own, common)).sum(1, dtype=np.int64)
            most = (n + m[near] - apart) // 2
            for k in near[den * most >= num * (n + m[near] - most)]:
                state.link(p, rows[k])
    return state.links


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _join_groups(kernel, classes, similarity):
    """mapInArrow function over rows sorted by ``home, i, j``."""
    def run(batches):
        import pyarrow as pa

        key, held = None, []

        def links():
            rows = list({(r["doc_id"], r["sig"], r["probe"]): r for r in held}.values())
            if len(rows) < 2 or not any(r["store"] for r in rows) or not any(r["probe"] for r in rows):
                return []
            col = lambda name: [r[name] for r in rows]
            ids = col("doc_id")
            return [(ids[p], ids[i]) for p, i in kernel(col("connected"), col("n"), col("payload"), np.array(col("probe")),
                                                        np.array(col("store")), classes.value, similarity)]

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found)], names=["a", "b"])

        for b in batches:
            found = []
            for at in range(0, b.num_rows, ROWS):
                for r in b.slice(at, ROWS).to_pylist():
                    now = r["home"], r["i"], r["j"]
                    if now != key:
                        found += links()
                        key, held = now, []
                    held.append(r)
            if found:
                yield batch(found)
        if found := links():
            yield batch(found)
    return run


def _blocks(block: int, each: float, block_bytes: int):
    """Blocks that the members of a group take, by number and by bytes."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") * each / block_bytes)).cast("int")


def links(meet: DataFrame, payload: DataFrame, kernel, block: int, each: float, classes, similarity=SIMILARITY,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links that ``kernel`` finds among the classes that ``meet`` (``home, doc_id,
    sig, size``), given their ``payload`` (``doc_id, sig, n, payload``), of ``each``
    bytes a shingle."""
    zero, yes, no = F.lit(0), F.lit(True), F.lit(False)
    part = lambda n: F.pmod(F.xxhash64("doc_id", "sig"), n).cast("int")

    def run(rows: DataFrame) -> DataFrame:
        cols = ["home", "i", "j", "doc_id", "sig", "connected", "probe", "store", "n", "payload"]
        return (rows.join(payload, ["doc_id", "sig"]).select(*cols).repartition("home", "i", "j")
                    .sortWithinPartitions("home", "i", "j").mapInArrow(_join_groups(kernel, classes, similarity), LINK))

    # homes above a block: a small table that a skewed home cannot unbalance
    blocks = _blocks(block, each, block_bytes)
    heavy = staged(meet.groupBy("home").agg(blocks.alias("g")).where(F.col("g") > 1), "ngram-heavy")
    meet = meet.join(heavy, "home", "left")
    small = meet.where(F.col("g").isNull()).select(
        "home", zero.alias("i"), zero.alias("j"), "doc_id", "sig", F.col("doc_id").alias("connected"),
        yes.alias("probe"), yes.alias("store"))
    big = staged(meet.where(F.col("g").isNotNull()), "ngram-hot")
    if not big.limit(1).count():
        return run(small)
    home = F.col("doc_id") == F.col("home")
    every = F.explode(F.sequence(zero, F.col("g") - 1))
    star = (big.where(~home).select("home", zero.alias("i"), part(F.col("g")).alias("j"), "doc_id", "sig",
                                    F.col("doc_id").alias("connected"), no.alias("probe"), yes.alias("store"))
            .unionByName(big.where(home).select("home", zero.alias("i"), every.alias("j"), "doc_id", "sig",
                                                F.col("doc_id").alias("connected"), yes.alias("probe"), no.alias("store"))))
    first = staged(run(star), "ngram-star")
    linked = first.select(F.col("a").alias("home"), F.col("b").alias("doc_id")).distinct().withColumn("l", yes)
    state = staged(big.where(~home).join(linked, ["home", "doc_id"], "left")
                   .withColumn("l", F.coalesce("l", no)), "ngram-state")
    loose = staged(state.where(~F.col("l")).groupBy("home").agg(blocks.alias("h")), "ngram-loose")
    state = state.join(loose, "home")
    other = F.pmod(F.xxhash64("sig", "doc_id"), F.col("h")).cast("int")
    rest = (state.select("home", F.explode(F.sequence(zero, F.col("h") - 1)).alias("i"), part(F.col("g")).alias("j"),
                         "doc_id", "sig", F.when(F.col("l"), F.col("home")).otherwise(F.col("doc_id")).alias("connected"),
                         no.alias("probe"), yes.alias("store"))
            .unionByName(state.where(~F.col("l")).select(
                "home", other.alias("i"), every.alias("j"), "doc_id", "sig", F.col("doc_id").alias("connected"),
                yes.alias("probe"), no.alias("store"))))
    return run(small).unionByName(first).unionByName(run(rest))


def every_link(meet: DataFrame, payload: DataFrame, block: int, classes, similarity=SIMILARITY,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All links within the groups of ``meet``: blocks of a group meet pairwise,
    each pair of blocks in a task of its own."""
    blocks = _blocks(block, SET_BYTES, block_bytes)
    heavy = staged(meet.groupBy("home").agg(blocks.alias("g")).where(F.col("g") > 1), "ngram-heavy")
    parts = meet.join(heavy, "home", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    parts = parts.withColumn("p", F.pmod(F.xxhash64("doc_id", "sig"), F.col("g")).cast("int"))
    parts = parts.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = parts.select("home", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "doc_id", "sig",
                        F.col("doc_id").alias("connected"), (F.col("p") <= F.col("o")).alias("probe"),
                        (F.col("p") >= F.col("o")).alias("store"))
    cols = ["home", "i", "j", "doc_id", "sig", "connected", "probe", "store", "n", "payload"]
    return (rows.join(payload, ["doc_id", "sig"]).select(*cols).repartition("home", "i", "j")
                .sortWithinPartitions("home", "i", "j").mapInArrow(_join_groups(trie_pairs, classes, similarity), LINK))


@dataclass
class Prepared:
    """What both forms of the join start from."""

    rows: DataFrame      # doc_id, n, sig, sig2 of every row
    group: DataFrame     # sig, sig2, n, rep: classes of equal sets
    clusters: DataFrame  # home, doc_id, sig, size: classes that may be linked
    sets: DataFrame      # doc_id, sig, n, payload of (at least) those
    classes: object      # broadcast order classes


def _prepare(docs: DataFrame, key: str, text: str, words: int, similarity, block: int, block_bytes: int) -> Prepared:
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first = staged(texts.mapInArrow(_signatures(words), DOC), "ngram-docs")
    sketches = first.where(F.col("sketch").isNotNull()).select("sketch")
    counts = _total_sketch(sketches, sketches.count())
    classes = spark.sparkContext.broadcast(order_classes(counts))
    rows = first.where(F.col("sketch").isNull()).select("doc_id", "n", "sig", "sig2")
    own = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    group = staged(own.groupBy("sig", "sig2", "n").agg(F.min("doc_id").alias("rep")), "ngram-classes")

    known = texts.where(F.col("doc_id").isNotNull())
    prefix = known.mapInArrow(_prefixes(classes, words, similarity), "token long, node long")
    homes = (prefix.groupBy("token").agg(F.min("node").alias("home"), F.max("node").alias("far"))
                   .where("home <> far").select("token", "home"))
    homes = staged(homes, "ngram-tokens")
    met = staged(prefix.join(homes, "token").select("home", "node").distinct(), "ngram-meet")
    reps = group.select(F.col("sig").alias("node"), "rep", F.col("n").alias("size"))
    discard(homes)
    meet = (met.join(reps, "node").select("home", F.col("node").alias("sig"), F.col("rep").alias("doc_id"), "size")
               .join(reps.select(F.col("node").alias("home"), F.col("rep").alias("home_id")), "home")
               .select(F.col("home_id").alias("home"), "doc_id", "sig", "size"))
    maps = (first.where(F.col("bits").isNotNull() & F.col("doc_id").isNotNull())
                 .select("doc_id", "sig", "n", F.col("bits").alias("payload")))
    meet = staged(meet, "ngram-homes")
    discard(met)
    near = components(links(meet, maps, bitmap_links, MAP_BLOCK if block == BLOCK else block,
                            MAP_BYTES, classes, similarity, block_bytes))
    clusters = near.select(F.col("b").alias("home"), F.col("a").alias("doc_id")).unionByName(
        near.select(F.col("b").alias("home"), F.col("b").alias("doc_id")).distinct())
    discard(meet)
    clusters = staged(clusters.join(reps.select(F.col("node").alias("sig"), F.col("rep").alias("doc_id"), "size"), "doc_id"),
                      "ngram-clusters")
    bits = spark.sparkContext.broadcast(_bit_table(clusters.select("doc_id")))
    sets = staged(known.mapInArrow(_sets(bits, words), "doc_id long, sig long, n long, payload binary"), "ngram-sets")
    discard(near)
    return Prepared(rows, group, clusters, sets, classes)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                    similarity: tuple[int, int] = SIMILARITY, block: int = BLOCK,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key, n_shingles, component_id`` of every row: rows are in a component if
    links of at least the similarity connect them; its id is its smallest key."""
    p = _prepare(docs, key, text, words, similarity, block, block_bytes)
    joined = components(links(p.clusters, p.sets, trie_links, block, SET_BYTES, p.classes, similarity, block_bytes))
    discard(p.sets, p.clusters)
    label = (p.group.join(joined.select(F.col("a").alias("rep"), F.col("b").alias("top")), "rep", "left")
                  .select("sig", "sig2", "n", F.coalesce("top", "rep").alias("component")))
    out = p.rows.join(label, ["sig", "sig2", "n"], "left")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def similar_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                  similarity: tuple[int, int] = SIMILARITY, block: int = BLOCK,
                  block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The join itself: ``a, b`` (a < b), every pair of classes of equal sets that
    reaches the similarity, by their smallest keys; and the members, ``key,
    class_id`` of every row with words and a key. Equal sets are not expanded into
    pairs. The pairs of a family grow with the square of its classes."""
    p = _prepare(docs, key, text, words, similarity, block, block_bytes)
    found = every_link(p.clusters, p.sets, block, p.classes, similarity, block_bytes)
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    members = (p.rows.where(F.col("doc_id").isNotNull()).join(p.group, ["sig", "sig2", "n"])
                     .select(F.col("doc_id").alias(key), F.col("rep").alias("class_id")))
    return pairs, members
