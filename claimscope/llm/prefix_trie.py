"""The prefix trie of conversations, from padded turn-id matrices.

Turns become 128-bit ids (of role and text) with their number of words; texts are not
read again. Conversations are numbered, rebuilt and cut into pieces of ``width``
turns. A piece is known by its slab (which piece of its conversation it is), the
prefix before it (a 128-bit sum over the earlier pieces) and its ids; equal pieces are
one row with the number of their conversations, so that groups of copies are one row
before anything is sorted.

The distinct pieces are range-sharded by (slab, prefix, ids). A shard is a matrix of
turn ids, one row per piece, padded; ``numpy.lexsort`` orders it, and the column-wise
changes between neighbouring rows, accumulated by OR, mark where a node starts at
every depth. ``reduceat`` over the starts aggregates every depth. Each node is charged
to the one row that starts it, so that subtree sums are sums over rows: a row brings
``words * (conversations - started here)`` of each turn to all nodes above. A shard also
sees the last row of the shard before it and the first of the one after, so that
starts are exact at its edges; nodes that go on beyond a shard or a slab, and those
right below them, leave it with a key, and their parts are added up by it. All others
are final.

Long conversations are not gathered: turns are numbered by running counts over range
partitions, pieces are of bounded width, prefix sums and the sums below a piece run
over range partitions of pieces too. Ends of conversations are digested by joining
ids to chunks in range partitions and hashing the chunks in order; SHA-256 is
sequential, so one node's digest is made by one task, one chunk in memory.

Defined cases: null role or text is empty; turns come by number, null first, then by
the hash of role and text; repeated rows are turns of their own; rows without a
conversation id belong to no conversation; a conversation none of whose turns is left
is a member of the root; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.staging import staged

#: Turns in a piece, turns in a shard, characters of a chunk of ids.
WIDTH, SHARD, CHUNK = 64, 50_000, 1 << 20
#: A conversation starts with turns of the one whose id is the next lower multiple.
FAMILY, MOST_SHARED = 20, 3
WORD = r"[^\x20\x09-\x0D]++"


def running(rows: DataFrame, group: str, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with running totals within ``group``: for each name in
    ``sums`` the sum of the column over the rows of the group before it.

    Rows are range-partitioned by group and order. Totals within a partition are
    added to those of the group's earlier partitions, of which there are at most as
    many rows as partitions."""
    kept = rows.columns
    order = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    by = [f"_o{i}" for i in range(len(order))]
    spread = rows.select("*", *order, *[c.alias(f"_v_{n}") for n, c in sums.items()])
    spread = staged(spread.repartitionByRange(group, *by).withColumn("_pid", F.spark_partition_id()), name)
    parts = spread.groupBy(group, "_pid").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col(group).alias("_g"), F.col("_pid").alias("_p"),
                          *[F.sum(f"_t_{n}").over(earlier).alias(f"_b_{n}") for n in sums])
    # only the first group of a partition can have begun in an earlier one
    before = before.where(F.col(f"_b_{next(iter(sums))}").isNotNull())
    inside = Window.partitionBy("_pid", group).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    run = spread.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(inside), zero).alias(f"_i_{n}") for n in sums])
    joined = run.join(F.broadcast(before), (F.col(group) == F.col("_g")) & (F.col("_pid") == F.col("_p")), "left")
    return joined.select(*kept, *[(F.col(f"_i_{n}") + F.coalesce(f"_b_{n}", zero)).alias(n) for n in sums])


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, id, words``: the turns of each conversation from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    # narrow rows, so that the sampling of the ranges reads no text
    return running(staged(turns, "trie-ids"), "conv_id", [F.col("turn").isNotNull(), F.col("turn"), F.col("id")],
                   {"pos": F.lit(1).cast("long")}, "trie-turns").select("conv_id", "pos", "id", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``numbered`` turns → the turns of the rebuilt conversations (``conv_id, pos,
    id, words, length``) and the ids of those without any.

    Conversation c starts with the first ``crc32(c) % 4`` turns of its family's first,
    in place of as many of its own."""
    head = F.when(F.col("pos") < MOST_SHARED, F.struct("pos", "id", "words"))
    whole = staged(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(head)).alias("head")),
                   "trie-conversations")
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    lent = whole.select(F.col("conv_id").alias("_first"), F.col("head").alias("_head"))
    given = (whole.select("conv_id", "n", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("_first"))
                  .join(lent, "_first", "left")
                  .withColumn("_lent", F.filter("_head", lambda x: x["pos"] < F.col("h"))))
    taken = F.when(F.col("_lent").isNull(), 0).otherwise(F.size("_lent")).cast("long")
    given = staged(given.select("conv_id", "h", "_lent", taken.alias("taken"),
                                (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-heads")
    own = (turns.join(given.select("conv_id", "h", "taken", "length"), "conv_id").where(F.col("pos") >= F.col("h"))
                .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "words", "length"))
    first = (given.select("conv_id", "length", F.explode("_lent").alias("x"))
                  .select("conv_id", "x.pos", "x.id", "x.words", "length"))
    return own.unionByName(first), given.where(F.col("length") == 0).select("conv_id")


def prefix_text(sums: list[Column]) -> Column:
    """Four running sums as one text of fixed length."""
    return F.concat(*[F.lpad(F.lower(F.hex(s)), 16, "0") for s in sums])


def pieces(turns: DataFrame, turnless: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per piece of a rebuilt conversation, staged: ``conv_id, slab, prefix, ids``
    (16 bytes a turn), ``words``, ``last`` (the conversation ends in it), ``many`` (it
    has several pieces)."""
    slab = F.expr(f"cast(pos div {width} as int)")
    cut = (turns.groupBy("conv_id", slab.alias("slab"))
                .agg(F.sort_array(F.collect_list(F.struct("pos", "id", "words"))).alias("t"), F.max("length").alias("length")))
    cut = cut.select("conv_id", "slab", F.unhex(F.array_join(F.transform("t", lambda x: x["id"]), "")).alias("ids"),
                     F.transform("t", lambda x: x["words"]).alias("words"),
                     (F.expr(f"(length - 1) div {width}") == F.col("slab")).alias("last"),
                     (F.col("length") > width).alias("many"))
    none = turnless.select("conv_id", F.lit(0).alias("slab"), F.lit(b"").alias("ids"), F.array().cast("array<long>").alias("words"),
                           F.lit(True).alias("last"), F.lit(False).alias("many"))
    cut = staged(cut.unionByName(none), "trie-cut")
    mark = F.md5(F.concat(F.col("slab").cast("string").cast("binary"), F.col("ids")))
    four = {f"p{i}": F.conv(F.substring(mark, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}
    long = running(cut.where("many"), "conv_id", [F.col("slab")], four, "trie-long")
    zero = F.lit("0" * 64)
    return staged(cut.where("not many").withColumn("prefix", zero).unionByName(
        long.withColumn("prefix", prefix_text([F.col(n) for n in four])).drop(*four)), "trie-pieces")


def end_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``piece, conv_id`` → ``piece, ends_sha256``: the digest of each piece's ids,
    ascending, comma-joined."""
    dealt = ends.repartitionByRange("piece", "conv_id").sortWithinPartitions("piece", "conv_id")
    chunks = dealt.mapInArrow(_chunks(chunk), "piece string, first long, said string")
    ordered = chunks.repartition("piece").sortWithinPartitions("piece", "first")
    return ordered.mapInArrow(_digests, "piece string, ends_sha256 string")


def _chunks(most: int):
    def run(batches):
        import pyarrow as pa

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))],
                                              names=["piece", "first", "said"])

        now, held, length = None, [], 0
        for b in batches:
            out = []
            for piece, conv in zip(b.column("piece").to_pylist(), b.column("conv_id").to_pylist()):
                if held and (piece != now or length >= most):
                    out.append((now, held[0], ",".join(map(str, held))))
                    held, length = [], 0
                now = piece
                held.append(conv)
                length += 12
            if out:
                yield batch(out)
        if held:
            yield batch([(now, held[0], ",".join(map(str, held)))])
    return run


def _digests(batches):
    import hashlib

    import pyarrow as pa

    now, sha = None, None
    for b in batches:
        out = []
        for piece, said in zip(b.column("piece").to_pylist(), b.column("said").to_pylist()):
            if piece != now:
                if sha:
                    out.append((now, sha.hexdigest()))
                now, sha = piece, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(said.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=["piece", "ends_sha256"])
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], names=["piece", "ends_sha256"])


def classes(cut: DataFrame) -> DataFrame:
    """The distinct pieces, staged: ``piece`` (a hash), ``slab, prefix, ids, words``,
    ``n`` (conversations), ``first`` (the smallest), ``n_on`` (those that go on)."""
    return staged(cut.groupBy("piece", "slab", "prefix", "ids").agg(
        F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"),
        F.count(F.when(~F.col("last"), 1)).alias("n_on")), "trie-classes")


# ---------------------------------------------------------------- shards

SHARDED = ["slab", "prefix", "ids"]


def shards(rows: DataFrame, shard: int) -> int:
    """The number of shards for ``classes``: rows of about ``shard`` turns each."""
    turns = rows.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    return max(1, math.ceil(turns / shard))


def sharded(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` in ``n`` range shards, staged, with ``_shard`` and ``_side`` 0, and for
    each shard the rows next to it on either side (``_side`` -1 and 1)."""
    dealt = staged(rows.repartitionByRange(n, *SHARDED).withColumn("_shard", F.spark_partition_id()), "trie-shards")
    edge = F.struct(*SHARDED)
    edges = dealt.groupBy("_shard").agg(F.min(edge).alias("low"), F.max(edge).alias("high"))
    w = Window.orderBy("_shard")  # a row per shard
    edges = edges.select("_shard", F.lag("high").over(w).alias("before"), F.lead("low").over(w).alias("after"))
    beside = edges.select("_shard", F.explode(F.array(
        F.struct(F.lit(-1).alias("_side"), F.col("before").alias("x")),
        F.struct(F.lit(1).alias("_side"), F.col("after").alias("x")))).alias("s"))
    beside = beside.where(F.col("s.x").isNotNull()).select("_shard", "s._side", *[F.col(f"s.x.{c}").alias(c) for c in SHARDED])
    return dealt.withColumn("_side", F.lit(0)).unionByName(beside, allowMissingColumns=True)


class Matrix:
    """The turn-id matrix of a shard: rows in order, starts of nodes at every depth."""

    def __init__(self, table):
        side = table.column("_side").to_numpy()
        slab = table.column("slab").to_numpy()
        prefix = table.column("prefix").to_pylist()
        ids = table.column("ids").to_pylist()
        size = np.array([len(x) // 16 for x in ids], np.int64)
        cols = int(size.max(initial=0))
        # ids as ranks in byte order, padded with 0
        flat = np.frombuffer(b"".join(ids), ">u8").reshape(-1, 2).astype(np.uint64)
        order = np.lexsort((flat[:, 1], flat[:, 0]))
        new = np.ones(len(flat), bool)
        if len(flat):
            s = flat[order]
            new[1:] = (s[1:] != s[:-1]).any(1)
        rank = np.empty(len(flat), np.int32)
        rank[order] = np.cumsum(new)
        matrix = np.zeros((len(ids), cols), np.int32)
        at = np.arange(cols)[None, :] < size[:, None]
        matrix[at] = rank
        known = {x: i for i, x in enumerate(sorted(set(prefix)))}
        group = np.array([known[x] for x in prefix], np.int64)
        keys = [matrix[:, c] for c in range(cols - 1, -1, -1)] + [group, slab]
        self.order = np.lexsort(keys)
        m, group, slab, size, side = (x[self.order] for x in (matrix, group, slab, size, side))
        change = np.ones((len(m), cols + 2), bool)
        change[1:, 0] = (group[1:] != group[:-1]) | (slab[1:] != slab[:-1])
        change[1:, 1:cols + 1] = m[1:] != m[:-1]
        start = np.logical_or.accumulate(change, axis=1)
        own = np.flatnonzero(side == 0)
        a, b = own[0], own[-1] + 1
        # the next row, if any, tells which nodes go on after the last
        self.after = start[b] if b < len(m) else np.ones(cols + 2, bool)
        self.order, self.start, self.size, self.slab, self.cols = self.order[a:b], start[a:b], size[a:b], slab[a:b], cols
        self.prefix, self.ids = [prefix[i] for i in self.order], [ids[i] for i in self.order]
        follows = np.vstack((self.start[1:], self.after[None, :]))
        #: rows that no other row of the slab extends
        self.tip = follows[np.arange(b - a), self.size]


def _taken(table, name: str, order) -> np.ndarray:
    return table.column(name).take(order).to_numpy()


def _brought(mx: Matrix, words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What each row brings to the nodes at each depth: the sums from there on."""
    depth = np.arange(1, mx.cols + 1)[None, :]
    each = words * (n[:, None] - mx.start[:, 1:mx.cols + 1]) * (depth <= mx.size[:, None])
    return np.cumsum(each[:, ::-1], axis=1)[:, ::-1]


def _padded_words(mx: Matrix, table) -> np.ndarray:
    out = np.zeros((len(mx.size), mx.cols), np.int64)
    out[np.arange(mx.cols)[None, :] < mx.size[:, None]] = [
        w for row in (table.column("words")[int(i)].as_py() for i in mx.order) for w in row]
    return out


CHARGE = T.StructType([T.StructField("piece", T.StringType()), T.StructField("saved", T.LongType()),
                       T.StructField("leaves", T.LongType())])


def _charges(table):
    """What the pieces of a shard bring to the nodes above their slab."""
    import pyarrow as pa

    mx = Matrix(table)
    n, on = _taken(table, "n", mx.order), _taken(table, "n_on", mx.order)
    brought = _brought(mx, _padded_words(mx, table), n)
    saved = brought[:, 0] if mx.cols else np.zeros(len(n), np.int64)
    piece = [table.column("piece")[int(i)].as_py() for i in mx.order]
    return pa.table([pa.array(piece, pa.string()), pa.array(saved, pa.int64()),
                     pa.array((mx.tip & (on == 0)).astype(np.int64))], names=CHARGE.fieldNames())


NODE = T.StructType([T.StructField("depth", T.LongType()), T.StructField("key", T.StringType()),
                     T.StructField("parent_key", T.StringType()), T.StructField("conv_id", T.LongType()),
                     T.StructField("parent_conv_id", T.LongType()), T.StructField("n_convs", T.LongType()),
                     T.StructField("n_children", T.LongType()), T.StructField("n_leaves", T.LongType()),
                     T.StructField("saved_tokens", T.LongType()), T.StructField("ends_sha256", T.StringType())])


def _next_prefix(slab: int, prefix: str, ids: bytes) -> str:
    from hashlib import md5

    mark = md5(str(slab).encode() + ids).hexdigest()
    return "".join(f"{int(prefix[16 * i:16 * i + 16], 16) + int(mark[8 * i:8 * i + 8], 16):016x}" for i in range(4))


def _nodes(width: int):
    """applyInArrow function: a shard's rows → its nodes, or parts of nodes."""
    def run(table):
        from hashlib import md5

        import pyarrow as pa

        mx = Matrix(table)
        rows = len(mx.size)
        get = lambda name: _taken(table, name, mx.order)
        n, on, first = get("n"), get("n_on"), get("first")
        below_saved, below_leaves = get("below_saved"), get("below_leaves")
        ends = [table.column("ends_sha256")[int(i)].as_py() for i in mx.order]
        brought = _brought(mx, _padded_words(mx, table), n) + below_saved[:, None]
        leaves = (mx.tip & (on == 0)) + below_leaves

        def key(row, d):
            slab, prefix, ids = int(mx.slab[row]), mx.prefix[row], mx.ids[row]
            if d == 0:
                return prefix
            return _next_prefix(slab, prefix, ids) if d == width else md5(prefix.encode() + ids[:16 * d]).hexdigest()

        out = {c: [] for c in NODE.fieldNames()}
        parent_of = np.zeros(rows, np.int64)  # the run at the depth above, per row
        parents = None
        for d in range(mx.cols + 1):
            there = mx.size >= d
            begins = mx.start[:, d] & there
            if not there.any():
                break
            lead = begins.copy()
            lead[np.flatnonzero(there)[0]] = True  # may go on from the shard before
            at = np.flatnonzero(lead)
            add = lambda x: np.add.reduceat(np.where(there, x, 0), at)
            count = add(n)
            least = np.minimum.reduceat(np.where(there, first, np.iinfo(np.int64).max), at)
            children = add(mx.start[:, d + 1] & (mx.size >= d + 1))
            tips = add(leaves)
            saved = add(brought[:, max(d, 1) - 1] if mx.cols else below_saved)
            ended = [ends[i] if mx.size[i] == d else None for i in at]
            # parts of nodes: those that go on beyond the shard or the slab
            part = ~begins[at]
            if there[-1] and not mx.after[d]:
                part[-1] = True
            if d == 0:
                part[:] = True
            elif d == width:
                part |= on[at] > 0
            slab = mx.slab[at]
            keys = np.array([key(r, d) if p else None for r, p in zip(at, part)], object)
            up = parent_of[at]
            pk, pc = np.full(len(at), None, object), np.full(len(at), None, object)
            if d:
                loose = parents["part"][up]
                pk = np.where(loose, parents["key"][up], None)
                pc = np.where(loose, None, parents["first"][up].astype(object))
            # the root of a deeper slab is a node of the one above: only its children are new
            deep = (slab > 0) & (d == 0)
            out["depth"] += (slab.astype(np.int64) * width + d).tolist()
            out["key"] += keys.tolist()
            out["parent_key"] += pk.tolist()
            out["conv_id"] += np.where(deep, None, least.astype(object)).tolist()
            out["parent_conv_id"] += pc.tolist()
            for name, x in (("n_convs", count), ("n_children", children), ("n_leaves", tips), ("saved_tokens", saved)):
                out[name] += (x if name == "n_children" else np.where(deep, 0, x)).tolist()
            out["ends_sha256"] += ended
            parents = {"part": part, "key": keys, "first": least}
            parent_of = np.cumsum(lead) - 1
        types = {"key": pa.string(), "parent_key": pa.string(), "ends_sha256": pa.string()}
        return pa.table([pa.array(v, types.get(c, pa.int64())) for c, v in out.items()], names=NODE.fieldNames())
    return run


NO_ENDS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # fixed value: SHA-256 of nothing


def trie(conversations: DataFrame, width: int = WIDTH, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """``conv_id, turn, role, text`` → a row per node: ``conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns = staged(numbered(conversations), "trie-numbered")
    cut = pieces(*rebuilt(turns), width)
    mark = F.md5(F.concat(F.concat_ws("/", F.col("slab").cast("string"), F.col("prefix")).cast("binary"), F.col("ids")))
    cut = cut.withColumn("piece", mark)
    rows = classes(cut)
    n_shards = shards(rows, shard)
    ends = end_digests(cut.where("last").select("piece", "conv_id"), chunk)
    zero = F.lit(0).cast("long")
    deep = rows.where(F.col("slab") > 0)
    if deep.limit(1).count():
        # what deeper pieces bring to the nodes above goes up along one of their conversations each
        charge = sharded(deep, shards(deep, shard)).groupBy("_shard").applyInArrow(_charges, CHARGE)
        charge = charge.join(deep.select("piece", F.col("first").alias("conv_id")), "piece")
        path = (cut.where("many").select("piece", "conv_id", "slab")
                   .join(charge.withColumnRenamed("piece", "_p").withColumnRenamed("conv_id", "_c"),
                         (F.col("piece") == F.col("_p")) & (F.col("conv_id") == F.col("_c")), "left"))
        path = running(path.select("piece", "conv_id", "slab", "saved", "leaves"), "conv_id", [-F.col("slab")],
                       {"below_saved": F.coalesce("saved", zero), "below_leaves": F.coalesce("leaves", zero)}, "trie-paths")
        below = path.groupBy("piece").agg(F.sum("below_saved").alias("below_saved"), F.sum("below_leaves").alias("below_leaves"))
        rows = rows.join(below, "piece", "left")
    else:
        rows = rows.withColumn("below_saved", zero).withColumn("below_leaves", zero)
    rows = rows.join(ends, "piece", "left").withColumn("below_saved", F.coalesce("below_saved", zero))
    rows = rows.withColumn("below_leaves", F.coalesce("below_leaves", zero)).drop("piece")
    found = staged(sharded(rows, n_shards).groupBy("_shard").applyInArrow(_nodes(width), NODE), "trie-nodes")
    return joined_parts(found)


def joined_parts(found: DataFrame) -> DataFrame:
    """The nodes of all shards: parts with the same key added up, parents looked up."""
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    parts = found.where(F.col("key").isNotNull())
    whole = staged(parts.groupBy("depth", "key").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("parent_conv_id").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in sums], F.max("ends_sha256").alias("ends_sha256")), "trie-parts")
    every = found.where(F.col("key").isNull()).drop("key").unionByName(whole.drop("key"))
    above = whole.select((F.col("depth") + 1).alias("_d"), F.col("key").alias("_k"), F.col("conv_id").alias("_up"))
    linked = every.join(above, (F.col("depth") == F.col("_d")) & (F.col("parent_key") == F.col("_k")), "left")
    return linked.select("conv_id", "depth", F.coalesce("_up", "parent_conv_id").alias("parent_conv_id"), *sums,
                         F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
