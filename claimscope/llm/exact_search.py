"""Exact top-k by inner product with a table of pivot distances.

Vectors become integers, ``floor(scale * x)``. A fixed number of pivots is chosen
among them. For every vector the distances to all pivots are computed once; for
a query q and a vector x each pivot p bounds their distance from below by
|d(q,p) - d(x,p)|, and the largest of these bounds d(q,x). Since
``2 q.x = |q|^2 + |x|^2 - d(q,x)^2``, that bounds the score from above. Candidates
are evaluated in the order of this bound, some at a time, until the k-th best score
found is above the next bound; the rest are eliminated. The pivots themselves are rows,
so a query's scores with them start it off with a k-th best score.

Vectors are packed into blocks of bounded size, and the blocks are dealt over tiles;
queries are packed into blocks likewise. A query block meets the vector blocks of a
tile in one task, one after the other, each with the k-th best scores found so far.
A task holds a tile and a query block, both of bounded bytes, and gives k rows per
query; the final ranking cuts per task before it shuffles. Shuffled are the vectors
once per query block and the queries once per tile. Nothing is broadcast but the
pivots, a fixed number of vectors, and nothing else reaches the driver.

Integers are exact at any size: vectors with a component beyond 2^26 go into blocks
of their own, which are computed in Python integers. A score among a query's best
that is outside the range of long is an error, not another value.

Defined cases: vectors that are null, or hold null or non-finite components, or have
no id, take no part; vectors are compared with
those of their own length; repeated rows are rows of their own, and a row with
the id of the query is never returned to it; repeated query ids are one query,
that of the smallest vector; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.staging import staged

PIVOTS = 48
#: Vectors in a block.
BLOCK = 1024
#: Bytes of a query block and of the vector blocks of a tile, about.
QUERY_BYTES, TILE_BYTES = 16 << 20, 32 << 20
#: Bytes of query copies that more tiles for more tasks may make, or a quarter of the vectors'.
COPIES = 64 << 20
#: Candidates evaluated before the first look at the bound; four times as many before each next one.
STEP = 64
#: Queries whose bounds are computed at once; the share of candidates from which all rows
#: of a block are multiplied at once instead of one by one.
CHUNK, DENSE = 64, 0.1
#: Up to here inner products are exact in int64.
LARGEST = 1 << 26


def integer_vectors(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``_id, _v`` (integers as an array of double, exact) of the vectors that take part."""
    # a NaN is the largest double in Spark's order
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    ok = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)

    def scaled(x: Column) -> Column:
        y = x.cast("double") * float(scale)
        # from 2^52 on every double is an integer
        return (F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).when(F.abs(y) < float("inf"), y)
                 .otherwise(F.raise_error(F.lit("vector component beyond the range of double")).cast("double")))

    return ok.select(F.col(key).cast("long").alias("_id"), F.transform(F.col(vector), scaled).alias("_v"))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` and ``b``: through doubles
    while every sum is exact in them, in Python integers beyond int64."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a.astype(object) @ b.astype(object).T


def _distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    na, n_p = (a * a).sum(1), (pivots * pivots).sum(1)
    return np.sqrt((na[:, None] + n_p[None, :] - 2 * _dot(a, pivots)).astype(np.float64))


def _norms(v: np.ndarray) -> np.ndarray:
    if v.dtype == object:
        return (v * v).sum(1).astype(np.float64)
    v = v.astype(np.float64)
    return (v * v).sum(1)


def _bounds(to_pivots: np.ndarray, q_to_pivots: np.ndarray, norm: np.ndarray, q_norm: np.ndarray) -> np.ndarray:
    """A bound above the score of each query (row) and vector (column)."""
    lower = np.zeros((len(q_norm), len(norm)))
    apart = np.empty_like(lower)
    for d, q in zip(to_pivots.T, q_to_pivots.T):
        np.subtract(d[None, :], q[:, None], out=apart)
        np.maximum(lower, np.abs(apart, out=apart), out=lower)
    far = to_pivots.max(1, initial=0.0)[None, :] + q_to_pivots.max(1, initial=0.0)[:, None]
    both = q_norm[:, None] + norm[None, :]
    upper = (both - lower * lower) / 2
    # a little above, for the rounding of the square roots and their difference
    return upper + np.abs(upper) * 1e-9 + (far * far + both) * 1e-12 + 1


def _pairs(queries: np.ndarray, vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the queries ``i`` with the vectors ``j``, a pair each."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    kind = np.int64 if most < 1 << 62 else object
    out = [np.zeros(0, kind)]
    for a in range(0, len(i), BLOCK * CHUNK):  # few at a time, they are copied
        at = slice(a, a + BLOCK * CHUNK)
        out.append((queries[i[at]].astype(kind) * vectors[j[at]].astype(kind)).sum(1))
    return np.concatenate(out)


class Found:
    """The best ``k`` of each of some queries among the candidates seen: ``q`` (number of
    the query), ``ids``, ``scores``, in order. ``worst`` is a score that k rows are known to
    reach, where ``known``."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k = k
        self.known = np.array([x != -math.inf for x in floor.tolist()], bool)
        self.worst = np.where(self.known, floor, 0).astype(np.int64) if floor.dtype.kind == "f" else floor.copy()
        self.q, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> np.ndarray:
        return np.where(self.known, self.worst.astype(np.float64), -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        stay = ~self.known[q] | (scores >= self.worst[q]).astype(bool)
        if not stay.any():
            return
        q, ids = np.concatenate((self.q, q[stay])), np.concatenate((self.ids, ids[stay]))
        scores = np.concatenate((self.scores, scores[stay]))
        if scores.dtype == object:
            order = np.array(sorted(range(len(q)), key=lambda i: (q[i], -scores[i], ids[i])), np.int64)
        else:
            order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.worst = self.worst.astype(np.result_type(self.worst, scores))
        self.worst[q[last]], self.known[q[last]] = scores[last], True
        stay = place < self.k
        self.q, self.ids, self.scores = q[stay], ids[stay], scores[stay]


def _search_block(ids: np.ndarray, vectors: np.ndarray, to_pivots: np.ndarray, norm: np.ndarray, q_ids: np.ndarray,
                  queries: np.ndarray, q_to_pivots: np.ndarray, found: Found) -> int:
    """Add to ``found`` the rows of a block that can be among a query's best; how many
    candidates no bound eliminated."""
    upper = _bounds(to_pivots, q_to_pivots, norm, _norms(queries))
    upper[ids[None, :] == q_ids[:, None]] = -np.inf
    left, evaluated, size, dense = (upper >= found.floor()[:, None]) & (upper > -np.inf), 0, STEP, None
    while left.any():
        take = left
        if size < len(ids):  # those with the largest bounds
            take = np.zeros_like(left)
            first = np.argpartition(np.where(left, -upper, np.inf), size, axis=1)[:, :size]
            np.put_along_axis(take, first, True, axis=1)
            take &= left
        i, j = np.nonzero(take)
        if dense is None and len(i) > DENSE * left.size:
            dense = _dot(queries, vectors)
        found.add(i, ids[j], _pairs(queries, vectors, i, j) if dense is None else dense[i, j])
        evaluated += len(i)
        left = left & ~take & (upper >= found.floor()[:, None])
        size *= 4
    return evaluated


def _search_blocks(blocks: list, q_ids: np.ndarray, queries: np.ndarray, q_to_pivots: np.ndarray, floor: np.ndarray, k: int):
    """``q, ids, scores, evaluated`` of some queries after the other: their best ``k`` rows in
    ``blocks`` (ids, vectors, distances to the pivots) that can be among their best ``k`` overall."""
    blocks = [(ids, v, np.asfortranarray(to_pivots), _norms(v)) for ids, v, to_pivots in blocks]
    for a in range(0, len(queries), CHUNK):
        at = slice(a, a + CHUNK)
        found = Found(k, floor[at])
        evaluated = sum(_search_block(*block, q_ids[at], queries[at], q_to_pivots[at], found) for block in blocks)
        yield a + found.q, found.ids, found.scores, evaluated


def pivot_search(ids: np.ndarray, vectors: np.ndarray, to_pivots: np.ndarray, q_ids: np.ndarray,
                 queries: np.ndarray, q_to_pivots: np.ndarray, floor: np.ndarray, k: int):
    """Each query's best ``k`` rows of a block that can be among its best ``k``
    overall. ``floor`` is a score that k rows are known to reach."""
    out, evaluated = [], 0
    for q, best, scores, n in _search_blocks([(ids, vectors, to_pivots)], q_ids, queries, q_to_pivots, floor, k):
        out += [(q_ids[i], best[q == i], scores[q == i]) for i in np.unique(q)]
        evaluated += n
    return out, evaluated


def _integers(stored: np.ndarray) -> np.ndarray:
    """Stored components: int32, or doubles that need Python integers."""
    if stored.dtype == np.int32:
        return stored.astype(np.int64)
    out = np.empty(stored.shape, object)
    out.ravel()[:] = [int(x) for x in stored.ravel().tolist()]
    return out


def _pack(size: int, pivots):
    """mapInArrow function: rows ``_id, _v, tag`` → blocks of a length and tag, with
    4 bytes a component, or 8 where one is beyond ``LARGEST``."""
    def run(batches):
        import pyarrow as pa

        held: dict[tuple, list] = {}

        def block(to):
            dim, tag, wide = to
            ids = np.array([x for x, _ in held[to]], np.int64)
            data = np.array([v for _, v in held[to]], np.float64).reshape(len(ids), dim)
            p = pivots.value.get(dim, np.zeros((0, dim), np.int64))
            held[to] = []
            stored = data if wide else data.astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in (
                    (dim, pa.int32()), (tag, pa.int32()), (len(ids), pa.int32()), (ids.tobytes(), pa.binary()),
                    (stored.tobytes(), pa.binary()), (_distances(_integers(stored), p).tobytes(), pa.binary()))],
                names=["dim", "tag", "n", "ids", "data", "table"])

        for b in batches:
            for i, v, tag in zip(b.column("_id").to_pylist(), b.column("_v"), b.column("tag").to_pylist()):
                v = v.values.to_numpy(zero_copy_only=False)
                to = len(v), tag, bool(np.abs(v).max(initial=0) > LARGEST)
                held.setdefault(to, []).append((i, v))
                if len(held[to]) >= size:
                    yield block(to)
        for to in held:
            if held[to]:
                yield block(to)
    return run


BLOCKS = "dim int, tag int, n int, ids binary, data binary, table binary"
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()),
                      T.StructField("score", T.LongType()), T.StructField("beyond", T.BooleanType()),
                      T.StructField("evaluated", T.LongType())])
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _unpack(blocks):
    """The blocks of an Arrow table: ids, vectors, distances to the pivots."""
    for i in range(blocks.num_rows):
        dim, n, ids, data, table = (blocks.column(c)[i].as_py() for c in ("dim", "n", "ids", "data", "table"))
        kind = np.int32 if len(data) == 4 * n * dim else np.float64
        yield (np.frombuffer(ids, np.int64), _integers(np.frombuffer(data, kind).reshape(n, dim)),
               np.frombuffer(table, np.float64).reshape(n, -1 if n else 0))


def _search(pivots, k: int):
    """Cogroup function: the vector blocks of a tile and the query blocks they meet."""
    def run(key, blocks, q_blocks):
        import pyarrow as pa

        dim = key[0].as_py()
        p = pivots.value.get(dim, np.zeros((0, dim), np.int64))
        p_ids = pivots.value.get(("ids", dim), np.zeros(0, np.int64))
        parts, tile = [], list(_unpack(blocks))
        for q_ids, queries, q_table in _unpack(q_blocks):
            scores = _dot(queries, p)
            own = q_ids[:, None] == p_ids[None, :]
            scores[own] = scores.min(initial=0) - 1
            floor = (np.partition(scores, len(p) - k, axis=1)[:, len(p) - k] if (~own).sum(1).min(initial=0) >= k
                     else np.full(len(queries), -np.inf))
            for q, ids, score, evaluated in _search_blocks(tile, q_ids, queries, q_table, floor, k):
                parts.append([q_ids[q], ids, np.clip(score, LEAST, MOST).astype(np.int64),
                              ((score < LEAST) | (score > MOST)).astype(bool), np.full(len(q), evaluated, np.int64)])
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], t) for t, c in zip(
            kinds, list(zip(*parts)) or [()] * len(kinds))], names=FOUND.fieldNames())
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
          scale: int = 1024, n_pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of each query
    (rows where ``is_query``), ties to smaller ids; exact."""
    spark = vectors.sparkSession
    base = integer_vectors(vectors, key, vector, scale)
    # a fixed number of pivots: the first distinct vectors in the order of the ids' hashes;
    # written, as the tasks' first rows are merged by a task then, not by the driver
    chosen: dict = {}
    small = base.where(F.forall("_v", lambda x: F.abs(x) <= float(LARGEST)))
    for r in staged(small.orderBy(F.xxhash64("_id"), "_id").limit(4 * n_pivots), "pivots").orderBy(F.xxhash64("_id"), "_id").collect():
        rows = chosen.setdefault(len(r._v), {})
        if len(rows) < n_pivots:
            rows.setdefault(tuple(r._v), r._id)
    table = {}
    for dim, rows in chosen.items():
        table[dim] = np.array(list(rows), np.int64).reshape(len(rows), dim)
        table["ids", dim] = np.array(list(rows.values()), np.int64)
    pivots = spark.sparkContext.broadcast(table)
    queries = staged(integer_vectors(vectors.where(is_query), key, vector, scale)
                     .groupBy("_id").agg(F.min("_v").alias("_v")), "queries")
    size = F.lit(8 + 8 * n_pivots) + 4 * F.size("_v")
    bytes_of = lambda df: df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    total, asked = bytes_of(base), bytes_of(queries)
    n_blocks = max(1, math.ceil(asked / QUERY_BYTES))
    tagged = queries.withColumn("tag", F.pmod(F.xxhash64("_id"), F.lit(n_blocks)).cast("int"))
    q_blocks = tagged.repartition(n_blocks, "tag").mapInArrow(_pack(1 << 30, pivots), BLOCKS)
    # every vector block meets every query block of its length; small tables are dealt over
    # more tiles, so that a few query blocks still make many tasks
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = max(1, math.ceil(total / TILE_BYTES),
                min(math.ceil(partitions / n_blocks), max(COPIES, total // 4) // max(1, asked)))
    blocks = (base.withColumn("tag", F.lit(0)).mapInArrow(_pack(BLOCK, pivots), BLOCKS).drop("tag")
              .withColumn("tile", F.pmod(F.xxhash64("ids"), F.lit(tiles)).cast("int"))
              .withColumn("tag", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    q_blocks = q_blocks.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    to = ["dim", "tag", "tile"]  # four partitions a task, so that few get two
    blocks, q_blocks = (df.repartition(4 * tiles * n_blocks, *to).groupBy(*to) for df in (blocks, q_blocks))
    found = blocks.cogroup(q_blocks).applyInArrow(_search(pivots, k), FOUND)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = (found.select("query_id", "vec_id", "score", "beyond").withColumn("rank", F.row_number().over(w))
                   .where(F.col("rank") <= k))
    return ranked.select("query_id", "rank", "vec_id", F.when(F.col("beyond"), F.raise_error(F.lit(
        "score beyond the range of long")).cast("long")).otherwise(F.col("score")).alias("score"))
