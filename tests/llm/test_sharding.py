import hashlib

import pytest

from claimscope.llm import sharding

DOC = "doc_id long, text string"


def tree(rows, limit):
    """Extendible hashing bucket by bucket: split what is too large."""
    bits = lambda i: f"{int(hashlib.md5(str('' if i is None else i).encode()).hexdigest()[:15], 16):060b}"
    out = {}

    def split(prefix, members):
        if sum(n for _, n in members) <= limit or len(members) == 1:
            for i, n in members:
                out.setdefault(i, []).append((prefix, sum(x for _, x in members)))
            return
        for b in "01":
            split(prefix + b, [m for m in members if bits(m[0])[len(prefix)] == b])
    split("", rows)
    return out


@pytest.mark.parametrize("limit", [50, 400, 5000, 10 ** 9])
def test_equals_bucket_by_bucket_splitting(spark, limit):
    rows = [(i, "é" * (i % 37)) for i in range(600)] + [(None, None), (1000, "x" * 3000)]
    got = sharding.shards(spark.createDataFrame([(*r, "s") for r in rows], DOC + ", shard string").repartition(4), limit=limit)
    want = tree([(i, len((t or "").encode())) for i, t in rows], limit)
    for r in got.collect():
        assert [(r.shard, r.shard_bytes)] == want[r.doc_id], r
        assert r.depth == len(r.shard) and r.oversize == (r.shard_bytes > limit)


def test_one_key_with_most_rows_is_split(spark):
    rows = [(7, "x" * 100)] * 800 + [(i, "y" * 100) for i in range(200)]
    got = sharding.shards(spark.createDataFrame(rows, DOC), limit=1000).collect()
    assert len(got) == 1000
    size = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
    assert max(size.values()) <= 1000 and all(size[r.shard] == r.shard_bytes for r in got)
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_empty_and_wrong_limit(spark):
    df = spark.createDataFrame([], DOC)
    assert sharding.shards(df).count() == 0
    with pytest.raises(ValueError):
        sharding.shards(df, limit=0)


def test_written_shards(spark, tmp_path):
    rows = [(i, "z" * 50, i) for i in range(40)] + [(7, "y" * 40, 100 + i) for i in range(30)] + [(None, None, 200), (None, "x" * 900, 201)]
    df = spark.createDataFrame(rows, DOC + ", _key int").repartition(3)
    sharding.write_shards(df, str(tmp_path / "out"), limit=500)
    back = spark.read.schema(DOC + ", _key int, shard string").parquet(str(tmp_path / "out"))
    got = back.collect()
    assert sorted((tuple(r[:3]) for r in got), key=str) == sorted(rows, key=str)
    size = {}
    for r in got:
        size.setdefault(r.shard, []).append(len(r.text or ""))
    assert all(sum(n) <= 500 or len([x for x in n if x]) == 1 for n in size.values())
