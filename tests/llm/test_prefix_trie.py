import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from claimscope.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, piece int, prefix string"


def rebuilt(rows):
    of = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            of[c].append((turn is not None, turn or 0, mark, role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in of.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = turns.get(first, [])[:h] + own[h:]
    return out


def brute(rows):
    conv = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in conv.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(cs) - 1) * words
    out = []
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(conv[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), children[node], leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, parts=4, **sizes):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in P.trie(df, **sizes).collect()), key=str)


def conversations(seed, n, longest):
    r = random.Random(seed)
    said = ["", "a b", "a  b\tc", None, "x" * 50, "one two three four", "é漢  y"]
    rows = []
    for c in range(n):
        for t in range(r.randint(1, longest)):
            rows.append((c * r.choice([1, 1, 1, 7]), t, r.choice(["user", "user", "assistant", None]), r.choice(said[:r.choice([2, 2, 7])])))
    return rows


@pytest.mark.parametrize("width,shard", [(64, 50_000), (3, 40), (1, 7), (4, 1000)])
def test_equals_brute_force(spark, width, shard):
    rows = conversations(3, 60, 9)
    rows += [(500 + c, t, "user", f"deep {t}") for c in range(5) for t in range(12)]            # copies, over several slabs
    rows += [(520 + c, t, "user", f"deep {t if t < 9 else (t, c % 3)}") for c in range(9) for t in range(9 + c)]
    rows += [(None, 1, "user", "no id"), (-7, None, None, None), (-7, 3, "user", "y z"), (-7, None, "b", "tie"), (-7, None, "a", "tie"),
             (2 ** 62, 0, "user", "far"), (-25, 1, "u", "w w"), (-20, 1, "u", "v"), (-20, 1, "u", "v")]
    assert found(spark, rows, width=width, shard=shard, chunk=40) == brute(rows)


def test_hot_conversation_is_cut(spark):
    rows = [(40, t, "user", f"turn {t % 5} of the long one") for t in range(400)] + conversations(5, 20, 6)
    rows += [(41, t, "user", f"turn {t % 5} of the long one") for t in range(390)]
    assert found(spark, rows, 8, width=16, shard=64) == brute(rows)


def test_copies_and_turnless(spark):
    # ids whose first turns are all replaced by those of an absent family head are turnless
    rows = [(c, 0, "user", "only") for c in range(1, 60) if c % 20]
    rows += [(1000 + c, t, "user", "same for all") for c in range(300) for t in range(4)]
    got = found(spark, rows, chunk=64)
    assert got == brute(rows)
    assert any(d == 0 and n_convs == len({r[0] for r in rows}) for _, d, _, n_convs, *_ in got)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


def test_long_texts_and_types(spark):
    rows = [(1, 0, "user", "w " * 100_000), (2, 0, "user", "w " * 100_000), (3, 0, "x:1" * 3, "q")]
    assert found(spark, rows) == brute(rows)
    assert P.trie(spark.createDataFrame([], SCHEMA)).columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_running_totals_over_partitions(spark):
    from pyspark.sql import functions as F
    rows = [("hot", i, 1 + i % 3) for i in range(300)] + [(f"g{i}", 0, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    got = {(r.g, r.o): r.s for r in P.running(df, "g", [F.col("o")], {"s": F.col("v")}, "test-running").collect()}
    assert got == {(g, o): sum(v for h, p, v in rows if h == g and p < o) for g, o, _ in rows}
