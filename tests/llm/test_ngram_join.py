import random
import re

import numpy as np
import pytest

from claimscope.llm import ngram_join as N
from claimscope.llm.components import components

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = BLANK.findall(low)
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


def corpus(seed=5):
    """Families of near copies, passages, common lines, exact copies and odd rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    rows, passage = [], text(60)
    for family in range(12):
        base = text(r.choice([6, 20, 60, 200]))
        for _ in range(r.choice([1, 3, 8])):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 30))):
                t[r.randrange(len(t))] = word()
            rows.append(" ".join(t))
    chain = text(80)
    for i in range(15):  # each like the one before, the ends unlike
        chain = chain[4:] + text(4)
        rows.append(" ".join(chain))
    rows += [" ".join(passage + text(n)) for n in (1, 5, 30, 100)] * 2
    rows += ["A b C", "a B c", "a b c d", "", None, " \t\n", "one", "ONE", "one　one", "É b c d e f", "é b c d e f"]
    rows += ["same words all over again and again"] * 9
    order = list(range(len(rows)))
    r.shuffle(order)
    return [(i * 3, rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [256, 3])
def test_components_equal_brute_force(spark, block):
    rows = corpus() + [(None, "same words all over again and again"), (9, "lonely text of some few words"),
                       (9, "lonely text of some few words"), (3001, "w" * 10 + " v" * 40_000)]
    # equal ids are one vertex: keep their texts equal
    rows = [r for k, r in enumerate(rows) if r[0] != 9 or "lonely" in r[1]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(6)
    got = N.near_duplicates(df, block=block).collect()
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("block", [256, 4])
def test_every_pair_equals_brute_force(spark, block):
    rows = corpus(9) + [(None, "same words all over again and again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pairs, members = N.similar_pairs(df, block=block)
    sets = {i: frozenset(shingles(t)) for i, t in rows if i is not None}
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    assert dict(map(tuple, members.collect())) == {i: rep[s] for i, s in sets.items() if s}
    reps = sorted(i for s, i in rep.items() if s)
    want = {(a, b) for a in reps for b in reps if a < b
            and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    got = list(map(tuple, pairs.collect()))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_hot_family_through_star_and_rest(spark):
    """A family far above the block size: some linked with its home, some not."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        t = list(base)
        for k in r.sample(range(120), r.randint(0, 6)):
            t[k] = f"x{r.randrange(10 ** 6)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, N.near_duplicates(df, block=7).collect())) == sorted(brute(rows))


def test_trie_against_plain_overlaps():
    rng = np.random.default_rng(2)
    for _ in range(60):
        base = rng.choice(60, 30, replace=False)
        sets = []
        for _ in range(rng.integers(2, 25)):
            s = set(base[: rng.integers(5, 30)]) | set(rng.choice(60, rng.integers(0, 12)))
            sets.append(np.array(sorted(s)))
        trie = N.Trie(sets)
        for x in sets:
            mark = np.zeros(60, bool)
            mark[x] = True
            wanted = rng.random(len(sets)) < 0.8
            got = set(trie.order[trie.linked(x, mark, wanted, (75, 100))].tolist())
            want = {int(trie.order[p]) for p in range(len(sets)) if wanted[p]
                    and 100 * len(set(x) & set(sets[trie.order[p]])) >= 75 * len(set(x) | set(sets[trie.order[p]]))}
            assert got == want


def test_shingles_do_not_depend_on_cuts(monkeypatch):
    texts = [t for _, t in corpus()] + ["long " * 3000 + "end"]
    raw = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    off = np.cumsum([0] + [len((t or "").encode()) for t in texts])
    whole = list(N.shingle_sets(raw, off))
    assert [len(s) for s in whole] == [len(shingles(t)) for t in texts]
    monkeypatch.setattr(N, "CHUNK_BYTES", 64)
    assert all((a == b).all() for a, b in zip(whole, N.shingle_sets(raw, off), strict=True))


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = spark.createDataFrame([(4, None), (5, "")], "doc_id long, text string")
    assert sorted(map(tuple, N.near_duplicates(only).collect())) == [(4, 0, 4), (5, 0, 5)]


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.a: r.b for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block_bytes", [1, 4000, 1 << 24])
def test_blocks_by_bytes_equal_brute_force(spark, block_bytes):
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    base = [r.choice(words) for _ in range(400)]
    rows = []
    for i in range(40):
        text = list(base)
        for _ in range(r.randint(0, 12)):
            text[r.randrange(400)] = r.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(r.choice(words) for _ in range(r.choice((3, 30, 300))))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, N.near_duplicates(df, block_bytes=block_bytes).collect())) == sorted(brute(rows))


def test_sets_of_one_signature_both_send_their_prefix(monkeypatch):
    import pyarrow as pa
    from types import SimpleNamespace

    texts = ["a b c d e", "f g h i j", "a b c d e"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    monkeypatch.setattr(N, "_signature", lambda s: 1)
    order = SimpleNamespace(value=np.zeros(N.SKETCH, np.uint16))
    out = list(N._prefixes(order, 5, N.SIMILARITY)([batch]))
    assert sum(b.num_rows for b in out) == 2 and len({t for b in out for t in b["token"].to_pylist()}) == 2


def test_components_contract_links_before_rounds(spark, monkeypatch):
    """Chains, stars and repeats that tasks hold whole need no round; cut up, the rounds
    give the same."""
    from claimscope.llm import components as C

    r = random.Random(7)
    chain = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(2001, 2000)] * 3 + [(5, 5)]
    r.shuffle(chain)
    want = {i: 0 for i in range(1, 301)} | {i: 1000 for i in range(1001, 1100)} | {2001: 2000}
    rounds = []
    large = C._large_star
    monkeypatch.setattr(C, "_large_star", lambda e: rounds.append(1) or large(e))
    whole = spark.createDataFrame(chain, "a long, b long").coalesce(1)
    rows = C.components(whole).collect()
    assert {x.a: x.b for x in rows} == want and len(rows) == len(want)
    assert not rounds
    monkeypatch.setattr(C, "contracted", lambda links, f=C.contracted: f(links, held=3))
    rows = C.components(spark.createDataFrame(chain, "a long, b long").repartition(7)).collect()
    assert {x.a: x.b for x in rows} == want and len(rows) == len(want)
    assert rounds
