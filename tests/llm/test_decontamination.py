import re

import pytest

from claimscope.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [(m[0], m.start(), m.end()) for m in WORD.finditer(t)]


def brute(text, bench, window=10):
    ws = words_of(text)
    plain = [w for w, _, _ in ws]
    hit, items = set(), set()
    for item, b in bench:
        bw = [w for w, _, _ in words_of(b)]
        wins = [] if not bw else [bw] if len(bw) < window else [bw[i:i + window] for i in range(len(bw) - window + 1)]
        for w in wins:
            for i in range(len(plain) - len(w) + 1):
                if plain[i:i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    items |= {str(item)} if item is not None else set()
    return len(ws), len(hit), sorted(items), ws, hit


BENCH = [(1, "The quick brown fox jumps over the lazy dog again today and more"), (2, "Short ITEM é"), (2, "Short ITEM é"),
         (3, ""), (4, None), (None, "nameless words here"), (10, "a b c d e f g h i j"), (11, "x"),
         (12, "b c d e f g h i j k")]
DOCS = [(1, "So: the QUICK, brown fox jumps over the lazy dog AGAIN today!"), (2, "short item é, Short item É"),
        (3, None), (4, ""), (5, "...!"), (6, "A b c d e f g h i j k l"), (7, "nameless-words-here"), (8, "x x yx x"),
        (9, "clean text only"), (9, "clean text only"), (None, "漢字 short\nitem é 漢字"), (11, "pad " * 30_000 + "short item é")]


@pytest.mark.parametrize("block_chars", [1 << 20, 60])
def test_against_brute_force(spark, block_chars):
    docs = spark.createDataFrame([(i, t, "h") for i, t in DOCS], "doc_id long, text string, hits string").repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in BENCH], "item_id long, text string, window int")
    got = D.mark(docs, bench, block_chars=block_chars).collect()
    assert len(got) == len(DOCS) and got[0].__fields__ == ["doc_id", "text", "hits"]
    for r in got:
        n, n_hit, items, ws, hit = brute(r.text, BENCH)
        assert (r.hits.n_words, r.hits.n_hit, r.hits["items"]) == (n, n_hit, items), r.text[:60]
        spans = [(s.start, s.end) for s in r.hits.spans]
        inside = {k for k, (_, a, b) in enumerate(ws) if any(x <= a and b <= y for x, y in spans)}
        assert inside == hit
        assert all(any(a == x for _, a, _ in ws) and any(b == y for _, _, b in ws) for x, y in spans)


# letters with a byte 85 or A0 in UTF-8, which are blanks to str.split() as Latin-1
LETTERS = "à х Р Π م 者 가 \u0145 \u00a0 \u0085".split(" ")


@pytest.mark.parametrize("block_chars", [1 << 20, 60])
def test_letters_with_bytes_that_look_like_blanks(spark, block_chars):
    words = [f"{c}{k}{c}w{c}" for k, c in enumerate(LETTERS)]
    items = [(1, " ".join(words)), (2, f"{LETTERS[0]}"), (3, " ".join(["voil" + LETTERS[0]] * 3)),
             (4, " ".join(words[::-1]) + " and one more"), (5, " ".join(f"p{k}" for k in range(9)) + f" {LETTERS[1]} q r")]
    texts = [f"pad {t}, pad" for _, t in items] + ["voil voil voil", "p0 p1 p2", " ".join(words[1:]), "w0 w1", "A\u00a0b", *LETTERS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = D.mark(docs, spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars).collect()
    assert len(got) == len(texts)
    for r in got:
        n, n_hit, found, _, _ = brute(r.text, items)
        assert (r.hits.n_words, r.hits.n_hit, r.hits["items"]) == (n, n_hit, found), r.text
        assert r.doc_id >= len(items) or str(items[r.doc_id][0]) in found


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminated(docs, none).count() == len(DOCS)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert D.mark(docs.limit(0), bench).count() == 0
    assert {r.doc_id for r in D.decontaminated(docs, bench).collect()} == {3, 4, 5, 9}
    assert D.mark(docs, bench, keep=["doc_id"]).columns == ["doc_id", "hits"]


def test_many_blocks_are_passes_of_their_own(spark):
    items = [(i, " ".join(f"q{i}w{k}" for k in range(14))) for i in range(40)]
    texts = [items[i][1] + " and " + items[-i - 1][1][:60] for i in range(40)] + ["clean", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows, n = D.window_blocks(bench, "item_id", "text", 10, 1200)
    assert n >= 10 and windows.count() == 200
    size = windows.selectExpr("block", "octet_length(w) + octet_length(array_join(items, ',')) as n").groupBy("block").sum("n").collect()
    assert len(size) == n and all(r[1] < 1200 + 100 for r in size)
    got = D.mark(docs, bench, block_chars=1200)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    for r in got.collect():
        assert (r.hits.n_words, r.hits.n_hit, r.hits["items"]) == brute(r.text, items)[:3]
    one = D.mark(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert one.count("MapInArrow") == 1 and "Exchange" not in one.split("MapInArrow")[0]
