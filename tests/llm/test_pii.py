import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from claimscope.llm import pii

# the stated patterns, plainly
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    double = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(double) % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    r = random.Random(11)
    bits = ["a@b.c", "x.y+z@q-r.example.org.", "@", "a@b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0255.001.2.3", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "41111111111111111", "+1 (555) 123-4567", "+123", "+1 2", "++12345678", " ", "\n", "é", "漢", "😀",
            "5500000000000004", "a@b.c+d@e.f", "a@b.c.d@e.f", "12 34  56", "-", ".", "+", "99999999999999999999999", "%40@x.y-z"]
    out = ["".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(400)]
    return out + [None, "", "a" * 60_000, "1" * 60_000, "1 " * 60_000, "1." * 40_000, "+1" + " " * 60_000, "a@" * 20_000,
                  "a@b.cd " * 3_000, "+1.2" * 10_000, "a.b@c" + ".d" * 30_000]


def test_base_spans_equal_plain_patterns(spark):
    rows = [(i, t, ["s"]) for i, t in enumerate(texts())] + [(None, "a@b.c", None), (3, "me@x.yz", None), (3, "me@x.yz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<string>").repartition(4)
    got = pii.find(df, support=10 ** 6).collect()
    want = sorted((str(i), str([tuple(x) for x in brute(t)])) for i, t, _ in rows)
    assert sorted((str(r.doc_id), str([(s.kind, s.start, s.end) for s in r.spans])) for r in got) == want


def test_disclosing_terms(spark):
    common = [(i, f"the letter goes to nobody number {i}") for i in range(60)]
    known = [(100 + i, f"line {i}\nask Smithson at js@corp.example the letter\nnext {i}") for i in range(5)]
    once = [(200, "only here Zebulon has zeb@corp.example"), (201, "Smithson alone is left alone")]
    df = spark.createDataFrame(common + known + once, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    text = dict(common + known + once)
    words = lambda i: {text[i][s.start:s.end] for s in got[i] if s.kind == "term"}
    assert all("Smithson" in words(100 + i) and "the" not in words(100 + i) for i in range(5))
    assert words(200) == set()                                    # one text is no evidence
    assert all(not got[i] for i, _ in common) and not got[201]    # clean documents are left alone
    # the shares by hand: 5 documents of 67 have the address, 6 the name, 5 both
    spans = pii.located(df, "doc_id", "text")[1]
    share = {r.term: r.share for r in pii.disclosing(df, "text", spans, pii.neighbours(spans)).collect()}
    import math
    assert share["smithson"] == pytest.approx(math.log2(67 * 5 / (5 * 6)) / math.log2(67 / 5))


def brute_terms(texts, support=2, threshold=0.5):
    """The term spans of each text, plainly: shares over whole documents."""
    import math
    from collections import defaultdict

    said, held = [], []
    for t in texts:
        base = brute(t)
        plain = list(t or "")
        for kind, a, b in base:
            plain[a:b] = " " * (b - a)
        said.append([(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", "".join(plain))])
        held.append({(k, t[a:b]) for k, a, b in base})
    e, w, both, seen = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set)
    for t, s, h in zip(texts, said, held):
        terms = {x for x, _, _ in s}
        for x in terms:
            w[x] += 1
        for v in h:
            e[v] += 1
            for x in terms:
                both[v, x] += 1
                seen[v, x].add(t)
    n = len(texts)
    told = {(v, x) for (v, x), b in both.items() if len(seen[v, x]) >= support and e[v] < n
            and math.log2(n * b / (e[v] * w[x])) / math.log2(n / e[v]) >= threshold}
    return [[(a, b) for x, a, b in s if any((v, x) in told for v in h)] for s, h in zip(said, held)]


def test_terms_anywhere_in_the_document(spark):
    common = [f"the letter goes to nobody number {i}" for i in range(60)]
    far = [f"Wu Zebulon, line {i}\n{'so it goes on and on ' * 20}\nthe mail is zw@corp.example\nand zebulon again; Wu" for i in range(4)]
    apart = [f"a@b.example c@d.example near {i} Quill" for i in range(3)]
    texts = common + far + apart + ["Zebulon alone, no mail"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "term"] for r in pii.find(df).collect()}
    said = lambda i: [texts[i][a:b] for a, b in got[i]]
    for i in range(60, 64):
        assert [x for x in said(i) if x in ("Wu", "Zebulon", "zebulon")] == ["Wu", "Zebulon", "zebulon", "Wu"]
        assert "the" not in said(i)
    assert all("Quill" in said(i) for i in range(64, 67)) and not got[67]
    assert [got[i] for i in range(len(texts))] == brute_terms(texts)


def test_terms_against_brute_force(spark):
    r = random.Random(5)
    names = ["Li", "é", "Ümit", "漢字", "o", "Smithson", "smithson", "Ann", *[f"w{chr(97 + k)}" for k in range(20)]]
    values = [f"p{k}@x.example" for k in range(28)] + ["1.2.3.4", "999.1.1.1", "+49 30 1234567", "4111 1111 1111 1111", "éa@b.c"]
    texts = []
    for _ in range(150):
        k = r.randint(0, 27)
        bits = [values[k], names[k]] * r.randint(0, 2) + [r.choice(names) for _ in range(r.randint(0, 3))]
        bits += [r.choice(values)] * r.randint(0, 1) + ["so " * r.choice([0, 0, 40]) + "\n"]
        r.shuffle(bits)
        texts.append(" ".join(bits))
    texts += texts[:20] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for support, threshold in ((2, 0.5), (3, 0.2), (1, 0.7)):
        got = {x.doc_id: [(s.start, s.end) for s in x.spans if s.kind == "term"]
               for x in pii.find(df, support=support, threshold=threshold).collect()}
        want = brute_terms(texts, support, threshold)
        assert [got[i] for i in range(len(texts))] == want and any(want)


def test_sanitised(spark):
    df = spark.createDataFrame([(1, "é ask me@x.yz or +49 30 1234567 now", 0), (2, None, 0), (3, "plain", 0)], "doc_id long, text string, n int")
    out = {r.doc_id: r.t for r in pii.find(df).join(df, "doc_id").select("doc_id", pii.sanitised(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert out == {1: "é ask [EMAIL] or [PHONE] now", 2: "", 3: "plain"}
    one = spark.createDataFrame([("ab name cd", [("term", 3, 7, True), ("ip", 8, 9, False), ("card", 8, 10, False)])],
                                "text string, spans array<struct<kind:string,start:bigint,end:bigint,remove:boolean>>")
    assert one.select(pii.sanitised(F.col("text"), F.col("spans"))).first()[0] in ("ab  [IP][CARD]", "ab  [CARD]")


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_digest(spark):
    from claimscope.llm.queries import op7_pii
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op7_pii(spark, sf).collect():
        base = brute(text[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in PLAIN]
