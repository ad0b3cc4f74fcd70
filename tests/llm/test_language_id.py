import math

import numpy as np
from pyspark.sql import functions as F

from claimscope.llm import language_id as L

TEXT = {"en": "the cat and the dog went over that hill with the other one ", "de": "der hund und die katze gingen über den berg ",
        "fr": "le chien et la vache étaient où les autres sont "}


def plain_bits(model_rows, text, least):
    """Code lengths byte by byte from dictionaries, as the tree is defined."""
    fold = lambda b: b + 32 if 65 <= b <= 90 else b
    out = {}
    counts = {l: [{}, {}, {}, {}] for l, _ in model_rows}
    for l, texts in model_rows:
        for t in texts:
            data = [0, 0, 0] + [fold(b) for b in t.encode()]
            for i in range(3, len(data)):
                for k in range(4):
                    ctx = tuple(data[i - k:i])
                    counts[l][k].setdefault(ctx, {}).setdefault(data[i], 0)
                    counts[l][k][ctx][data[i]] += 1
    kept = [None, None, set(), set()]
    for k in (2, 3):
        for l in counts:
            kept[k] |= {c for c, f in counts[l][k].items() if sum(f.values()) >= least and (k == 2 or c[1:] in kept[2])}

    def dist(l, ctx):
        k = len(ctx)
        f = counts[l][k].get(ctx, {})
        n, q = sum(f.values()), len(f)
        if k == 0:
            return {b: f[b] / (n + q) if b in f else q / (n + q) / (256 - q) for b in range(256)}
        short = dist(l, ctx[1:])
        if not n:
            return short
        rest = max(1 - sum(short[b] for b in f), 1e-9)
        return {b: f[b] / (n + q) if b in f else q / (n + q) * short[b] / rest for b in range(256)}

    for l, _ in model_rows:
        data, bits, cache = [0, 0, 0] + [fold(b) for b in text.encode()], 0, {}
        for i in range(3, len(data)):
            ctx = tuple(data[i - 1:i])
            for k in (2, 3):
                if tuple(data[i - k:i]) in kept[k] and len(ctx) == k - 1:
                    ctx = tuple(data[i - k:i])
            if ctx not in cache:
                cache[ctx] = dist(l, ctx)
            bits += round(-math.log2(cache[ctx][data[i]]) * L.UNIT)
        out[l] = bits
    return out


def test_code_lengths_equal_plain_ppm():
    rows = [(l, [t * 3, t[::-1]]) for l, t in sorted(TEXT.items())]
    parts = []
    for l, texts in rows:
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        off = np.cumsum([0] + [len(t.encode()) for t in texts])
        w, n = np.unique(L._windows(raw, off), return_counts=True)
        parts.append((l, w.astype(np.int64), n))
    model = L.build(parts, least_context=4)
    for text in ["the hund étaient", "", "X", "Zq%7 漢", "over THE hill " * 5]:
        raw = np.frombuffer(text.encode(), np.uint8)
        got = model.bits(raw, np.array([0, len(raw)]))[0]
        want = plain_bits(rows, text, 4)
        assert np.abs(got - np.array([want[l] for l in model.langs])).max() <= len(raw)


def test_bits_do_not_depend_on_cuts(monkeypatch):
    raw = np.frombuffer(("".join(TEXT.values()) * 40).encode(), np.uint8)
    w, n = np.unique(L._windows(raw, np.array([0, len(raw)])), return_counts=True)
    model = L.build([("x", w.astype(np.int64), n), ("y", w[::2].astype(np.int64), n[::2])], least_context=3)
    off = np.array([0, 0, 3, 5, 5, 700, len(raw) - 1, len(raw)])
    whole = model.bits(raw, off)
    for size in (1, 2, 7, 1000):
        monkeypatch.setattr(L, "CHUNK_BYTES", size)
        assert (model.bits(raw, off) == whole).all()
    one = np.concatenate([model.bits(raw[a:b], np.array([0, b - a])) for a, b in zip(off, off[1:])])
    assert (one == whole).all()


def test_predicts_held_out_texts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        lang = sorted(TEXT)[i % 3]
        rows.append((i, " ".join(rng.choice(TEXT[lang].split(), 12)), lang, "src"))
    rows += [(900, None, "en", "x"), (901, "", "en", "x"), (902, "12 34 !?", "en", "x"), (903, "der hund", None, None),
             (904, "the dog " * 50_000, "en", "x"), (0, rows[0][1], rows[0][2], "x")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")
    held = F.col("doc_id") % 4 == 2
    model = L.train(df, ~held)
    out = L.predict(df, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score", "bits_per_byte"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == (r.lang or "de") and 0 < r.score <= 1
    # other columns have no part in it
    blind = L.predict(df.withColumn("lang", F.lit("zz")), model).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in blind) == sorted((r.doc_id, r.lang_pred) for r in got)


def test_sample_data_held_out_accuracy(spark):
    from claimscope.llm.queries import op3_language_id
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    r = op3_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out")
    assert r.count() > 200 and r.where("lang = lang_pred").count() >= 0.97 * r.count()


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([(1, "hallo welt", None)], "doc_id long, text string, lang string")
    assert L.train(df, F.lit(True)) is None
    assert L.predict(df, None).first().lang_pred == "und"
    assert L.train(df.limit(0), F.lit(True)) is None
    assert L.predict(df.limit(0), None).count() == 0


def test_training_uses_every_row(spark, monkeypatch):
    # more rows than any sample had, in small batches of windows
    monkeypatch.setattr(L, "HELD_WINDOWS", 50)
    texts = [(i, " ".join(np.random.default_rng(i).choice(TEXT[l].split(), 6)) + chr(97 + i % 26) * 3, l)
             for i in range(3400) for l in sorted(TEXT)[:2]]
    texts += [(i, "ﬁzz ﬁzz", sorted(TEXT)[0]) for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = L.train(df, F.lit(True))
    parts = []
    for l in sorted(TEXT)[:2]:
        own = [t.encode() for _, t, x in texts if x == l]
        raw, off = np.frombuffer(b"".join(own), np.uint8), np.cumsum([0] + [len(t) for t in own])
        w, n = np.unique(L._windows(raw, off), return_counts=True)
        parts.append((l, w.astype(np.int64), n))
    whole = L.build(parts)
    for f in ("symbol", "second", "third", "costs"):
        assert (getattr(model, f) == getattr(whole, f)).all()
    rates = L.predict(df, whole, keep=[]).selectExpr("percentile_approx(bits_per_byte, 0.5)").first()[0]
    assert model.usual == rates
