"""Personal data: patterns, and terms that give protected entities away.

Base patterns find e-mail and IP addresses, card and phone numbers. Each value
found is a protected entity. A term in the same document, anywhere outside the
values found, may reveal it: with document frequencies over the whole corpus, the
term discloses the share

    PMI(entity; term) / IC(entity)
      = log(N df(e,t) / (df(e) df(t))) / log(N / df(e))

of the entity's information (1: whoever reads the term knows the entity). Terms
with an entity in at least ``support`` different texts that disclose at least
``threshold`` are found as well, at every occurrence in the documents that hold the
entity: from ``removal`` on they are removed, below that generalised.

All of it is DataFrame expressions. Matches are located by cutting the text at
the pattern: the pieces between matches give their offsets by a running sum. The
patterns are written so that they neither recurse nor start in the middle of a
run, so very long runs of digits or letters take linear time.

Counts are of distinct terms and texts, aggregated before each shuffle, and only of
pairs that can reach the threshold by their document frequencies. Only short rows
are shuffled, but for the texts with a match: they are joined with the terms to mark.

Defined cases: null text is empty; repeated rows have equal spans each, and equal
texts count once in the statistics; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.staging import staged

#: The patterns. Possessive quantifiers and look-behind only forbid what could
#: not lead to a match; ``\G`` lets a match start where the last one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for its pattern to be worth a look.
NEEDS = {
    "email": lambda t: F.instr(t, "@") > 0,
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: F.instr(t, "+") > 0,
}
KINDS = [*PATTERNS, "term"]
TERM = r"\p{L}+"
#: Least number of texts, shares of disclosure.
SUPPORT, THRESHOLD, REMOVAL = 2, 0.5, 0.9
#: Terms that are broadcast to leave them out early, because they are too frequent.
COMMON = 20_000


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: Column, m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    octets = F.forall(parts, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    n = F.length(_digits(m))
    return (F.when(kind == "ip", octets)
             .when(kind == "card", n.between(16, 19) & F.call_function("luhn_check", _digits(m)))
             .when(kind == "phone", n.between(8, 15)).otherwise(F.lit(True)))


def _found(text: Column, kind: str) -> Column:
    """The matches of a kind in order, each with the length of the piece before
    it and what stands on either side."""
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    rows = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("p"), matches.alias("m"))
    found = F.transform(rows, lambda z: F.struct(
        F.lit(kind).alias("kind"), z["m"].alias("m"), F.length(z["p"]).alias("skip")))
    empty = F.array().cast("array<struct<kind:string,m:string,skip:int>>")
    return F.when(NEEDS[kind](text), found).otherwise(empty)


def _blanked(text: Column) -> Column:
    """The text with a blank for each character of an e-mail address. The other
    kinds hold no letters, so this leaves the terms outside base values."""
    p = PATTERNS["email"]
    rows = F.arrays_zip(F.split(text, p, -1).alias("p"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("m"))
    return F.when(NEEDS["email"](text), F.array_join(F.transform(rows, lambda z: F.concat(
        z["p"], F.repeat(F.lit(" "), F.coalesce(F.length(z["m"]), F.lit(0))))), "")).otherwise(text)


def _words(text: Column) -> Column:
    """The distinct terms outside base values, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_blanked(text), F.lit(TERM), F.lit(0)), F.lower))


def located(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """All rows as ``_row, key, _text`` (a hash) and ``_blanked`` (the blanked text
    if there is a match, else null), and their base spans: ``_row, _text, kind,
    value, start, end``."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key), F.xxhash64(t).alias("_text"),
                       t.alias("_t"), *[_found(t, k).alias(f"_{k}") for k in PATTERNS])
    held = F.greatest(*[F.size(f"_{k}") for k in PATTERNS]) > 0
    rows = staged(rows.withColumn("_blanked", F.when(held, _blanked(F.col("_t")))).drop("_t"), "pii-found")
    each = [rows.where(F.size(f"_{k}") > 0).select("_row", "_text", F.posexplode(f"_{k}").alias("i", "f"))
            for k in PATTERNS]
    found = each[0]
    for more in each[1:]:
        found = found.unionByName(more)
    w = Window.partitionBy("_row", "f.kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("f.skip") + F.length("f.m")).over(w).cast("long")
    spans = found.select("_row", "_text", "f.kind", F.col("f.m").alias("value"),
                         (end - F.length("f.m")).alias("start"), end.alias("end"))
    return rows.select("_row", key, "_text", "_blanked"), spans.where(_valid(F.col("kind"), F.col("value")))


def neighbours(spans: DataFrame) -> DataFrame:
    """The texts that hold an entity, once each: ``_text, kind, value, n`` (rows with
    that text). Every term of such a text is next to the entity."""
    rows = spans.select("_text", "kind", "value", "_row").distinct()
    return rows.groupBy("_text", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def disclosing(docs: DataFrame, text: str, spans: DataFrame, near: DataFrame, support: int = SUPPORT,
               threshold: float = THRESHOLD) -> DataFrame:
    """``kind, value, term, share``: terms that disclose an entity. ``near`` are the
    ``neighbours`` of ``spans``.

    A pair cannot share more documents than either has, so its share reaches the
    threshold only if the term is in at most ``N (df(e) / N) ** threshold``
    documents; pairs beyond that are not counted."""
    t = F.coalesce(F.col(text), F.lit(""))
    near = staged(near, "pii-near")
    entity = near.groupBy("kind", "value").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("_texts"))
    entity = staged(entity.where(F.col("_texts") >= support).drop("_texts"), "pii-entities")
    total = docs.count()
    most = entity.agg(F.max("n_entity")).first()[0] or 0
    # a little above, for the rounding of the power
    bound = lambda e: F.lit(float(total)) * F.pow(e / F.lit(float(max(total, 1))), F.lit(float(threshold))) * (1 + 1e-9)
    limit = bound(F.lit(float(most)))
    each = docs.select(F.xxhash64(t).alias("_text"), t.alias("_t"))
    term = staged(each.select(F.explode(_words(F.col("_t"))).alias("term")).groupBy("term")
                      .agg(F.count(F.lit(1)).alias("n_term")).where(F.col("n_term") >= support), "pii-terms")
    # the most frequent terms beyond the bound go before anything is shuffled
    common = term.where(F.col("n_term") > limit).orderBy(F.col("n_term").desc(), "term").limit(COMMON).select("term")
    held = F.lit(False)
    for k in PATTERNS:
        held = held | F.exists(_found(F.col("_t"), k), lambda f: _valid(f["kind"], f["m"]))
    words = (each.where(held).select("_text", F.explode(_words(F.col("_t"))).alias("term"))
                 .join(F.broadcast(common), "term", "left_anti").distinct()
                 .join(term.where(F.col("n_term") <= limit), "term"))
    pairs = near.join(entity, ["kind", "value"]).join(words, "_text").where(F.col("n_term") <= bound(F.col("n_entity")))
    joint = (pairs.groupBy("kind", "value", "term", "n_entity", "n_term")
                  .agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("_texts")).where(F.col("_texts") >= support))
    chance = F.log2(F.lit(total) / F.col("n_entity"))
    share = F.when(chance > 0, F.log2(
        F.lit(total) * F.col("n_both") / (F.col("n_entity") * F.col("n_term"))) / chance)
    return joint.withColumn("share", share).where(F.col("share") >= threshold).select("kind", "value", "term", "share")


def occurrences(rows: DataFrame, base: DataFrame, told: DataFrame) -> DataFrame:
    """``_row, start, end, share``: every occurrence, outside base values, of a term
    in a row that holds an entity it discloses; the largest share."""
    said = (base.select("_row", "kind", "value").distinct().join(told, ["kind", "value"])
                .groupBy("_row", "term").agg(F.max("share").alias("share")))
    said = said.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("_said"))
    matches = F.regexp_extract_all(F.col("_blanked"), F.lit(TERM), F.lit(0))
    pieces = F.slice(F.split("_blanked", TERM, -1), F.lit(1), F.size(matches))
    each = F.transform(F.arrays_zip(pieces.alias("p"), matches.alias("m")), lambda z: F.struct(
        F.length(z["p"]).alias("skip"), F.length(z["m"]).alias("size"),
        F.element_at("_said", F.lower(z["m"])).alias("share")))
    found = (rows.where(F.col("_blanked").isNotNull()).select("_row", "_blanked").join(said, "_row")
                 .select("_row", F.posexplode(each).alias("i", "f")))
    w = Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("f.skip") + F.col("f.size")).over(w).cast("long")
    return (found.select("_row", (end - F.col("f.size")).alias("start"), end.alias("end"), F.col("f.share").alias("share"))
                 .where(F.col("share").isNotNull()))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", support: int = SUPPORT,
         threshold: float = THRESHOLD, removal: float = REMOVAL) -> DataFrame:
    """A row per document: ``key`` and ``spans``, an array of structs ``kind``
    (in the order of ``KINDS``), ``start``, ``end`` (code points, end exclusive)
    and ``remove``, ordered by kind and start."""
    rows, base = located(docs, key, text)
    base = staged(base, "pii-base")
    near = neighbours(base)
    told = staged(disclosing(docs, text, base, near, support, threshold), "pii-disclosing")
    terms = occurrences(rows, base, told).withColumn("remove", F.col("share") >= removal)
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    every = (base.select("_row", "kind", "start", "end", F.lit(False).alias("remove"))
                 .unionByName(terms.select("_row", F.lit("term").alias("kind"), "start", "end", "remove")))
    grouped = every.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(
        number.alias("number"), "start", "end", "kind", "remove"))).alias("_s"))
    spans = F.transform(F.coalesce(F.col("_s"), F.array().cast(
        "array<struct<number:bigint,start:bigint,end:bigint,kind:string,remove:boolean>>")),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                           s["remove"].alias("remove")))
    return rows.join(grouped, "_row", "left").select(key, spans.alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets, or by nothing
    where it is removed. Of overlapping spans the first is replaced; the others
    go from where it ends."""
    text = F.coalesce(text, F.lit(""))
    ordered = F.array_sort(spans, lambda x, y: F.when(x["start"] < y["start"], -1)
                           .when(x["start"] > y["start"], 1).otherwise(0))
    step = lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when(x["end"] <= s["at"], s["out"]).otherwise(F.concat(
            s["out"], F.substring(text, (s["at"] + 1).cast("int"),
                                  F.greatest(x["start"] - s["at"], F.lit(0)).cast("int")),
            F.when(x["remove"], F.lit("")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))).alias("out"))
    rest = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    return F.aggregate(ordered, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, rest)
