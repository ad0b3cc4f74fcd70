"""Billing code → service sector.

Codes are classified by family: a letter followed by four digits (HCPCS
Level II and dental codes) or five digits (CPT). Every rule is a numeric range
inside one family, so the rules are data – a fixed table of (family, letter,
range, sector) rows – and classifying the distinct codes is a broadcast range
join (no UDF, no per-rule regex). The fact is then joined with the small
code → sector map on the raw code.

The input is the code stripped of surrounding whitespace and upper-cased; the
first matching rule wins; a code no rule matches has no sector (null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.session import checkpoint_dir

DENTAL = "Dental"
HOSPICE = "Hospice"
HOME = "Home health & personal care"
TRANSPORT = "Transportation (NEMT & ambulance)"
SUPPLIES = "Medical supplies"
DME = "DME, prosthetics & orthotics"
DRUGS = "Drugs (provider-administered)"
BEHAVIORAL = "Behavioral health & community services"
VISION = "Vision & hearing"
STATE_PLAN = "State plan & waiver services"
PHYSICIAN = "Physician & clinical services"
LAB = "Lab & imaging"
OTHER = "Other / unclassified"

SECTORS = [DENTAL, HOSPICE, HOME, TRANSPORT, SUPPLIES, DME, DRUGS, BEHAVIORAL, VISION,
           STATE_PLAN, PHYSICIAN, LAB]

# --- Fixed values: the classification rules, in the order they are tried. ---
# Letter rules: (sector, letters, first, last) matches a letter from `letters`
# followed by four digits whose value lies in first..last.
LETTER_RULES = [
    (DENTAL, "D", 0, 9999),
    (HOSPICE, "T", 2042, 2046),
    (HOSPICE, "Q", 5003, 5010),
    (HOME, "T", 1019, 1022),
    (HOME, "T", 1000, 1005),
    (HOME, "T", 1030, 1031),
    (HOME, "G", 151, 162),
    (HOME, "G", 299, 300),
    (TRANSPORT, "T", 2001, 2005),
    (TRANSPORT, "T", 2049, 2049),
    (TRANSPORT, "A", 0, 999),
    (TRANSPORT, "S", 215, 215),
    (SUPPLIES, "A", 4000, 9999),
    (DME, "EKL", 0, 9999),
    (DRUGS, "J", 0, 9999),
    (BEHAVIORAL, "H", 0, 9999),
    (VISION, "V", 0, 9999),
    (HOME, "S", 5000, 5999),
    (HOME, "S", 9100, 9199),
    (STATE_PLAN, "ST", 0, 9999),
    (PHYSICIAN, "G", 0, 9999),
]
# Five-digit rules: (sector, first, last) on the code's numeric value.
NUMERIC_RULES = [
    (PHYSICIAN, 100, 1999),
    (PHYSICIAN, 10004, 69990),
    (LAB, 70010, 89398),
    (BEHAVIORAL, 90785, 90899),
    (PHYSICIAN, 90281, 99499),
    (HOME, 99500, 99602),
    (PHYSICIAN, 99605, 99607),
]
# --- end of fixed values ---

# Characters Python's str.strip() removes: \s plus vertical tab, the
# information separators, NEL and every Unicode space separator.
WHITESPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def normalize_code(col: Column) -> Column:
    return F.upper(F.regexp_replace(col, rf"^{WHITESPACE}+|{WHITESPACE}+$", ""))


def rule_segments() -> list[tuple[str, str, int, int, str]]:
    """The ordered rules as disjoint ``(kind, letter, lo, hi, sector)``
    segments: within one family and letter the number line is cut at every
    rule boundary and each piece takes the sector of the first rule covering
    it; adjacent pieces of the same sector are merged. Five-digit codes use
    kind ``N`` and letter ``#``. A code then matches at most one segment."""
    by_letter: dict[tuple[str, str], list[tuple[int, int, str]]] = {}
    for sector, letters, lo, hi in LETTER_RULES:
        for x in letters:
            by_letter.setdefault(("L", x), []).append((lo, hi, sector))
    for sector, lo, hi in NUMERIC_RULES:
        by_letter.setdefault(("N", "#"), []).append((lo, hi, sector))
    out: list[tuple[str, str, int, int, str]] = []
    for (kind, letter), rules in by_letter.items():
        cuts = sorted({lo for lo, _, _ in rules} | {hi + 1 for _, hi, _ in rules})
        for a, b in zip(cuts, cuts[1:]):
            sector = next((sec for lo, hi, sec in rules if lo <= a and b - 1 <= hi), None)
            if sector is None:
                continue
            if out and out[-1][:2] == (kind, letter) and out[-1][3] == a - 1 \
                    and out[-1][4] == sector:
                out[-1] = (kind, letter, out[-1][2], b - 1, sector)
            else:
                out.append((kind, letter, a, b - 1, sector))
    return out


def rules_table(spark: SparkSession) -> DataFrame:
    """:func:`rule_segments` as a small fixed DataFrame (tens of rows)."""
    return spark.createDataFrame(rule_segments(),
                                 "kind string, letter string, lo int, hi int, sector string")


def classify(df: DataFrame, code: str = "hcpcs", out: str = "sector") -> DataFrame:
    """Add the sector of ``df[code]`` as column ``out`` (null = unclassified).

    The code is normalised and split into family / first letter / number in
    projections of its own; the broadcast segment table is then probed on
    (family, letter) with a range check on the number – a streaming
    broadcast hash join, no shuffle, at most one match per row.
    """
    n = normalize_code(F.col(code))
    staged = df.withColumn("_sc_n", n)
    n = F.col("_sc_n")
    kind = F.when(n.rlike(r"\A[A-Z][0-9]{4}\z"), F.lit("L")).when(
        n.rlike(r"\A[0-9]{5}\z"), F.lit("N"))
    staged = staged.withColumn("_sc_kind", kind)
    is_l = F.col("_sc_kind") == "L"
    staged = staged.select(
        *df.columns, "_sc_kind",
        F.when(is_l, F.substring("_sc_n", 1, 1)).otherwise(F.lit("#")).alias("_sc_letter"),
        F.when(is_l, F.substring("_sc_n", 2, 4).try_cast("int"))
         .otherwise(F.col("_sc_n").try_cast("int")).alias("_sc_num"))
    seg = rules_table(df.sparkSession).select(
        F.col("kind").alias("_rk"), F.col("letter").alias("_rl"), F.col("lo").alias("_rlo"),
        F.col("hi").alias("_rhi"), F.col("sector").alias("_rs"))
    j = staged.join(F.broadcast(seg), (F.col("_sc_kind") == F.col("_rk"))
                    & (F.col("_sc_letter") == F.col("_rl"))
                    & F.col("_sc_num").between(F.col("_rlo"), F.col("_rhi")), "left")
    return j.select(*df.columns, F.col("_rs").alias(out))


def code_sectors(codes: DataFrame, code: str = "hcpcs") -> DataFrame:
    """``code → sector`` for every distinct classified code of ``codes``
    (raw code as key; unclassified codes left out). One row per distinct
    code – small next to the fact, which is joined with it on the raw code.

    Eager: the distinct codes are checkpointed. Else the filter on the sector
    sends the rules' patterns below ``distinct``, to every row."""
    checkpoint_dir(codes.sparkSession)
    c = codes.select(code).where(F.col(code).isNotNull()).distinct().checkpoint(eager=True)
    return classify(c, code, "sector").where(F.col("sector").isNotNull())
