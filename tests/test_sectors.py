"""Sector rules: the Spark range join and the oracle's patterns against a literal
table of codes at every boundary, and against each other over all codes."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimscope.functions import sectors as S
from claimscope.plans.oracle_sql import sector_sql

# Codes on both sides of each rule's boundaries.
EXPECTED = {
    "Dental": "D0000 D0120 D1110 D9999",
    "Hospice": "T2042 T2046 Q5003 Q5009 Q5010",
    "Home health & personal care": "T1000 T1005 T1019 T1022 T1030 T1031 G0151 G0159 G0160 G0162 G0299 G0300 "
                                   "S5000 S5100 S5999 S9100 S9123 S9199 99500 99599 99600 99602",
    "Transportation (NEMT & ambulance)": "T2001 T2005 T2049 A0000 A0425 A0999 S0215",
    "Medical supplies": "A4000 A9999",
    "DME, prosthetics & orthotics": "E0000 E9999 K0001 L9999",
    "Drugs (provider-administered)": "J0000 J9999",
    "Behavioral health & community services": "H0000 H2019 H9999 90785 90789 90790 90799 90800 90899",
    "Vision & hearing": "V0000 V9999",
    "State plan & waiver services": "T0999 T1006 T1018 T1023 T1029 T1032 T2000 T2006 T2041 T2047 T2048 T2050 "
                                    "S0000 S0214 S0216 S4999 S6000 S9099 S9200 T9999",
    "Physician & clinical services": "G0000 G0150 G0163 G0298 G0301 G9999 00100 00199 00200 00999 01000 01999 10004 "
                                     "10009 10010 10099 10100 10999 11000 19999 20000 69000 69899 69900 69989 69990 "
                                     "90281 90289 90290 90299 90300 90784 90900 91000 98999 99000 99499 99605 99607",
    "Lab & imaging": "70010 70099 70100 70999 71000 79999 80000 88999 89000 89299 89300 89389 89390 89398",
    None: "A1000 A3999 Q0000 Q5002 Q5011 B0000 C1000 M0001 P9999 R0000 W1793 Z9999 N0001 00000 00099 02000 10003 "
          "69991 70009 89399 90280 99603 99604 99608 99999 20 A123 A12345 ZZZZZ T201 1234 T1019X T-101 DD120",
}
SPACED = {" T1019 ": "T1019", "T1019\n": "T1019", "\tD0120": "D0120", "t1019": "T1019", "g0151": "G0151", "": "20", " ": "20"}
CODES = {c: s for s, codes in EXPECTED.items() for c in codes.split()}
ODD = {k: CODES[v] for k, v in SPACED.items()}


@pytest.fixture(scope="module")
def all_codes(spark):
    letters = spark.range(26 * 10000).select(
        F.concat(F.expr("char(65 + cast(id div 10000 as int))"),
                 F.lpad((F.col("id") % 10000).cast("string"), 4, "0")).alias("hcpcs"))
    digits = spark.range(100000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("hcpcs"))
    odd = spark.createDataFrame([(c,) for c in [*ODD, *CODES]], "hcpcs string")
    return letters.unionByName(digits).unionByName(odd)


@pytest.fixture(scope="module")
def by_join(all_codes):
    return {r.hcpcs: r.sector for r in S.code_sectors(all_codes).collect()}


def test_range_join_at_the_boundaries(by_join):
    want = CODES | ODD
    assert {c: by_join.get(c) for c in want} == want
    # five-digit codes in no rule: the gaps between the ranges
    assert sum(f"{n:05d}" not in by_join for n in range(100000)) == 100 + 8004 + 19 + 882 + 2 + 392
    assert set(S.SECTORS) == set(by_join.values())


def test_oracle_patterns_equal_range_join_on_every_code(all_codes, by_join):
    codes = sorted({r.hcpcs for r in all_codes.collect()})
    con = duckdb.connect()
    con.register("c", pd.DataFrame({"hcpcs": codes}))
    got = dict(con.execute(f"select hcpcs, {sector_sql('hcpcs')} as s from c").fetchall())
    assert {c: s for c, s in got.items() if s != by_join.get(c)} == {}


def test_code_sectors_classify_each_distinct_code_once(spark):
    from claimscope.functions.sectors import code_sectors
    rows = spark.range(3000).selectExpr("concat('D', lpad(cast(id % 7 as string), 4, '0')) as hcpcs")
    out = code_sectors(rows.unionByName(spark.createDataFrame([("zz",), (None,)], "hcpcs string")))
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()  # no pattern goes down to the rows
    assert sorted(r.hcpcs for r in out.collect()) == [f"D000{i}" for i in range(7)]
