"""The fact and dimension views over the driver's TPC-H-style tables.

The test data carries no payments table, so a fixed, documented mapping turns
line items into payment rows (``spending_raw``), suppliers and customers into
registered providers (``npi_lookup``), and adds the billing state by a left
join (``spending``). The mapping puts in the awkward cases on purpose: null
billing provider and code, a lower-case code, a three-letter state, providers
with no registry row, negative and zero amounts, rows over 1e8, codes of every
sector and unclassified codes.

All views are lazy but the state join, which looks at the registry first; Catalyst prunes the columns and pushes filters through the
joins into the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.sources.joins import add_billing_state


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixed values of the fixture mapping: the cycle of 12 five-character codes
# picked for every 25th part, and the letters used as code prefixes.
CODE_CYCLE = "T1019T2042Q5003G0299A0425S0215S91235T201602D1110W17939959999605"
CODE_LETTERS = "DTQGASEKLJHVWZ"
# Two-letter states by nation key (nation 24 gets the three-letter 'SCX').
STATE_CODES = "NYCATXMAMINJOHNCFLAZVAMOPAILGAWAORCOMNWIINTNKYLA"

BILLING_NPI = "case when l_suppkey % 29 = 0 then null else cast(1000000000 + l_suppkey as string) end"


def spending_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment rows: line item ⋈ order, one row per line item."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_shipdate")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    return j.select(
        F.expr(BILLING_NPI).alias("billing_npi"),
        F.expr("cast(2000000000 + o_custkey as string)").alias("servicing_npi"),
        F.expr(f"""case when l_partkey % 97 = 0 then null
                        when l_partkey % 89 = 0 then 't1019'
                        when l_partkey % 25 = 0 then substr('{CODE_CYCLE}',
                             cast(floor(l_partkey / 25) as int) % 12 * 5 + 1, 5)
                        when l_partkey % 3 = 0 then lpad(cast(l_partkey * 7919 % 100000 as string), 5, '0')
                        else substr('{CODE_LETTERS}', cast(l_partkey % 14 as int) + 1, 1)
                             || lpad(cast(l_partkey * 37 % 10000 as string), 4, '0')
                   end""").alias("hcpcs"),
        F.expr("substr(cast(l_shipdate as string), 1, 7)").alias("month"),
        F.expr("cast(l_quantity as bigint)").alias("patients"),
        F.expr("cast(l_quantity as bigint) * l_linenumber").alias("claim_lines"),
        F.expr("""cast(case when l_orderkey % 101 = 0 then -1
                            when l_orderkey % 103 = 0 then 0
                            when l_orderkey % 1009 = 0 then 100000
                            else 1 end * cast(l_extendedprice as decimal(18,2))
                       as decimal(18,2))""").alias("paid"),
    )


def npi_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider registry: npi, name, state (suppliers bill, customers serve)."""
    sup = (read_table(spark, sf_dir, "supplier")
           .where("s_suppkey % 13 <> 0")
           .select(F.expr("cast(1000000000 + s_suppkey as string)").alias("npi"),
                   F.col("s_name").alias("name"), F.col("s_nationkey").alias("nk")))
    cus = (read_table(spark, sf_dir, "customer")
           .select(F.expr("cast(2000000000 + c_custkey as string)").alias("npi"),
                   F.col("c_name").alias("name"), F.col("c_nationkey").alias("nk")))
    return sup.unionByName(cus).select(
        "npi", "name",
        F.expr(f"case when nk = 24 then 'SCX' "
               f"else substr('{STATE_CODES}', nk * 2 + 1, 2) end").alias("state"))


def spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact view: payment rows with the billing provider's state."""
    billed = read_table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().select(F.expr(BILLING_NPI).alias("billing_npi"))
    return add_billing_state(spending_raw(spark, sf_dir), npi_lookup(spark, sf_dir), billed)


def code_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions exist for letter codes only (numeric codes have none)."""
    return (spending_raw(spark, sf_dir)
            .select("hcpcs")
            .where(F.col("hcpcs").isNotNull() & F.substring("hcpcs", 1, 1).between("A", "Z"))
            .distinct()
            .select("hcpcs", F.concat(F.lit("Service "), F.col("hcpcs")).alias("name")))
