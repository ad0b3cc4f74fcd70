"""Raw-file readers and the Parquet tables of the batch build.

* ``read_claims_csv`` / ``read_registry_csv`` – the raw inputs, read with an
  header names as text and cast with ANSI semantics (a bad number fails
  the job instead of becoming null).
* ``write_fact`` – the clustered fact table: range-partitioned and sorted by
  (month, normalised code), one directory per month, ZSTD. Month filters
  prune whole directories; code filters prune row groups by min/max;
  provider equality filters prune row groups by bloom filter.
* ``new_build`` / ``complete_build`` / ``latest_build`` – all tables of a build
  live in one version folder; readers switch when its marker is written.
* ``finish_table`` – a step that can be repeated: finished tables stay, unfinished
  ones are written again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.schema import MONEY, NPI_LOOKUP, SOURCE_COLUMNS, SPENDING

FACT_SCHEMA_DDL = ", ".join(
    [f"{f.name} {f.dataType.simpleString()}" for f in SPENDING.fields] + ["hcpcs_norm string"])


def read_csv_by_name(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header as text columns named by its header. Every file must
    have that header; a row with too few or too many fields fails the job; a
    doubled quote inside quotes is a quote."""
    return (spark.read.option("header", True).option("inferSchema", False)
                 .option("enforceSchema", False).option("mode", "FAILFAST")
                 .option("columnPruning", False).option("escape", '"').csv(path))


def typed_claims(raw: DataFrame, rounding: str = "fail") -> DataFrame:
    """Source columns (by name, text) → the seven typed fact columns. An
    amount with more than two decimals fails the job, or is rounded when
    ``rounding`` is ``"round"``; a value that is no number fails it always."""
    if rounding not in ("fail", "round"):
        raise ValueError("rounding is fail or round")
    amount = F.col("TOTAL_PAID").cast(MONEY)
    if rounding == "fail":
        exact = F.col("TOTAL_PAID").cast("decimal(38,10)") == amount
        amount = F.when(F.col("TOTAL_PAID").isNull() | exact, amount).otherwise(F.raise_error(F.concat(
            F.lit("amount with more than two decimals: "), F.col("TOTAL_PAID"))).cast(MONEY))
    made = {"patients": F.col("TOTAL_PATIENTS").cast("bigint"),
            "claim_lines": F.col("TOTAL_CLAIM_LINES").cast("bigint"), "paid": amount}
    return raw.select(*[made.get(dst, F.col(src)).alias(dst) for src, dst in SOURCE_COLUMNS])


def read_claims_csv(spark: SparkSession, path: str, rounding: str = "fail") -> DataFrame:
    """The claims-summary CSV → the seven typed fact columns."""
    return typed_claims(read_csv_by_name(spark, path), rounding)


def write_claims_csv(raw: DataFrame, path: str) -> None:
    """Fact columns back to the source CSV layout."""
    (raw.select(*[F.col(dst).cast("string").alias(src) for src, dst in SOURCE_COLUMNS])
        .write.option("header", True).option("escape", '"').csv(path))


def amount_precision_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows whose amount has more than two decimals, counted (for a look at a
    file before it is ingested with ``rounding="round"``)."""
    wide = F.col("TOTAL_PAID").cast("decimal(38,10)")
    return read_csv_by_name(spark, path).agg(
        F.count(F.when(wide != wide.cast(MONEY), 1)).alias("rounded_rows"),
        F.count(F.lit(1)).alias("rows"))


# The two registry columns used.
REGISTRY_NPI = "NPI"
REGISTRY_STATE = "Provider Business Practice Location Address State Name"
REGISTRY_NAME = "Provider Organization Name (Legal Business Name)"


def read_registry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Provider registry CSV (all text) → ``npi, name, state``: state trimmed
    and upper-cased, rows without an NPI dropped."""
    raw = read_csv_by_name(spark, path)
    name = F.col(f"`{REGISTRY_NAME}`") if REGISTRY_NAME in raw.columns else F.lit(None)
    return (raw.select(F.col(REGISTRY_NPI).cast("string").alias("npi"),
                       name.cast("string").alias("name"),
                       F.upper(F.trim(F.col(f"`{REGISTRY_STATE}`"))).alias("state"))
               .where(F.col("npi").isNotNull()))


def dedupe_lookup(lookup: DataFrame) -> DataFrame:
    """One row per NPI (a duplicate would multiply fact rows in the state
    join). The smallest state that is not null wins, then the smallest name
    that is not null."""
    best = F.struct(F.col("state").isNull(), "state", F.col("name").isNull(), "name")
    return (lookup.groupBy("npi").agg(F.min(best).alias("_v"))
                  .select("npi", F.col("_v.name").alias("name"), F.col("_v.state").alias("state")))


def clustered(fact: DataFrame) -> DataFrame:
    """Add ``hcpcs_norm`` and lay the rows out by (month, hcpcs_norm). The
    provider columns are part of the range key, so the rows of one busy month
    and code are spread over several partitions."""
    fact = fact.withColumn("hcpcs_norm", F.upper("hcpcs"))
    key = ["month", "hcpcs_norm", "billing_npi", "servicing_npi"]
    return fact.repartitionByRange(*key).sortWithinPartitions(*key)


#: How a fact table is written besides its folders.
FACT_OPTIONS = {"maxRecordsPerFile": 5_000_000, "parquet.bloom.filter.enabled#billing_npi": "true",
                "parquet.bloom.filter.enabled#servicing_npi": "true"}


def write_fact(fact: DataFrame, path: str, max_records_per_file: int = FACT_OPTIONS["maxRecordsPerFile"]) -> None:
    """Write the clustered fact table. Provider columns are not clustered, so
    they get Parquet bloom filters: an equality filter on a billing or
    servicing NPI (peers, provider filters) skips the row groups that cannot
    hold it instead of reading them all. (A column chunk that stays fully
    dictionary-encoded – small files – gets no bloom filter; Parquet's
    dictionary filtering skips those row groups instead.)"""
    (clustered(fact).write.mode("errorifexists")
        .partitionBy("month")
        .option("compression", "zstd")
        .options(**FACT_OPTIONS | {"maxRecordsPerFile": max_records_per_file})
        .parquet(path))


def read_fact(spark: SparkSession, root: str) -> DataFrame:
    """The fact table of the latest complete build under ``root``."""
    return fact_at(spark, latest_build(spark, root))


def fact_at(spark: SparkSession, build: str, name: str = "fact") -> DataFrame:
    """The fact table of one build, or a copy of it in another layout (explicit schema,
    so the month directories are read back as text)."""
    path = f"{build}/{name}"
    return (spark.read.schema(FACT_SCHEMA_DDL)
                 .option("basePath", path).parquet(path)
                 .select(*[f.name for f in SPENDING.fields], "hcpcs_norm"))


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def table_exists(spark: SparkSession, path: str) -> bool:
    """A finished table (``_SUCCESS`` written) at ``path``."""
    fs, p = _fs(spark, path)
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))


# ---------------------------------------------------------------- builds
# All tables of a build share one version folder. Its marker is written last, so
# readers never see half a build and never mix tables of two. Aggregates that are
# added to a build later have a marker of their own.
MARKER, BAKED = "_BUILD_COMPLETE", "_BAKE_COMPLETE"


def _numbered(spark: SparkSession, root: str) -> dict[int, str]:
    return {int(n[2:]): f"{root}/{n}" for n in names_in(spark, root) if n.startswith("v=") and n[2:].isdigit()}


def new_build(spark: SparkSession, root: str) -> str:
    """The path of a version that does not exist yet."""
    return f"{root}/v={max(_numbered(spark, root), default=0) + 1}"


def mark(spark: SparkSession, path: str) -> None:
    """Write an empty marker file."""
    fs, p = _fs(spark, path)
    fs.create(p).close()


def unmark(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, False)


def marked(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    fs, p = _fs(spark, path)
    return sorted(st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else []


def complete_build(spark: SparkSession, build: str) -> None:
    mark(spark, f"{build}/{MARKER}")


def latest_build(spark: SparkSession, root: str) -> str:
    """The newest version whose marker is there."""
    for _, path in sorted(_numbered(spark, root).items(), reverse=True):
        if marked(spark, f"{path}/{MARKER}"):
            return path
    raise FileNotFoundError(f"no complete build under {root}")


def is_baked(spark: SparkSession, build: str) -> bool:
    """All aggregates of a build are written."""
    return marked(spark, f"{build}/{BAKED}")


def read_json_map(spark: SparkSession, path: str, key: str = "hcpcs",
                  value: str = "sector") -> DataFrame:
    """A JSON object file ``{"code": "value", ...}`` → ``key, value`` rows.

    Such a file is one JSON value, so each file is parsed by one task; it is
    meant for the small code maps (sector names, code descriptions), which
    are then broadcast by size. Many files are read in parallel."""
    text = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), "map<string,string>")
    return text.select(F.explode(m).alias(key, value))


def write_json_map(df: DataFrame, path: str, key: str = "hcpcs", value: str = "sector") -> None:
    """Inverse of :func:`read_json_map` for a small map (one file)."""
    (df.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, value)))).alias("value"))
       .write.mode("overwrite").text(path))


def write_table(df: DataFrame, path: str) -> None:
    """Write a new table; an existing one is never overwritten."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def finish_table(df: DataFrame, path: str, by: Sequence[str] = (), **options) -> bool:
    """Write a table (partitioned ``by`` columns) unless it is finished; what a writer
    that died has left is overwritten. Returns whether it was written."""
    if table_exists(df.sparkSession, path):
        return False
    df.write.mode("overwrite").partitionBy(*by).option("compression", "zstd").options(**options).parquet(path)
    return True


__all__ = ["read_json_map", "write_json_map", "read_csv_by_name", "read_claims_csv", "read_registry_csv",
           "typed_claims", "write_claims_csv", "amount_precision_report", "dedupe_lookup", "write_fact",
           "read_fact", "fact_at", "write_table", "finish_table", "new_build", "complete_build", "latest_build",
           "is_baked", "mark", "unmark", "marked", "names_in", "NPI_LOOKUP"]
