"""Claims CSV with bad rows set apart, beside the reader that fails at the first one.

``land_claims`` reads the files once and writes every row: good ones typed, the others
with the reason, the file and the record as it was. Good and rejected rows lie in
partitions of their own and together are all rows of the input. A file with another
header still fails the job: then no row of it can be told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.schema import MONEY, SOURCE_COLUMNS, SPENDING_RAW
from claimscope.sources.tables import finish_table, read_csv_by_name

#: Why a row is rejected.
FIELDS, NUMBER, DECIMALS = "wrong number of fields", "not a number", "more than two decimals"
LANDED = T.StructType([*SPENDING_RAW.fields, T.StructField("reason", T.StringType()), T.StructField("file", T.StringType()),
                       T.StructField("record", T.StringType()), T.StructField("rejected", T.BooleanType())])
NUMBERS = {"TOTAL_PATIENTS": "bigint", "TOTAL_CLAIM_LINES": "bigint", "TOTAL_PAID": MONEY.simpleString()}


def _reason(rounding: str, corrupt: str) -> Column:
    reason = F.when(F.col(corrupt).isNotNull(), F.lit(FIELDS))
    for name, kind in NUMBERS.items():
        reason = reason.when(F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull(), F.lit(f"{name}: {NUMBER}"))
    if rounding == "fail":
        amount = F.col("TOTAL_PAID")
        reason = reason.when(amount.try_cast("decimal(38,10)") != amount.try_cast(MONEY), F.lit(f"TOTAL_PAID: {DECIMALS}"))
    return reason


def checked_claims(spark: SparkSession, path: str, rounding: str = "fail") -> DataFrame:
    """One row per row of the files: the seven fact columns, ``reason`` (null: good),
    ``file``, ``record`` (null: good) and ``rejected``. The fact columns of a rejected
    row are null. ``rounding`` as in ``typed_claims``."""
    if rounding not in ("fail", "round"):
        raise ValueError("rounding is fail or round")
    header, corrupt = read_csv_by_name(spark, path).schema, "_corrupt"
    raw = (spark.read.schema(T.StructType([*header.fields, T.StructField(corrupt, T.StringType())]))
                .option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", corrupt).option("columnPruning", False).option("escape", '"').csv(path))
    fields = [F.col("`" + f.name.replace("`", "``") + "`") for f in header.fields]
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), _reason(rounding, corrupt).alias("_reason"))
    good = F.col("_reason").isNull()
    typed = [F.when(good, F.col(src).try_cast(NUMBERS[src]) if src in NUMBERS else F.col(src)).alias(dst)
             for src, dst in SOURCE_COLUMNS]
    record = F.when(~good, F.coalesce(F.col(corrupt), F.to_csv(F.struct(*fields))))
    return raw.select(*typed, F.col("_reason").alias("reason"), F.col("_file").alias("file"), record.alias("record"),
                      (~good).alias("rejected"))


def land_claims(spark: SparkSession, path: str, out: str, rounding: str = "fail") -> bool:
    """Write :func:`checked_claims` to ``out`` unless that is finished; one read of the
    files. Returns whether it was written."""
    return finish_table(checked_claims(spark, path, rounding), out, by=["rejected"])


def accepted_claims(spark: SparkSession, out: str) -> DataFrame:
    """The good rows that were landed: the seven fact columns."""
    return _landed(spark, out).where(~F.col("rejected")).select(*[f.name for f in SPENDING_RAW.fields])


def rejected_claims(spark: SparkSession, out: str) -> DataFrame:
    """The rejected rows that were landed: ``reason, file, record``."""
    return _landed(spark, out).where("rejected").select("reason", "file", "record")


def _landed(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(LANDED).parquet(out)
