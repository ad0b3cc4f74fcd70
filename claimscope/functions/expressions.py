"""Small Column builders used across the queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def paid_bucket(paid: Column | str = "paid") -> Column:
    """Log-10 bucket of a positive amount: floor(log10(paid)); null for
    amounts that are zero, negative or null."""
    p = col(paid)
    return F.when(p > 0, F.floor(F.log10(p.cast("double"))).cast("int"))


def money(c: Column | str) -> Column:
    """Exact DECIMAL money → DOUBLE for output (conversion happens once, at the end)."""
    return col(c).cast("double")


def round2(c: Column | str) -> Column:
    """round(x, 2) on a decimal: exact half-up, a no-op for two-place data."""
    return F.round(col(c), 2)


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0))


def valid_state(c: Column | str = "billing_state") -> Column:
    """A usable state code: non-null and exactly two characters."""
    x = col(c)
    return x.isNotNull() & (F.length(x) == 2)


def measure_sums(paid: str = "paid") -> list[Column]:
    """sum(paid), sum(patients), sum(claim_lines), count(*) – kept exact."""
    return [F.sum(paid).alias("paid"), F.sum("patients").alias("patients"),
            F.sum("claim_lines").alias("claim_lines"), F.count(F.lit(1)).alias("n")]
