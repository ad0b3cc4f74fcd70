"""The one filter every query shares.

A :class:`Filter` holds the user's raw parameters (strings, as they arrive)
and turns them into a single Column predicate. Clauses are ANDed; absent or
blank parameters are skipped; SQL null logic applies, so a null column value
never passes a clause. Each query honours only its own subset of the
parameters, chosen with :meth:`Filter.scoped`.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, fields, replace
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the per-row amount above which the "exclude extreme rows"
# preset drops a row (inclusive limit).
EXTREME_PAID = "100000000"

# Parameters each query honours.
DASHBOARD_SCOPE = ("month_from", "month_to", "hcpcs", "billing_npi", "servicing_npi",
                   "state", "paid_min", "paid_max")
ROWS_SCOPE = DASHBOARD_SCOPE
LEADERS_SCOPE = ("month_from", "month_to", "hcpcs", "state", "paid_min", "paid_max")
PEERS_SCOPE = ("month_from", "month_to", "state", "paid_min", "paid_max")


def parse_codes(text: str | None) -> list[str]:
    """The billing codes of a comma list, normalised; blank items are skipped."""
    return list(filter(None, map(str.strip, (text or "").upper().split(","))))


def amount_bound(text, rounding: str) -> Column:
    """An amount bound as a literal that is exact and pushable.

    ``paid`` has two decimals, so a bound may be rounded to two decimals inwards
    (a minimum up, a maximum down) without changing the answer; it then has the
    type of ``paid`` and Parquet can use it. Bounds beyond the type's range are
    compared as doubles. A non-numeric amount is an error.
    """
    value = float(text)
    try:
        d = Decimal(str(text).strip())
    except InvalidOperation:
        d = Decimal(value)
    if not d.is_finite() or abs(d) >= Decimal(10) ** 16 - 1:
        return F.lit(value)
    return F.lit(d.quantize(Decimal("0.01"), rounding=rounding)).cast("decimal(18,2)")


def _code_column(columns) -> Column:
    # a stored hcpcs_norm prunes row groups; upper(hcpcs) cannot
    stored = columns is not None and "hcpcs_norm" in columns
    return F.col("hcpcs_norm") if stored else F.upper(F.col("hcpcs"))


def _code_clause(value, columns) -> Column | None:
    codes = parse_codes(value)
    return _code_column(columns).isin(codes) if codes else None


def _equals(column: str, normalise=str.strip):
    def clause(value, _) -> Column | None:
        v = normalise(value)
        return F.col(column) == F.lit(v) if v else None
    return clause


# How each parameter restricts the rows: (value, column names) → clause.
CLAUSES = {
    "month_from": lambda v, _: F.col("month") >= F.lit(v),
    "month_to": lambda v, _: F.col("month") <= F.lit(v),
    "hcpcs": _code_clause,
    "billing_npi": _equals("billing_npi"),
    "servicing_npi": _equals("servicing_npi"),
    "state": _equals("billing_state", lambda v: v.strip().upper()),
    "paid_min": lambda v, _: F.col("paid") >= amount_bound(v, ROUND_CEILING),
    "paid_max": lambda v, _: F.col("paid") <= amount_bound(v, ROUND_FLOOR),
}


@dataclass(frozen=True)
class Filter:
    month_from: str | None = None
    month_to: str | None = None
    hcpcs: str | None = None
    billing_npi: str | None = None
    servicing_npi: str | None = None
    state: str | None = None
    paid_min: str | float | None = None
    paid_max: str | float | None = None

    @classmethod
    def from_params(cls, params: dict) -> "Filter":
        """Build from a dict of strings (or single-item lists, as query strings give)."""
        names = {f.name for f in fields(cls)}
        kw = {}
        for k, v in params.items():
            if k in names:
                kw[k] = v[0] if isinstance(v, (list, tuple)) else v
        return cls(**kw)

    @classmethod
    def exclude_extreme(cls) -> "Filter":
        return cls(paid_max=EXTREME_PAID)

    def scoped(self, *names: str) -> "Filter":
        """Keep only the named parameters (the others are cleared)."""
        return replace(self, **{f.name: None for f in fields(self) if f.name not in names})

    def clauses(self, columns=None) -> list[Column]:
        """One Column per active clause. ``columns`` (the frame's column
        names) lets the code filter use a stored ``hcpcs_norm`` column, which
        Parquet can prune on, instead of ``upper(hcpcs)``, which it cannot."""
        given = {f.name: getattr(self, f.name) for f in fields(self)}
        made = [build(given[name], columns) for name, build in CLAUSES.items()
                if given[name] not in (None, "")]
        return [c for c in made if c is not None]

    def predicate(self, columns=None) -> Column | None:
        cl = self.clauses(columns)
        return functools.reduce(operator.and_, cl) if cl else None

    def apply(self, df: DataFrame) -> DataFrame:
        p = self.predicate(df.columns)
        return df if p is None else df.where(p)

    def is_empty(self) -> bool:
        return not self.clauses()


NO_FILTER = Filter()
