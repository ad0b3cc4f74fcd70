"""Answers from the tables baked with a build, computed where none is stored.

Each function takes :class:`claimscope.plans.inputs.Inputs` and returns what the
operator of the same question returns: from the stored table if the build has it
and the question is the one it was baked for, else from the fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.filters import DASHBOARD_SCOPE, LEADERS_SCOPE, NO_FILTER, Filter
from claimscope.operators import cubes as C
from claimscope.operators import dashboard as dash
from claimscope.operators import leaders as L
from claimscope.operators import paid_range
from claimscope.operators import provider_lists as PL
from claimscope.operators import providers as P
from claimscope.operators import rows as R
from claimscope.operators import search
from claimscope.plans.inputs import Inputs


def dashboard(i: Inputs, flt: Filter = NO_FILTER) -> DataFrame:
    """The landing page and the preset without extreme rows are stored; a range of
    amounts (and months) is answered from cells and lists where these are."""
    flt = flt.scoped(*DASHBOARD_SCOPE)
    name = {NO_FILTER: "dash_default", Filter.exclude_extreme(): "dash_outliers"}.get(flt)
    baked = i.stored(name) if name else None
    if baked is not None:
        return baked
    if paid_range.answers(flt) and all(i.stored(t) is not None for t in paid_range.tables()):
        return paid_range.dashboard_long(i.stored, i.fact(), i.lookup(), i.descs(), flt, sectors=i.sectors())
    return dash.dashboard_long(i.fact_for(flt), i.lookup(), i.descs(), flt, sectors=i.sectors())


def sector_leaders(i: Inputs, flt: Filter = NO_FILTER) -> DataFrame:
    baked = i.stored("sector_leaders") if flt.scoped(*LEADERS_SCOPE).is_empty() else None
    if baked is None:
        return L.sector_leaders(i.fact_for(flt.scoped(*LEADERS_SCOPE)), i.lookup(), i.sectors(), flt)
    return baked.orderBy("sector", F.col("paid").desc_nulls_last(), "rk")


def top_providers(i: Inputs, group: str, role: str = "billing") -> DataFrame:
    """``group``: state or code."""
    baked = i.stored(f"top_providers_{group}_{role}")
    if baked is not None:
        return baked
    return {"state": L.top_providers_by_state, "code": L.top_providers_by_code}[group](i.fact(), i.lookup(), role)


def provider_index(i: Inputs) -> DataFrame:
    baked = i.stored("provider_index")
    if baked is None:
        return P.provider_index(i.fact(), i.lookup())
    return baked.orderBy(F.col("total").desc(), F.col("npi").asc())


def top_rows(i: Inputs, k: int = 2000) -> DataFrame:
    """At most 2,000 rows are stored; more are listed by their place in the order."""
    baked = i.stored("top_rows") if k <= 2000 else None
    if baked is None:
        return R.top_rows(i.fact(), k, i.stored("order_paid"))
    return baked.orderBy(*[key.order() for key in R.sort_keys()]).limit(k)


def find_provider(i: Inputs, name: str, k: int = 10) -> DataFrame:
    totals, grams = i.stored("provider_totals"), i.stored("name_grams")
    if totals is None or grams is None:
        return P.find_provider(i.fact(), i.lookup(), name, k)
    return search.find_stored(totals, grams, name, k)


def dashboard_from_cubes(i: Inputs, flt: Filter = NO_FILTER) -> DataFrame:
    """The whole dashboard under months and codes from the baked cube, provider lists
    and bitmaps; the fact is not read."""
    flt = flt.scoped("month_from", "month_to", "hcpcs")
    given = {n: getattr(flt, n) for n in ("month_from", "month_to", "hcpcs")}
    cube = i.stored("cube_dashboard")
    rest = C.cubes_dashboard_long(cube, i.descs(), sectors=i.sectors(), **given)
    return rest.unionByName(PL.provider_sections(i.stored, i.lookup(), flt))
