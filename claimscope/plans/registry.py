"""Named queries: each is a Spark plan plus its oracle SQL.

``QUERIES`` maps a name to ``(build, sql)`` where ``build(inputs)`` returns a
lazy DataFrame and ``sql`` is the DuckDB text of the same question (None when
no SQL is given). Parameters are the fixed test parameters of the fixture.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.filters import Filter
from claimscope.operators import cubes as C
from claimscope.operators import dashboard as dash
from claimscope.operators import leaders as L
from claimscope.operators import dictionary, paid_range
from claimscope.operators import provider_lists as PL
from claimscope.operators import providers as P
from claimscope.operators import rows as R
from claimscope.operators import stats as S
from claimscope.plans import oracle_sql as O
from claimscope.plans import serve as V
from claimscope.plans.build import bake, build_from_files
from claimscope.plans.inputs import Inputs
from claimscope.schema import SOURCE_COLUMNS
from claimscope.session import checkpoint_dir
from claimscope.sources import quarantine as QR
from claimscope.sources import tables as T

# --- Fixed test parameters ---
MONTHS = Filter(month_from="1997-01", month_to="1998-12")
CODES = Filter(hcpcs="t1019, T2042 , ,D1110")
STATE = Filter(state="ny")
PAID = Filter(paid_min="10000", paid_max="50000")
EXTREME = Filter.exclude_extreme()
BILLING = Filter(billing_npi=" 1000000007 ")
SERVICING = Filter(servicing_npi="2000000001")
COMBINED = Filter(month_from="1997-03", month_to="1999-12", state="ny", paid_min="1000")
PEER_SCOPE = Filter(month_from="1997-03", month_to="1999-12", paid_min="1000", hcpcs="D1110")
NO = Filter()

QUERIES: dict[str, tuple[Callable[[Inputs], DataFrame], str | None]] = {}


def register(name: str, build: Callable[[Inputs], DataFrame], sql: str | None):
    QUERIES[name] = (build, sql)


# ---------------------------------------------------------------- dashboard
register("dash_grouping_sets",
         lambda i: dash.grouping_sets_out(dash.grouping_sets(i.fact())),
         O.dash_grouping_sets(NO))


def _section(name, flt=NO):
    def build(i: Inputs) -> DataFrame:
        a1 = dash.grouping_sets(i.fact(), flt)
        if name == "summary":
            return dash.summary(a1)
        if name == "monthly":
            return dash.monthly(a1)
        if name == "hist":
            return dash.hist(a1)
        if name == "top_sectors":
            return dash.top_sectors(a1)
        if name == "top_hcpcs":
            return dash.top_codes(a1, i.descs())
        if name == "top_billing":
            return dash.top_providers(a1, i.lookup(), "billing_npi")
        if name == "top_servicing":
            return dash.top_providers(a1, i.lookup(), "servicing_npi")
        if name == "top_states":
            return dash.top_groups(a1, "billing_state")
        raise KeyError(name)
    return build


for _s in ("summary", "monthly", "hist", "top_sectors", "top_hcpcs", "top_billing",
           "top_servicing", "top_states"):
    register(f"dash_{_s}", _section(_s), O.dash_section(NO, _s))


def _long(flt):
    return lambda i: dash.dashboard_long(i.fact(), i.lookup(), i.descs(), flt,
                                         sectors=i.sectors() if i.built else None)


register("dashboard_long", _long(NO), O.dashboard_long(NO))
for _n, _f in (("month_range", MONTHS), ("codes", CODES), ("state", STATE), ("paid_range", PAID),
               ("billing_npi", BILLING), ("servicing_npi", SERVICING), ("combined", COMBINED)):
    register(f"dash_filter_{_n}", _long(_f), O.dashboard_long(_f))
register("dash_exclude_extreme", _long(EXTREME), O.dashboard_long(EXTREME))


# ---------------------------------------------------------------- leaders

register("sector_leaders", lambda i: L.sector_leaders(i.fact(), i.lookup(), i.sectors()),
         O.sector_leaders(NO))
register("sector_leaders_filtered",
         lambda i: L.sector_leaders(i.fact(), i.lookup(), i.sectors(), COMBINED), O.sector_leaders(COMBINED))
register("sector_leaders_codes",
         lambda i: L.sector_leaders(i.fact(), i.lookup(), i.sectors(), CODES), O.sector_leaders(CODES))
for _role in ("billing", "servicing"):
    register(f"top_providers_state_{_role}",
             (lambda r: lambda i: L.top_providers_by_state(i.fact(), i.lookup(), r))(_role),
             O.top_providers_by_state(_role))
    register(f"top_providers_code_{_role}",
             (lambda r: lambda i: L.top_providers_by_code(i.fact(), i.lookup(), r))(_role),
             O.top_providers_by_code(_role))

# ---------------------------------------------------------------- providers

SUBJECT = "1000000007"
register("find_provider", lambda i: V.find_provider(i, "supplier#00000001"),
         O.find_provider("supplier#00000001"))
register("find_provider_broad", lambda i: V.find_provider(i, " SUPPLIER# "),
         O.find_provider(" SUPPLIER# "))
register("find_provider_none", lambda i: V.find_provider(i, "no such name"),
         O.find_provider("no such name"))
register("peer_codes", lambda i: P.peer_codes(i.fact(), i.descs(), SUBJECT),
         O.peer_codes(NO, SUBJECT))
register("peers", lambda i: P.peers(i.fact(), i.lookup(), SUBJECT), O.peers(NO, SUBJECT))
register("peer_codes_filtered", lambda i: P.peer_codes(i.fact(), i.descs(), SUBJECT, PEER_SCOPE),
         O.peer_codes(PEER_SCOPE, SUBJECT))
register("peers_filtered", lambda i: P.peers(i.fact(), i.lookup(), SUBJECT, PEER_SCOPE),
         O.peers(PEER_SCOPE, SUBJECT))
register("peers_unknown_npi", lambda i: P.peers(i.fact(), i.lookup(), "999"),
         O.peers(NO, "999"))
register("peer_subject", lambda i: P.peer_subject(i.lookup(), SUBJECT), O.peer_subject(SUBJECT))


def _index(i: Inputs) -> DataFrame:
    df = P.provider_index(i.fact(), i.lookup())
    return df.withColumn("codes", F.concat_ws(",", "codes"))


register("provider_index", _index, O.provider_index())

# ---------------------------------------------------------------- rows

register("rows_page", lambda i: R.rows_page(i.fact(), NO, "paid", "desc", 50, 100, i.stored("order_paid")),
         O.rows_page(NO, "paid", "desc", 50, 100))
register("rows_page_bogus_sort", lambda i: R.rows_page(i.fact(), NO, "bogus", "desc", 50, 0),
         O.rows_page(NO, "bogus", "desc", 50, 0))
register("rows_page_month_asc", lambda i: R.rows_page(i.fact(), STATE, "month", "ASC", 9999, 0),
         O.rows_page(STATE, "month", "ASC", 9999, 0))
register("rows_page_filtered", lambda i: R.rows_page(i.fact(), COMBINED, "hcpcs", "asc", 50, 20),
         O.rows_page(COMBINED, "hcpcs", "asc", 50, 20))
register("rows_page_deep", lambda i: R.rows_page(i.fact(), NO, "paid", "desc", 700, 59500),
         O.rows_page(NO, "paid", "desc", 700, 59500))
register("rows_page_middle", lambda i: R.rows_page(i.fact(), NO, "paid", "asc", 700, 30000),
         O.rows_page(NO, "paid", "asc", 700, 30000))
register("top_rows", lambda i: R.top_rows(i.fact(), counts=i.stored("order_paid")), O.top_rows())


def _walked(i: Inputs, limit: int = 20_000) -> DataFrame:
    """All rows, a page after the other, each from where the last one ended; from a copy
    in the order of the pages, so that a page reads its own few ranges."""
    path, table = _written(i, "rows-walk"), _written(i, "rows-walk-ordered")
    R.write_ordered_rows(i.fact(), table, rows_per_range=5 * limit)
    R.walk(i.spark, table, path, limit=limit)
    return i.spark.read.option("basePath", path).parquet(path).drop("page")


def _ordered_page(i: Inputs) -> DataFrame:
    path = _written(i, "rows-ordered")
    R.write_ordered_rows(i.fact(), path, rows_per_range=10_000)
    return R.ordered_rows_page(i.spark, path, limit=700, offset=30_000)


register("rows_walk", _walked, O.all_rows())
register("rows_page_ordered", _ordered_page, O.rows_page(NO, "paid", "desc", 700, 30_000))

# ---------------------------------------------------------------- cubes


def _mc(i: Inputs) -> DataFrame:
    return i.cube("cube_month_code", C.cube_month_code)


def _cb(i: Inputs) -> DataFrame:
    return i.cube("cube_code_bucket", C.cube_code_bucket)


register("cube_month_code", lambda i: C.out(_mc(i)), O.cube("month_code"))
register("cube_code_bucket", lambda i: C.out(_cb(i)), O.cube("code_bucket"))
register("cube_month_state", lambda i: C.out(i.cube("cube_month_state", C.cube_month_state)),
         O.cube("month_state"))
register("cube_state_code", lambda i: C.out(i.cube("cube_state_code", C.cube_state_code)),
         O.cube("state_code"))


def _cells(i: Inputs, name: str) -> DataFrame:
    """The cells of a cube, written: the cube and the indexes of its keys read the fact once."""
    path = _written(i, f"{name}-cells")
    T.write_table(C.cells(i.fact(), name), path)
    return i.spark.read.parquet(path)


def _indexed(i: Inputs) -> DataFrame:
    f = _cells(i, "cube_month_code")
    c = C.rolled("cube_month_code", f)
    c = C.with_index(c, "month", S.distinct_values(f, "month"), "month_idx")
    c = C.with_index(c, "hcpcs", S.distinct_values(f, "hcpcs"), "code_idx")
    return C.out(c)


register("cube_month_code_indexed", _indexed, O.cube_month_code_indexed())


def _indexed_cube(kind: str):
    def build(i: Inputs) -> DataFrame:
        f = _cells(i, f"cube_{kind}")
        c = C.rolled(f"cube_{kind}", f)
        if kind == "code_bucket":
            c = C.with_index(c, "hcpcs", S.distinct_values(f, "hcpcs"),
                             "code_idx")
            return C.out(c.select("code_idx", "bucket", "paid", "n"))
        if kind == "month_state":
            c = C.with_index(c, "month", S.distinct_values(f, "month"),
                             "month_idx")
            c = C.with_index(c, "billing_state", S.distinct_values(f, "billing_state"),
                             "state_idx")
        else:
            c = C.with_index(c, "billing_state",
                             S.distinct_values(f, "billing_state"), "state_idx")
            c = C.with_index(c, "hcpcs", S.distinct_values(f, "hcpcs"), "code_idx")
        return C.out(c)
    return build


for _k in ("code_bucket", "month_state", "state_code"):
    register(f"cube_{_k}_indexed", _indexed_cube(_k), O.cube_indexed(_k))

CUBE_ARGS = {"month_from": "1997-01", "month_to": "1998-12", "hcpcs": "t1019, T2042 , ,D1110"}
register("cubes_summary", lambda i: C.cubes_summary(_mc(i), **CUBE_ARGS),
         O.cubes_summary(**CUBE_ARGS))
register("cubes_monthly", lambda i: C.cubes_monthly(_mc(i), **CUBE_ARGS),
         O.cubes_monthly(**CUBE_ARGS))
register("cubes_monthly_all", lambda i: C.cubes_monthly(_mc(i)),
         O.cubes_monthly())
register("cubes_top_codes",
         lambda i: C.cubes_top_codes(_mc(i), month_from="1997-01",
                                     month_to="1998-12"),
         O.cubes_top_codes(month_from="1997-01", month_to="1998-12"))
register("cubes_hist", lambda i: C.cubes_hist(_cb(i), CUBE_ARGS["hcpcs"]),
         O.cubes_hist(CUBE_ARGS["hcpcs"]))

# ---------------------------------------------------------------- stats
register("dataset_stats", lambda i: S.dataset_stats(i.fact()), O.dataset_stats())
register("meta", lambda i: S.meta(i.fact()), O.meta())
register("distinct_months", lambda i: S.distinct_values(i.fact(), "month"),
         O.distinct_values("month"))
register("distinct_codes", lambda i: S.distinct_values(i.fact(), "hcpcs"),
         O.distinct_values("hcpcs"))
register("distinct_states", lambda i: S.distinct_values(i.fact(), "billing_state"),
         O.distinct_values("billing_state"))
register("state_coverage", lambda i: S.state_coverage(i.fact()), O.state_coverage())
register("sector_map", lambda i: S.sector_map(i.fact()), O.sector_map())
register("sector_code_counts", lambda i: S.sector_code_counts(i.fact()), O.sector_code_counts())


def _fact_view(i: Inputs) -> DataFrame:
    return i.fact().select("billing_npi", "servicing_npi", "hcpcs", "month", "patients",
                           "claim_lines", F.col("paid").cast("double").alias("paid"),
                           "billing_state")


register("fact_view", _fact_view, O.fact_view())

def _from_cube(**given):
    return lambda i: C.cubes_dashboard_long(i.cube("cube_dashboard", C.cube_dashboard), i.descs(),
                                            sectors=i.sectors() if i.built else None, **given)


register("cube_dashboard", lambda i: C.out(i.cube("cube_dashboard", C.cube_dashboard)), O.cube("dashboard"))
register("dash_from_cubes", _from_cube(**CUBE_ARGS), O.cubes_dashboard_long(**CUBE_ARGS))
register("dash_from_cubes_codes", _from_cube(hcpcs=CUBE_ARGS["hcpcs"]),
         O.cubes_dashboard_long(hcpcs=CUBE_ARGS["hcpcs"]))
register("dash_from_cubes_all", _from_cube(), O.cubes_dashboard_long())

# ---------------------------------------------------------------- sources and builds


def _written(i: Inputs, name: str) -> str:
    return f"{checkpoint_dir(i.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _money_out(df: DataFrame) -> DataFrame:
    return df.withColumn("paid", F.col("paid").cast("double"))


def _ingest_spending(i: Inputs) -> DataFrame:
    path = _written(i, "claims-csv")
    T.write_claims_csv(i.raw(), path)
    return _money_out(T.read_claims_csv(i.spark, path))


def _registry_csv(i: Inputs) -> str:
    path = _written(i, "registry-csv")
    wide = i.lookup().select(F.lit("x").alias("Entity Type Code"), F.col("name").alias(T.REGISTRY_NAME),
                             F.concat(F.lit(" "), F.lower("state"), F.lit("  ")).alias(T.REGISTRY_STATE),
                             F.col("npi").alias(T.REGISTRY_NPI))
    wide.write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _ingest_lookup(i: Inputs) -> DataFrame:
    twice = T.read_registry_csv(i.spark, _registry_csv(i))
    return T.dedupe_lookup(twice.unionByName(twice.withColumn("state", F.lit(None).cast("string"))))


def _json(i: Inputs, df: DataFrame, value: str) -> str:
    path = _written(i, f"{value}-json")
    T.write_json_map(df, path, "hcpcs", value)
    return path


_BUILDS: dict[tuple[str, str], str] = {}


def _from_files(i: Inputs, *tables: str) -> Inputs:
    """A whole build from files, of the fixture's rows, with the baked ``tables``; one
    build for each session and folder, to which a query adds the tables it reads."""
    at = (i.spark.sparkContext.applicationId, i.sf_dir)
    if at not in _BUILDS:
        claims, root = _written(i, "claims-csv"), _written(i, "build")
        T.write_claims_csv(i.raw(), claims)
        build_from_files(i.spark, claims, _registry_csv(i), root, _json(i, i.descs(), "name"), _json(i, i.sectors(), "sector"))
        _BUILDS[at] = root
    bake(i.spark, _BUILDS[at], only=tables)
    return Inputs.from_build(i.spark, _BUILDS[at])


def _built(answer, *tables: str):
    return lambda i: answer(_from_files(i, *tables))


register("ingest_spending", _ingest_spending, O.raw_view())
register("ingest_npi_lookup", _ingest_lookup, O.lookup_view())
register("load_code_desc", lambda i: T.read_json_map(i.spark, _json(i, i.descs(), "name"), "hcpcs", "name"),
         O.desc_view())
register("load_sector_map",
         lambda i: T.read_json_map(i.spark, _json(i, i.sectors(), "sector"), "hcpcs", "sector"), O.sector_map())


def _quarantined(i: Inputs) -> DataFrame:
    """The claims CSV with short rows, bad numbers and a third decimal, landed: all its
    rows, good and rejected."""
    text = {dst: F.col(dst).cast("string") for _, dst in SOURCE_COLUMNS}
    p = F.col("patients")
    text["patients"] = F.when(p == 17, F.lit("x17")).otherwise(text["patients"])
    text["claim_lines"] = F.when(p == 23, F.lit("1.5")).otherwise(text["claim_lines"])
    text["paid"] = F.when(p == 19, F.concat(text["paid"], F.lit("5"))).otherwise(text["paid"])
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in text.values()])
    line = F.when(p == 13, F.substring_index(line, ",", 3)).otherwise(line)
    path, out = _written(i, "claims-dirty"), _written(i, "claims-landed")
    (i.raw().select(line.alias(",".join(src for src, _ in SOURCE_COLUMNS))).write.option("header", True)
        .option("sep", "\u0001").option("quote", "").csv(path))
    QR.land_claims(i.spark, path, out)
    return _money_out(QR.accepted_claims(i.spark, out)).unionByName(QR.rejected_claims(i.spark, out).drop("file"), allowMissingColumns=True)


register("ingest_quarantine", _quarantined, O.quarantined())


def _grown_index(i: Inputs) -> DataFrame:
    """The codes' index after the months arrive in three batches."""
    path, known = _written(i, "code-index"), None
    month, ends = F.coalesce("month", F.lit("9")), ("", "1994-01", "1997-01", "~")
    for n, (first, end) in enumerate(zip(ends, ends[1:])):
        rows = i.fact().where((month >= first) & (month < end))
        T.write_table(dictionary.new_keys(known, rows, "hcpcs"), f"{path}/batch={n}")
        known = i.spark.read.option("basePath", path).parquet(*[f"{path}/batch={m}" for m in range(n + 1)]).drop("batch")
    return dictionary.sorted_view(known, "hcpcs")


register("codes_grown_index", _grown_index, O.grown_index())
register("built_fact", _built(_fact_view), O.fact_view())
register("built_dashboard_long", _built(_long(NO)), O.dashboard_long(NO))
register("built_peers", _built(lambda b: P.peers(b.fact(), b.lookup(), SUBJECT)), O.peers(NO, SUBJECT))
register("built_dash_default", _built(V.dashboard, "dash_default"), O.dashboard_long(NO))
register("built_dash_outliers", _built(lambda b: V.dashboard(b, EXTREME), "dash_outliers"), O.dashboard_long(EXTREME))
register("built_sector_leaders", _built(V.sector_leaders, "sector_leaders"), O.sector_leaders(NO))
register("built_provider_index",
         _built(lambda b: V.provider_index(b).withColumn("codes", F.concat_ws(",", "codes")), "provider_index"), O.provider_index())
register("built_top_rows", _built(V.top_rows, "top_rows"), O.top_rows())
for _role in ("billing", "servicing"):
    for _group, _sql in (("state", O.top_providers_by_state), ("code", O.top_providers_by_code)):
        register(f"built_top_providers_{_group}_{_role}",
                 _built((lambda g, r: lambda b: V.top_providers(b, g, r))(_group, _role), f"top_providers_{_group}_{_role}"),
                 _sql(_role))
for _n, _text in (("", "supplier#00000001"), ("_broad", " SUPPLIER# "), ("_wildcard", "S_pp%er#%7"), ("_no_gram", "s%e%7")):
    register(f"built_find_provider{_n}", _built((lambda t: lambda b: V.find_provider(b, t))(_text), "provider_totals", "name_grams"),
             O.find_provider(_text))
for _k in ("month_code", "code_bucket", "month_state", "state_code", "dashboard"):
    register(f"built_cube_{_k}", _built((lambda k: lambda b: C.out(b.stored(f"cube_{k}")))(_k), f"cube_{_k}"), O.cube(_k))
register("built_rows_page_deep",
         _built(lambda b: R.rows_page(b.fact(), NO, "paid", "desc", 700, 59500, b.stored("order_paid")), "order_paid"),
         O.rows_page(NO, "paid", "desc", 700, 59500))
for _n, _f in (("", Filter(**CUBE_ARGS)), ("_months", MONTHS), ("_codes", CODES), ("_all", NO)):
    register(f"built_dash_from_cubes{_n}",
             _built((lambda f: lambda b: V.dashboard_from_cubes(b, f))(_f), *PL.tables(_f), "cube_dashboard"), O.dashboard_long(_f))


def _of_amounts(flt):
    return lambda b: paid_range.dashboard_long(b.stored, b.fact(), b.lookup(), b.descs(), flt, sectors=b.sectors())


for _n, _f in (("paid_range", PAID), ("paid_extreme", EXTREME),
               ("paid_months", Filter(month_from="1997-01", month_to="1998-12", paid_min="-1500", paid_max="61000.505"))):
    register(f"built_dash_{_n}", _built(_of_amounts(_f), *paid_range.tables()), O.dashboard_long(_f))


def _from_interleaved(flt):
    return lambda b: dash.dashboard_long(b.fact_for(flt), b.lookup(), b.descs(), flt, sectors=b.sectors())


register("built_fact_interleaved", _built(lambda b: _money_out(b.fact_for(STATE).drop("hcpcs_norm")), "fact_interleaved"), O.fact_view())
for _n, _f in (("billing_npi", BILLING), ("servicing_npi", SERVICING), ("state", STATE), ("paid_range", PAID),
               ("months_paid", Filter(month_from="1997-01", month_to="1998-12", state="ny", paid_min="61000.505"))):
    register(f"built_dash_interleaved_{_n}", _built(_from_interleaved(_f), "fact_interleaved"), O.dashboard_long(_f))
