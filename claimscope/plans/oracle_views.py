"""The fixture views as SQL text, for the independent DuckDB oracle.

Only the driver's base tables are registered in the oracle's database, so
every oracle query starts with these views as CTEs. The text is the fixture
definition itself and is accepted unchanged by DuckDB and Spark SQL.
"""

SPENDING_RAW_SQL = """
select
  case when l_suppkey % 29 = 0 then null else cast(1000000000 + l_suppkey as string) end as billing_npi,
  cast(2000000000 + o_custkey as string) as servicing_npi,
  case when l_partkey % 97 = 0 then null
       when l_partkey % 89 = 0 then 't1019'
       when l_partkey % 25 = 0 then substr('T1019T2042Q5003G0299A0425S0215S91235T201602D1110W17939959999605', cast(floor(l_partkey / 25) as int) % 12 * 5 + 1, 5)
       when l_partkey % 3 = 0 then lpad(cast(l_partkey * 7919 % 100000 as string), 5, '0')
       else substr('DTQGASEKLJHVWZ', cast(l_partkey % 14 as int) + 1, 1) || lpad(cast(l_partkey * 37 % 10000 as string), 4, '0')
  end as hcpcs,
  substr(cast(l_shipdate as string), 1, 7) as month,
  cast(l_quantity as bigint) as patients,
  cast(l_quantity as bigint) * l_linenumber as claim_lines,
  cast(case when l_orderkey % 101 = 0 then -1
            when l_orderkey % 103 = 0 then 0
            when l_orderkey % 1009 = 0 then 100000
            else 1 end * cast(l_extendedprice as decimal(18,2)) as decimal(18,2)) as paid
from lineitem join orders on l_orderkey = o_orderkey
"""

NPI_STATE_SQL = """
select npi, name,
       case when nk = 24 then 'SCX'
            else substr('NYCATXMAMINJOHNCFLAZVAMOPAILGAWAORCOMNWIINTNKYLA', nk * 2 + 1, 2) end as state
from (select cast(1000000000 + s_suppkey as string) as npi, s_name as name, s_nationkey as nk
      from supplier where s_suppkey % 13 <> 0
      union all
      select cast(2000000000 + c_custkey as string) as npi, c_name as name, c_nationkey as nk
      from customer) u
"""

SPENDING_SQL = """
select s.*, n.state as billing_state
from spending_raw s left join npi_state n on s.billing_npi = n.npi
"""

CODE_DESC_SQL = """
select distinct hcpcs, 'Service ' || hcpcs as name
from spending_raw
where hcpcs is not null and substr(hcpcs, 1, 1) between 'A' and 'Z'
"""

VIEWS = (f"with spending_raw as ({SPENDING_RAW_SQL}),\n"
         f"npi_state as ({NPI_STATE_SQL}),\n"
         f"spending as ({SPENDING_SQL}),\n"
         f"code_desc as ({CODE_DESC_SQL})")


def with_views(body: str, *ctes: tuple[str, str]) -> str:
    """``WITH <fixture views>, <extra ctes> <body>``."""
    extra = "".join(f",\n{name} as ({sql})" for name, sql in ctes)
    return f"{VIEWS}{extra}\n{body}"
