"""Filing, company, panel and price tables made of the given star-schema tables.

Each view is SQL that Spark and DuckDB read alike; ``{name}`` stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .functions.concepts import ALL_TAGS
from .functions.sectors import SECTORS, listed_ranges

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels")
_FEATURES = {
    "total_assets": "true",
    "total_liabilities": "l_linenumber <= 4",
    "total_equity": "l_linenumber > 4",
    "current_assets": "l_returnflag = 'N'",
    "current_liabilities": "l_returnflag = 'A'",
    "retained_earnings": "l_linenumber = 2",
    "cash_equivalents": "l_linenumber = 3",
    "total_debt": "l_quantity > 40",
    "total_revenue": "l_quantity > 5",
    "cost_of_sales": "l_quantity between 6 and 30",
    "operating_income": "l_discount > 0.05",
    "net_income": "l_discount > 0.07",
    "interest_expense": "l_linenumber = 1",
    "cash_from_operations": "l_tax > 0.04",
    "cash_from_investing": "l_tax <= 0.02",
    "cash_from_financing": "l_tax between 0.02 and 0.05",
}
FEATURES = tuple(_FEATURES)
VIEWS = {
    "sector_range": "select * from (values " + ", ".join(f"({i}, {lo}, {hi}, '{s}')" for i, lo, hi, s in listed_ranges()) + ") as t(place, low, high, sector)",
    "sector_list": "select * from (values " + ", ".join(f"({i}, '{s}', '{b}')" for i, (s, b) in enumerate(SECTORS)) + ") as t(idx, sector, bench)",
    "company": "select lpad(cast(c_custkey as string), 10, '0') as cik, c_custkey as custkey, c_name as entity_name, 'U' || cast(c_custkey % (select max(user_id) + 6 from {events}) as string) as ticker, c_mktsegment as exchange, lpad(cast((c_custkey * 37) % 10000 as string), 4, '0') as sic_code, cast(c_nationkey as string) as state from {customer}",
    "filing": "select lpad(cast(o_custkey as string), 10, '0') as cik, c_name as company_name, cast(o_orderdate as date) as date_filed, case o_orderstatus when 'F' then '10-K' when 'O' then '10-K/A' else 'NT 10-K/A' end as form_type, o_orderkey as filename from {orders} join {customer} on o_custkey = c_custkey",
    "panel": "select lpad(cast(o_custkey as string), 10, '0') as cik, cast(year(o_orderdate) as int) as fiscal_year, make_date(cast(year(o_orderdate) as int), 12, 31) as period_end, max(cast(o_orderdate as date)) as filed_date, " + ", ".join(f"round(sum(case when {c} then l_extendedprice end), 2) as {n}" for n, c in _FEATURES.items()) + " from {orders} join {lineitem} on o_orderkey = l_orderkey group by o_custkey, year(o_orderdate)",
    "fact": "select lpad(cast(o_custkey as string), 10, '0') as cik, split_part('" + ",".join(ALL_TAGS) + "', ',', cast(l_linenumber + 7 * (l_partkey % 5) as int)) as tag, cast(year(o_orderdate) as int) as fy, 'FY' as fp, 'USD' as unit, case o_orderstatus when 'F' then '10-K' when 'O' then '10-K/A' else '10-Q' end as form, cast(l_shipdate as date) as filed, make_date(cast(year(o_orderdate) as int), 12, case when l_partkey % 11 = 0 then 28 else 31 end) as period_end, l_partkey * 10000000 + l_orderkey as pos, l_extendedprice as val from {lineitem} join {orders} on l_orderkey = o_orderkey",
    "price": "select 'U' || cast(user_id as string) as ticker, cast(ts as date) as dt, max_by(value, event_id) + 1 as close, count(*) as volume from {events} group by user_id, cast(ts as date)",
    "bench_price": "select event_type as bench, cast(ts as date) as dt, round(avg(value), 6) + 1 as close from {events} group by event_type, cast(ts as date) union all select 'market' as bench, cast(ts as date) as dt, round(avg(value), 6) + 1 as close from {events} group by cast(ts as date)",
    "company_sector": "select c.*, coalesce(s.sector, 'Other') as sector from {company} c left join (select cik, max_by(r.sector, r.place) as sector from {company} join {sector_range} r on cast(sic_code as int) between r.low and r.high group by cik) s on c.cik = s.cik",
    "bench_list": "select bench, cast(row_number() over (order by bench) as int) - 1 as place from (select distinct event_type as bench from {events}) b",
    "grid": "select c.cik, c.custkey, c.ticker, c.sector, b.bench, date '2024-01-01' + cast(c.custkey % 35 as int) as filing_date, date '2023-10-03' + cast(c.custkey % 35 as int) as period_end from {company_sector} c join {sector_list} s on c.sector = s.sector join {bench_list} b on b.place = s.idx % (select count(*) from {bench_list})",
    "event_date": "select lpad(cast(o_custkey as string), 10, '0') as cik, cast(l_shipdate as date) as event_date from {lineitem} join {orders} on l_orderkey = o_orderkey where l_returnflag = 'R'",
    "event_span": "select lpad(cast(o_custkey as string), 10, '0') as cik, cast(o_orderdate as date) as start_date, cast(l_shipdate as date) as end_date from {lineitem} join {orders} on l_orderkey = o_orderkey where l_linenumber = 1",
    "pred": "select l_orderkey * 10 + l_linenumber as row_id, m.model, l_returnflag as outcome, cast(l_partkey % 12 as int) as sector_idx, case when l_linestatus = 'F' then 1 else 0 end as y, cast((l_orderkey * 7919 + l_linenumber * 104729 + m.k * 31 + case when l_linestatus = 'F' then 57 else 0 end) % 1000 as int) / cast(1000 as double) as score from {lineitem} cross join (values ('a', 0), ('b', 7)) as m(model, k)",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or one of the views over them."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return query(spark, sf_dir, VIEWS[name])


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in names})


def portable(sql: str) -> str:
    """The same for DuckDB: the views that are needed, in order, as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text)):
            if n in VIEWS and n not in needed:
                visit(VIEWS[n])
                if n not in needed:
                    needed.append(n)

    visit(sql)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    head = ", ".join(f"{n} as ({plain(VIEWS[n])})" for n in needed)
    body = plain(sql).strip()
    if not head:
        return body
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"
