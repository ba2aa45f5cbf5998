"""Queries on filings, companies, facts, labels and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.concepts import DATING, DEBT, FEATURES as ANNUAL, PROBES, SIMPLE, concept_rows, concept_table
from .functions.exprs import normalize_key, portable_uniform, safe_div
from .functions.sectors import sector_index, with_sector
from .operators import facts as A
from .operators import labels as B
from .operators import panel as P
from .operators.features import PanelScaler
from .plans import splits as S
from .queries_market import r6
from .sources import landed
from .streaming import streams
from .views import FEATURES, view

_TAGS = "tags as (select * from (values " + ", ".join(f"('{t}', '{f}', {p})" for t, f, p in concept_rows()) + ") as t(tag, feature, priority))"
_RES = f"{_TAGS}, res as (select cik, fy, feature, tag, filed, val from (select f.*, t.feature, row_number() over (partition by cik, fy, feature order by priority, filed desc, pos) as k from {{fact}} f join tags t on f.tag = t.tag where form = '10-K') x where k = 1)"
FIRST, LAST, SINCE = 1995, 2001, "1997-01-01"
_PANEL_COLS = ("total_assets", "total_equity", "retained_earnings", "interest_expense", "net_income")


def _resolved(spark, sf):
    return P.resolve_features(view(spark, sf, "fact").where("form = '10-K'"), concept_table(spark))


def _coverage(spark, sf):
    return P.filing_coverage(view(spark, sf, "filing"), FIRST, LAST, SINCE)


def normalize_keys(spark, sf):
    c = view(spark, sf, "customer")
    raw = F.when(F.col("c_custkey") % 7 == 0, " nan ").otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", normalize_key(raw, 10, True).alias("cik"), normalize_key(F.concat(F.lit("12345"), F.col("c_custkey").cast("string")), 6).alias("gvkey"))


def safe_div_query(spark, sf):
    li = view(spark, sf, "lineitem")
    den = F.when(F.col("l_linenumber") == 1, 1e-9).otherwise(F.col("l_quantity"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", safe_div(F.col("l_extendedprice"), den).alias("ratio"))


def sic_sector(spark, sf):
    return with_sector(view(spark, sf, "company")).select("cik", "sic_code", "sector")


def sector_index_query(spark, sf):
    return with_sector(view(spark, sf, "company")).select("cik", sector_index(F.col("sector")).alias("sector_idx"))


def filing_index_scan(spark, sf):
    return landed.filter_forms(view(spark, sf, "filing"), ["10-K", "10-K/A"]).withColumn("filing_year", F.year("date_filed"))


def filing_index_parse(spark, sf):
    """One file a year and quarter. Half of the company numbers stand at the right of their field, and files of fourth quarters have no header, so none of their rows count."""
    f = view(spark, sf, "filing").withColumn("file", F.year("date_filed") * 10 + F.quarter("date_filed"))
    number = F.col("cik").cast("long").cast("string")
    placed = F.when(F.col("filename") % 2 == 0, F.lpad(number, 17, " ")).otherwise(F.rpad(number, 12, " "))
    line = F.concat(F.rpad("form_type", 12, " "), F.rpad("company_name", 62, " "), placed, F.lit(" "), F.rpad(F.col("date_filed").cast("string"), 12, " "), F.concat(F.lit("edgar/data/"), F.col("filename").cast("string"), F.lit(".txt")))
    header = f.where("file % 10 <> 4").select("file", F.lit("Form Type   Company Name   CIK   Date Filed  File Name").alias("value")).distinct()
    return landed.parse_index_lines(f.select("file", line.alias("value")).union(header))


def tickers_scan(spark, sf):
    """Documents of at most a thousand companies."""
    c = view(spark, sf, "company")
    row = F.array(F.col("custkey").cast("string"), "entity_name", "ticker", "exchange")
    doc = c.groupBy(F.expr("custkey div 1000").alias("part")).agg(F.to_json(F.struct(F.array(*map(F.lit, ("cik", "name", "ticker", "exchange"))).alias("fields"), F.collect_list(row).alias("data"))).alias("json"))
    return landed.parse_column_json(doc, "json", ["cik", "name", "ticker", "exchange"]).withColumn("cik", normalize_key(F.col("cik")))


def _documents(f):
    """One JSON document a company; its rows meet once, for all groupings."""
    f = f.repartition("cik")
    entry = F.struct(F.col("val"), F.col("fy"), F.col("fp"), F.col("form"), F.col("filed").cast("string").alias("filed"), F.col("period_end").cast("string").alias("end"))
    tags = f.groupBy("cik", "tag", "unit").agg(F.sort_array(F.collect_list(F.struct("pos", entry.alias("e")))).alias("x"))
    tags = tags.select("cik", "tag", "unit", F.transform("x", lambda s: s["e"]).alias("x"))
    doc = tags.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct(F.create_map("unit", "x").alias("units"))))).alias("m"))
    return doc.select(F.to_json(F.struct(F.col("cik"), F.struct(F.col("m").alias("us-gaap")).alias("facts"))).alias("json"))


def _exploded(f):
    return landed.explode_facts(_documents(f), "json").drop("pos").groupBy("cik", "tag", "unit", "fy", "form").agg(F.count("*").alias("n"), F.round(F.sum("val"), 2).alias("total"), F.max("filed").alias("filed"), F.min("period_end").alias("period_end"))


def facts_explode(spark, sf):
    return _exploded(view(spark, sf, "fact"))


def filing_coverage(spark, sf):
    c = _coverage(spark, sf)
    text = lambda n: F.array_join(F.col(n).cast("array<string>"), ",").alias(n)
    return c.select("cik", "n_filings", "n_since", "first_filed", "last_filed", text("filing_years"), text("gap_years"), "coverage", F.col("has_gap").cast("int").alias("has_gap"), F.col("is_current").cast("int").alias("is_current"))


def filings_per_year(spark, sf):
    return _coverage(spark, sf).select(F.explode("filing_years").alias("year")).groupBy("year").agg(F.count("*").alias("n"))


def latest_name(spark, sf):
    f = view(spark, sf, "filing").withColumn("company_name", F.when(F.col("filename") % 3 != 0, F.concat_ws("/", "company_name", "filename")))
    return P.latest_value(f, "cik", "company_name", ["date_filed", "filename"])


def _dedup(order):
    return lambda spark, sf: P.dedup_keep(view(spark, sf, "filing"), ["cik"], order())


def primary_listing(spark, sf):
    c = view(spark, sf, "company")
    return P.dedup_keep(c, ["ticker"], [(~F.col("exchange").isin("AUTOMOBILE", "MACHINERY")).cast("int"), F.col("custkey")]).select("ticker", "cik", "exchange")


def top_exchanges(spark, sf):
    c = view(spark, sf, "company").withColumn("exchange", F.when(F.col("custkey") % 5 != 0, F.col("exchange")))
    return c.groupBy(F.coalesce("exchange", F.lit("Unknown")).alias("exchange")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "exchange").limit(3)


def _enriched(spark, sf):
    names = P.latest_value(view(spark, sf, "filing"), "cik", "company_name", ["date_filed", "filename"])
    return P.universe_enrich(_coverage(spark, sf), names, view(spark, sf, "company"))


def universe(spark, sf):
    u = _enriched(spark, sf)
    return u.select("cik", "n_filings", "coverage", F.col("is_current").cast("int").alias("is_current"), "company_name", "ticker", "exchange", "sic_code", "state", "sector")


def universe_enrich(spark, sf):
    """Beside the enriched rows those without company data."""
    names = P.latest_value(view(spark, sf, "filing"), "cik", "company_name", ["date_filed", "filename"])
    bare = P.universe_enrich(_coverage(spark, sf), names).withColumn("enriched", F.lit(0))
    shown = ["cik", "company_name", "ticker", "exchange", "sic_code", "state", "sector", "enriched"]
    return _enriched(spark, sf).withColumn("enriched", F.lit(1)).select(shown).union(bare.select(shown))


def universe_summary(spark, sf):
    return P.universe_summary(_enriched(spark, sf))


def resolve_features(spark, sf):
    return _resolved(spark, sf)


def total_debt(spark, sf):
    return A.total_debt(_resolved(spark, sf)).withColumn("total_debt", F.round("total_debt", 2))


def annual_facts(spark, sf):
    return A.annual_facts(view(spark, sf, "fact"), FIRST, LAST).withColumn("total_debt", F.round("total_debt", 2))


def panel(spark, sf):
    c = view(spark, sf, "company").select("cik", "ticker", F.col("custkey").alias("place"))
    return A.build_panel(view(spark, sf, "fact"), c, FIRST, LAST).withColumn("total_debt", F.round("total_debt", 2))


def amendment_registry(spark, sf):
    return A.amendment_registry(view(spark, sf, "fact"), FIRST, LAST)


def amended_count(spark, sf):
    return A.amended_count(amendment_registry(spark, sf))


def _grid(spark, sf):
    return view(spark, sf, "panel").select("cik", "fiscal_year", "period_end")


def event_in_window(spark, sf):
    return P.event_in_window(_grid(spark, sf), view(spark, sf, "event_date"), "cik", "period_end", 365, "label")


def interval_overlap(spark, sf):
    return P.interval_overlap(_grid(spark, sf), view(spark, sf, "event_span"), "cik", "period_end", 365, "label")


def restate_reconciled(spark, sf):
    r = B.restate_reconciled(_grid(spark, sf), view(spark, sf, "filing"), amendment_registry(spark, sf), label="label")
    return r.select("cik", "period_end", "label", F.col("label_source").alias("source"))


def restate_strict(spark, sf):
    return B.restate_strict(_grid(spark, sf), view(spark, sf, "filing"), label="label").select("cik", "period_end", "label")


def validate_labels(spark, sf):
    d = restate_reconciled(spark, sf).join(restate_strict(spark, sf).withColumnRenamed("label", "strict"), ["cik", "period_end"])
    d = d.withColumn("known", F.when(F.col("source") != "none", F.col("label")))
    return P.validate_labels(d, ["label", "strict", "known"])


def ratios(spark, sf):
    p = P.ratios(view(spark, sf, "panel"))
    names = p.columns[4 + len(FEATURES) :]
    return p.select("cik", "fiscal_year", *(F.round(n, 4).alias(n) for n in names))


def yoy(spark, sf):
    p = P.yoy(view(spark, sf, "panel"), _PANEL_COLS)
    return p.select("cik", "fiscal_year", "is_first_year", *(F.round(f"yoy_{c}", 4).alias(f"yoy_{c}") for c in _PANEL_COLS))


def coverage_report(spark, sf):
    return r6(P.coverage_report(view(spark, sf, "panel"), FEATURES), "coverage")


def missing_flags(spark, sf):
    return P.missing_flags(view(spark, sf, "panel"), _PANEL_COLS).select("cik", "fiscal_year", *(f"{c}_missing" for c in _PANEL_COLS))


def scaler_zscore(spark, sf):
    p = view(spark, sf, "panel").select("cik", "fiscal_year", *_PANEL_COLS)
    s = PanelScaler(_PANEL_COLS).fit(p.where("fiscal_year <= 1998"))
    return s.transform(p).select("cik", "fiscal_year", *(F.round(c, 5).alias(c) for c in _PANEL_COLS))


def make_splits(spark, sf):
    return S.describe_splits(S.make_splits(view(spark, sf, "panel"), "1997-12-31", "1998-12-31", "2000-12-31"))


def _folds(spark):
    return S.fold_table(spark, "1996-12-31", "2001-12-31")


def rolling_configs(spark, sf):
    last = view(spark, sf, "panel").agg(F.max("period_end").alias("d")).first().d
    return S.fold_table(spark, "1996-12-31", str(last))


def rolling_splits(spark, sf):
    return S.describe_splits(S.rolling_splits(view(spark, sf, "panel"), _folds(spark)), ("fold", "split"))


def temporal_cv(spark, sf):
    return S.temporal_cv(view(spark, sf, "panel"), 3).groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("fiscal_year").alias("first"), F.max("fiscal_year").alias("last"))


def stratified_sample(spark, sf):
    c = view(spark, sf, "company").withColumn("u", portable_uniform("cik", F.lit("7")))
    return P.dedup_keep_n(c, ["exchange"], [F.col("u"), F.col("cik")], 5).select("exchange", "cik")


def validate_panel(spark, sf):
    return A.validate_panel(view(spark, sf, "panel"), FEATURES)


def tag_phrases(spark, sf):
    rules = spark.createDataFrame([(1, ["the", "tion"], "high"), (2, ["license"], "low"), (3, ["le", "la", "de"], "low")], "rule int, phrases array<string>, tier string")
    d = view(spark, sf, "documents").select("doc_id", "text")
    return landed.tag_phrases(d, rules, "doc_id", "text").groupBy("doc_id").agg(F.min("rule").alias("first_rule"), F.count("*").alias("n_rules"))


def label_version_diff(spark, sf):
    a, b = restate_strict(spark, sf), event_in_window(spark, sf).where("fiscal_year > 1995").select("cik", "period_end", "label")
    return P.version_diff(a, b, ["cik", "period_end"], "label")


def stream_ingest(spark, sf):
    return streams.ingest(spark, f"{sf}/orders.parque[t]", view(spark, sf, "orders").schema).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def stream_latest(spark, sf):
    return streams.latest(spark, f"{sf}/orders.parque[t]", view(spark, sf, "orders").schema, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_PLACE = "list_position([" + ", ".join(f"'{t}'" for t in PROBES) + "], tag)"
_REG = f"reg as (select cik, fy as fiscal_year, period_end, filed as filed_date, form from (select *, row_number() over (partition by cik, fy, filed order by {_PLACE}, pos) as k from {{fact}} where form in ('10-K', '10-K/A') and tag in {_IN(PROBES)} and fy between {FIRST} and {LAST}) t where k = 1)"
_ANNUAL = f"{_RES}, yrs as (select cik, fy, case when tag in {_IN(DATING)} then period_end end as period_end, case when tag in {_IN(DATING)} then filed end as filed_date from (select *, row_number() over (partition by cik, fy order by {_PLACE}, filed desc, pos) as k from {{fact}} where form = '10-K' and tag in {_IN(PROBES)} and fy between {FIRST} and {LAST}) t where k = 1), wid as (select cik, fy, " + ", ".join(f"max(case when feature = '{f}' then val end) as {f}" for f in SIMPLE) + f", round(sum(case when feature in {_IN(DEBT)} then val end), 2) as total_debt from res group by 1, 2), ann as (select y.cik, y.fy as fiscal_year, period_end, filed_date, " + ", ".join(ANNUAL) + " from yrs y left join wid w on y.cik = w.cik and y.fy = w.fy)"
_COVER = f"cov as (select cik, count(*) as n_filings, count(*) filter (date_filed >= date '{SINCE}') as n_since, min(date_filed) as first_filed, max(date_filed) as last_filed, list_sort(list_distinct(list(cast(year(date_filed) as int)))) as ys from {{filing}} where form_type = '10-K' and year(date_filed) between {FIRST} and {LAST} group by 1)"
_PCT = "round(n_since / cast(n_filings as double), 4)"
_UNI = f"{_COVER}, nm as (select cik, arg_max(company_name, row(date_filed, filename)) as company_name from {{filing}} group by 1), uni as (select cov.cik, n_filings, {_PCT} as coverage, cast(list_contains(ys, 2000) or list_contains(ys, 2001) as int) as is_current, company_name, ticker, exchange, sic_code, state, sector, first_filed, last_filed from cov left join nm using (cik) left join {{company_sector}} using (cik))"
_EV = "exists (select 1 from {{event_date}} e where e.cik = p.cik and e.event_date between p.period_end and p.period_end + {0})"
_STRICT = "st as (select p.cik, p.period_end, cast(exists (select 1 from {filing} f where f.form_type = '10-K/A' and f.cik = p.cik and f.date_filed between p.period_end and p.period_end + 365) as int) as label from {panel} p)"
_REC = f"{_REG}, pairs as (select cik, period_end from reg group by 1, 2 having count(*) >= 2), src as (select p.cik, p.period_end, exists (select 1 from {{filing}} f where f.form_type in ('10-K/A', 'NT 10-K/A') and f.cik = p.cik and f.date_filed between p.period_end and p.period_end + 1095) as e, exists (select 1 from pairs q where q.cik = p.cik and q.period_end = p.period_end) as x from {{panel}} p), rec as (select cik, period_end, cast(e or x as int) as label, case when e and x then 'both' when e then 'edgar' when x then 'xbrl' else 'none' end as source from src)"


def _div(a, b):
    return f"case when abs({b}) >= 1e-8 then {a} / {b} end"


_RATIO_EXPR = {
    **{n: _div(a, b) for n, (a, b) in P.RATIOS.items()},
    "quick_ratio": _div("cash_equivalents", "current_liabilities"),
    "gross_margin": _div("(total_revenue - cost_of_sales)", "total_revenue"),
    "altman_z": " + ".join(f"{w} * ({_div(a, b)})" for w, a, b in ((1.2, "(current_assets - current_liabilities)", "total_assets"), (1.4, "retained_earnings", "total_assets"), (3.3, "operating_income", "total_assets"), (0.6, "total_equity", "total_liabilities"), (1.0, "total_revenue", "total_assets"))),
}
_RATIO_SQL = ", ".join(f"round({e}, 4) as {n}" for n, e in _RATIO_EXPR.items())
_YOY_SQL = ", ".join(f"round(case when first = 1 then 0.0 when l_{c} <> 0 then ({c} - l_{c}) / abs(l_{c}) end, 4) as yoy_{c}" for c in _PANEL_COLS)
_LAGS = ", ".join(f"lag({c}) over w as l_{c}" for c in _PANEL_COLS)
_SCALE = "tr as (select * from {panel} where fiscal_year <= 1998), md as (select " + ", ".join(f"coalesce(median({c}), 0) as {c}" for c in _PANEL_COLS) + " from tr), im as (select " + ", ".join(f"coalesce(tr.{c}, md.{c}) as {c}" for c in _PANEL_COLS) + " from tr, md), bo as (select " + ", ".join(f"quantile_cont({c}, 0.01) as lo_{c}, quantile_cont({c}, 0.99) as hi_{c}" for c in _PANEL_COLS) + " from im), mo as (select " + ", ".join(f"avg(greatest(lo_{c}, least(hi_{c}, {c}))) as m_{c}, stddev_samp(greatest(lo_{c}, least(hi_{c}, {c}))) as s_{c}" for c in _PANEL_COLS) + " from im, bo)"
_SCALED = ", ".join(f"round((greatest(lo_{c}, least(hi_{c}, coalesce(p.{c}, md.{c}))) - m_{c}) / s_{c}, 5) as {c}" for c in _PANEL_COLS)
_FOLDS = "folds as (select * from (values " + ", ".join(f"({k}, date '{1996 + k}-12-31', date '{1997 + k}-12-31', date '{1998 + k}-12-31')" for k in range(4)) + ") as t(fold, train_end, val_end, test_end))"
_VAL = lambda n: f"select '{n}' as label, count(*) filter ({n} = 1) as n_pos, count(*) filter ({n} = 0) as n_neg, count(*) filter ({n} is null) as n_missing, round(100.0 * count({n}) / count(*), 2) as coverage_pct, round(avg({n}), 4) as positive_rate, case when count(*) filter ({n} = 1) >= 20 then 'OK' else 'LOW' end as flag from j"

QUERIES = {
    "normalize_keys": (normalize_keys, "select c_custkey, case when c_custkey % 7 <> 0 then lpad(cast(c_custkey as string), 10, '0') end as cik, case when length('12345' || c_custkey) < 6 then lpad('12345' || c_custkey, 6, '0') else '12345' || c_custkey end as gvkey from {customer}"),
    "safe_div": (safe_div_query, "select l_orderkey, l_linenumber, l_partkey, case when l_linenumber <> 1 and abs(l_quantity) >= 1e-8 then l_extendedprice / l_quantity end as ratio from {lineitem}"),
    "sic_sector": (sic_sector, "select cik, sic_code, sector from {company_sector}"),
    "sector_index": (sector_index_query, "select cik, s.idx as sector_idx from {company_sector} c join {sector_list} s on c.sector = s.sector"),
    "filing_index_scan": (filing_index_scan, "select *, cast(year(date_filed) as int) as filing_year from {filing} where form_type in ('10-K', '10-K/A')"),
    "filing_index_parse": (filing_index_parse, "select form_type, company_name, cik, date_filed, 'edgar/data/' || filename || '.txt' as filename from {filing} where quarter(date_filed) <> 4"),
    "filter_forms": (lambda spark, sf: landed.filter_forms(view(spark, sf, "filing"), ["NT 10-K/A"]).select("cik", "filename"), "select cik, filename from {filing} where form_type = 'NT 10-K/A'"),
    "tickers_scan": (tickers_scan, "select cik, entity_name as name, ticker, exchange from {company}"),
    "facts_explode": (facts_explode, "select cik, tag, unit, fy, form, count(*) as n, round(sum(val), 2) as total, max(filed) as filed, min(period_end) as period_end from {fact} group by 1, 2, 3, 4, 5"),
    "facts_explode_all": (facts_explode, "select cik, tag, unit, fy, form, count(*) as n, round(sum(val), 2) as total, max(filed) as filed, min(period_end) as period_end from {fact} group by 1, 2, 3, 4, 5"),
    "filing_coverage": (filing_coverage, f"with {_COVER} select cik, n_filings, n_since, first_filed, last_filed, array_to_string(ys, ',') as filing_years, array_to_string(list_filter(range(ys[1], ys[len(ys)] + 1), lambda y: not list_contains(ys, y)), ',') as gap_years, {_PCT} as coverage, cast({_PCT} < 0.95 as int) as has_gap, cast(list_contains(ys, 2000) or list_contains(ys, 2001) as int) as is_current from cov"),
    "filings_per_year": (filings_per_year, "select cast(year(date_filed) as int) as year, count(distinct cik) as n from {filing} where form_type = '10-K' and year(date_filed) between 1995 and 2001 group by 1"),
    "latest_name": (latest_name, "select cik, arg_max(company_name || '/' || filename, row(date_filed, filename)) as company_name from {filing} where filename % 3 <> 0 group by 1"),
    "dedup_latest": (_dedup(lambda: [F.desc("date_filed"), F.desc("filename")]), "select * exclude (k) from (select *, row_number() over (partition by cik order by date_filed desc, filename desc) as k from {filing}) t where k = 1"),
    "dedup_earliest": (_dedup(lambda: [F.col("date_filed"), F.col("filename")]), "select * exclude (k) from (select *, row_number() over (partition by cik order by date_filed, filename) as k from {filing}) t where k = 1"),
    "primary_listing": (primary_listing, "select ticker, cik, exchange from (select *, row_number() over (partition by ticker order by case when exchange in ('AUTOMOBILE', 'MACHINERY') then 0 else 1 end, custkey) as k from {company}) t where k = 1"),
    "top_exchanges": (top_exchanges, "select case when custkey % 5 <> 0 then exchange else 'Unknown' end as exchange, count(*) as n from {company} group by 1 order by n desc, exchange limit 3"),
    "universe": (universe, f"with {_UNI} select * exclude (first_filed, last_filed) from uni"),
    "universe_enrich": (universe_enrich, f"with {_UNI} select cik, company_name, ticker, exchange, sic_code, state, sector, 1 as enriched from uni union all select cik, company_name, null, null, null, null, null, 0 from uni"),
    "universe_summary": (universe_summary, f"with {_UNI} select count(*) as n_companies, round(avg(case when ticker is not null then 1 else 0 end) * 100, 4) as pct_ticker, round(avg(case when coverage >= 0.8 then 1 else 0 end) * 100, 4) as pct_covered, round(avg(is_current) * 100, 4) as pct_current, min(first_filed) as earliest, max(last_filed) as latest from uni"),
    "resolve_features": (resolve_features, f"with {_RES} select * from res"),
    "total_debt": (total_debt, f"with {_RES} select cik, fy, round(sum(val), 2) as total_debt, count(*) as n_parts from res where feature in {_IN(DEBT)} group by 1, 2"),
    "annual_facts": (annual_facts, f"with {_ANNUAL} select * from ann"),
    "panel": (panel, f"with {_ANNUAL} select a.cik, c.ticker, fiscal_year, period_end, filed_date, {', '.join(ANNUAL)} from ann a left join {{company}} c on a.cik = c.cik"),
    "amendment_registry": (amendment_registry, f"with {_REG} select * from reg"),
    "amended_count": (amended_count, f"with {_REG} select count(*) filter (k > 1) as n_amended, count(*) as n_pairs from (select count(*) as k from reg group by cik, fiscal_year) t"),
    "event_in_window": (event_in_window, "select p.cik, p.fiscal_year, p.period_end, cast(exists (select 1 from {event_date} e where e.cik = p.cik and e.event_date between p.period_end and p.period_end + 365) as int) as label from {panel} p"),
    "interval_overlap": (interval_overlap, "select p.cik, p.fiscal_year, p.period_end, cast(exists (select 1 from {event_span} e where e.cik = p.cik and e.start_date <= p.period_end + 365 and e.end_date >= p.period_end) as int) as label from {panel} p"),
    "restate_strict": (restate_strict, f"with {_STRICT} select * from st"),
    "restate_reconciled": (restate_reconciled, f"with {_REC} select * from rec"),
    "validate_labels": (validate_labels, f"with {_REC}, {_STRICT}, j as (select rec.label, st.label as strict, case when source <> 'none' then rec.label end as known from rec join st using (cik, period_end)) " + " union all ".join(_VAL(n) for n in ("label", "strict", "known"))),
    "ratios": (ratios, f"select cik, fiscal_year, {_RATIO_SQL} from {{panel}}"),
    "yoy": (yoy, f"select cik, fiscal_year, first as is_first_year, {_YOY_SQL} from (select *, case when lag(fiscal_year) over w is null or fiscal_year - lag(fiscal_year) over w > 1 then 1 else 0 end as first, {_LAGS} from {{panel}} window w as (partition by cik order by fiscal_year, filed_date)) t"),
    "coverage_report": (coverage_report, " union all ".join(f"select '{c}' as feature, round(coalesce(avg(case when {c} is not null then 1 else 0 end), 0), 6) as coverage from {{panel}}" for c in FEATURES)),
    "missing_flags": (missing_flags, "select cik, fiscal_year, " + ", ".join(f"cast({c} is null as int) as {c}_missing" for c in _PANEL_COLS) + " from {panel}"),
    "scaler_zscore": (scaler_zscore, f"with {_SCALE} select cik, fiscal_year, {_SCALED} from {{panel}} p, md, bo, mo"),
    "make_splits": (make_splits, "select case when period_end <= date '1997-12-31' then 'train' when period_end <= date '1998-12-31' then 'val' else 'test' end as split, count(*) as n_rows, count(distinct cik) as n_companies, min(period_end) as first, max(period_end) as last from {panel} where period_end <= date '2000-12-31' group by 1"),
    "describe_splits": (make_splits, "select case when period_end <= date '1997-12-31' then 'train' when period_end <= date '1998-12-31' then 'val' else 'test' end as split, count(*) as n_rows, count(distinct cik) as n_companies, min(period_end) as first, max(period_end) as last from {panel} where period_end <= date '2000-12-31' group by 1"),
    "rolling_configs": (rolling_configs, f"with {_FOLDS} select * from folds where test_end <= (select max(period_end) from {{panel}})"),
    "rolling_splits": (rolling_splits, f"with {_FOLDS} select fold, case when period_end <= train_end then 'train' when period_end <= val_end then 'val' else 'test' end as split, count(*) as n_rows, count(distinct cik) as n_companies, min(period_end) as first, max(period_end) as last from {{panel}} join folds on period_end <= test_end group by 1, 2"),
    "temporal_cv": (temporal_cv, "with ys as (select y, cast(row_number() over (order by y desc) as int) as k from (select distinct fiscal_year as y from {panel}) t), f as (select 3 - k as fold, y as val_year from ys where k <= 3) select fold, case when fiscal_year = val_year then 'val' else 'train' end as part, count(*) as n, min(fiscal_year) as first, max(fiscal_year) as last from {panel} join f on fiscal_year <= val_year group by 1, 2"),
    "stratified_sample": (stratified_sample, "select exchange, cik from (select *, row_number() over (partition by exchange order by ('0x' || substr(md5(cik || '|7'), 1, 8))::ubigint, cik) as k from {company}) t where k <= 5"),
    "validate_panel": (validate_panel, "select count(*) as n_rows, count(distinct cik) as n_companies, min(fiscal_year) as first, max(fiscal_year) as last, count(*) - (select count(*) from (select distinct cik, fiscal_year from {panel}) d) as n_duplicates, " + ", ".join(f"round(count({c}) * 100.0 / count(*), 1) as pct_{c}" for c in FEATURES) + " from {panel}"),
    "tag_phrases": (tag_phrases, "with h as (select doc_id, case when contains(lower(text), 'the') and contains(lower(text), 'tion') then 1 end as r1, case when contains(lower(text), 'license') then 2 end as r2, case when contains(lower(text), 'le') and contains(lower(text), 'la') and contains(lower(text), 'de') then 3 end as r3 from {documents}) select doc_id, coalesce(r1, r2, r3) as first_rule, cast((r1 is not null) as bigint) + cast((r2 is not null) as bigint) + cast((r3 is not null) as bigint) as n_rules from h where coalesce(r1, r2, r3) is not null"),
    "label_version_diff": (label_version_diff, f"with {_STRICT}, b as (select p.cik, p.period_end, cast(exists (select 1 from {{event_date}} e where e.cik = p.cik and e.event_date between p.period_end and p.period_end + 365) as int) as label from {{panel}} p where p.fiscal_year > 1995), j as (select a.label as x, b.label as y, a.cik is not null as ina, b.cik is not null as inb from st a full join b on a.cik = b.cik and a.period_end = b.period_end) select count(*) filter (x = 0 and y = 1) as flips_up, count(*) filter (x = 1 and y = 0) as flips_down, count(*) filter (x = 1 and y = 1) as same_pos, count(*) filter (x = 0 and y = 0) as same_neg, count(*) filter (ina and inb and x is not null and y is null) as became_null, count(*) filter (ina and inb and x is null and y is not null) as became_known, count(*) filter (not ina) as new_rows, count(*) filter (not inb) as dropped_rows, round(avg(x), 4) as old_rate, round(avg(y), 4) as new_rate from j"),
    "stream_ingest": (stream_ingest, "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from {orders} group by 1"),
    "stream_latest": (stream_latest, "select o_custkey, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) as o_orderkey from {orders} group by 1"),
}
