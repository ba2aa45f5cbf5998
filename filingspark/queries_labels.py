"""Queries on label sources, the label database, audits, outside files and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries_market as K
from . import queries_panel as Q
from .functions.codes import DELISTINGS, DIVISIONS, EXCHANGES, delist_reason, exchange_name, sic_division
from .operators import joins as J
from .operators import labels as B
from .operators import publish as U
from .operators import reports as R
from .sources import external, landed
from .streaming.streams import new_place
from .views import FEATURES, view

CUTS = ("1997-12-31", "1998-12-31", "2000-12-31")
_MOVED = 300


def _grid(spark, sf):
    return view(spark, sf, "panel").select("cik", "period_end")


def _outside(spark, sf):
    """A label file as it might come: company numbers without zeros, some twice, some values that aren't numbers."""
    p = view(spark, sf, "panel")
    k = F.col("cik").cast("long")
    once = p.select(k.cast("string").alias("cik"), "period_end", F.when(k % 7 == 0, "n/a").otherwise((k % 2).cast("string")).alias("audit_qualification"), F.lit(1).alias("place"), (k % 3).alias("k"))
    return once.union(once.withColumns({"audit_qualification": F.lit("9"), "place": F.lit(2)})).where("k > 0").drop("k")


def external_label_merge(spark, sf):
    return B.external_label(_grid(spark, sf), _outside(spark, sf), "audit_qualification", [F.col("place")])


def label_audit(spark, sf):
    """Beside an outside file its absence, which leaves all unknown."""
    rows = B.audit_label(_grid(spark, sf), _outside(spark, sf).where("place = 1"))
    return B.audit_label(rows, None, "without")


def label_enforcement(spark, sf):
    """By spans, by dates, and without a source."""
    spans = view(spark, sf, "event_span")
    rows = B.enforcement_label(_grid(spark, sf), spans)
    rows = B.enforcement_label(rows, spans.select("cik", F.col("start_date").alias("aaer_date")), label="by_date")
    return B.enforcement_label(rows, None, label="without")


def _vendor(spark, sf):
    k = F.col("custkey")
    return view(spark, sf, "company").select("cik", F.when(k % 5 == 0, " 03 ").otherwise("06").alias("cstat_dlrsn"), F.date_add(F.lit("1996-01-01").cast("date"), (k % 1500).cast("int")).alias("cstat_dldte"))


def label_bankruptcy(spark, sf):
    """By the vendor's reasons, by outside filing dates, and without a source."""
    rows = B.bankruptcy_label(_grid(spark, sf), _vendor(spark, sf), None)
    rows = B.bankruptcy_label(rows, _vendor(spark, sf), view(spark, sf, "event_date").withColumnRenamed("event_date", "filing_date"), source="external_csv", label="by_date")
    return B.bankruptcy_label(rows, None, None, label="without")


def _later(df, *dates):
    """Filings moved to the years of the prices."""
    return df.withColumns({d: F.add_months(d, _MOVED) for d in dates})


def labels_db(spark, sf):
    registry = Q.amendment_registry(spark, sf).withColumn("period_end", F.lit("2023-10-10").cast("date"))
    audit = view(spark, sf, "grid").select("cik", "period_end", (F.col("custkey") % 2).alias("audit_qualification")).where("cik > '0000000010'")
    vendor = _later(_vendor(spark, sf), "cstat_dldte")
    return B.build_labels(K._aligned(spark, sf), 12, _later(view(spark, sf, "filing"), "date_filed"), registry, vendor, audit, _later(view(spark, sf, "event_span"), "start_date", "end_date"))


def label_stats(spark, sf):
    return B.label_stats(labels_db(spark, sf).drop("bankruptcy"))


def label_overview(spark, sf):
    return B.label_overview(labels_db(spark, sf))


def amendment_audit(spark, sf):
    labels = B.restate_strict(_grid(spark, sf), view(spark, sf, "filing"), 100)
    return B.audit_summary(B.amendment_audit(Q.amendment_registry(spark, sf), labels, view(spark, sf, "filing"))).withColumn("positive_rate", F.round("positive_rate", 6))


def _refiled(spark, sf):
    """The panel with every fifth company's rows filed once more, a month later."""
    p = view(spark, sf, "panel")
    again = p.where(F.col("cik").cast("long") % 5 == 0).withColumn("filed_date", F.add_months("filed_date", 1))
    return p.union(again)


def _labels(spark, sf):
    """Labels of each company-year at dates up to nineteen days off the panel's."""
    p = view(spark, sf, "panel")
    k = F.col("cik").cast("long")
    return p.select("cik", F.date_sub("period_end", (k % 20).cast("int")).alias("period_end"), *(F.expr(f"cast((fiscal_year + cast(cik as bigint) * {i + 2}) % 2 as int)").alias(n) for i, n in enumerate(B.OUTCOMES)), F.lit("none").alias("earnings_restate_source"))


def amendment_label_audit(spark, sf):
    return U.amendment_label_audit(_refiled(spark, sf), _labels(spark, sf))


def published_panel(spark, sf):
    p = _refiled(spark, sf)
    c = view(spark, sf, "company_sector")
    p = J.lookup(p, c, "cik", ["ticker"], [F.col("custkey")])
    k = F.col("cik").cast("long")
    m = _labels(spark, sf).where("cik > '0000000020'").select("cik", "period_end", (k % 7 / 10).alias("fwd_ret_252d"), (k % 5 / 10).alias("mkt_adj_252d"), (k % 3 == 0).cast("int").alias("delisted"))
    return U.publish(p, _labels(spark, sf), m, c, CUTS)


def splits_write(spark, sf):
    """What is read back from the written splits."""
    path = new_place(spark)
    U.write_splits(view(spark, sf, "panel").transform(lambda p: U.make_splits(p, *CUTS)), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.min("cik").alias("first"), F.round(F.sum("total_assets"), 2).alias("total"))


def provenance_roundtrip(spark, sf):
    path = new_place(spark)
    landed.write_with_provenance(_grid(spark, sf), path, {"built": "today", "source": "panel"})
    df, p = landed.read_with_provenance(spark, path)
    return df.withColumn("source", F.lit(p["source"]))


def external_label_scan(spark, sf):
    """A CSV file with odd names and a date that can't be read."""
    path = new_place(spark)
    k = F.col("cik").cast("long")
    own = _grid(spark, sf).select(k.cast("string").alias(" CIK"), F.when(k % 9 == 0, "unknown").otherwise(F.col("period_end").cast("string")).alias("Period_End"), (k % 2).alias("Bankruptcy "))
    own.write.csv(f"{path}/bankruptcy.csv", header=True)
    assert external.external_label(spark, path, "audit_qualification") is None
    return external.external_label(spark, path, "bankruptcy").select("cik", "period_end", F.col("bankruptcy").cast("int").alias("bankruptcy"))


def _codes(spark, sf):
    k = F.col("custkey")
    exchanges, reasons = F.array(*map(F.lit, [*EXCHANGES, 77])), F.array(*map(F.lit, [*DELISTINGS, "99"]))
    return view(spark, sf, "company").select("custkey", "sic_code", F.get(exchanges, (k % 8).cast("int")).cast("string").alias("exchg"), F.get(reasons, (k % 11).cast("int")).alias("dlrsn"))


def crossref_load(spark, sf):
    """The vendor's file as CSV, some keys blank or "nan"."""
    path = f"{new_place(spark)}/company.csv"
    k = F.col("custkey")
    raw = _codes(spark, sf).select(k.cast("string").alias("GVKEY "), F.when(k % 3 == 0, "nan").when(k % 3 == 1, " ").otherwise(k.cast("string")).alias("cik"), F.when(k % 4 == 0, None).otherwise(F.col("sic_code").cast("int").cast("string")).alias("sic"), F.when(k % 2 == 0, "1999-02-30").otherwise("1999-02-28").alias("dldte"), "exchg", "dlrsn")
    raw.write.csv(path, header=True)
    return external.crossref(spark, path).select("gvkey", "cik", "sic", "dldte", "exchange_name", "delist_reason")


def code_maps(spark, sf):
    c = _codes(spark, sf)
    return c.select("custkey", exchange_name(F.col("exchg")).alias("exchange_name"), delist_reason(F.col("dlrsn")).alias("delist_reason"), sic_division(F.col("sic_code")).alias("sic_division"))


def source_events(spark, sf):
    """Events found by phrases: filings' texts are documents, of companies by number; each (cik, date) once, known companies only."""
    d = view(spark, sf, "documents").where("doc_id is not null")
    rules = spark.createDataFrame([(1, ["the", "tion"], "high"), (2, ["license"], "low")], "rule int, phrases array<string>, tier string")
    hits = landed.tag_phrases(d, rules, "doc_id", "text").select("doc_id").distinct()
    hits = hits.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("adsh"), F.array(F.lpad((F.col("doc_id") % 700).cast("string"), 10, "0")).alias("ciks"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).cast("string").alias("file_date"))).alias("hit"))
    events = J.search_hits(hits, "hit").select("cik", F.col("file_date").alias("event_date")).distinct()
    return events.join(view(spark, sf, "company").select("cik"), "cik", "left_semi")


def quality_scorecard(spark, sf):
    return R.quality_scorecard(K._aligned(spark, sf), "fwd_12", "mkt_adj_12", "trailing_volume", years=(2024, 2024)).withColumn("value", F.round("value", 6))


def panel_label_join(spark, sf):
    labels = B.restate_strict(_grid(spark, sf), view(spark, sf, "filing")).withColumn("total_assets", F.lit(1.0))
    return U.panel_label_join(view(spark, sf, "panel").select("cik", "fiscal_year", "period_end", "total_assets"), labels)


_OUT = "oo as (select cik, period_end, case when cast(cik as bigint) % 7 = 0 then null else cast(cast(cik as bigint) % 2 as int) end as v from {panel} where cast(cik as bigint) % 3 > 0)"
_IN = lambda events, at, extra="": f"cast(exists (select 1 from {events} e where e.cik = p.cik and e.{at} between p.period_end and p.period_end + 365{extra}) as int)"
_VENDOR = "vendor as (select cik, date '1996-01-01' + cast(custkey % 1500 as int) as dldte from {company} where custkey % 5 = 0)"
_NAMED = lambda value, names, default: f"case {value} " + " ".join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in names.items()) + (f" else '{default}' end" if default else " end")
_LIST = lambda names, k: "[" + ", ".join(f"'{n}'" for n in names) + f"][cast({k} as int) + 1]"
_EXCHG, _DLRSN = _LIST([*EXCHANGES, 77], "custkey % 8"), _LIST([*DELISTINGS, "99"], "custkey % 11")
_SHIFT = "interval 25 year"
_DB = f"{K._DECLINE}, {Q._REG}, two as (select cik from reg group by 1 having count(*) >= 2), {_VENDOR}, db as (select p.cik, p.period_end, p.stock_decline, exists (select 1 from {{filing}} f where f.form_type in ('10-K/A', 'NT 10-K/A') and f.cik = p.cik and f.date_filed + {_SHIFT} between p.period_end and p.period_end + 1095) as e, p.period_end = date '2023-10-10' and exists (select 1 from two t where t.cik = p.cik) as x, case when p.cik > '0000000010' then cast(cast(p.cik as bigint) % 2 as int) end as audit_qualification, cast(exists (select 1 from {{event_span}} s where s.cik = p.cik and s.start_date + {_SHIFT} <= p.period_end + 365 and s.end_date + {_SHIFT} >= p.period_end) as int) as sec_enforcement, cast(exists (select 1 from vendor v where v.cik = p.cik and v.dldte + {_SHIFT} between p.period_end and p.period_end + 365) as int) as bankruptcy from lab p), ldb as (select cik, period_end, stock_decline, cast(e or x as int) as earnings_restate, audit_qualification, sec_enforcement, bankruptcy, case when e and x then 'both' when e then 'edgar' when x then 'xbrl' else 'none' end as earnings_restate_source from db)"
_STAT = lambda n, c: f"select '{n}' as label, count(*) filter ({c} = 1) as n_pos, count(*) filter ({c} = 0) as n_neg, count(*) filter ({c} is null) as n_missing, round(100.0 * count({c}) / count(*), 2) as coverage_pct, round(avg({c}), 4) as positive_rate, case when count(*) filter ({c} = 1) >= 20 then 'OK' else 'LOW' end as flag from ldb"
_LAB = "lb as (select cik, fiscal_year as year, period_end - cast(cast(cik as bigint) % 20 as int) as period_end_label, cast(cik as bigint) % 20 as apart, " + ", ".join(f"cast((fiscal_year + cast(cik as bigint) * {i + 2}) % 2 as int) as {n}" for i, n in enumerate(B.OUTCOMES)) + " from {panel})"
_ALL = " and ".join(f"{n} is not null" for n in B.OUTCOMES)
_SPLIT = f"case when p.period_end <= date '{CUTS[0]}' then 'train' when p.period_end <= date '{CUTS[1]}' then 'val' else 'test' end"
_CHECKS = {"companies": ("cast(count(distinct cik) as double)", ">= 5000"), "return_coverage": ("avg(case when fwd_12 is not null then 100.0 else 0 end)", ">= 70"), "adjusted_coverage": ("avg(case when mkt_adj_12 is not null then 100.0 else 0 end)", ">= 70"), "delisted": ("avg(cast(delisted as int)) * 100.0", "< 40"), "years": ("cast(min(year(filing_date)) <= 2024 and max(year(filing_date)) >= 2024 as int)", "= 1"), "sectors": ("cast(count(distinct sector) as double)", ">= 10"), "volume_coverage": ("avg(case when trailing_volume is not null then 100.0 else 0 end)", ">= 60")}
QUERIES = {
    "external_label_merge": (external_label_merge, f"with {_OUT} select p.cik, p.period_end, v as audit_qualification from {{panel}} p left join oo on p.cik = oo.cik and p.period_end = oo.period_end"),
    "label_audit": (label_audit, f"with {_OUT} select p.cik, p.period_end, v as audit_qualification, cast(null as int) as without from {{panel}} p left join oo on p.cik = oo.cik and p.period_end = oo.period_end"),
    "label_enforcement": (label_enforcement, f"select p.cik, p.period_end, cast(exists (select 1 from {{event_span}} e where e.cik = p.cik and e.start_date <= p.period_end + 365 and e.end_date >= p.period_end) as int) as sec_enforcement, {_IN('{event_span}', 'start_date')} as by_date, cast(null as int) as without from {{panel}} p"),
    "label_bankruptcy": (label_bankruptcy, f"with {_VENDOR} select p.cik, p.period_end, {_IN('vendor', 'dldte')} as bankruptcy, {_IN('{event_date}', 'event_date')} as by_date, cast(null as int) as without from {{panel}} p"),
    "labels_db": (labels_db, f"{_DB} select * from ldb"),
    "label_stats": (label_stats, f"{_DB} " + " union all ".join(_STAT(n, n if n != "bankruptcy" else "cast(null as int)") for n in B.OUTCOMES)),
    "label_overview": (label_overview, f"{_DB} select count(*) as n_observations, count(*) filter ({_ALL}) as n_all_present, " + " + ".join(f"cast(count({n}) * 2 > count(*) as int)" for n in B.OUTCOMES) + " as n_majority from ldb"),
    "amendment_audit": (amendment_audit, f"with {Q._REG}, am as (select cik, period_end from reg where period_end is not null group by 1, 2 having count(*) >= 2), lb as (select p.cik, p.period_end, cast(exists (select 1 from {{filing}} f where f.form_type = '10-K/A' and f.cik = p.cik and f.date_filed between p.period_end and p.period_end + 100) as int) as y from {{panel}} p), fs as (select cik, max(case when form_type = '10-K/A' then date_filed end) as last from {{filing}} where form_type in ('10-K/A', 'NT 10-K/A') group by 1), b as (select y, case when y = 1 then 'both' when fs.cik is null then 'xbrl_only' when last > am.period_end + 365 then 'edgar_misses_by_window' when last is not null then 'label_only' else 'edgar_misses_by_form' end as bucket from am left join lb on am.cik = lb.cik and am.period_end = lb.period_end left join fs on am.cik = fs.cik) select bucket, count(*) as n, count(*) filter (y = 1) as n_positive, round(avg(case when y = 1 then 1 else 0 end), 6) as positive_rate from b group by 1"),
    "amendment_label_audit": (amendment_label_audit, f"with {_LAB}, m as (select earnings_restate as y from lb where cast(cik as bigint) % 5 = 0) select count(*) as n, count(*) filter (y = 1) as n_1, count(*) filter (y = 0) as n_0, count(*) filter (y is null) as n_null, round(100.0 * count(*) filter (y = 1) / count(*), 4) as pct_1, cast(100.0 * count(*) filter (y = 1) / count(*) < 50 as int) as low from m"),
    "published_panel": (published_panel, f"with {_LAB} select p.cik, c.ticker, p.fiscal_year, p.period_end, p.filed_date, c.sector, c.sic_code, {', '.join('p.' + f for f in FEATURES)}, {', '.join(B.OUTCOMES)}, 'none' as earnings_restate_source, case when p.cik > '0000000020' then cast(p.cik as bigint) % 7 / 10.0 end as fwd_ret_252d, case when p.cik > '0000000020' then cast(p.cik as bigint) % 5 / 10.0 end as mkt_adj_252d, case when p.cik > '0000000020' then cast(cast(p.cik as bigint) % 3 = 0 as int) end as delisted, p.period_end as period_end_xbrl, period_end_label, {_SPLIT} as split from {{panel}} p join lb on p.cik = lb.cik and p.fiscal_year = lb.year and apart <= 14 left join {{company_sector}} c on p.cik = c.cik where p.period_end <= date '{CUTS[2]}'"),
    "splits_write": (splits_write, f"select {_SPLIT} as split, count(*) as n, min(cik) as first, round(sum(total_assets), 2) as total from {{panel}} p where period_end <= date '{CUTS[2]}' group by 1"),
    "provenance_roundtrip": (provenance_roundtrip, "select cik, period_end, 'panel' as source from {panel}"),
    "external_label_scan": (external_label_scan, "select cik, case when cast(cik as bigint) % 9 <> 0 then period_end end as period_end, cast(cast(cik as bigint) % 2 as int) as bankruptcy from {panel}"),
    "crossref_load": (crossref_load, f"select lpad(cast(custkey as string), 6, '0') as gvkey, case when custkey % 3 = 2 then cik end as cik, case when custkey % 4 <> 0 then sic_code end as sic, case when custkey % 2 <> 0 then date '1999-02-28' end as dldte, {_NAMED(_EXCHG, EXCHANGES, 'Other')} as exchange_name, {_NAMED(_DLRSN, DELISTINGS, 'Unknown')} as delist_reason from {{company}}"),
    "code_maps": (code_maps, f"select custkey, {_NAMED(_EXCHG, EXCHANGES, 'Other')} as exchange_name, {_NAMED(_DLRSN, DELISTINGS, 'Unknown')} as delist_reason, {_NAMED('substr(sic_code, 1, 2)', DIVISIONS, None)} as sic_division from {{company}}"),
    "source_events": (source_events, "select distinct c.cik, date '1996-01-01' + cast(doc_id % 90 as int) as event_date from {documents} d join {company} c on c.custkey = d.doc_id % 700 where (contains(lower(text), 'the') and contains(lower(text), 'tion')) or contains(lower(text), 'license')"),
    "quality_scorecard": (quality_scorecard, f"{K._ALIGN}, c as (select " + ", ".join(f"{e} as {n}" for n, (e, _) in _CHECKS.items()) + " from al) " + " union all ".join(f"select {i} as place, '{n}' as check_name, round({n}, 6) as value, cast({n} {t} as int) as passed, " + " + ".join(f"cast({m} {u} as int)" for m, (_, u) in _CHECKS.items()) + " as score from c" for i, (n, (_, t)) in enumerate(_CHECKS.items()))),
    "panel_label_join": (panel_label_join, f"with {Q._STRICT} select p.cik, p.fiscal_year, p.period_end, p.total_assets, st.label as earnings_restate, 1.0 as total_assets_label from {{panel}} p join st on p.cik = st.cik and p.period_end = st.period_end"),
}
