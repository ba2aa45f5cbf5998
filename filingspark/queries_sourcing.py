"""Queries on sourcing and publishing: index folders, listings, events found by phrases, specification, match counts, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries_joins as QJ
from . import queries_market as QM
from . import queries_panel as Q
from .functions.exprs import portable_uniform
from .operators import joins as J
from .operators import labels as B
from .operators import market as M
from .operators import models as D
from .operators import panel as P
from .operators import reports as R
from .operators.panel import RATIO_NAMES
from .plans import splits as S
from .sources import external, landed
from .sources.places import cut, new_place
from .views import FEATURES, view

CUTS = ("1997-12-31", "1998-12-31", "2000-12-31")
_FRACTIONS = (0.1, 0.25, 0.5, 0.75, 1.0)
_FIRST, _LAST = 1996, 1998


def _index_lines(f):
    number = F.col("cik").cast("long").cast("string")
    return F.concat(F.rpad("form_type", 12, " "), F.rpad("company_name", 62, " "), F.rpad(number, 12, " "), F.lit(" "), F.rpad(F.col("date_filed").cast("string"), 12, " "), F.concat(F.lit("edgar/data/"), F.col("filename").cast("string"), F.lit(".txt")))


def filing_index_quarters(spark, sf):
    """The index in folders of quarters, of which third quarters are missing; three years of it are read."""
    f = view(spark, sf, "filing").withColumns({"year": F.year("date_filed"), "quarter": F.quarter("date_filed")}).where("quarter <> 3")
    head = f.select("year", "quarter", F.lit("Form Type   Company Name   CIK   Date Filed  File Name").alias("line")).distinct()
    root = new_place(spark, "index")
    f.select("year", "quarter", _index_lines(f).alias("line")).union(head).write.partitionBy("year", "quarter").text(root)
    return landed.read_index_quarters(spark, root, _FIRST, _LAST, ["10-K", "10-K/A"])


def _listings(spark, sf):
    """Companies with up to three listings, of which those of even numbers have one on a primary exchange."""
    c = view(spark, sf, "company").select("cik", "custkey", "ticker", "exchange", "sic_code", "state")
    more = c.select("cik", "custkey", F.concat(F.lit("A"), "ticker").alias("ticker"), F.lit("OTC").alias("exchange"), "sic_code", "state")
    main = c.where("custkey % 2 = 0").select("cik", "custkey", F.concat(F.lit("Z"), "ticker").alias("ticker"), F.when(F.col("custkey") % 4 == 0, "NYSE").otherwise("Nasdaq").alias("exchange"), "sic_code", "state")
    return c.union(more).union(main)


def universe_listings(spark, sf):
    names = P.latest_value(view(spark, sf, "filing"), "cik", "company_name", ["date_filed", "filename"])
    return P.universe_enrich(Q._coverage(spark, sf), names, _listings(spark, sf)).select("cik", "n_filings", "company_name", "ticker", "exchange", "sector")


def universe_provenance(spark, sf):
    """The universe is written with what it was built from, and read back with it."""
    told = P.universe_provenance(Q._coverage(spark, sf), view(spark, sf, "filing"), Q.FIRST, Q.LAST, ["10-K"], 1, Q.SINCE, "1999-01-01")
    path = new_place(spark, "universe")
    landed.write_with_provenance(universe_listings(spark, sf), path, told)
    rows, kept = landed.read_with_provenance(spark, path)
    return rows.groupBy("exchange").agg(F.count("*").alias("n")).select("exchange", "n", *(F.lit(kept[k]).alias(k) for k in sorted(kept)))


def _filings_with_text(spark, sf):
    """Documents as filings: companies by number, forms by number."""
    d = view(spark, sf, "documents").where("doc_id is not null")
    form = F.when(F.col("doc_id") % 3 == 0, "8-K").when(F.col("doc_id") % 3 == 1, "10-K ").otherwise("10-Q")
    date = F.when(F.col("doc_id") % 11 == 0, "none").otherwise(F.date_add(F.lit("1996-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).cast("string"))
    return d.select(F.col("doc_id").cast("string").alias("adsh"), (F.col("doc_id") % 700).cast("string").alias("cik"), form.alias("form"), date.alias("file_date"), "text")


_RULES = ((1, ["license"], ["8-K"], "high"), (2, ["the", "tion"], ["8-K", "10-K"], "high"), (3, ["mit license"], None, "moderate"))


def source_bankruptcy(spark, sf):
    """By rules with forms, as the given texts hold no real disclosures; the real rules ran beside them find what they find."""
    f = _filings_with_text(spark, sf)
    return B.sourced_events(f, [*_RULES, *((r + 10, *rest) for r, *rest in B.BANKRUPTCY_RULES)], view(spark, sf, "company"), "filing_date")


def tag_phrases_by_form(spark, sf):
    f = _filings_with_text(spark, sf)
    rules = spark.createDataFrame(list(_RULES), "rule int, phrases array<string>, forms array<string>, tier string")
    return landed.tag_phrases(f, rules, "adsh", "text", "form")


def crossref_report(spark, sf):
    """What the look-up by company number, then by ticker, gives; companies on MACHINERY count as listed."""
    joined = QJ.crossref_merge(spark, sf).join(view(spark, sf, "company").select("cik", "exchange"), "cik")
    return J.match_report(joined, "cik", "ticker", F.col("exchange") == "MACHINERY")


def data_spec(spark, sf):
    splits = S.make_splits(view(spark, sf, "panel").select("cik", "period_end"), *CUTS)
    features = {"raw": FEATURES, "ratios": RATIO_NAMES, "yoy": [f"yoy_{c}" for c in FEATURES], "other": ["is_first_year"]}
    return R.data_spec(view(spark, sf, "company_sector"), splits, CUTS, features, B.OUTCOMES, {"first_train_end": "1996-12-31", "val_window_years": 1, "test_window_years": 1})


def volume_histogram(spark, sf):
    """log10 of the mean volume before a filing, in millions."""
    found = M.equal_bins(QM._aligned(spark, sf), M.log_millions(F.col("trailing_volume")), 60)
    return found.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


def coverage_histogram(spark, sf):
    found = M.equal_bins(Q._coverage(spark, sf), F.col("coverage") * 100, 20)
    return found.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


def train_fraction_exact(spark, sf):
    """How many rows each fraction takes, exactly, and which is the first and last company in it."""
    hashed = portable_uniform(F.col("cik"), F.col("fiscal_year").cast("string"), F.lit("3"))
    p, u = cut(view(spark, sf, "panel").select("cik", "fiscal_year", hashed.alias("u"))), F.col("u")  # read once for each step of the search
    members, _ = D.fraction_members(p, ["cik", "fiscal_year"], u, _FRACTIONS)
    each = F.array_compact(F.array(*(F.when(m, F.lit(f)) for f, m in zip(_FRACTIONS, members))))
    return p.select("*", F.explode(each).alias("fraction")).groupBy("fraction").agg(F.count("*").alias("n"), F.sum(F.col("cik").cast("long") * F.col("fiscal_year")).alias("total"))


def csv_sample(spark, sf):
    """A sample is written as CSV and read back as text."""
    path = new_place(spark, "sample")
    external.write_csv_sample(view(spark, sf, "nation").select("n_nationkey", "n_name"), path)
    return external.load_dataset(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("name")).union(spark.read.csv(path, header=True))


_U3 = "('0x' || substr(md5(cik || '|' || cast(fiscal_year as string) || '|' || '3'), 1, 8))::ubigint / 4294967296.0"
_LIST = "ls as (select cik, custkey, ticker, exchange, sic_code, state from {company} union all select cik, custkey, 'A' || ticker, 'OTC', sic_code, state from {company} union all select cik, custkey, 'Z' || ticker, case when custkey % 4 = 0 then 'NYSE' else 'Nasdaq' end, sic_code, state from {company} where custkey % 2 = 0), pl as (select * from (select *, row_number() over (partition by cik order by case when exchange in ('Nasdaq', 'NYSE', 'NYSE MKT') then 0 else 1 end, ticker) as k from ls) t where k = 1)"
_UL = f"{Q._UNI}, {_LIST}, ul as (select uni.cik, n_filings, uni.company_name, pl.ticker, pl.exchange, cs.sector from uni left join pl on uni.cik = pl.cik left join {{company_sector}} cs on cs.cik = uni.cik)"
_TEXTS = "ft as (select cast(doc_id as string) as adsh, lpad(cast(doc_id % 700 as string), 10, '0') as cik, case doc_id % 3 when 0 then '8-K' when 1 then '10-K' else '10-Q' end as form, case when doc_id % 11 <> 0 then date '1996-01-01' + cast(doc_id % 90 as int) end as day, lower(text) as low from {documents} where doc_id is not null)"
_RULE = {1: "form = '8-K' and contains(low, 'license')", 2: "form in ('8-K', '10-K') and contains(low, 'the') and contains(low, 'tion')", 3: "contains(low, 'mit license')"}
_BINS = lambda src, n: f"b as (select min(x) as lo, max(x) as hi from {src}), c as (select cast(case when hi = lo then 0 else least({n - 1}, floor((x - lo) / ((hi - lo) / {n}))) end as int) as bin, lo, hi from {src}, b) select bin, round(bin * ((hi - lo) / {n}) + lo, 6) as low, round((bin + 1) * ((hi - lo) / {n}) + lo, 6) as high, count(*) as n from c group by bin, lo, hi"
_SPLIT = f"case when period_end <= date '{CUTS[0]}' then 'train' when period_end <= date '{CUTS[1]}' then 'val' else 'test' end"
_SPEC_FIXED = [("features", "raw", str(len(FEATURES))), ("features", "ratios", str(len(RATIO_NAMES))), ("features", "yoy", str(len(FEATURES))), ("features", "other", "1"), ("features", "total_numeric", str(2 * len(FEATURES) + len(RATIO_NAMES) + 1)), *(("labels", "outcome", o) for o in B.OUTCOMES), ("splits", "train_end", CUTS[0]), ("splits", "val_end", CUTS[1]), ("splits", "test_end", CUTS[2]), ("rolling", "first_train_end", "1996-12-31"), ("rolling", "val_window_years", "1"), ("rolling", "test_window_years", "1")]
_STATS = " union all ".join(f"select {_SPLIT} as section, '{n}' as name, cast({e} as varchar) as value from {{panel}} where period_end <= date '{CUTS[2]}' group by 1" for n, e in (("n_rows", "count(*)"), ("n_companies", "count(distinct cik)"), ("first", "min(period_end)"), ("last", "max(period_end)")))
QUERIES = {
    "filing_index_quarters": (filing_index_quarters, f"select form_type, trim(company_name) as company_name, cik, date_filed, 'edgar/data/' || filename || '.txt' as filename, cast(year(date_filed) as int) as year, cast(quarter(date_filed) as int) as quarter from {{filing}} where form_type in ('10-K', '10-K/A') and quarter(date_filed) <> 3 and year(date_filed) between {_FIRST} and {_LAST}"),
    "universe_listings": (universe_listings, f"with {_UL} select * from ul"),
    "universe_provenance": (universe_provenance, f"with {_UL} select exchange, count(*) as n, '1999-01-01' as build_date, '{Q.FIRST}' as start_year, '{Q.LAST}' as end_year, (select cast(count(*) as varchar) from ul) as n_companies, (select cast(count(*) as varchar) from {{filing}} where form_type = '10-K' and year(date_filed) between {Q.FIRST} and {Q.LAST}) as n_filings_in_index, '10-K' as form_types, '1' as min_filings, '{Q.SINCE}' as mandatory_since from ul group by 1"),
    "source_bankruptcy": (source_bankruptcy, f"with {_TEXTS} select distinct ft.cik, day as filing_date from ft join {{company}} c on c.cik = ft.cik where day is not null and ({' or '.join(f'({r})' for r in _RULE.values())} or (form = '8-K' and (contains(low, 'item 1.03') or contains(low, 'bankruptcy or receivership'))))"),
    "tag_phrases_by_form": (tag_phrases_by_form, f"with {_TEXTS} " + " union all ".join(f"select adsh, {n} as rule, '{'moderate' if n == 3 else 'high'}' as tier from ft where {r}" for n, r in _RULE.items())),
    "crossref_report": (crossref_report, "with v as (select case when custkey % 2 <> 0 then cik end as vcik, ticker as tic from {company} where custkey % 3 = 0), m as (select exchange, case when cik in (select vcik from v where vcik is not null) then 'cik' when ticker in (select tic from v) then 'ticker' end as matched from {company}) select count(*) as n, count(*) filter (matched = 'cik') as n_primary, count(*) filter (matched = 'ticker') as n_fallback, count(*) filter (matched is null) as n_unmatched, round(coalesce(count(*) filter (matched = 'ticker') / cast(nullif(count(*) filter (matched is null or matched = 'ticker'), 0) as double), 0), 4) as recovered, count(*) filter (matched is null and exchange = 'MACHINERY') as n_unmatched_listed from m"),
    "data_spec": (data_spec, " union all ".join(f"select '{a}' as section, '{b}' as name, '{c}' as value" for a, b, c in _SPEC_FIXED) + f" union all select 'universe', 'n_companies', cast(count(distinct cik) as varchar) from {{company_sector}} union all select 'sectors', sector, cast(count(*) as varchar) from {{company_sector}} group by sector union all {_STATS}"),
    "volume_histogram": (volume_histogram, f"{QM._ALIGN}, v as (select log10(trailing_volume / 1e6 + 1e-3) as x from al where trailing_volume > 0), {_BINS('v', 60)}"),
    "coverage_histogram": (coverage_histogram, f"with {Q._COVER}, v as (select {Q._PCT} * 100 as x from cov), {_BINS('v', 20)}"),
    "train_fraction_exact": (train_fraction_exact, f"with r as (select cik, fiscal_year, row_number() over (order by {_U3}, cik, fiscal_year) as k, count(*) over () as n from {{panel}}) " + " union all ".join(f"select cast({f} as double) as fraction, count(*) as n, sum(cast(cik as bigint) * fiscal_year) as total from r where k <= greatest(1, cast(floor(n * {f}) as bigint))" for f in _FRACTIONS)),
    "csv_sample": (csv_sample, "select cast(r_regionkey as varchar) as key, r_name as name from {region} union all select cast(n_nationkey as varchar), n_name from {nation}"),
}
