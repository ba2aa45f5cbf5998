"""Queries on look-ups, tolerance joins, reconciliation, pruning, masking and sampling."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from . import queries_panel as Q
from .functions.exprs import portable_uniform
from .operators import joins as J
from .operators import labels as B
from .operators import panel as P
from .operators.publish import split_snapshots as split_snapshots_of
from .plans import splits as S
from .sources import landed
from .views import FEATURES, view

_COLS = ("total_assets", "total_equity", "net_income")
_FRACTIONS = (0.1, 0.25, 0.5, 0.75, 1.0)


def _keyed(spark, sf, *more):
    return view(spark, sf, "panel").select("cik", "fiscal_year", *more)


def ticker_map(spark, sf):
    return J.lookup(_keyed(spark, sf), view(spark, sf, "company"), "cik", ["ticker"], [F.desc("custkey")])


def sic_join(spark, sf):
    return J.lookup(_keyed(spark, sf), view(spark, sf, "company").withColumn("sic_code", F.expr("case when custkey % 4 <> 0 then sic_code end")), "cik", ["sic_code"], [F.col("custkey")])


def crossref_merge(spark, sf):
    c = view(spark, sf, "company")
    known = F.col("custkey") % 3 == 0
    vendor = c.select(F.lpad(F.col("custkey").cast("string"), 6, "0").alias("gvkey"), F.when(known & (F.col("custkey") % 2 != 0), F.col("cik")).alias("vcik"), F.when(known, F.col("ticker")).alias("tic"))
    return J.primary_then_fallback(c.select("cik", "ticker"), vendor, ("cik", "vcik"), ("ticker", "tic"), [F.col("gvkey")]).select("cik", "ticker", "vendor.gvkey", "matched")


def amended_pairs(spark, sf):
    return B.amended_pairs(_keyed(spark, sf, "period_end"), Q.amendment_registry(spark, sf)).select("cik", "fiscal_year", "amended")


def universe_semi_join(spark, sf):
    return view(spark, sf, "event_date").join(view(spark, sf, "company").where("exchange = 'MACHINERY'"), "cik", "left_semi")


def _pairs(spark, sf):
    p = _keyed(spark, sf, "period_end", "filed_date")
    return J.year_pairs(p.drop("fiscal_year"), p.select("cik", F.expr("date_sub(period_end, cast(cik as int) % 20)").alias("label_end")))


def year_tolerance_join(spark, sf):
    return _pairs(spark, sf).where("days_apart <= 14").select("cik", "year", "period_end", "label_end")


def date_alignment_report(spark, sf):
    d = F.col("days_apart")
    return _pairs(spark, sf).agg(F.count_if(d == 0).alias("n_exact"), F.count_if(d.between(1, 14)).alias("n_near"), F.count_if(d > 14).alias("n_dropped"))


def split_snapshots(spark, sf):
    s = S.make_splits(view(spark, sf, "panel"), "1997-12-31", "1998-12-31", "2000-12-31")
    return split_snapshots_of(s, Q.universe(spark, sf).select("cik", "sector", "is_current"))


def split_preview(spark, sf):
    p = S.make_splits(view(spark, sf, "panel"), "1997-12-31", "1998-12-31", "2000-12-31").groupBy("split").agg(F.count("*").alias("n"))
    # one row a split is left by now
    return p.select("split", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4).alias("share"))


def sector_distribution(spark, sf):
    return view(spark, sf, "company_sector").groupBy("sector").agg(F.count("*").alias("n"))


def metric_reconcile(spark, sf):
    a = _keyed(spark, sf, "total_revenue")
    b = a.where("fiscal_year <> 1997").withColumn("total_revenue", F.col("total_revenue") + F.when(F.col("fiscal_year") == 1995, 1.0).otherwise(1e-5))
    return J.reconcile(a, b, ["cik", "fiscal_year"], "total_revenue").select("cik", "fiscal_year", F.round("a", 2).alias("a"), F.round("b", 2).alias("b"))


def label_flips(spark, sf):
    b = Q.event_in_window(spark, sf).select("cik", "period_end", F.col("label").alias("b"))
    both = Q.restate_strict(spark, sf).withColumnRenamed("label", "a").join(b, ["cik", "period_end"])
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def prune_features(spark, sf):
    p = view(spark, sf, "panel")
    kept = J.prune_low_coverage(p, p.where("fiscal_year <= 1998"), FEATURES, 0.9)
    names = [c for c in FEATURES if c in kept.columns]
    counts = kept.agg(*(F.count(c).alias(c) for c in names))
    return counts.unpivot([], names, "feature", "n")


def first_year_flag(spark, sf):
    return P.yoy(view(spark, sf, "panel"), []).select("cik", "fiscal_year", "is_first_year")


def _masked(spark, sf):
    return J.mask_features(_keyed(spark, sf, *_COLS), ["cik", "fiscal_year"], _COLS, 0.3, 5)


def masked_mse(spark, sf):
    """The error of the masked zeros against the true values, in thousands."""
    true = _keyed(spark, sf, *(F.col(c).alias(f"true_{c}") for c in _COLS))
    j = _masked(spark, sf).join(true, ["cik", "fiscal_year"])
    return j.agg(*(F.round(F.sum(F.pow((F.col(c) - F.col(f"true_{c}")) / 1000, F.lit(2)) * F.col(f"{c}_masked")) / F.greatest(F.sum(f"{c}_masked"), F.lit(1)), 2).alias(c) for c in _COLS))


def train_fraction(spark, sf):
    u = portable_uniform(F.col("cik"), F.col("fiscal_year").cast("string"), F.lit("3"))
    return J.nested_samples(_keyed(spark, sf), u, _FRACTIONS).groupBy("fraction").agg(F.count("*").alias("n"), F.min("cik").alias("first"))


def union_by_name(spark, sf):
    f = view(spark, sf, "filing")
    a = f.where("form_type = '10-K'").select("cik", "filename", "form_type")
    return a.unionByName(f.where("form_type = '10-K/A'").select("filename", "cik"), allowMissingColumns=True)


def search_hits_extract(spark, sf):
    f = view(spark, sf, "filing")
    adsh = F.when(F.col("filename") % 10 == 0, "").otherwise(F.expr("cast(filename div 3 as string)"))
    date = F.when(F.col("filename") % 7 == 0, "none").otherwise(F.col("date_filed").cast("string"))
    return J.search_hits(f.select(F.to_json(F.struct(adsh.alias("adsh"), F.array(F.col("cik"), F.lit("x")).alias("ciks"), date.alias("file_date"))).alias("hit")), "hit")


def submissions_meta(spark, sf):
    c = view(spark, sf, "company")
    state = F.when(F.col("custkey") % 5 == 0, "").otherwise(F.col("state"))
    doc = F.to_json(F.struct(F.col("custkey").alias("cik"), F.col("entity_name").alias("name"), F.col("sic_code").alias("sic"), state.alias("state"), F.col("exchange").alias("category"), F.lit("1231").alias("fiscal_year_end")))
    return landed.parse_submissions(c.select(doc.alias("doc")), "doc", ("name", "sic", "state", "category", "fiscal_year_end"))


def short_interest_join(spark, sf):
    interest = view(spark, sf, "price").select("ticker", F.col("dt").alias("filing_date"), F.col("volume").alias("short_interest"))
    return J.short_interest(view(spark, sf, "grid").select("cik", "ticker", "filing_date"), interest)


def _u(*parts):
    return "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 8))::ubigint / 4294967296.0"


_SPLIT = "case when period_end <= date '1997-12-31' then 'train' when period_end <= date '1998-12-31' then 'val' else 'test' end as split"
_YEAR = "d as (select cik, cast(year(period_end) as int) as year, period_end, period_end - cast(cast(cik as int) % 20 as int) as label_end, cast(cik as int) % 20 as apart from {panel})"
_HIT = {c: f"{_u('cik', 'cast(fiscal_year as string)', repr(c), repr('5'))} < 0.3" for c in _COLS}
QUERIES = {
    "submissions_meta": (submissions_meta, "select cik, entity_name as name, sic_code as sic, case when custkey % 5 <> 0 then state end as state, exchange as category, '1231' as fiscal_year_end from {company}"),
    "short_interest_join": (short_interest_join, "select g.cik, g.ticker, g.filing_date, p.volume as short_interest from {grid} g left join {price} p on g.ticker = p.ticker and g.filing_date = p.dt"),
    "ticker_map": (ticker_map, "select p.cik, fiscal_year, ticker from {panel} p left join {company} c on p.cik = c.cik"),
    "sic_join": (sic_join, "select p.cik, fiscal_year, case when custkey % 4 <> 0 then sic_code end as sic_code from {panel} p left join {company} c on p.cik = c.cik"),
    "crossref_merge": (crossref_merge, "with v as (select lpad(cast(custkey as string), 6, '0') as gvkey, case when custkey % 2 <> 0 then cik end as vcik, ticker as tic from {company} where custkey % 3 = 0), f as (select tic, min(gvkey) as gvkey from v group by 1) select c.cik, c.ticker, coalesce(v.gvkey, f.gvkey) as gvkey, case when v.gvkey is not null then 'cik' when f.gvkey is not null then 'ticker' end as matched from {company} c left join v on c.cik = v.vcik left join f on c.ticker = f.tic"),
    "amended_pairs": (amended_pairs, f"with {Q._REG} select p.cik, p.fiscal_year, cast(coalesce(k, 0) >= 2 as int) as amended from {{panel}} p left join (select cik, period_end, count(*) as k from reg group by 1, 2) r on p.cik = r.cik and p.period_end = r.period_end"),
    "universe_semi_join": (universe_semi_join, "select cik, event_date from {event_date} where cik in (select cik from {company} where exchange = 'MACHINERY')"),
    "year_tolerance_join": (year_tolerance_join, f"with {_YEAR} select cik, year, period_end, label_end from d where apart <= 14"),
    "date_alignment_report": (date_alignment_report, f"with {_YEAR} select count(*) filter (apart = 0) as n_exact, count(*) filter (apart between 1 and 14) as n_near, count(*) filter (apart > 14) as n_dropped from d"),
    "split_snapshots": (split_snapshots, f"with {Q._UNI}, s as (select split, u.sector, u.is_current from (select distinct {_SPLIT}, cik from {{panel}} where period_end <= date '2000-12-31') s join uni u on s.cik = u.cik), w as (select split, count(*) filter (is_current = 1) as n_current, round(avg(coalesce(is_current, 0)) * 100, 1) as pct_current from s group by 1) select s.split, sector, count(*) as n, n_current, pct_current from s join w on s.split = w.split group by all"),
    "split_preview": (split_preview, f"select split, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 4) as share from (select {_SPLIT} from {{panel}} where period_end <= date '2000-12-31') s group by 1"),
    "sector_distribution": (sector_distribution, "select sector, count(*) as n from {company_sector} group by 1"),
    "metric_reconcile": (metric_reconcile, "select cik, fiscal_year, round(total_revenue, 2) as a, round(case when fiscal_year = 1995 then total_revenue + 1 end, 2) as b from {panel} where total_revenue is not null and fiscal_year in (1995, 1997)"),
    "label_flips": (label_flips, f"with {Q._STRICT}, b as (select p.cik, p.period_end, cast({Q._EV.format(365)} as int) as b from {{panel}} p) select st.cik, st.period_end, label as a, b from st join b on st.cik = b.cik and st.period_end = b.period_end where label <> b"),
    "prune_features": (prune_features, " union all ".join(f"select '{c}' as feature, count({c}) as n from {{panel}} having count({c}) filter (fiscal_year <= 1998) >= 0.9 * count(*) filter (fiscal_year <= 1998)" for c in FEATURES)),
    "first_year_flag": (first_year_flag, "select cik, fiscal_year, case when fiscal_year - lag(fiscal_year) over (partition by cik order by fiscal_year, filed_date) = 1 then 0 else 1 end as is_first_year from {panel}"),
    "mask_features": (_masked, "select cik, fiscal_year, " + ", ".join(f"case when {h} then 0.0 else {c} end as {c}, cast({h} as int) as {c}_masked" for c, h in _HIT.items()) + " from {panel}"),
    "masked_mse": (masked_mse, "select " + ", ".join(f"round(sum(case when {h} then ({c} / 1000) * ({c} / 1000) end) / greatest(count(*) filter ({h}), 1), 2) as {c}" for c, h in _HIT.items()) + " from {panel}"),
    "train_fraction": (train_fraction, " union all ".join(f"select cast({f} as double) as fraction, count(*) as n, min(cik) as first from {{panel}} where {_u('cik', 'cast(fiscal_year as string)', repr('3'))} < {f}" for f in _FRACTIONS)),
    "union_by_name": (union_by_name, "select cik, filename, case when form_type = '10-K' then form_type end as form_type from {filing} where form_type in ('10-K', '10-K/A')"),
    "search_hits_extract": (search_hits_extract, "with h as (select case when filename % 10 = 0 then '' else cast(filename // 3 as string) end as adsh, cik, case when filename % 7 = 0 then 'none' else cast(date_filed as string) end as fd from {filing}), o as (select *, row_number() over (partition by adsh order by fd, cik) as k from h) select adsh, cik, try_cast(fd as date) as file_date from o where (adsh = '' or k = 1) and fd <> 'none'"),
}
