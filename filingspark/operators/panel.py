"""Universe, facts, labels and features of a company-year panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import col_or_null, safe_div
from ..functions.sectors import with_sector
from .ordered import HOT, exists_within, overlaps


def dedup_keep(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in an explicit order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def filing_coverage(filings: DataFrame, first_year: int, last_year: int, since: str, form: str = "10-K", min_filings: int = 1) -> DataFrame:
    """Per company over the original filings of a window of years: how many, and how many of them since the date ``since``; coverage, the share of the latter (4 decimals), and has_gap if it is below 0.95; first and last date, years and the years missing between them, and whether it filed in the last two."""
    year = F.year("date_filed")
    a = filings.where((F.trim("form_type") == form) & year.between(first_year, last_year)).groupBy("cik").agg(
        F.count("*").alias("n_filings"),
        F.count_if(F.col("date_filed") >= F.lit(since).cast("date")).alias("n_since"),
        F.min("date_filed").alias("first_filed"),
        F.max("date_filed").alias("last_filed"),
        F.array_sort(F.collect_set(year)).alias("filing_years"),
    )
    gaps = F.array_except(F.sequence(F.array_min("filing_years"), F.array_max("filing_years")), F.col("filing_years"))
    coverage = F.round(F.col("n_since") / F.col("n_filings"), 4)
    return a.where(F.col("n_filings") >= min_filings).select("*", gaps.alias("gap_years"), coverage.alias("coverage"), (coverage < 0.95).alias("has_gap"), F.arrays_overlap("filing_years", F.array(F.lit(last_year - 1), F.lit(last_year))).alias("is_current"))


#: The exchanges whose listings come before others.
PRIMARY = ("Nasdaq", "NYSE", "NYSE MKT")


def primary_listing(listings: DataFrame, primary: Sequence[str] = PRIMARY, order: Sequence[Column] = ()) -> DataFrame:
    """One listing a company: the first on a ``primary`` exchange, else the first of all, by ``order`` or the ticker."""
    other = (~F.coalesce(F.col("exchange").isin(list(primary)), F.lit(False))).cast("int")
    return dedup_keep(listings, ["cik"], [other, *(order or [F.col("ticker")])])


def universe_enrich(coverage: DataFrame, names: DataFrame, companies: DataFrame | None = None, primary: Sequence[str] = PRIMARY) -> DataFrame:
    """coverage (cik, ...) with each company's latest name and, of ``companies`` (cik, ticker, exchange, sic_code, state), its primary listing and sector. Without companies these are NULL."""
    columns = ("ticker", "exchange", "sic_code", "state", "sector")
    named = coverage.join(names, "cik", "left")
    if companies is None:
        return named.withColumns({c: F.lit(None).cast("string") for c in columns})
    one = primary_listing(companies, primary).select("cik", *columns[:-1])
    return named.join(with_sector(one), "cik", "left")


def universe_provenance(universe: DataFrame, filings: DataFrame, first_year: int, last_year: int, forms: Sequence[str], min_filings: int, since: str, built: str) -> dict[str, str]:
    """What a universe was built from, as text: the window, forms and limits, and how many companies it has and filings the index."""
    year = F.year("date_filed")
    n = filings.where(F.trim("form_type").isin(list(forms)) & year.between(first_year, last_year)).count()
    told = {"build_date": built, "start_year": first_year, "end_year": last_year, "n_companies": universe.count(), "n_filings_in_index": n, "form_types": ",".join(forms), "min_filings": min_filings, "mandatory_since": since}
    return {k: str(v) for k, v in told.items()}


def universe_summary(universe: DataFrame) -> DataFrame:
    """One row: companies, percents with a ticker, with a coverage of at least 0.8 and current ones, first and last filing."""
    pct = lambda c: F.round(F.avg(c.cast("int")) * 100, 4)
    return universe.agg(F.count("*").alias("n_companies"), pct(F.col("ticker").isNotNull()).alias("pct_ticker"), pct(F.col("coverage") >= 0.8).alias("pct_covered"), pct(F.col("is_current").cast("boolean")).alias("pct_current"), F.min("first_filed").alias("earliest"), F.max("last_filed").alias("latest"))


def latest_value(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def event_in_window(grid: DataFrame, events: DataFrame, key: str, at: str, days: int, label: str, hot: int = HOT) -> DataFrame:
    """1 if any event (key, event_date) of the same key lies in [at, at + days], else 0; one ordered pass over both sides, no pairs."""
    return exists_within(grid, events, key, at, "event_date", days, label, hot)


def interval_overlap(grid: DataFrame, spans: DataFrame, key: str, at: str, days: int, label: str, hot: int = HOT) -> DataFrame:
    """1 if any span (key, start_date, end_date) overlaps [at, at + days], else 0; one ordered pass over both sides, no pairs."""
    return overlaps(grid, spans, key, at, days, label, hot)


def resolve_features(facts: DataFrame, tags: DataFrame) -> DataFrame:
    """facts (cik, fy, tag, filed, pos, val) and tags (tag, feature, priority): per company, year and feature the value of the first tag with an entry, of its entries the latest filed, of these the first listed."""
    return dedup_keep(facts.join(tags, "tag"), ["cik", "fy", "feature"], [F.col("priority"), F.desc("filed"), F.col("pos")]).select("cik", "fy", "feature", "tag", "filed", "val")


RATIOS = {
    "debt_to_equity": ("total_debt", "total_equity"),
    "debt_to_assets": ("total_debt", "total_assets"),
    "current_ratio": ("current_assets", "current_liabilities"),
    "roa": ("net_income", "total_assets"),
    "roe": ("net_income", "total_equity"),
    "operating_margin": ("operating_income", "total_revenue"),
    "net_margin": ("net_income", "total_revenue"),
    "interest_coverage": ("operating_income", "interest_expense"),
    "cfo_to_debt": ("cash_from_operations", "total_debt"),
}


RATIO_NAMES = (*RATIOS, "quick_ratio", "gross_margin", "altman_z")


def ratios(panel: DataFrame) -> DataFrame:
    """panel with twelve ratios, in one projection; a missing input or a denominator near zero makes a ratio NULL."""
    c = lambda n: col_or_null(panel, n)
    out = {name: safe_div(c(a), c(b)) for name, (a, b) in RATIOS.items()}
    out["quick_ratio"] = safe_div(c("cash_equivalents"), c("current_liabilities"))
    out["gross_margin"] = safe_div(c("total_revenue") - c("cost_of_sales"), c("total_revenue"))
    # fixed values: the five weights of the Z score
    z = zip((1.2, 1.4, 3.3, 0.6, 1.0), (c("current_assets") - c("current_liabilities"), c("retained_earnings"), c("operating_income"), c("total_equity"), c("total_revenue")), ("total_assets",) * 3 + ("total_liabilities", "total_assets"))
    parts = [w * safe_div(a, c(b)) for w, a, b in z]
    out["altman_z"] = parts[0] + parts[1] + parts[2] + parts[3] + parts[4]
    return panel.select("*", *(e.alias(n) for n, e in out.items()))


def yoy(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """panel with is_first_year and yoy_{c}: (x − previous)/|previous|, NULL for a previous 0 or NULL, 0 in a company's first year and after a gap. A column that the panel lacks counts as NULL."""
    w = Window.partitionBy("cik").orderBy("fiscal_year", "filed_date")
    before = F.lag("fiscal_year").over(w)
    first = before.isNull() | (F.col("fiscal_year") - before > 1)

    def change(c: str) -> Column:
        if c not in panel.columns:
            return F.lit(None).cast("double")
        return F.when(F.lag(c).over(w) != 0, (F.col(c) - F.lag(c).over(w)) / F.abs(F.lag(c).over(w)))

    return panel.select("*", first.cast("int").alias("is_first_year"), *(F.when(first, 0.0).otherwise(change(c)).alias(f"yoy_{c}") for c in columns))


def coverage_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, coverage): the share that isn't NULL, in one pass; 0 for an empty table, columns that don't exist are left out."""
    have = [c for c in columns if c in df.columns]
    one = df.agg(*(F.coalesce(F.avg(F.col(c).isNotNull().cast("int")), F.lit(0.0)).alias(c) for c in have))
    pairs = ", ".join(f"'{c}', {c}" for c in have)
    return one.selectExpr(f"stack({len(have)}, {pairs}) as (feature, coverage)")


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select("*", *(F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in columns))


def validate_labels(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per label: positives, negatives, missing, coverage in percent (2 decimals), positive rate (4), and whether there are 20 positives."""
    pairs = ", ".join(f"'{c}', {c}" for c in labels)
    long = df.selectExpr(f"stack({len(labels)}, {pairs}) as (label, y)")
    a = long.groupBy("label").agg(F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"), F.count_if(F.col("y").isNull()).alias("n_missing"))
    known = F.col("n_pos") + F.col("n_neg")
    return a.select("*", F.round(100 * known / (known + F.col("n_missing")), 2).alias("coverage_pct"), F.round(F.when(known > 0, F.col("n_pos") / known), 4).alias("positive_rate"), F.when(F.col("n_pos") >= 20, "OK").otherwise("LOW").alias("flag"))


def dedup_keep_n(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Up to n rows a key, the first in an explicit order; ordered by a hash, a sample of each stratum."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def version_diff(old: DataFrame, new: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """One row: how a label changed between two versions, over their common keys, how many keys came and went, and the positive rates (4 decimals)."""
    a = old.select(*key, F.col(label).alias("__x"), F.lit(True).alias("__a"))
    b = new.select(*key, F.col(label).alias("__y"), F.lit(True).alias("__b"))
    j = a.join(b, list(key), "full")
    x, y = F.col("__x"), F.col("__y")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return j.agg(
        F.count_if((x == 0) & (y == 1)).alias("flips_up"),
        F.count_if((x == 1) & (y == 0)).alias("flips_down"),
        F.count_if((x == 1) & (y == 1)).alias("same_pos"),
        F.count_if((x == 0) & (y == 0)).alias("same_neg"),
        F.count_if(both & x.isNotNull() & y.isNull()).alias("became_null"),
        F.count_if(both & x.isNull() & y.isNotNull()).alias("became_known"),
        F.count_if(F.col("__a").isNull()).alias("new_rows"),
        F.count_if(F.col("__b").isNull()).alias("dropped_rows"),
        F.round(F.avg(x), 4).alias("old_rate"),
        F.round(F.avg(y), 4).alias("new_rate"),
    )
