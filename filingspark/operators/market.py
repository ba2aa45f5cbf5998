"""Prices against filings: forward returns, as-of dates, benchmarks, alignment, and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import clip
from .ordered import HOT, next_row
from .quantiles import quantiles


def forward_returns(prices: DataFrame, horizons: Sequence[int], key: str = "ticker") -> DataFrame:
    """prices (key, dt, close) with fwd_{h}: the log return over the next h rows of a series, NULL in the tail and where a price isn't positive."""
    w = Window.partitionBy(key).orderBy("dt")
    log = F.when(F.col("close") > 0, F.ln("close"))
    return prices.where("close is not null").withColumns({f"fwd_{h}": F.lead(log, h).over(w) - log for h in horizons})


def forward_returns_long(prices: DataFrame, horizons: Sequence[int], key: str = "ticker") -> DataFrame:
    """(key, dt, horizon, fwd_return), with the tail's NULL rows."""
    wide = forward_returns(prices, horizons, key)
    pairs = ", ".join(f"{h}, fwd_{h}" for h in horizons)
    return wide.selectExpr(key, "dt", f"stack({len(horizons)}, {pairs}) as (horizon, fwd_return)")


def days_remaining(prices: DataFrame, key: str = "ticker") -> DataFrame:
    """prices with the number of later rows in the series."""
    w = Window.partitionBy(key)
    return prices.where("close is not null").withColumn("days_left", (F.count("*").over(w) - F.row_number().over(w.orderBy("dt"))).cast("long"))


def trailing_volume(prices: DataFrame, rows: int, key: str = "ticker") -> DataFrame:
    """prices with the mean volume of up to ``rows`` rows before each; rows without a close count too."""
    w = Window.partitionBy(key).orderBy("dt").rowsBetween(-rows, -1)
    return prices.withColumn("trailing_volume", F.avg("volume").over(w))


def asof_next(events: DataFrame, series: DataFrame, key: str, at: str, carry: Sequence[str], hot: int = HOT) -> DataFrame:
    """``events`` with ref_date and the ``carry`` columns of the first series row of the same key at or after ``at``; NULLs without one.

    Both sides are laid into one sequence a key, from the last date to the first, so a key's rows are read once and the
    frame only grows; no pair is made. A key with more than ``hot`` rows is cut into ranges of dates that spread over
    tasks. ``series`` is (key, dt, carry...), unique by (key, dt).
    """
    row = F.struct(F.col("dt").alias("ref_date"), *carry)
    left = events.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(0).alias("__kind"), F.struct(*events.columns).alias("__event"), F.lit(None).cast(_type_of(series, row)).alias("__row"))
    right = series.select(F.col(key).alias("__key"), F.col("dt").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(left.schema["__event"].dataType).alias("__event"), row.alias("__row"))
    found = next_row(left.union(right), "__key", "__at", "__kind", "__row", hot)
    unmatched = F.col("__key").isNull() | F.col("__at").isNull()
    return found.select("__event.*", *(F.when(~unmatched, F.col(f"__next.{c}")).alias(c) for c in ("ref_date", *carry)))


def asof_next_shared(events: DataFrame, series: DataFrame, key: str, at: str, carry: Sequence[str]) -> DataFrame:
    """As ``asof_next`` where few keys and dates stand for many events: each (key, at) is looked up once, and the answers join the events by equality."""
    asked = events.select(F.col(key).alias("__k"), F.col(at).alias("__a")).distinct()
    found = asof_next(asked, series.withColumnRenamed(key, "__k"), "__k", "__a", carry)
    joined = events.join(found, (F.col(key) == F.col("__k")) & (F.col(at) == F.col("__a")), "left")
    return joined.select(*events.columns, "ref_date", *carry)


def _type_of(df: DataFrame, column: Column):
    return df.select(column.alias("c")).schema["c"].dataType


def align(grid: DataFrame, prices: DataFrame, benchmarks: DataFrame, horizons: Sequence[int], primary: int, volume_rows: int, market: str) -> DataFrame:
    """Filings (…, ticker, bench, filing_date) against prices and benchmark series (bench, dt, close).

    Rows without a ticker go. Each series is scanned once: returns, rows left and trailing volume are computed where it
    is sorted, and one as-of lookup brings them to the filings; the benchmarks' returns are looked up once for each
    reference date. Without a price on or after the filing date everything is NULL and the row counts as delisted.
    """
    if primary not in horizons:
        raise ValueError("the primary horizon must be one of the horizons")
    # The volume counts rows without a close, the rest doesn't; all of it is one exchange and one sort by ticker and date.
    own = days_remaining(forward_returns(trailing_volume(prices, volume_rows), horizons))
    names = [f"fwd_{h}" for h in horizons]
    own = own.select("ticker", "dt", "days_left", "trailing_volume", *names)
    rows = asof_next(grid.where("ticker is not null"), own, "ticker", "filing_date", ["days_left", "trailing_volume", *names])
    series = forward_returns(benchmarks, horizons, "bench").select(F.col("bench").alias("__bench"), "dt", *names)
    for prefix, bench in (("mkt", F.lit(market)), ("sec", F.col("bench"))):
        renamed = series.withColumnsRenamed({n: f"{prefix}_{n}" for n in names})
        asked = rows.withColumn("__bench", bench).withColumnRenamed("ref_date", "__ref")
        taken = asof_next_shared(asked, renamed, "__bench", "__ref", [f"{prefix}_{n}" for n in names])
        rows = taken.drop("ref_date", "__bench").withColumnRenamed("__ref", "ref_date")
    delisted = F.coalesce(F.col("days_left") < primary, F.lit(True))
    adjusted = {f"{p}_adj_{h}": F.col(f"fwd_{h}") - F.col(f"{p}_fwd_{h}") for p in ("mkt", "sec") for h in horizons}
    return rows.withColumns({"delisted": delisted, **adjusted})


def stock_decline(mkt_adj: Column, delisted: Column, threshold: float = -0.2, delisting_counts: bool = True) -> Column:
    """1 if the market-adjusted return is below the threshold, NULL if it's missing; a delisted company counts as 1."""
    label = F.when(mkt_adj.isNotNull(), (mkt_adj < threshold).cast("int"))
    return F.when(delisted, 1).otherwise(label) if delisting_counts else label


def wide_close(prices: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """dt by ticker. The tickers are named, so no extra job looks for them, and other tickers' rows aren't shuffled."""
    return prices.where(F.col("ticker").isin(list(tickers))).groupBy("dt").pivot("ticker", list(tickers)).agg(F.first("close"))


def closes_by_date(prices: DataFrame, parts: int = 1) -> DataFrame:
    """(dt, part, closes): the closes of a date's tickers as maps, for any number of tickers; a ticker has one price a date.

    Each ticker belongs to one of ``parts``, by its hash, so that no map and no task holds a whole large market.
    """
    part = F.pmod(F.xxhash64("ticker"), F.lit(parts)).cast("int").alias("part")
    return prices.groupBy("dt", part).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ticker", "close")))).alias("closes"))


def excess_returns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two return series (dt, ret) on their common dates."""
    return a.join(b.withColumnRenamed("ret", "__ret"), "dt").select("dt", (F.col("ret") - F.col("__ret")).alias("excess"))


def index_to_100(series: DataFrame, key: str) -> DataFrame:
    """close over the series' close on the table's first date, times 100; NULL for a series without a row on that date."""
    first = series.agg(F.min("dt").alias("dt"))
    base = series.join(F.broadcast(first), "dt").select(F.col(key), F.col("close").alias("__base"))
    return series.join(base, key, "left").select(key, "dt", (F.col("close") / F.col("__base") * 100).alias("indexed"))


def annualised_return(series: DataFrame, key: str, rows_per_year: int = 252) -> DataFrame:
    """Of series longer than a year: the yearly log return, the total return, and the years (1 decimal)."""
    a = series.groupBy(key).agg(F.min_by("close", "dt").alias("f"), F.max_by("close", "dt").alias("l"), F.count("*").alias("n")).where(F.col("n") > rows_per_year)
    return a.select(key, (F.ln(F.col("l") / F.col("f")) / (F.col("n") / rows_per_year)).alias("annualised"), (F.col("l") / F.col("f") - 1).alias("total"), F.round(F.col("n") / rows_per_year, 1).alias("years"))


def event_rate(labelled: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """Percent of labelled rows with label 1, and how many there are."""
    return labelled.where(F.col(label).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), (F.avg(label) * 100).alias("rate"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample deviation, extremes and five exact percentiles; NULLs but for the count without values."""
    x = df.select(F.col(column).cast("double").alias("x"))
    a = x.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"))
    both = a.join(quantiles(x, [], "x", (0.05, 0.25, 0.5, 0.75, 0.95)), "n", "left")
    return both.select("n", "mean", "std", "low", *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate((5, 25, 50, 75, 95))), "high")


def histogram(df: DataFrame, column: str, bins: int, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(bin, n) of the values clipped to two quantiles, in equal bins; the highest value belongs to the last. The two bounds come to the driver; no rows without values."""
    bounds = quantiles(df, [], column, (low, high)).first()
    lo, hi = bounds.q if bounds else (0.0, 1.0)
    x = clip(F.col(column), F.lit(lo), F.lit(hi))
    place = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(x - lo, F.lit((hi - lo) / bins)), F.lit(0.0)))).cast("int")
    return df.where(F.col(column).isNotNull()).select(place.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def equal_bins(df: DataFrame, column: Column, bins: int) -> DataFrame:
    """(bin, low, high, n) of the values in equal bins from the lowest to the highest, which belongs to the last; only bins with values. The two extremes come to the driver; one bin where all values are equal, no rows without any."""
    x = df.select(column.cast("double").alias("x")).where("x is not null and not isnan(x)")
    b = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    lo, hi = (b.lo, b.hi) if b.lo is not None else (0.0, 0.0)
    width = (hi - lo) / bins
    place = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col("x") - lo, F.lit(width)), F.lit(0.0)))).cast("int")
    counted = x.select(place.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return counted.select("bin", (F.col("bin") * width + lo).alias("low"), ((F.col("bin") + 1) * width + lo).alias("high"), "n")


def log_millions(volume: Column) -> Column:
    """log10 of a volume in millions, with a thousandth added; NULL for a volume that isn't positive."""
    return F.when(volume > 0, F.log10(volume / 1e6 + 1e-3))


def group_median(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, median) of the groups that have values."""
    return quantiles(df, [key], column, (0.5,)).select(key, F.col("q")[0].alias("median"))


def missing_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, pct_missing)."""
    one = df.agg(*(F.avg(F.col(c).isNull().cast("int") * 100.0).alias(c) for c in columns))
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {pairs}) as (column_name, pct_missing)")


def missing_pivot(df: DataFrame, row: str, column: str, values: Sequence, of: str) -> DataFrame:
    """Percent missing by row and column value; a cell without rows counts as 100."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg(F.col(of).isNull().cast("int") * 100.0)).fillna(100.0)


def boxplot(df: DataFrame, key: str, column: str) -> DataFrame:
    """Quartiles and the outermost values within 1.5 interquartile ranges of them."""
    some = df.where(F.col(column).isNotNull())
    q = quantiles(some, [key], column, (0.25, 0.5, 0.75)).select(key, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = some.join(q, key).where(F.col(column).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(key, "q1", "median", "q3").agg(F.min(column).alias("low"), F.max(column).alias("high"))


def company_year_grid(companies: DataFrame, default_mmdd: str = "1231", lag_days: int = 90) -> DataFrame:
    """companies (cik, filing_years, and fiscal_year_end as MMDD, if there is one) as a row a year: fiscal_year, period_end, filing_date.

    Hyphens go from MMDD and it is padded to four digits; where it is missing the default holds, and where the year
    lacks that day, 31 December. Empty lists give no rows; other columns stay.
    """
    given = F.regexp_replace(F.trim(F.col("fiscal_year_end").cast("string")), "-", "") if "fiscal_year_end" in companies.columns else F.lit(None).cast("string")
    mmdd = F.coalesce(F.nullif(given, F.lit("")), F.lit(default_mmdd))
    mmdd = F.when(F.length(mmdd) < 4, F.lpad(mmdd, 4, "0")).otherwise(mmdd)
    rest = [c for c in companies.columns if c not in ("filing_years", "fiscal_year_end")]
    rows = companies.select(*rest, mmdd.alias("__mmdd"), F.explode("filing_years").alias("fiscal_year"))
    day = F.concat_ws("-", F.col("fiscal_year").cast("string"), F.substring("__mmdd", 1, 2), F.substring("__mmdd", 3, 2))
    end = F.coalesce(F.try_to_date(day, "yyyy-MM-dd"), F.make_date("fiscal_year", F.lit(12), F.lit(31)))
    return rows.select(*rest, "fiscal_year", end.alias("period_end"), F.date_add(end, lag_days).alias("filing_date"))


def market_summary(aligned: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """One row: rows, companies, tickers, dates, and percents delisted and with a return at each horizon."""
    share = lambda c: F.avg(c.cast("int")) * 100
    return aligned.agg(F.count("*").alias("n_rows"), F.count_distinct("cik").alias("n_companies"), F.count_distinct("ticker").alias("n_tickers"), F.min("filing_date").alias("first"), F.max("filing_date").alias("last"), share(F.col("delisted")).alias("delisted_pct"), *(share(F.col(f"fwd_{h}").isNotNull()).alias(f"coverage_{h}") for h in horizons))


def standard_prices(raw: DataFrame, keep: Sequence[str] = ("ticker", "dt")) -> DataFrame:
    """Landed price rows with one ``close``: of the columns Close, close, Adj Close and adj_close the first there is, ValueError without any. Rows with nothing but keys, and rows without a close, go."""
    close = next((c for c in ("Close", "close", "Adj Close", "adj_close") if c in raw.columns), None)
    if close is None:
        raise ValueError("no close column")
    return raw.dropna("all", subset=[c for c in raw.columns if c not in keep]).where(F.col(f"`{close}`").isNotNull()).withColumn("close", F.col(f"`{close}`").cast("double"))
