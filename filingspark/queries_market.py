"""Queries on prices and filings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.sectors import benchmark
from .operators import joins as J
from .operators import market as M
from .operators import panel as P
from .views import view

HORIZONS, PRIMARY, VOLUME_ROWS = (1, 3, 6, 12), 12, 5


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _aligned(spark, sf):
    return M.align(view(spark, sf, "grid"), view(spark, sf, "price"), view(spark, sf, "bench_price"), HORIZONS, PRIMARY, VOLUME_ROWS, "market")


_FWD = ", ".join(f"lead(case when close > 0 then ln(close) end, {h}) over w - case when close > 0 then ln(close) end as fwd_{h}" for h in HORIZONS)
_OWN = f"own as (select ticker, dt, {_FWD}, count(*) over (partition by ticker) - row_number() over w as days_left, avg(volume) over (partition by ticker order by dt rows between {VOLUME_ROWS} preceding and 1 preceding) as trailing_volume from {{price}} where close is not null window w as (partition by ticker order by dt)), bm as (select bench, dt, {_FWD} from {{bench_price}} where close is not null window w as (partition by bench order by dt))"
_REF = "ref as (select g.*, (select min(dt) from own o where o.ticker = g.ticker and o.dt >= g.filing_date) as ref_date from {grid} g)"
_ALIGN = f"with {_OWN}, {_REF}, al as (select r.cik, r.ticker, r.sector, r.filing_date, r.period_end, r.ref_date, o.days_left, o.trailing_volume, coalesce(o.days_left < {PRIMARY}, true) as delisted, " + ", ".join(f"o.fwd_{h}, o.fwd_{h} - m.fwd_{h} as mkt_adj_{h}, o.fwd_{h} - s.fwd_{h} as sec_adj_{h}, m.fwd_{h} as mkt_fwd_{h}, s.fwd_{h} as sec_fwd_{h}" for h in HORIZONS) + " from ref r left join own o on o.ticker = r.ticker and o.dt = r.ref_date left join bm m on m.bench = 'market' and m.dt = (select min(dt) from bm where bench = 'market' and dt >= r.ref_date) left join bm s on s.bench = r.bench and s.dt = (select min(b2.dt) from bm b2 where b2.bench = r.bench and b2.dt >= r.ref_date))"
_SHOWN = ["trailing_volume", *(f"{p}_{h}" for p in ("fwd", "mkt_adj", "sec_adj") for h in HORIZONS)]


def market_align(spark, sf):
    a = _aligned(spark, sf)
    return r6(a.select("cik", "ticker", "filing_date", "ref_date", "days_left", F.col("delisted").cast("int").alias("delisted"), *_SHOWN), *_SHOWN)


def _labelled(spark, sf):
    a = _aligned(spark, sf)
    return a.withColumn("stock_decline", M.stock_decline(F.col("mkt_adj_12"), F.col("delisted")))


_DECLINE = _ALIGN + ", lab as (select *, case when delisted then 1 when mkt_adj_12 is not null then case when mkt_adj_12 < -0.2 then 1 else 0 end end as stock_decline from al)"


def event_rate(spark, sf):
    labelled = _labelled(spark, sf).withColumn("year", F.year("period_end"))
    return r6(M.event_rate(labelled, "stock_decline", ["sector", "year"]), "rate")


def decline_preview(spark, sf):
    a = _aligned(spark, sf).where("fwd_12 is not null")
    return a.select("cik", "period_end", (F.col("fwd_12") < F.ln(F.lit(0.7))).cast("int").alias("decline"))


def forward_returns(spark, sf):
    d = M.forward_returns(view(spark, sf, "price"), HORIZONS)
    names = [f"fwd_{h}" for h in HORIZONS]
    return r6(d.select("ticker", "dt", *names), *names)


def forward_returns_long(spark, sf):
    return r6(M.forward_returns_long(view(spark, sf, "price"), HORIZONS), "fwd_return")


def asof_next_trading_day(spark, sf):
    g = view(spark, sf, "grid").select("cik", "ticker", "filing_date")
    return M.asof_next(g, view(spark, sf, "price").select("ticker", "dt", "close"), "ticker", "filing_date", ["close"])


def asof_benchmark(spark, sf):
    g = view(spark, sf, "grid").select("cik", "bench", "filing_date")
    return r6(M.asof_next_shared(g, view(spark, sf, "bench_price"), "bench", "filing_date", ["close"]), "close")


def close_wide(spark, sf):
    """A row a date with the closes of all tickers, in ten-thousandths, as text."""
    wide = M.closes_by_date(view(spark, sf, "price"))
    each = F.transform(F.map_entries("closes"), lambda e: F.concat_ws("=", e["key"], F.round(e["value"] * 10000).cast("long").cast("string")))
    return wide.select("dt", F.size("closes").cast("long").alias("n_tickers"), F.array_join(F.array_sort(each), ",").alias("closes"))


def close_wide_all(spark, sf):
    return M.closes_by_date(view(spark, sf, "price"), 64).select("dt", F.explode("closes").alias("ticker", "close"))


def excess_returns(spark, sf):
    series = M.forward_returns(view(spark, sf, "bench_price"), [1], "bench")
    of = lambda b: series.where(F.col("bench") == b).select("dt", F.col("fwd_1").alias("ret"))
    return r6(M.excess_returns(of("click"), of("market")), "excess")


def sector_benchmark(spark, sf):
    g = view(spark, sf, "filing").join(view(spark, sf, "company_sector").select("cik", "sector"), "cik")
    return g.withColumn("benchmark", benchmark(F.col("sector"), F.add_months("date_filed", 240))).groupBy("sector", "benchmark").agg(F.count("*").alias("n"))


def company_year_grid(spark, sf):
    c = P.filing_coverage(view(spark, sf, "filing"), 1995, 2001, "1997-01-01").select("cik", "filing_years")
    k = F.col("cik").cast("long") % 4
    return M.company_year_grid(c.withColumn("fiscal_year_end", F.when(k == 0, "0229").when(k == 1, "6-30").when(k == 2, "1030")))


def market_summary(spark, sf):
    return r6(M.market_summary(_aligned(spark, sf), HORIZONS), "delisted_pct", *(f"coverage_{h}" for h in HORIZONS))


def prices_scan(spark, sf):
    raw = view(spark, sf, "price").withColumnRenamed("close", "Adj Close")
    return M.standard_prices(raw).select("ticker", "dt", "close", "volume")


def market(spark, sf):
    """From companies' years and fiscal year ends to aligned returns and short interest."""
    g = view(spark, sf, "grid")
    c = g.select("cik", "ticker", "sector", "bench", F.array(F.lit(2023)).alias("filing_years"), F.date_format("period_end", "MM-dd").alias("fiscal_year_end"))
    rows = M.align(M.company_year_grid(c), view(spark, sf, "price"), view(spark, sf, "bench_price"), HORIZONS, PRIMARY, VOLUME_ROWS, "market")
    interest = view(spark, sf, "price").select("ticker", F.col("dt").alias("filing_date"), F.col("volume").alias("short_interest"))
    rows = J.short_interest(rows, interest)
    shown = ["trailing_volume", *(f"fwd_{h}" for h in HORIZONS)]
    return r6(rows.select("cik", "ticker", "sector", "fiscal_year", "period_end", "filing_date", "ref_date", F.col("delisted").cast("int").alias("delisted"), "short_interest", *shown, "mkt_fwd_12", "sec_fwd_12"), *shown, "mkt_fwd_12", "sec_fwd_12")


def sector_median(spark, sf):
    return r6(M.group_median(_aligned(spark, sf), "sector", "mkt_adj_12").withColumnRenamed("median", "median_excess"), "median_excess")


def describe_returns(spark, sf):
    d = M.describe(_aligned(spark, sf), "fwd_6")
    return r6(d, *(c for c in d.columns if c != "n"))


def histogram(spark, sf):
    return M.histogram(view(spark, sf, "price"), "close", 80)


def missing_by_column(spark, sf):
    return r6(M.missing_share(_aligned(spark, sf), [f"fwd_{h}" for h in HORIZONS]), "pct_missing")


def missing_pivot(spark, sf):
    a = _aligned(spark, sf).withColumn("d", F.dayofmonth("filing_date") % 3)
    return r6(M.missing_pivot(a, "sector", "d", [0, 1, 2], "fwd_6").withColumnsRenamed({str(i): f"m{i}" for i in range(3)}), "m0", "m1", "m2")


def coverage_by_year(spark, sf):
    a = _aligned(spark, sf).withColumn("year", F.year("period_end"))
    return r6(a.groupBy("year").agg(*((F.avg(F.col(f"fwd_{h}").isNotNull().cast("int")) * 100).alias(f"coverage_{h}") for h in HORIZONS)), *(f"coverage_{h}" for h in HORIZONS))


def boxplot_stats(spark, sf):
    names = ("q1", "median", "q3", "low", "high")
    return r6(M.boxplot(_aligned(spark, sf), "sector", "fwd_1"), *names)


def first_per_group(spark, sf):
    a = _aligned(spark, sf).where("fwd_1 is not null")
    return a.groupBy("sector").agg(F.min_by("ticker", F.struct("filing_date", "cik")).alias("ticker"))


def trailing_volume(spark, sf):
    return r6(M.trailing_volume(view(spark, sf, "price"), VOLUME_ROWS).select("ticker", "dt", "trailing_volume"), "trailing_volume")


def days_remaining(spark, sf):
    return M.days_remaining(view(spark, sf, "price")).select("ticker", "dt", "days_left")


def stock_decline(spark, sf):
    return _labelled(spark, sf).select("cik", "period_end", "stock_decline")


def index_to_100(spark, sf):
    return r6(M.index_to_100(view(spark, sf, "bench_price"), "bench"), "indexed")


def annualised_return(spark, sf):
    return r6(M.annualised_return(view(spark, sf, "bench_price"), "bench", 20), "annualised", "total")


def corporate_actions(spark, sf):
    e = view(spark, sf, "events")
    split, dividend = F.col("event_type") == "error", F.col("event_type") == "purchase"
    return e.groupBy(F.month("ts").alias("month")).agg(F.count_distinct(F.when(split, F.col("user_id"))).alias("tickers_split"), F.count_if(split).alias("splits"), F.count_if(dividend).alias("dividends"))


_R = lambda *names: ", ".join(f"round({n}, 6) as {n}" for n in names)
_COV = ", ".join(f"round(avg(case when fwd_{h} is not null then 1 else 0 end) * 100, 6) as coverage_{h}" for h in HORIZONS)
QUERIES = {
    "market_align": (market_align, f"{_ALIGN} select cik, ticker, filing_date, ref_date, days_left, cast(delisted as int) as delisted, {_R(*_SHOWN)} from al"),
    "event_rate": (event_rate, f"{_DECLINE} select sector, cast(year(period_end) as int) as year, count(*) as n, round(avg(stock_decline) * 100, 6) as rate from lab where stock_decline is not null group by 1, 2"),
    "stock_decline": (stock_decline, f"{_DECLINE} select cik, period_end, stock_decline from lab"),
    "decline_preview": (decline_preview, f"{_ALIGN} select cik, period_end, cast(fwd_12 < ln(0.7) as int) as decline from al where fwd_12 is not null"),
    "forward_returns": (forward_returns, f"with {_OWN} select ticker, dt, {_R(*(f'fwd_{h}' for h in HORIZONS))} from own"),
    "forward_returns_long": (forward_returns_long, f"with {_OWN} " + " union all ".join(f"select ticker, dt, {h} as horizon, round(fwd_{h}, 6) as fwd_return from own" for h in HORIZONS)),
    "days_remaining": (days_remaining, f"with {_OWN} select ticker, dt, days_left from own"),
    "trailing_volume": (trailing_volume, f"with {_OWN} select ticker, dt, {_R('trailing_volume')} from own"),
    "asof_next_trading_day": (asof_next_trading_day, "select g.cik, g.ticker, g.filing_date, p.dt as ref_date, p.close from {grid} g asof left join {price} p on g.ticker = p.ticker and g.filing_date <= p.dt"),
    "asof_benchmark": (asof_benchmark, "select g.cik, g.bench, g.filing_date, p.dt as ref_date, round(p.close, 6) as close from {grid} g asof left join {bench_price} p on g.bench = p.bench and g.filing_date <= p.dt"),
    "prices_scan": (prices_scan, "select ticker, dt, close, volume from {price} where close is not null"),
    "market": (market, f"{_ALIGN} select a.cik, a.ticker, a.sector, 2023 as fiscal_year, a.period_end, a.filing_date, ref_date, cast(delisted as int) as delisted, p.volume as short_interest, {', '.join(f'round({n}, 6) as {n}' for n in ('trailing_volume', *(f'fwd_{h}' for h in HORIZONS)))}, round(mkt_fwd_12, 6) as mkt_fwd_12, round(sec_fwd_12, 6) as sec_fwd_12 from al a left join {{price}} p on p.ticker = a.ticker and p.dt = a.filing_date"),
    "close_wide": (close_wide, "select dt, count(*) as n_tickers, array_to_string(list_sort(list(ticker || '=' || cast(cast(round(close * 10000) as bigint) as string))), ',') as closes from {price} group by dt"),
    "close_wide_all": (close_wide_all, "select dt, ticker, close from {price}"),
    "excess_returns": (excess_returns, f"with {_OWN} select a.dt, round(a.fwd_1 - b.fwd_1, 6) as excess from bm a join bm b on a.dt = b.dt where a.bench = 'click' and b.bench = 'market'"),
    "sector_benchmark": (sector_benchmark, "select c.sector, case when s.bench = 'XLC' and f.date_filed + interval 20 year < date '2018-06-18' then '^GSPC' else s.bench end as benchmark, count(*) as n from {filing} f join {company_sector} c on f.cik = c.cik join {sector_list} s on s.sector = c.sector group by 1, 2"),
    "company_year_grid": (company_year_grid, "with y as (select distinct cik, cast(year(date_filed) as int) as fiscal_year from {filing} where form_type = '10-K' and year(date_filed) between 1995 and 2001), e as (select cik, fiscal_year, coalesce(try_cast(fiscal_year || '-' || case cast(cik as bigint) % 4 when 0 then '02-29' when 1 then '06-30' when 2 then '10-30' else '12-31' end as date), make_date(fiscal_year, 12, 31)) as period_end from y) select cik, fiscal_year, period_end, period_end + 90 as filing_date from e"),
    "market_summary": (market_summary, f"{_ALIGN} select count(*) as n_rows, count(distinct cik) as n_companies, count(distinct ticker) as n_tickers, min(filing_date) as first, max(filing_date) as last, round(avg(cast(delisted as int)) * 100, 6) as delisted_pct, {_COV} from al"),
    "sector_median": (sector_median, f"{_ALIGN} select sector, round(quantile_cont(mkt_adj_12, 0.5), 6) as median_excess from al where mkt_adj_12 is not null group by 1"),
    "describe_returns": (describe_returns, f"{_ALIGN} select count(fwd_6) as n, round(avg(fwd_6), 6) as mean, round(stddev_samp(fwd_6), 6) as std, round(min(fwd_6), 6) as low, " + ", ".join(f"round(quantile_cont(fwd_6, {p / 100}), 6) as p{p}" for p in (5, 25, 50, 75, 95)) + ", round(max(fwd_6), 6) as high from al"),
    "histogram": (histogram, "with b as (select quantile_cont(close, 0.01) as lo, quantile_cont(close, 0.99) as hi from {price}) select cast(least(79, floor((greatest(lo, least(hi, close)) - lo) / ((hi - lo) / 80))) as int) as bin, count(*) as n from {price}, b where close is not null group by 1"),
    "missing_by_column": (missing_by_column, f"{_ALIGN} " + " union all ".join(f"select 'fwd_{h}' as column_name, round(avg(case when fwd_{h} is null then 100.0 else 0.0 end), 6) as pct_missing from al" for h in HORIZONS)),
    "missing_pivot": (missing_pivot, f"{_ALIGN} select sector, " + ", ".join(f"round(coalesce(avg(case when day(filing_date) % 3 = {i} then case when fwd_6 is null then 100.0 else 0.0 end end), 100), 6) as m{i}" for i in range(3)) + " from al group by 1"),
    "coverage_by_year": (coverage_by_year, f"{_ALIGN} select cast(year(period_end) as int) as year, {_COV} from al group by 1"),
    "boxplot_stats": (boxplot_stats, f"{_ALIGN}, q as (select sector, quantile_cont(fwd_1, 0.25) as q1, quantile_cont(fwd_1, 0.5) as median, quantile_cont(fwd_1, 0.75) as q3 from al where fwd_1 is not null group by 1) select q.sector, {_R('q1', 'median', 'q3')}, round(min(fwd_1), 6) as low, round(max(fwd_1), 6) as high from al join q on al.sector = q.sector where fwd_1 between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by q.sector, q1, median, q3"),
    "first_per_group": (first_per_group, f"{_ALIGN} select sector, arg_min(ticker, row(filing_date, cik)) as ticker from al where fwd_1 is not null group by 1"),
    "index_to_100": (index_to_100, "select s.bench, s.dt, round(s.close / b.close * 100, 6) as indexed from {bench_price} s left join (select * from {bench_price} where dt = (select min(dt) from {bench_price})) b on s.bench = b.bench"),
    "annualised_return": (annualised_return, "select bench, round(ln(arg_max(close, dt) / arg_min(close, dt)) / (count(*) / 20.0), 6) as annualised, round(arg_max(close, dt) / arg_min(close, dt) - 1, 6) as total, round(count(*) / 20.0, 1) as years from {bench_price} group by 1 having count(*) > 20"),
    "corporate_actions": (corporate_actions, "select cast(month(ts) as int) as month, count(distinct case when event_type = 'error' then user_id end) as tickers_split, count(*) filter (event_type = 'error') as splits, count(*) filter (event_type = 'purchase') as dividends from {events} group by 1"),
}
