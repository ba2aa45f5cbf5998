"""The published company-year table: features, labels and market context in one, by split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.concepts import FEATURES
from ..plans.splits import make_splits
from .joins import lookup, year_pairs
from .labels import OUTCOMES
from .panel import dedup_keep

MARKET = ("fwd_ret_252d", "mkt_adj_252d", "delisted")
# The columns of the published table in their order.
COLUMNS = ("cik", "ticker", "fiscal_year", "period_end", "filed_date", "sector", "sic_code", *FEATURES, *OUTCOMES, "earnings_restate_source", *MARKET, "period_end_xbrl", "period_end_label")


def panel_label_join(panel: DataFrame, labels: DataFrame, require_rows: bool = False) -> DataFrame:
    """Inner join by (cik, period_end); the labels' columns that the panel has too get the suffix _label. With ``require_rows``, ValueError where nothing meets."""
    key = ["cik", "period_end"]
    twice = {c: f"{c}_label" for c in labels.columns if c in panel.columns and c not in key}
    joined = panel.join(labels.withColumnsRenamed(twice), key)
    if require_rows and joined.isEmpty():
        raise ValueError("no row of the panel has labels")
    return joined


def dropped_amendments(panel: DataFrame) -> DataFrame:
    """The rows that keeping each company's earliest filed one of a calendar year leaves out."""
    year = panel.withColumn("year", F.year("period_end"))
    first = dedup_keep(year, ["cik", "year"], [F.col("filed_date"), F.col("period_end")]).select("cik", "year", F.col("filed_date").alias("__f"), F.col("period_end").alias("__p"))
    other = ~(F.col("filed_date").eqNullSafe(F.col("__f")) & F.col("period_end").eqNullSafe(F.col("__p")))
    return year.join(first, ["cik", "year"]).where(other).drop("__f", "__p")


def amendment_label_audit(panel: DataFrame, labels: DataFrame, label: str = "earnings_restate") -> DataFrame:
    """One row: of the labelled company-years with a dropped amendment, how many have label 1, 0 and NULL, the percent of 1, and whether that's below 50."""
    years = dropped_amendments(panel).select("cik", "year").distinct()
    met = labels.withColumn("year", F.year("period_end")).join(years, ["cik", "year"], "left_semi")
    y = F.col(label)
    a = met.agg(F.count("*").alias("n"), F.count_if(y == 1).alias("n_1"), F.count_if(y == 0).alias("n_0"), F.count_if(y.isNull()).alias("n_null"))
    pct = F.when(F.col("n") > 0, 100.0 * F.col("n_1") / F.col("n"))
    return a.select("*", F.round(pct, 4).alias("pct_1"), (pct < 50).cast("int").alias("low"))


def publish(panel: DataFrame, labels: DataFrame, market: DataFrame, companies: DataFrame, cutoffs: tuple[str, str, str], days: int = 14) -> DataFrame:
    """The published columns and ``split`` (train, val, test) of the panel's earliest filed rows whose labels of the same calendar year end at most ``days`` apart.

    labels (cik, period_end, outcomes...) and market (cik, period_end, ...) share period ends. ValueError if a
    company-year of the labels repeats.
    """
    own = labels.withColumnRenamed("period_end", "label_end")
    pairs = year_pairs(panel, own.select("cik", "label_end")).where(F.col("days_apart") <= days).drop("days_apart", "year")
    rows = pairs.join(own, ["cik", "label_end"])
    context = dedup_keep(market, ["cik", "period_end"], [F.col("period_end")]).select("cik", F.col("period_end").alias("label_end"), *MARKET)
    rows = rows.join(context, ["cik", "label_end"], "left")
    rows = lookup(rows, companies, "cik", ["sector", "sic_code"], [F.col("sic_code")])
    rows = rows.withColumn("period_end_xbrl", F.col("period_end")).withColumnRenamed("label_end", "period_end_label")
    return make_splits(rows.select(*(c for c in COLUMNS if c in rows.columns)), *cutoffs)


def write_splits(df: DataFrame, path: str, key: Sequence[str] = ("cik", "fiscal_year")) -> None:
    """One folder a split, snappy parquet, each file in the order of ``key``."""
    df.sortWithinPartitions("split", *key).write.mode("overwrite").partitionBy("split").option("compression", "snappy").parquet(path)


def split_snapshots(split: DataFrame, universe: DataFrame) -> DataFrame:
    """(split, sector, n, n_current, pct_current) of the companies of ``universe`` (cik, sector, is_current) in each split; the last two are of the whole split (1 decimal)."""
    s = split.select("split", "cik").distinct().join(dedup_keep(universe, ["cik"], [F.col("sector")]), "cik")
    whole = s.groupBy("split").agg(F.count_if(F.col("is_current").cast("int") == 1).alias("n_current"), F.round(F.avg(F.coalesce(F.col("is_current").cast("int"), F.lit(0))) * 100, 1).alias("pct_current"))
    return s.groupBy("split", "sector").agg(F.count("*").alias("n")).join(whole, "split")


