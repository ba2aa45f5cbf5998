"""Annual features and the registry of filings, from reported facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.concepts import DATING, DEBT, FEATURES, PROBES, concept_table
from .joins import lookup
from .panel import dedup_keep, resolve_features


def _annual(facts: DataFrame, first_year: int, last_year: int, forms: Sequence[str]) -> DataFrame:
    return facts.where(F.col("form").isin(list(forms)) & (F.col("fp") == "FY") & (F.col("unit") == "USD") & F.col("fy").between(first_year, last_year))


def _ordinal(tags: Sequence[str]):
    return F.array_position(F.array(*map(F.lit, tags)), F.col("tag"))


def total_debt(resolved: DataFrame) -> DataFrame:
    """(cik, fy, total_debt, n_parts): the sum of the parts of debt that were found; no row where none was."""
    return resolved.where(F.col("feature").isin(list(DEBT))).groupBy("cik", "fy").agg(F.sum("val").alias("total_debt"), F.count("*").alias("n_parts"))


def annual_facts(facts: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """facts (cik, tag, unit, pos, val, fy, fp, form, filed, period_end) as a row a company and year, of the years with a probe: cik, fiscal_year, period_end, filed_date and the features.

    The dates are those of the first dating concept that the year has, from its latest filed entry, the first listed of these.
    """
    own = _annual(facts, first_year, last_year, ["10-K"])
    place = _ordinal(PROBES)
    probes = own.where(F.col("tag").isin(list(PROBES))).withColumn("place", place)
    years = dedup_keep(probes, ["cik", "fy"], [F.col("place"), F.desc("filed"), F.col("pos")])
    dated = F.col("tag").isin(list(DATING))
    years = years.select("cik", "fy", F.when(dated, F.col("period_end")).alias("period_end"), F.when(dated, F.col("filed")).alias("filed_date"))
    found = resolve_features(own, concept_table(facts.sparkSession))
    debt = total_debt(found).select("cik", "fy", F.lit("total_debt").alias("feature"), F.col("total_debt").alias("val"))
    wide = found.select("cik", "fy", "feature", "val").unionByName(debt).groupBy("cik", "fy").pivot("feature", list(FEATURES)).agg(F.first("val"))
    return years.join(wide, ["cik", "fy"], "left").withColumnRenamed("fy", "fiscal_year").select("cik", "fiscal_year", "period_end", "filed_date", *FEATURES)


def amendment_registry(facts: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """(cik, fiscal_year, period_end, filed_date, form): each filing of a year once, original or amended, as the first probe lists it."""
    own = _annual(facts, first_year, last_year, ["10-K", "10-K/A"]).where(F.col("tag").isin(list(PROBES)) & F.col("filed").isNotNull())
    one = dedup_keep(own.withColumn("place", _ordinal(PROBES)), ["cik", "fy", "filed"], [F.col("place"), F.col("pos")])
    return one.select("cik", F.col("fy").alias("fiscal_year"), "period_end", F.col("filed").alias("filed_date"), "form")


def amended_count(registry: DataFrame) -> DataFrame:
    """One row: how many company-years have more than one filing, and how many there are."""
    k = registry.groupBy("cik", "fiscal_year").agg(F.count("*").alias("k"))
    return k.agg(F.count_if(F.col("k") > 1).alias("n_amended"), F.count("*").alias("n_pairs"))


def build_panel(facts: DataFrame, tickers: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """The annual features with each company's ticker, the last listed one of several (``place`` orders them)."""
    p = lookup(annual_facts(facts, first_year, last_year), tickers, "cik", ["ticker"], [F.desc("place")])
    return p.select("cik", "ticker", "fiscal_year", "period_end", "filed_date", *FEATURES)


def validate_panel(panel: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """One row: rows, companies, years, company-years beyond their first, and each feature's coverage in percent (1 decimal)."""
    have = [c for c in features if c in panel.columns]
    cover = [F.round(F.avg(F.col(c).isNotNull().cast("int")) * 100, 1).alias(f"pct_{c}") for c in have]
    return panel.agg(F.count("*").alias("n_rows"), F.count_distinct("cik").alias("n_companies"), F.min("fiscal_year").alias("first"), F.max("fiscal_year").alias("last"), (F.count("*") - F.count_distinct(F.struct("cik", "fiscal_year"))).alias("n_duplicates"), *cover)
