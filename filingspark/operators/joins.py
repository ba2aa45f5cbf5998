"""Look-ups, fallback joins, tolerance joins, reconciliation, pruning, masking and sampling of panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import portable_uniform
from .panel import coverage_report, dedup_keep


def lookup(df: DataFrame, dimension: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Left join to the first row of each key of a dimension, in an explicit order."""
    return df.join(dedup_keep(dimension.where(F.col(key).isNotNull()), [key], order).select(key, *columns), key, "left")


def primary_then_fallback(df: DataFrame, vendor: DataFrame, primary: tuple[str, str], fallback: tuple[str, str], order: Sequence[Column]) -> DataFrame:
    """df with ``vendor``, a struct of the vendor's row by the first pair of keys (df's, vendor's) or, only if that has none, by the second; and ``matched``, the key that found it."""

    def side(key: str, name: str) -> DataFrame:
        rows = dedup_keep(vendor.where(F.col(key).isNotNull()), [key], order)
        return rows.select(F.col(key).alias(f"{name}_key"), F.struct(*vendor.columns).alias(name))

    both = df.join(side(primary[1], "__p"), F.col(primary[0]) == F.col("__p_key"), "left").join(side(fallback[1], "__f"), F.col(fallback[0]) == F.col("__f_key"), "left")
    matched = F.when(F.col("__p").isNotNull(), primary[0]).when(F.col("__f").isNotNull(), fallback[0])
    return both.select(*df.columns, F.coalesce("__p", "__f").alias("vendor"), matched.alias("matched"))


def match_report(joined: DataFrame, primary: str, fallback: str, listed: Column | None = None) -> DataFrame:
    """One row on what ``primary_then_fallback`` gave: rows, matches by either key, rows without one, the share that the fallback recovered of what the first key missed (4 decimals), and, of rows that count as ``listed``, those without a match."""
    m = F.col("matched")
    missed = F.count_if(m.isNull() | (m == fallback))
    unmatched_listed = F.count_if(m.isNull() & F.coalesce(listed, F.lit(False))) if listed is not None else F.lit(0).cast("long")
    return joined.agg(F.count("*").alias("n"), F.count_if(m == primary).alias("n_primary"), F.count_if(m == fallback).alias("n_fallback"), F.count_if(m.isNull()).alias("n_unmatched"), F.round(F.coalesce(F.try_divide(F.count_if(m == fallback), missed), F.lit(0.0)), 4).alias("recovered"), unmatched_listed.alias("n_unmatched_listed"))


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"keys repeat: {', '.join(keys)}")
    return df


def year_pairs(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """panel (cik, period_end, filed_date), of a company's year the earliest filed row, with labels (cik, label_end) of the same year; days_apart between the two dates."""
    year = F.year("period_end")
    one = dedup_keep(panel.withColumn("year", year), ["cik", "year"], [F.col("filed_date"), F.col("period_end")])
    other = require_unique(labels.withColumn("year", F.year("label_end")), ["cik", "year"])
    return one.join(other, ["cik", "year"]).withColumn("days_apart", F.abs(F.datediff("period_end", "label_end")))


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float = 6e-4) -> DataFrame:
    """(keys, a, b) of the values that differ by ``tolerance`` or more, or that only one table has."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), list(keys), "full")
    agree = F.col("a").eqNullSafe(F.col("b")) | F.coalesce(F.abs(F.col("a") - F.col("b")) < tolerance, F.lit(False))
    return both.where(~agree)


def prune_low_coverage(df: DataFrame, train: DataFrame, features: Sequence[str], least: float) -> DataFrame:
    """df without the features whose share of values in ``train`` is below ``least``; one short row a feature comes to the driver."""
    kept = {r.feature for r in coverage_report(train, features).where(F.col("coverage") >= least).collect()}
    return df.drop(*(c for c in features if c not in kept))


def mask_features(df: DataFrame, keys: Sequence[str], columns: Sequence[str], rate: float, seed: int) -> DataFrame:
    """Each cell independently, by a hash of its row, column and seed, becomes 0.0; {c}_masked tells which."""
    hit = lambda c: portable_uniform(*(F.col(k).cast("string") for k in keys), F.lit(c), F.lit(str(seed))) < rate
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *(F.when(hit(c), 0.0).otherwise(F.col(c)).alias(c) for c in columns), *(hit(c).cast("int").alias(f"{c}_masked") for c in columns))


def nested_samples(df: DataFrame, key: Column, fractions: Sequence[float]) -> DataFrame:
    """Each row once for every fraction above its hash, so that a smaller sample lies in each larger one; no sort."""
    return df.select("*", F.explode(F.array(*map(F.lit, fractions))).alias("fraction")).where(key < F.col("fraction"))


def search_hits(df: DataFrame, column: str) -> DataFrame:
    """(adsh, cik, file_date) of JSON hits {adsh, ciks, file_date}: one hit a number, all of those without one; the first company; no bad dates."""
    h = df.select(F.from_json(column, "adsh string, ciks array<string>, file_date string").alias("h")).select("h.adsh", F.get("h.ciks", F.lit(0)).alias("cik"), "h.file_date")
    blank = F.coalesce(F.col("adsh"), F.lit("")) == ""
    one = dedup_keep(h.where(~blank), ["adsh"], [F.col("file_date"), F.col("cik")]).unionByName(h.where(blank))
    return one.withColumn("file_date", F.try_to_timestamp("file_date", F.lit("yyyy-MM-dd")).cast("date")).where("cik is not null and file_date is not null")


def short_interest(df: DataFrame, interest: DataFrame) -> DataFrame:
    """df with the short interest of exactly its ticker and filing date, NULL where there is none; df as it is where ``interest`` lacks a column."""
    names = ["ticker", "filing_date", "short_interest"]
    if not set(names) <= set(interest.columns):
        return df
    return df.join(dedup_keep(interest.select(*names), names[:2], [F.col("short_interest")]), names[:2], "left")
