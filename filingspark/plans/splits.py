"""Temporal splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def make_splits(panel: DataFrame, train_end: str, val_end: str, test_end: str, at: str = "period_end") -> DataFrame:
    """panel with split: train up to the first cutoff, val up to the second, test up to the third; later and NULL dates go."""
    d = F.col(at)
    cut = lambda s: F.lit(s).cast("date")
    split = F.when(d <= cut(train_end), "train").when(d <= cut(val_end), "val").when(d <= cut(test_end), "test")
    return panel.withColumn("split", split).where("split is not null")


def fold_table(spark: SparkSession, first_train_end: str, last: str, val_years: int = 1, test_years: int = 1, step_years: int = 1) -> DataFrame:
    """(fold, train_end, val_end, test_end): windows move on until a test would end after ``last``; possibly no rows. As many rows as the dates give."""
    years = int(str(last)[:4]) - int(str(first_train_end)[:4])
    limit = spark.range(max(0, years // step_years) + 1).select(F.col("id").cast("int").alias("fold"), F.lit(first_train_end).cast("date").alias("d"))
    f = limit.select("fold", F.add_months("d", F.col("fold") * (12 * step_years)).alias("train_end"))
    f = f.select("*", F.add_months("train_end", 12 * val_years).alias("val_end"), F.add_months("train_end", 12 * (val_years + test_years)).alias("test_end"))
    return f.where(F.col("test_end") <= F.lit(last).cast("date"))


def rolling_splits(panel: DataFrame, folds: DataFrame, at: str = "period_end") -> DataFrame:
    """One row for each fold that a row belongs to: expanding train, then val, then test. The fold table has a row a step."""
    d = F.col(at)
    split = F.when(d <= F.col("train_end"), "train").when(d <= F.col("val_end"), "val").otherwise("test")
    return panel.join(F.broadcast(folds), d <= F.col("test_end")).withColumn("split", split).drop("train_end", "val_end", "test_end")


def describe_splits(split: DataFrame, keys=("split",), at: str = "period_end") -> DataFrame:
    return split.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct("cik").alias("n_companies"), F.min(at).alias("first"), F.max(at).alias("last"))


def temporal_cv(panel: DataFrame, n_folds: int, year: str = "fiscal_year") -> DataFrame:
    """Expanding folds over the last ``n_folds`` years: (…, fold, part). NULL years are left out; ValueError with too few years."""
    years = sorted(r[0] for r in panel.where(F.col(year).isNotNull()).select(year).distinct().collect())
    if len(years) <= n_folds:
        raise ValueError(f"{len(years)} years are too few for {n_folds} folds")
    folds = panel.sparkSession.createDataFrame(list(enumerate(years[-n_folds:])), "fold int, val_year int")
    part = F.when(F.col(year) == F.col("val_year"), "val").otherwise("train")
    return panel.join(F.broadcast(folds), F.col(year) <= F.col("val_year")).withColumn("part", part).drop("val_year")
