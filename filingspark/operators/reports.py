"""Report tables on market data and on models' results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

METRICS = ("auroc", "auprc", "brier", "ece")


def quality_scorecard(aligned: DataFrame, ret: str, adjusted: str, volume: str, companies: int = 5000, years: tuple[int, int] = (2012, 2023), sectors: int = 10) -> DataFrame:
    """(place, check_name, value, passed, score): seven checks of an aligned market table, and how many pass."""
    pct = lambda c: F.coalesce(F.avg(c.cast("int")) * 100, F.lit(0.0))
    year = F.year("filing_date")
    a = aligned.agg(
        F.count_distinct("cik").cast("double").alias("companies"),
        pct(F.col(ret).isNotNull()).alias("return_coverage"),
        pct(F.col(adjusted).isNotNull()).alias("adjusted_coverage"),
        pct(F.col("delisted")).alias("delisted"),
        F.coalesce(F.min(year) <= years[0], F.lit(False)).__and__(F.coalesce(F.max(year) >= years[1], F.lit(False))).cast("double").alias("years"),
        F.count_distinct("sector").cast("double").alias("sectors"),
        pct(F.col(volume).isNotNull()).alias("volume_coverage"),
    )
    tests = {"companies": f"companies >= {companies}", "return_coverage": "return_coverage >= 70", "adjusted_coverage": "adjusted_coverage >= 70", "delisted": "delisted < 40", "years": "years = 1", "sectors": f"sectors >= {sectors}", "volume_coverage": "volume_coverage >= 60"}
    score = " + ".join(f"cast({t} as int)" for t in tests.values())
    rows = ", ".join(f"{i}, '{n}', {n}, cast({t} as int)" for i, (n, t) in enumerate(tests.items()))
    return a.selectExpr(f"stack({len(tests)}, {rows}) as (place, check_name, value, passed)", f"{score} as score")


def best_variant(scores: DataFrame, baseline: str, least: float = 0.005) -> DataFrame:
    """scores (outcome, variant, place, value): per outcome the baseline, the best variant that beats it (of equals the one of the lowest place; none: "none"), its lead (6 decimals), how many outcomes it improves by ``least``, and proceed (3 or more), marginal (1) or no_gain. Outcomes without a baseline are left out."""
    base = scores.where((F.col("variant") == baseline) & F.col("value").isNotNull()).select("outcome", F.col("value").alias("baseline"))
    other = scores.where((F.col("variant") != baseline) & F.col("value").isNotNull())
    best = other.groupBy("outcome").agg(F.max_by(F.struct("variant", "value"), F.struct("value", -F.col("place"))).alias("b"))
    j = base.join(best, "outcome", "left")
    better = F.coalesce(F.col("b.value") > F.col("baseline"), F.lit(False))
    rows = j.select("outcome", "baseline", F.when(better, F.col("b.value")).otherwise(F.col("baseline")).alias("best"), F.when(better, F.col("b.variant")).otherwise("none").alias("best_variant"))
    rows = rows.withColumn("delta", F.round(F.col("best") - F.col("baseline"), 6))
    improved = rows.agg(F.count_if(F.col("best") - F.col("baseline") >= least).alias("n")).first().n
    word = "proceed" if improved >= 3 else "marginal" if improved else "no_gain"
    return rows.select("*", F.lit(improved).cast("long").alias("n_improved"), F.lit(word).alias("recommendation"))


def sweep_means(results: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, mean): each configuration's mean over the outcomes that could be evaluated, 0 without any."""
    return results.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def sweep_topk(results: DataFrame, keys: Sequence[str], k: int = 10, value: str = "value") -> DataFrame:
    """The ``k`` best configurations; of equals those first in the order of ``keys``."""
    return sweep_means(results, keys, value).orderBy(F.desc("mean"), *keys).limit(k)


def sweep_pivot(results: DataFrame, row: str, column: str, values: Sequence, value: str = "value") -> DataFrame:
    return sweep_means(results, [row, column], value).groupBy(row).pivot(column, list(values)).agg(F.first("mean"))


def metrics_table(metrics: DataFrame, grid: DataFrame, low: Column, high: Column) -> DataFrame:
    """grid (outcome, model), every row of it, with the four metrics and the area's interval; NULLs where a model was skipped."""
    own = metrics.select("outcome", "model", *METRICS, low.alias("low"), high.alias("high"))
    return grid.join(own, ["outcome", "model"], "left")


def gate_conditional(metrics: DataFrame, a: str, b: str, margin: float, min_wins: int = 3) -> DataFrame:
    """metrics (model, outcome, value), NULL where skipped. One row: wins of ``a`` over ``b`` by ``margin``, outcomes that both have, and GO at ``min_wins`` wins, CONDITIONAL_GO where all evaluable ones, two at least, are won, else NO_GO."""
    wide = metrics.groupBy("outcome").pivot("model", [a, b]).agg(F.first("value"))
    lead = F.col(a) - F.col(b)
    n = wide.agg(F.count_if(lead >= margin).alias("wins"), F.count_if(lead.isNotNull()).alias("evaluable"), F.count("*").alias("outcomes"))
    decision = F.when(F.col("wins") >= min_wins, "GO").when((F.col("evaluable") >= 2) & (F.col("wins") == F.col("evaluable")), "CONDITIONAL_GO").otherwise("NO_GO")
    return n.select("*", decision.alias("decision"))


def config_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with fingerprint: the first 16 hex digits of the SHA-256 of the columns as JSON, in the order of their names."""
    return df.withColumn("fingerprint", F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16))


def data_spec(universe: DataFrame, splits: DataFrame, cutoffs: tuple[str, str, str], features: dict[str, Sequence[str]], outcomes: Sequence[str], rolling: dict[str, object] | None = None) -> DataFrame:
    """(section, name, value), all text, of a dataset: companies and their sectors, the groups of features and all numeric ones, outcomes, cutoffs and rolling settings, and each split's rows, companies and dates.

    universe (cik, sector), splits (split, cik, period_end). One aggregation of each; no row comes to the driver.
    """
    spark = universe.sparkSession
    fixed = [("features", k, str(len(v))) for k, v in features.items()] + [("features", "total_numeric", str(sum(map(len, features.values()))))]
    fixed += [("labels", "outcome", o) for o in outcomes]
    fixed += list(zip(["splits"] * 3, ("train_end", "val_end", "test_end"), cutoffs)) + [("rolling", k, str(v)) for k, v in (rolling or {}).items()]
    text = lambda c: F.col(c).cast("string")
    companies = universe.agg(F.count_distinct("cik").alias("n")).select(F.lit("universe").alias("section"), F.lit("n_companies").alias("name"), text("n").alias("value"))
    sectors = universe.where("sector is not null").groupBy("sector").agg(F.count("*").alias("n")).select(F.lit("sectors"), "sector", text("n"))
    stats = splits.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("cik").alias("n_companies"), F.min("period_end").alias("first"), F.max("period_end").alias("last"))
    stats = stats.unpivot(["split"], [text(c).alias(c) for c in ("n_rows", "n_companies", "first", "last")], "name", "value").select("split", "name", "value")
    return spark.createDataFrame(fixed, "section string, name string, value string").union(companies).union(sectors).union(stats)
