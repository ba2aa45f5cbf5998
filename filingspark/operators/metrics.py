"""Exact ranking and calibration metrics, distributed.

Everything comes from one table of (group, score, pos, neg): one shuffle, then running sums over each group's distinct
scores. Running sums are cut into ranges of scores, so a group's scores need not fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.places import cut
from .quantiles import ACCURACY, _place

_RANGES = 255


def counted(pred: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """(keys, score, pos, neg, pos_above, neg_above, p, n): counts, of rows or of their whole weights, at and strictly above each distinct score, and the group's totals.

    A group's distinct scores are cut where a sketch of them says, so that crowded scores spread over ranges as well.
    """
    w = F.col(weight) if weight else F.lit(1)
    cells = pred.groupBy(*keys, "score").agg(F.sum(w * F.col("y")).cast("long").alias("pos"), F.sum(w * (1 - F.col("y"))).cast("long").alias("neg"))
    # A sketch depends on the order in which its parts arrive: written once, it gives both sides of the join the same ranges.
    edges = cut(cells.groupBy(*keys).agg(F.percentile_approx("score", [i / _RANGES for i in range(1, _RANGES)], ACCURACY).alias("__e")))
    cells = cells.join(edges, list(keys)).withColumn("__range", _place(F.col("score"), F.col("__e"), _RANGES)).drop("__e")
    ranges = cells.groupBy(*keys, "__range").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    over = Window.partitionBy(*keys).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    ranges = ranges.select(*keys, "__range", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_above") for c in ("rp", "rn")), F.sum("rp").over(whole).alias("p"), F.sum("rn").over(whole).alias("n"))
    inside = Window.partitionBy(*keys, "__range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    own = cells.withColumns({c: F.coalesce(F.sum(of).over(inside), F.lit(0)) for c, of in (("ip", "pos"), ("in_", "neg"))})
    both = own.join(ranges, [*keys, "__range"])
    return both.select(*keys, "score", "pos", "neg", (F.col("ip") + F.col("rp_above")).alias("pos_above"), (F.col("in_") + F.col("rn_above")).alias("neg_above"), "p", "n")


def ranking(pred: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """(keys, n_rows, n_pos, auroc, auprc, threshold, f1): ties count half; the threshold is the highest that maximises TPR − FPR; NULLs for a group of one class."""
    c = counted(pred, keys, weight)
    both = (F.col("p") > 0) & (F.col("n") > 0)
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    gain = tp * F.col("n") - fp * F.col("p")
    best = F.max(F.struct(gain.alias("gain"), F.col("score").alias("score"), tp.alias("tp"), fp.alias("fp")))
    a = c.groupBy(*keys).agg(
        F.first("p").alias("p"),
        F.first("n").alias("n"),
        F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)).alias("u"),
        F.sum(F.coalesce(F.try_divide(F.col("pos") * tp, tp + fp), F.lit(0.0))).alias("ap"),
        best.alias("b"),
    )
    taken = F.col("b.gain") > 0
    f1 = F.when(taken, 2 * F.col("b.tp") / (F.col("b.tp") + F.col("b.fp") + F.col("p"))).otherwise(0.0)
    return a.select(*keys, (F.col("p") + F.col("n")).alias("n_rows"), F.col("p").alias("n_pos"), F.when(both, F.col("u") / (F.col("p") * F.col("n"))).alias("auroc"), F.when(both, F.col("ap") / F.col("p")).alias("auprc"), F.when(both & taken, F.col("b.score")).alias("threshold"), F.when(both, f1).alias("f1"))


def calibration(pred: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """(keys, bin, n, fraction_positive, mean_score) of the bins (lo, hi] that have rows; 0 belongs to the first."""
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil(F.col("score") * bins) - 1)).cast("int")
    return pred.withColumn("bin", place).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("y").alias("fraction_positive"), F.avg("score").alias("mean_score"))


def ece(pred: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    c = calibration(pred, keys, bins)
    gap = F.abs(F.col("fraction_positive") - F.col("mean_score"))
    return c.groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def brier(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pred.groupBy(*keys).agg(F.avg(F.pow(F.col("score") - F.col("y"), 2)).alias("brier"))


def all_metrics(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    return ranking(pred, keys).join(brier(pred, keys), keys).join(ece(pred, keys), keys)


def stratified(pred: DataFrame, strata: DataFrame, keys: Sequence[str], least: int = 30) -> DataFrame:
    """Ranking metrics of each stratum (keys), all of them listed; NULL below ``least`` rows or with one class."""
    r = strata.join(ranking(pred, keys), list(keys), "left")
    ok = F.col("n_rows") >= least
    return r.select(*keys, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.when(ok, F.col("auroc")).alias("auroc"), F.when(ok, F.col("auprc")).alias("auprc"))


def hanley_mcneil(auc: Column, n_pos: Column, n_neg: Column) -> Column:
    """The standard error of an area under the curve; NULL unless there are two cases of each class, so that intervals are NULL as well."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    v = auc * (1 - auc) + (n_pos - 1) * (q1 - auc * auc) + (n_neg - 1) * (q2 - auc * auc)
    return F.when((n_pos > 1) & (n_neg > 1), F.sqrt(F.greatest(F.lit(0.0), v) / (n_pos * n_neg)))


def interval(value: Column, se: Column, z: float = 1.96) -> list[Column]:
    """(low, high) with 4 decimals; NULL where the error is."""
    return [F.round(value - z * se, 4).alias("low"), F.round(value + z * se, 4).alias("high")]


def pairwise(scored: DataFrame, key: str, a: str, b: str, z: float = 1.96) -> DataFrame:
    """scored (key, model, auroc, n_pos, n_neg): the lead of model ``a`` over ``b``, its error as if the two were independent, and whether its interval leaves out 0."""
    side = lambda m: scored.where(F.col("model") == m).select(key, F.col("auroc").alias(f"auc_{m}"), hanley_mcneil(F.col("auroc"), F.col("n_pos"), F.col("n_neg")).alias(f"se_{m}"))
    delta, se = F.col(f"auc_{a}") - F.col(f"auc_{b}"), F.sqrt(F.col(f"se_{a}") * F.col(f"se_{a}") + F.col(f"se_{b}") * F.col(f"se_{b}"))
    low, high = interval(delta, se, z)
    return side(a).join(side(b), key).select(key, delta.alias("delta"), se.alias("se"), ((low > 0) | (high < 0)).cast("int").alias("significant"))


def gate(metrics: DataFrame, a: str, b: str, margin: float, min_wins: int = 3) -> DataFrame:
    """metrics (model, outcome, value): how many outcomes model a wins by at least ``margin``, and whether that's enough."""
    wide = metrics.groupBy("outcome").pivot("model", [a, b]).agg(F.first("value"))
    wins = F.count_if(F.col(a) - F.col(b) >= margin)
    return wide.agg(wins.alias("wins"), F.count("*").alias("outcomes"), (wins >= min_wins).alias("passed"))


def walk_forward_summary(folds: DataFrame, a: str, b: str, flagged: Sequence[int]) -> DataFrame:
    """folds (outcome, model, fold, value): of the folds that both models have, how many ``a`` wins, all and flagged ones, and its lead."""
    wide = folds.groupBy("outcome", "fold").pivot("model", [a, b]).agg(F.first("value"))
    lead = wide.select("outcome", "fold", (F.col(a) - F.col(b)).alias("delta")).where("delta is not null")
    won = F.col("delta") > 0
    return lead.groupBy("outcome").agg(F.count("*").alias("n_folds"), F.count_if(won).alias("folds_won"), F.count_if(won & F.col("fold").isin(list(flagged))).alias("flagged_won"), F.avg("delta").alias("mean_delta"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"))
