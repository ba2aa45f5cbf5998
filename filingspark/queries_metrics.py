"""Queries on predictions and metric tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from .functions.sectors import SECTORS
from .operators import bootstrap as S
from .operators import metrics as X
from .operators import reports as R
from .operators.features import class_balance as class_balance_of
from .queries_market import r6
from .views import view

KEYS = ["model", "outcome"]
_CELLS = "cells as (select model, outcome, score, sum(y) as pos, sum(1 - y) as neg from {pred} group by 1, 2, 3), cum as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by model, outcome) as p, sum(neg) over (partition by model, outcome) as n from cells window w as (partition by model, outcome order by score desc))"
_AUROC = "auroc as (select model, outcome, sum(neg * (tp - pos + pos / 2.0)) / (max(p) * max(n)) as auroc, sum(pos * tp / cast(tp + fp as double)) / max(p) as auprc, max(p) as n_pos, max(p) + max(n) as n_rows from cum group by 1, 2)"
_YOUDEN = "youden as (select model, outcome, score as threshold, 2.0 * tp / (tp + fp + p) as f1 from (select *, row_number() over (partition by model, outcome order by tp * n - fp * p desc, score desc) as k from cum) t where k = 1)"
_ECE = "ece as (select model, outcome, sum(n * abs(fp - ms)) / sum(n) as ece from (select model, outcome, greatest(0, least(9, ceil(score * 10) - 1)) as bin, count(*) as n, avg(y) as fp, avg(score) as ms from {pred} group by 1, 2, 3) c group by 1, 2)"


def _pred(spark, sf):
    return view(spark, sf, "pred")


def _ranking(*names):
    return lambda spark, sf: r6(X.ranking(_pred(spark, sf), KEYS).select(*KEYS, *names), *names)


def brier(spark, sf):
    return r6(X.brier(_pred(spark, sf), KEYS), "brier")


def calibration(spark, sf):
    return r6(X.calibration(_pred(spark, sf), KEYS), "fraction_positive", "mean_score")


def ece(spark, sf):
    return r6(X.ece(_pred(spark, sf), KEYS), "ece")


def all_metrics(spark, sf):
    return r6(X.all_metrics(_pred(spark, sf), KEYS), "auroc", "auprc", "threshold", "f1", "brier", "ece")


def sector_metrics(spark, sf):
    p = _pred(spark, sf)
    indexes = F.array(*(F.lit(i) for i in range(len(SECTORS))))
    strata = p.select("model").distinct().select("model", F.explode(indexes).alias("sector_idx"))
    return r6(X.stratified(p, strata, ["model", "sector_idx"]), "auroc", "auprc")


def _scored(spark, sf):
    return X.ranking(_pred(spark, sf), KEYS).withColumn("n_neg", F.col("n_rows") - F.col("n_pos"))


def hanley_mcneil(spark, sf):
    se = X.hanley_mcneil(F.col("auroc"), F.col("n_pos"), F.col("n_neg"))
    return _scored(spark, sf).select(*KEYS, F.round(se, 6).alias("se"), *X.interval(F.col("auroc"), se))


def pairwise_ci(spark, sf):
    return r6(X.pairwise(_scored(spark, sf), "outcome", "a", "b"), "delta", "se")


def gate(spark, sf):
    m = X.ranking(_pred(spark, sf), KEYS).select("model", "outcome", F.col("auroc").alias("value"))
    return X.gate(m, "a", "b", 0.0).withColumn("passed", F.col("passed").cast("int"))


def multiseed_summary(spark, sf):
    p = _pred(spark, sf).withColumn("seed", F.col("row_id") % 3)
    a = X.ranking(p, ["outcome", "model", "seed"])
    return r6(a.groupBy("outcome", "model").agg(F.avg("auroc").alias("mean"), F.stddev_pop("auroc").alias("std")), "mean", "std")


def walk_forward_summary(spark, sf):
    p = _pred(spark, sf).withColumn("fold", F.col("row_id") % 3)
    a = X.ranking(p, ["outcome", "model", "fold"]).withColumnRenamed("auroc", "value")
    return r6(X.walk_forward_summary(a, "a", "b", [0]), "mean_delta", "min_delta", "max_delta")


def class_balance(spark, sf):
    p = _pred(spark, sf).withColumn("split", F.when(F.col("sector_idx") < 8, "train").when(F.col("sector_idx") < 10, "val").otherwise("test"))
    return r6(class_balance_of(p, ["model", "outcome"]), "pos_weight")


def bootstrap_auroc(spark, sf):
    return r6(S.bootstrap_auroc(_pred(spark, sf), KEYS, 50), "estimate", "low", "high")


def bootstrap_delta(spark, sf):
    """The given rows' numbers repeat, so they are counted through."""
    again = F.row_number().over(Window.partitionBy("model", "outcome", "row_id").orderBy("sector_idx", "y"))
    p = _pred(spark, sf).withColumn("again", again)
    return r6(S.bootstrap_delta(p, "outcome", ["row_id", "again"], "a", "b", 50), "estimate", "low", "high")


def _by_sector(spark, sf):
    """Areas by model and sector, to stand for variants and configurations."""
    return X.ranking(_pred(spark, sf), ["outcome", "model", "sector_idx"]).select("outcome", "model", "sector_idx", F.col("auroc").alias("value"))


def best_variant(spark, sf):
    v = _by_sector(spark, sf).select("outcome", F.concat_ws("_", "model", "sector_idx").alias("variant"), (F.col("sector_idx") + F.when(F.col("model") == "b", 100).otherwise(0)).alias("place"), "value")
    return r6(R.best_variant(v, "a_0"), "baseline", "best", "delta")


def sweep_topk(spark, sf):
    return r6(R.sweep_topk(_by_sector(spark, sf), ["model", "sector_idx"]), "mean")


def sweep_pivot(spark, sf):
    return r6(R.sweep_pivot(_by_sector(spark, sf), "sector_idx", "model", ["a", "b"]), "a", "b")


def metrics_table(spark, sf):
    """All pairs of an outcome and three models, of which one was skipped."""
    p = _pred(spark, sf)
    grid = p.select("outcome").distinct().select("outcome", F.explode(F.array(*map(F.lit, ("a", "b", "c")))).alias("model"))
    m = X.all_metrics(p, KEYS)
    se = X.hanley_mcneil(F.col("auroc"), F.col("n_pos"), F.col("n_rows") - F.col("n_pos"))
    return r6(R.metrics_table(m, grid, *X.interval(F.col("auroc"), se)), *R.METRICS)


def gate_conditional(spark, sf):
    """Model b wasn't evaluated on one outcome."""
    m = X.ranking(_pred(spark, sf), KEYS).select("model", "outcome", F.when((F.col("model") != "b") | (F.col("outcome") != "R"), F.col("auroc")).alias("value"))
    return R.gate_conditional(m, "a", "b", -1.0)


def config_fingerprint(spark, sf):
    return R.config_fingerprint(view(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_regionkey", "n_name", "n_nationkey"])


_SE = "se as (select *, case when n_pos > 1 and n_rows - n_pos > 1 then sqrt(greatest(0, auroc * (1 - auroc) + (n_pos - 1) * (auroc / (2 - auroc) - auroc * auroc) + (n_rows - n_pos - 1) * (2 * auroc * auroc / (1 + auroc) - auroc * auroc)) / (n_pos * (n_rows - n_pos))) end as se from auroc)"
_SEED = "cells as (select model, outcome, row_id % 3 as seed, score, sum(y) as pos, sum(1 - y) as neg from {pred} group by 1, 2, 3, 4), cum as (select *, sum(pos) over w as tp, sum(pos) over (partition by model, outcome, seed) as p, sum(neg) over (partition by model, outcome, seed) as n from cells window w as (partition by model, outcome, seed order by score desc)), a as (select model, outcome, seed, sum(neg * (tp - pos + pos / 2.0)) / (max(p) * max(n)) as auroc from cum group by 1, 2, 3)"
_BY = lambda keys, cond="": f"cells as (select {keys}, score, sum(w * y) as pos, sum(w * (1 - y)) as neg from src {cond} group by all), cum as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by {keys}) as p, sum(neg) over (partition by {keys}) as n from cells window w as (partition by {keys} order by score desc)), a as (select {keys}, sum(neg * (tp - pos + pos / 2.0)) / nullif(max(p) * max(n), 0) as auroc, case when max(n) > 0 then sum(pos * tp / cast(tp + fp as double)) / nullif(max(p), 0) end as auprc, max(p) as n_pos, max(p) + max(n) as n_rows from cum group by all)"
_SRC = "src as (select *, 1 as w from {pred})"
_SEC = f"{_SRC}, {_BY('model, sector_idx')}"
_BYSEC = f"{_SRC}, {_BY('outcome, model, sector_idx')}"
_U = lambda text: f"('0x' || substr(md5({text} || '|' || replicate || '|42'), 1, 8))::ubigint / 4294967296.0"
_9 = lambda c: f"cast(cast(round({c} * 1e9) as bigint) as varchar)"
# The inverse of the Poisson distribution: how many counts the uniform number has passed.
_CDF = "ks as (select distinct k from cells0), js as (select k, unnest(range(0, cast(ceil(k + 12 * sqrt(k) + 20) as bigint) + 1)) as j from ks), cdf as (select k, list(c order by j) as cdf from (select k, j, sum(exp(j * ln(k) - k - lgamma(j + 1))) over (partition by k order by j) as c from js) t group by k)"
_DRAWN = lambda n, text: f"drawn as (select c.*, replicate, len(list_filter(cdf, lambda v: v <= u)) as w from (select *, {_U(text)} as u from cells0, (select unnest(range(1, {n + 1})) as replicate) r) c join cdf on c.k = cdf.k)"
_OWN = f"own as (with src as (select *, 1 as w from {{pred}}), {_BY('outcome, model')} select * from a)"
_ONE = "model || '|' || outcome || '|' || " + _9("score") + " || '|' || y"
_BOOT = f"cells0 as (select model, outcome, score, y, cast(count(*) as double) as k from {{pred}} group by all), {_CDF}, {_DRAWN(50, _ONE)}, src as (select * from drawn), {_BY('outcome, model, replicate', 'where w > 0')}, {_OWN}"
_TWO = "outcome || '|' || " + _9("sa") + " || '|' || " + _9("sb") + " || '|' || y"
_PAIRS = f"nr as (select *, row_number() over (partition by model, outcome, row_id order by sector_idx, y) as again from {{pred}}), cells0 as (select x.outcome, x.score as sa, z.score as sb, x.y, cast(count(*) as double) as k from nr x join nr z on x.outcome = z.outcome and x.row_id = z.row_id and x.again = z.again where x.model = 'a' and z.model = 'b' group by all), {_CDF}, {_DRAWN(50, _TWO)}, src as (select outcome, replicate, 'a' as model, sa as score, y, w from drawn union all select outcome, replicate, 'b', sb, y, w from drawn), {_BY('outcome, model, replicate', 'where w > 0')}, {_OWN}"
_SPLIT = "case when sector_idx < 8 then 'train' when sector_idx < 10 then 'val' else 'test' end"
QUERIES = {
    "auroc": (_ranking("auroc"), f"with {_CELLS}, {_AUROC} select model, outcome, round(auroc, 6) as auroc from auroc"),
    "auprc": (_ranking("auprc"), f"with {_CELLS}, {_AUROC} select model, outcome, round(auprc, 6) as auprc from auroc"),
    "youden_f1": (_ranking("threshold", "f1"), f"with {_CELLS}, {_YOUDEN} select model, outcome, round(threshold, 6) as threshold, round(f1, 6) as f1 from youden"),
    "brier": (brier, "select model, outcome, round(avg((score - y) * (score - y)), 6) as brier from {pred} group by 1, 2"),
    "calibration": (calibration, "select model, outcome, cast(greatest(0, least(9, ceil(score * 10) - 1)) as int) as bin, count(*) as n, round(avg(y), 6) as fraction_positive, round(avg(score), 6) as mean_score from {pred} group by 1, 2, 3"),
    "ece": (ece, f"with {_ECE} select model, outcome, round(ece, 6) as ece from ece"),
    "all_metrics": (all_metrics, f"with {_CELLS}, {_AUROC}, {_YOUDEN}, {_ECE}, b as (select model, outcome, avg((score - y) * (score - y)) as brier from {{pred}} group by 1, 2) select model, outcome, cast(n_rows as bigint) as n_rows, cast(n_pos as bigint) as n_pos, round(auroc, 6) as auroc, round(auprc, 6) as auprc, round(threshold, 6) as threshold, round(f1, 6) as f1, round(brier, 6) as brier, round(ece, 6) as ece from auroc join youden using (model, outcome) join ece using (model, outcome) join b using (model, outcome)"),
    "sector_metrics": (sector_metrics, f"with {_SEC} select m.model, s.idx as sector_idx, cast(coalesce(n_rows, 0) as bigint) as n_rows, cast(coalesce(n_pos, 0) as bigint) as n_pos, round(case when n_rows >= 30 then auroc end, 6) as auroc, round(case when n_rows >= 30 then auprc end, 6) as auprc from {{sector_list}} s, (select distinct model from {{pred}}) m left join a on s.idx = a.sector_idx and m.model = a.model"),
    "bootstrap_auroc": (bootstrap_auroc, f"with {_BOOT} select own.model, own.outcome, round(own.auroc, 6) as estimate, round(quantile_cont(a.auroc, 0.025), 6) as low, round(quantile_cont(a.auroc, 0.975), 6) as high from own join a on own.outcome = a.outcome and own.model = a.model group by all"),
    "bootstrap_delta": (bootstrap_delta, f"with {_PAIRS}, d as (select x.outcome, x.auroc - y.auroc as d from a x join a y on x.outcome = y.outcome and x.replicate = y.replicate and x.model = 'a' and y.model = 'b'), q as (select outcome, quantile_cont(d, 0.025) as low, quantile_cont(d, 0.975) as high from d group by 1) select x.outcome, round(x.auroc - y.auroc, 6) as estimate, round(low, 6) as low, round(high, 6) as high, cast(low > 0 or high < 0 as int) as significant from own x join own y on x.outcome = y.outcome and x.model = 'a' and y.model = 'b' join q on q.outcome = x.outcome"),
    "best_variant": (best_variant, f"with {_BYSEC}, v as (select outcome, model || '_' || sector_idx as variant, sector_idx + case when model = 'b' then 100 else 0 end as place, auroc as value from a where auroc is not null), b as (select outcome, value as baseline from v where variant = 'a_0'), t as (select outcome, variant, value, row_number() over (partition by outcome order by value desc, place) as k from v where variant <> 'a_0'), r as (select b.outcome, baseline, case when value > baseline then value else baseline end as best, case when value > baseline then variant else 'none' end as best_variant from b left join t on b.outcome = t.outcome and k = 1), n as (select count(*) filter (best - baseline >= 0.005) as n_improved from r) select outcome, round(baseline, 6) as baseline, round(best, 6) as best, best_variant, round(best - baseline, 6) as delta, n_improved, case when n_improved >= 3 then 'proceed' when n_improved >= 1 then 'marginal' else 'no_gain' end as recommendation from r, n"),
    "sweep_topk": (sweep_topk, f"with {_BYSEC} select model, sector_idx, round(coalesce(avg(auroc), 0), 6) as mean from a group by 1, 2 order by coalesce(avg(auroc), 0) desc, 1, 2 limit 10"),
    "sweep_pivot": (sweep_pivot, f"with {_BYSEC}, m as (select model, sector_idx, coalesce(avg(auroc), 0) as mean from a group by 1, 2) select sector_idx, round(max(case when model = 'a' then mean end), 6) as a, round(max(case when model = 'b' then mean end), 6) as b from m group by 1"),
    "metrics_table": (metrics_table, f"with {_CELLS}, {_AUROC}, {_ECE}, {_SE}, br as (select model, outcome, avg((score - y) * (score - y)) as brier from {{pred}} group by 1, 2) select o.outcome, m.model, round(auroc, 6) as auroc, round(auprc, 6) as auprc, round(brier, 6) as brier, round(ece, 6) as ece, round(auroc - 1.96 * se, 4) as low, round(auroc + 1.96 * se, 4) as high from (select distinct outcome from {{pred}}) o, (values ('a'), ('b'), ('c')) as m(model) left join se on se.outcome = o.outcome and se.model = m.model left join ece on ece.outcome = o.outcome and ece.model = m.model left join br on br.outcome = o.outcome and br.model = m.model"),
    "gate_conditional": (gate_conditional, f"with {_CELLS}, {_AUROC}, d as (select x.outcome, x.auroc - case when y.outcome <> 'R' then y.auroc end as d from auroc x join auroc y on x.outcome = y.outcome and x.model = 'a' and y.model = 'b'), n as (select count(*) filter (d >= -1) as wins, count(d) as evaluable, count(*) as outcomes from d) select *, case when wins >= 3 then 'GO' when evaluable >= 2 and wins = evaluable then 'CONDITIONAL_GO' else 'NO_GO' end as decision from n"),
    "config_fingerprint": (config_fingerprint, "select n_nationkey, n_name, n_regionkey, substr(sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}'), 1, 16) as fingerprint from {nation}"),
    "hanley_mcneil": (hanley_mcneil, f"with {_CELLS}, {_AUROC}, {_SE} select model, outcome, round(se, 6) as se, round(auroc - 1.96 * se, 4) as low, round(auroc + 1.96 * se, 4) as high from se"),
    "pairwise_ci": (pairwise_ci, f"with {_CELLS}, {_AUROC}, {_SE}, d as (select a.outcome, a.auroc - b.auroc as d, sqrt(a.se * a.se + b.se * b.se) as s from se a join se b on a.outcome = b.outcome where a.model = 'a' and b.model = 'b') select outcome, round(d, 6) as delta, round(s, 6) as se, cast(round(d - 1.96 * s, 4) > 0 or round(d + 1.96 * s, 4) < 0 as int) as significant from d"),
    "gate": (gate, f"with {_CELLS}, {_AUROC} select count(*) filter (a.auroc - b.auroc >= 0) as wins, count(*) as outcomes, cast(count(*) filter (a.auroc - b.auroc >= 0) >= 3 as int) as passed from auroc a join auroc b on a.outcome = b.outcome where a.model = 'a' and b.model = 'b'"),
    "multiseed_summary": (multiseed_summary, f"with {_SEED} select outcome, model, round(avg(auroc), 6) as mean, round(stddev_pop(auroc), 6) as std from a group by 1, 2"),
    "walk_forward_summary": (walk_forward_summary, f"with {_SEED}, d as (select x.outcome, x.seed, x.auroc - y.auroc as delta from a x join a y on x.outcome = y.outcome and x.seed = y.seed where x.model = 'a' and y.model = 'b') select outcome, count(*) as n_folds, count(*) filter (delta > 0) as folds_won, count(*) filter (delta > 0 and seed = 0) as flagged_won, round(avg(delta), 6) as mean_delta, round(min(delta), 6) as min_delta, round(max(delta), 6) as max_delta from d where delta is not null group by 1"),
    "class_balance": (class_balance, f"with b as (select model, outcome, {_SPLIT} as split, count(*) filter (y = 1) as n_pos, count(*) filter (y = 0) as n_neg from {{pred}} group by 1, 2, 3), s as (select model, outcome, cast(coalesce(max(case when split = 'train' then n_pos end), 0) < 20 or coalesce(max(case when split = 'test' then least(n_pos, n_neg) end), 0) = 0 as int) as skipped from b group by 1, 2) select b.*, round(n_neg / cast(greatest(n_pos, 1) as double), 6) as pos_weight, skipped from b join s on b.model = s.model and b.outcome = s.outcome"),
}
