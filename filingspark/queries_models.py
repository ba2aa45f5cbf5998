"""Queries on baseline models. Fitting isn't SQL; they have no oracle and are tested against brute-force versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries_panel as Q
from .functions.exprs import portable_uniform
from .functions.sectors import SECTORS, sector_index
from .operators import models as M
from .operators.features import PanelScaler
from .operators.panel import RATIO_NAMES, ratios
from .plans import splits as S
from .sources.places import cut, new_place
from .views import FEATURES, view

CUTS = ("1997-12-31", "1998-12-31", "2000-12-31")
OUTCOMES = ("restated", "returned")
FULL = (*FEATURES, *RATIO_NAMES)
TRADITIONAL = tuple(n for n in RATIO_NAMES if n not in ("interest_coverage", "cfo_to_debt"))
#: Depth and sampling are the library's defaults; rounds are fewer and steps longer, so that the queries end in a minute.
ROUNDS = {"rounds": 40, "rate": 0.2}
_SHORT = {"rounds": 15, "rate": 0.3}


def _panel(spark, sf):
    """Company-years of all splits with both outcomes, raw features, ratios and the sector's index, written once: fits, scores and metrics read them many times."""
    labels = Q.restate_strict(spark, sf).withColumnRenamed("label", "restated").join(Q.event_in_window(spark, sf).select("cik", "period_end", F.col("label").alias("returned")), ["cik", "period_end"])
    sector = view(spark, sf, "company_sector").select("cik", sector_index(F.col("sector")).alias("sector_idx"))
    p = S.make_splits(ratios(view(spark, sf, "panel")), *CUTS).join(labels, ["cik", "period_end"]).join(sector, "cik", "left")
    return cut(p.select("cik", "fiscal_year", "period_end", "split", "sector_idx", *OUTCOMES, *FULL))


def _matrix(spark, sf):
    p = _panel(spark, sf)
    return PanelScaler(FULL).fit(p.where("split = 'train'")).transform(p)


def _scores(table, fit):
    def run(spark, sf):
        m = table(spark, sf)
        return M.scored(fit(m.where("split = 'train'")), m.where("split = 'test'"), ["cik", "fiscal_year", "restated"]).withColumn("score", F.round("score", 6))

    return run


lr_scores = _scores(_matrix, lambda t: M.logistic_regression(t, FULL, "restated"))
lr_traditional_scores = _scores(_matrix, lambda t: M.logistic_regression(t, TRADITIONAL, "restated"))
gbt_full_scores = _scores(_matrix, lambda t: M.boosted_trees(t, FULL, "restated", **ROUNDS))
#: On raw features with their missing values, classes balanced.
gbt_raw_scores = _scores(_panel, lambda t: M.boosted_trees(t, FEATURES, "restated", balanced=True, l2=0.0, min_weight=1e-3, min_rows=20, subsample=1.0, colsample=1.0, **ROUNDS))


def temporal_grid(spark, sf):
    """Over the training split's own years."""
    trees = [{"depth": 3, **_SHORT}, {"depth": 6, **_SHORT}]
    found = M.temporal_grid(_panel(spark, sf).where("split = 'train'"), FULL, "restated", (0.1, 1.0), trees, 2)
    return found.withColumn("mean_auroc", F.round("mean_auroc", 6))


def _bench(spark, sf):
    m = _matrix(spark, sf)
    trees = {"gbt_full": {"features": FULL, **_SHORT}, "gbt_raw": {"features": FEATURES, "balanced": True, "min_rows": 20, **_SHORT}}
    scores = cut(M.benchmark_scores(m, OUTCOMES, {"lr_full": FULL, "lr_traditional": TRADITIONAL}, trees, ["sector_idx"]))
    return M.benchmark(scores, "gbt_full", "lr_full", len(SECTORS), 0.01, 2)


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def benchmark(spark, sf):
    return _rounded(_bench(spark, sf)[0])


def benchmark_sectors(spark, sf):
    return _rounded(_bench(spark, sf)[1])


def benchmark_gate(spark, sf):
    return _bench(spark, sf)[2].withColumn("passed", F.col("passed").cast("int"))


def walk_forward(spark, sf):
    """Two runs over the same folder: the second one finds all folds committed and reads them."""
    labels = Q.restate_strict(spark, sf).withColumnRenamed("label", "restated")
    p = cut(view(spark, sf, "panel").join(labels, ["cik", "period_end"]))
    out = new_place(spark, "folds")
    for _ in range(2):
        found = M.walk_forward(p, Q._folds(spark), FEATURES, ["restated"], out, "v1", {**_SHORT, "depth": 4}, method="zscore")
    return _rounded(found)


def scaling_curve(spark, sf):
    m = _matrix(spark, sf)
    order = portable_uniform(F.col("cik"), F.col("fiscal_year").cast("string"), F.lit("3"))
    return _rounded(M.scaling_curve(m.where("split = 'train'"), m.where("split = 'test'"), FULL, "restated", ["cik", "fiscal_year"], order))


QUERIES = {f: (globals()[f], None) for f in ("lr_scores", "lr_traditional_scores", "gbt_full_scores", "gbt_raw_scores", "temporal_grid", "benchmark", "benchmark_sectors", "benchmark_gate", "walk_forward", "scaling_curve")}
