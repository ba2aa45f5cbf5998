"""Normalisation that is fitted on a training split only, and the feature matrix that is built with it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import clip
from ..functions.normal import normal_quantile
from ..functions.sectors import sector_index, with_sector
from ..plans.splits import make_splits
from ..sources.places import cut
from .joins import lookup, prune_low_coverage
from .panel import RATIO_NAMES, missing_flags, ratios, yoy
from .quantiles import _place, column_quantiles, knots

METHODS = ("zscore", "quantile", "winsorize", "impute")
#: Values nearer than this to the lowest or highest knot count as it; normal scores end at the quantile of this probability.
EDGE, FARTHEST = 1e-7, 5.199337582605575


class PanelScaler:
    """Median imputation, winsorising, then z-scores or normal scores by quantile knots; the methods "impute" and "winsorize" end before. Only the statistics, a few numbers a column and at most 1000 knots, come to the driver.

    Fitting without rows leaves values as they are, but for missing ones, which become 0.
    """

    def __init__(self, columns: Sequence[str], low: float = 0.01, high: float = 0.99, method: str = "zscore", median_impute: bool = True):
        if method not in METHODS:
            raise ValueError(f"unknown method: {method}")
        self.columns, self.low, self.high, self.method, self.median_impute, self.stats = list(columns), low, high, method, median_impute, None

    def _require(self, df: DataFrame) -> None:
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")

    def fit(self, train: DataFrame) -> PanelScaler:
        """Medians, then the bounds of the imputed values, then what the method needs of the clipped ones. The training split's columns are kept while this reads them again."""
        self._require(train)
        self.stats = {}
        if not self.columns:
            return self
        wide = train.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.columns))).persist()
        try:
            names = wide.columns
            of = dict(zip(names, self.columns))
            medians = dict.fromkeys(self.columns, 0.0) | {of[x]: q[0] for x, q in column_quantiles(wide, names, [0.5]).items()}
            filled = wide.select(*(F.coalesce(x, F.lit(medians[of[x]])).alias(x) for x in names))
            bounds = {of[x]: q for x, q in column_quantiles(filled, names, [self.low, self.high]).items()}
            if bounds and self.method != "impute":
                clipped = filled.select(*(clip(F.col(x), F.lit(bounds[of[x]][0]), F.lit(bounds[of[x]][1])).alias(x) for x in names))
                if self.method == "zscore":
                    one = clipped.agg(*(F.avg(x).alias(f"m_{x}") for x in names), *(F.stddev_samp(x).alias(f"s_{x}") for x in names)).first()
                    rest = {of[x]: {"mean": one[f"m_{x}"], "std": one[f"s_{x}"] if (one[f"s_{x}"] or 0.0) > 1e-12 else 1.0} for x in names}
                elif self.method == "quantile":
                    long = clipped.selectExpr(f"stack({len(names)}, {', '.join(f"'{x}', {x}" for x in names)}) as (feature, value)")
                    rest = {of[r.feature]: {"knots": list(r.knots)} for r in knots(long, ["feature"], "value").collect()}
                else:
                    rest = dict.fromkeys(self.columns, {})
                self.stats = {c: {"median": medians[c], "low": bounds[c][0], "high": bounds[c][1], **rest[c]} for c in self.columns}
            else:
                self.stats = {c: {"median": medians[c]} for c in self.columns}
        finally:
            wide.unpersist()
        return self

    def _clipped(self, c: str) -> Column:
        s = self.stats[c]
        x = F.coalesce(F.col(c).cast("double"), F.lit(s["median"])) if self.median_impute else F.col(c).cast("double")
        return clip(x, F.lit(s["low"]), F.lit(s["high"])) if "low" in s else x

    def transform(self, df: DataFrame) -> DataFrame:
        if self.stats is None:
            raise RuntimeError("fit first")
        self._require(df)
        out = df.withColumns({c: self._clipped(c) for c in self.stats}) if self.stats else df
        if self.method == "quantile":
            return normal_scores(out, {c: s["knots"] for c, s in self.stats.items() if "knots" in s}).select(df.columns)
        return out.withColumns({c: (F.col(c) - s["mean"]) / s["std"] for c, s in self.stats.items() if "mean" in s})

    def fit_transform(self, train: DataFrame) -> DataFrame:
        return self.fit(train).transform(train)

    def table(self, spark) -> DataFrame:
        """(feature, median, low, high, mean, std): the statistics; NULLs where the method has none."""
        rows = [(c, *(s.get(k) for k in ("median", "low", "high", "mean", "std"))) for c, s in (self.stats or {}).items()]
        return spark.createDataFrame(rows, "feature string, median double, low double, high double, mean double, std double")


def _array(values, kind: str) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def normal_scores(df: DataFrame, values: dict[str, Sequence[float]]) -> DataFrame:
    """df with the columns of ``values`` as normal scores by their rank among evenly spaced quantiles, and helper columns; of equal knots the mean rank counts.

    It goes in steps, so that each is computed once for a row.
    """
    if not values:
        return df
    col = lambda c, of: F.col(f"__{of}_{c}")
    rows = df.withColumns({f"__at_{c}": F.greatest(_place(F.col(c), _array(k, "double"), len(k)), F.lit(1)) - 1 for c, k in values.items()})
    near = {}
    for c, k in values.items():
        firsts = [i if not i or k[i] != k[i - 1] else -1 for i in range(len(k))]
        for i in range(1, len(k)):
            firsts[i] = firsts[i - 1] if firsts[i] < 0 else firsts[i]
        near |= {f"__a_{c}": F.get(_array(k, "double"), col(c, "at")), f"__b_{c}": F.get(_array(k, "double"), F.least(col(c, "at") + 1, F.lit(len(k) - 1))), f"__first_{c}": F.get(_array(firsts, "int"), col(c, "at"))}
    rows = rows.withColumns(near)
    rank = lambda c: F.when(F.col(c) == col(c, "a"), (col(c, "at") + col(c, "first")) / 2.0).otherwise(col(c, "at") + F.coalesce(F.try_divide(F.col(c) - col(c, "a"), col(c, "b") - col(c, "a")), F.lit(0.0)))
    rows = rows.withColumns({f"__p_{c}": rank(c) / float(len(k) - 1) for c, k in values.items()})

    def score(c: str, k: Sequence[float]) -> Column:
        x, z = F.col(c), normal_quantile(col(c, "p"))
        inner = F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), z))
        return F.when(x.isNull(), None).when(x - EDGE < k[0], -FARTHEST).when(x + EDGE > k[-1], FARTHEST).otherwise(inner)

    return rows.withColumns({c: score(c, k) for c, k in values.items()})


def derived(panel: DataFrame, raw: Sequence[str], companies: DataFrame | None = None, use_ratios: bool = True, use_yoy: bool = True) -> DataFrame:
    """The panel with what ``build_feature_matrix`` adds to it that hangs on no split: sector index, ratios, changes."""
    df = panel
    if companies is not None:
        df = with_sector(lookup(df, companies, "cik", ["sic_code"], [F.col("sic_code")]))
        df = df.withColumn("sector_idx", sector_index(F.col("sector"))).drop("sector")
    df = ratios(df) if use_ratios else df
    return yoy(df, raw) if use_yoy else df


def build_feature_matrix(panel: DataFrame, raw: Sequence[str], cutoffs: tuple[str, str, str] | None = None, companies: DataFrame | None = None, least_coverage: float = 0.5, method: str = "quantile", limits: tuple[float, float] = (0.01, 0.99), use_ratios: bool = True, use_yoy: bool = True, use_flags: bool = True, median_impute: bool = True, ready: bool = False):
    """(matrix, scaler, features, categorical) of a company-year panel.

    ``matrix`` has the panel's rows with ``split`` and the features: raw ones, ratios and changes that cover at least
    ``least_coverage`` of the training split, normalised on it, then flags of what was missing and of first years,
    which aren't. ``companies`` (cik, sic_code) gives the categorical sector index. Without cutoffs all is training.
    A panel that is ``ready`` has gone through ``derived`` with the same settings and been written.
    """
    df = panel if ready else derived(panel, raw, companies, use_ratios, use_yoy)
    categorical = [] if companies is None else ["sector_idx"]
    candidates = [*(c for c in raw if c in panel.columns), *(RATIO_NAMES if use_ratios else ()), *(f"yoy_{c}" for c in raw if use_yoy)]
    df = make_splits(df, *cutoffs) if cutoffs else df.withColumn("split", F.lit("train"))
    if not ready:
        df = cut(df)  # coverage, statistics and the matrix read it
    df = prune_low_coverage(df, df.where("split = 'train'"), candidates, least_coverage)
    kept = [c for c in candidates if c in df.columns]
    flags = [f"{c}_missing" for c in kept] if use_flags else []
    if use_flags:
        df = missing_flags(df, kept)
    if use_yoy:
        flags = [*flags, "is_first_year"]
    scaler = PanelScaler(kept, *limits, method=method, median_impute=median_impute).fit(df.where("split = 'train'"))
    return scaler.transform(df), scaler, kept + flags, categorical


def labelled_rows(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """The rows whose label is known; what is still missing of the features becomes 0."""
    return df.where(F.col(label).isNotNull()).select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in features else F.col(c) for c in df.columns))


def class_balance(df: DataFrame, keys: Sequence[str], label: str = "y", split: str = "split", least: int = 20) -> DataFrame:
    """(keys, split, n_pos, n_neg, pos_weight, skipped) of the rows with a label; a group is skipped where its train part has fewer than ``least`` positives or its test part only one class."""
    y, own = F.col(label), list(keys)
    a = df.where(y.isNotNull()).groupBy(*own, split).agg(F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg"))
    few = F.coalesce(F.max(F.when(F.col(split) == "train", F.col("n_pos"))), F.lit(0)) < least
    one = F.coalesce(F.max(F.when(F.col(split) == "test", F.least("n_pos", "n_neg"))), F.lit(0)) == 0
    skipped = a.groupBy(*own).agg((few | one).cast("int").alias("skipped"))
    return a.join(skipped, own).select(*own, split, "n_pos", "n_neg", (F.col("n_neg") / F.greatest("n_pos", F.lit(1))).alias("pos_weight"), "skipped")
