"""Baseline models and the studies that compare them. Fits of one study share their passes over the rows (``linear``, ``boosting``)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.external import exists
from ..sources.places import cut, discard
from .boosting import Forest, TreeFit, boosted_fits
from .features import PanelScaler, build_feature_matrix, derived
from .linear import Linear, LinearFit, logistic_fits
from .metrics import all_metrics, gate, ranking, stratified

METRICS = "n_rows long, n_pos long, auroc double, auprc double, threshold double, f1 double, brier double, ece double"


def logistic_regression(train: DataFrame, features: Sequence[str], label: str, c: float = 1.0) -> Linear:
    """Standardised features, then an L2 logistic regression with balanced classes. ValueError with fewer than two classes."""
    return _fitted(logistic_fits(train, features, label, [LinearFit(F.lit(True), c)])[0], label)


def boosted_trees(train: DataFrame, features: Sequence[str], label: str, **how) -> Forest:
    """Boosted trees that take missing values as they are; ``how`` as in ``TreeFit``: 500 rounds of depth 6 unless it says otherwise."""
    return _fitted(boosted_fits(train, [TreeFit(label, tuple(features), **how)])[0], label)


def _fitted(model, label: str):
    if model is None:
        raise ValueError(f"{label} has fewer than two classes")
    return model


def scored(model: Linear | Forest, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep, score): the probability of label 1."""
    return df.select(*keep, model.probability().alias("score"))


def _years(panel: DataFrame, folds: int, year: str) -> list[int]:
    years = sorted(r[0] for r in panel.where(F.col(year).isNotNull()).select(year).distinct().collect())
    if len(years) <= folds:
        raise ValueError(f"{len(years)} years are too few for {folds} folds")
    return years[-folds:]


def temporal_grid(train: DataFrame, features: Sequence[str], label: str, cs: Sequence[float] = (), trees: Sequence[dict] = (), folds: int = 3, year: str = "fiscal_year", scale: bool = True) -> DataFrame:
    """(place, model, params, mean_auroc, n_folds, best) of every setting, over folds that validate on each of the last ``folds`` years of the training rows and learn from the years before it.

    ``cs`` are penalties of logistic regressions, ``trees`` settings of ``TreeFit``. Medians, bounds and deviations are
    those of a fold's own training years. All folds and settings of a kind of model are fitted in the same passes. A
    fold with one class in either part is left out, 0 without any; of equal settings the first is the best.
    """
    spark = train.sparkSession
    last = _years(train, folds, year)
    known = train.where(F.col(label).isNotNull()).select(year, label, *features)
    parts = []
    for f, y in enumerate(last):
        rows = known.where(F.col(year) <= y)
        if scale:
            rows = PanelScaler(features).fit(rows.where(F.col(year) < y)).transform(rows)
        parts.append(rows.select(F.lit(f).alias("__fold"), (F.col(year) < y).alias("__learns"), F.col(label).cast("int").alias("y"), *(F.col(c).cast("double").alias(c) for c in features)))
    rows = cut(reduce(DataFrame.union, parts))
    learns = [(F.col("__fold") == f) & F.col("__learns") for f in range(folds)]
    settings = [("lr", {"c": float(c)}) for c in cs] + [("gbt", dict(t)) for t in trees]
    n = len(cs)
    linear = logistic_fits(rows, features, "y", [LinearFit(m, float(c)) for c in cs for m in learns]) if cs else []
    forests = boosted_fits(rows, [TreeFit("y", tuple(features), rows=m, **t) for t in trees for m in learns]) if trees else []
    tests = rows.where(~F.col("__learns"))
    each = []
    for s in range(len(settings)):
        for f in range(folds):
            model = linear[s * folds + f] if s < n else forests[(s - n) * folds + f]
            if model is not None:
                each.append(tests.where(F.col("__fold") == f).select(F.lit(s).alias("place"), F.lit(f).alias("fold"), "y", model.probability().alias("score")))
    found = {}
    if each:
        for r in ranking(reduce(DataFrame.union, each), ["place", "fold"]).where("auroc is not null").select("place", "auroc").collect():
            found.setdefault(r.place, []).append(r.auroc)
    discard(rows)
    means = [sum(sorted(found.get(s, []))) / max(1, len(found.get(s, []))) for s in range(len(settings))]
    best = max(range(len(settings)), key=lambda s: (means[s], -s)) if settings else None
    text = lambda p: ", ".join(f"{k}={v}" for k, v in sorted(p.items()))
    table = [(s, kind, text(params), means[s], len(found.get(s, [])), int(s == best)) for s, (kind, params) in enumerate(settings)]
    return spark.createDataFrame(table, "place int, model string, params string, mean_auroc double, n_folds int, best int")


def evaluable(rows: DataFrame, outcomes: Sequence[str], least: int = 20) -> list[str]:
    """The outcomes whose train part has ``least`` positives and some negative, and whose test part has both classes; one pass for all."""
    split = F.col("split")
    one = rows.agg(*(F.count_if((split == s) & (F.col(o) == v)).alias(f"{o}|{s}{v}") for o in outcomes for s in ("train", "test") for v in (0, 1))).first()
    return [o for o in outcomes if one[f"{o}|train1"] >= least and min(one[f"{o}|train0"], one[f"{o}|test1"], one[f"{o}|test0"]) > 0]


def benchmark_scores(matrix: DataFrame, outcomes: Sequence[str], linear: dict[str, Sequence[str]], trees: dict[str, dict], keep: Sequence[str] = (), least: int = 20) -> DataFrame:
    """(outcome, model, keep, y, score) of the test rows of a matrix (split, outcomes, features, keep).

    ``linear`` names the features of each logistic regression, ``trees`` the settings of each ``TreeFit``, its features
    among them. Outcomes that can't be evaluated are left out. All trees, of every outcome, grow in the same passes.
    """
    spark = matrix.sparkSession
    possible = evaluable(matrix, outcomes, least)
    train, test = matrix.where("split = 'train'"), matrix.where("split = 'test'")
    models = {(o, name): logistic_regression(train, features, o) for name, features in linear.items() for o in possible}
    names = [(o, name) for name in trees for o in possible]
    models |= dict(zip(names, boosted_fits(train, [TreeFit(o, **trees[name]) for o, name in names]))) if names else {}
    each = [test.where(F.col(o).isNotNull()).select(F.lit(o).alias("outcome"), F.lit(name).alias("model"), *keep, F.col(o).cast("int").alias("y"), m.probability().alias("score")) for (o, name), m in models.items()]
    if each:
        return reduce(DataFrame.union, each)
    kept = "".join(f"{c} {t}, " for c, t in matrix.select(*keep).dtypes) if keep else ""
    return spark.createDataFrame([], f"outcome string, model string, {kept}y int, score double")


def benchmark(scores: DataFrame, challenger: str, reference: str, sectors: int = 0, margin: float = 0.01, min_wins: int = 3) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(metrics, sector metrics, gate) of test scores (outcome, model, sector_idx, y, score): each model's metrics, its ranking metrics in each of so many sectors, and whether the challenger wins often enough."""
    metrics = all_metrics(scores, ["outcome", "model"])
    by_sector = None
    if sectors:
        strata = scores.select("outcome", "model").distinct().select("outcome", "model", F.explode(F.sequence(F.lit(0), F.lit(sectors - 1))).alias("sector_idx"))
        by_sector = stratified(scores.where("sector_idx is not null"), strata, ["outcome", "model", "sector_idx"])
    won = gate(metrics.select("model", "outcome", F.col("auroc").alias("value")), challenger, reference, margin, min_wins)
    return metrics, by_sector, won


def committed(spark, path: str) -> bool:
    """Whether a job has ended writing ``path``: its last act is the _SUCCESS mark."""
    return exists(spark, f"{path}/_SUCCESS")


def walk_forward(panel: DataFrame, folds: DataFrame, raw: Sequence[str], outcomes: Sequence[str], out: str | None = None, fingerprint: str = "", trees: dict | None = None, least: int = 20, **matrix) -> DataFrame:
    """(fold, outcome, model, metrics...) of a logistic regression and boosted trees, for each fold (fold, train_end, val_end, test_end).

    Pruning and normalisation are fitted anew on a fold's training part (``matrix`` as in ``build_feature_matrix``), and so
    are the models; the test part only gives the metrics. Ratios and changes hang on no split and are written once. Outcomes with fewer than
    ``least`` positives, or one class in the test part, are left out of a fold. With ``out``, each fold is written to a
    folder of its own below ``fingerprint``, which stands for the settings: a fold whose folder is complete isn't run
    again, one that a job left half-written is.
    """
    spark = panel.sparkSession
    schema = f"outcome string, model string, {METRICS}"
    found, known = spark.createDataFrame([], f"fold int, {schema}"), None
    for f in folds.orderBy("fold").collect():
        path = f"{out.rstrip('/')}/{fingerprint or 'run'}/fold={f.fold}" if out else None
        if path and committed(spark, path):
            one = spark.read.schema(schema).parquet(path)
        else:
            ends = (str(f.train_end), str(f.val_end), str(f.test_end))
            if known is None:
                known = cut(derived(panel, raw, **{k: v for k, v in matrix.items() if k in ("companies", "use_ratios", "use_yoy")}))
            rows, _, features, categorical = build_feature_matrix(known, raw, ends, ready=True, **matrix)
            names = (*features, *categorical)
            rows = cut(rows.select("split", *outcomes, *(F.col(c).cast("double").alias(c) for c in names)))
            scores = cut(benchmark_scores(rows, outcomes, {"lr": names}, {"gbt": {"features": names, **(trees or {})}}, (), least))
            one = all_metrics(scores, ["outcome", "model"]).select(*(c.split()[0] for c in schema.split(", ")))
            if path:
                one.coalesce(1).write.mode("overwrite").parquet(path)
                one = spark.read.schema(schema).parquet(path)
            else:
                one = cut(one)
            discard(rows, scores)
        found = found.union(one.select(F.lit(f.fold).cast("int").alias("fold"), "*"))
    if known is not None:
        discard(known)
    return found


def rank_values(df: DataFrame, order: Column, ranks: Sequence[int], parts: int = 2048) -> list[tuple[float, int]]:
    """For each rank, from 0, the value of ``order``, a number in [0, 1), at that place and how many rows lie below that value.

    Brackets are counted, not sorted: each pass parts every open bracket in ``parts`` and keeps the one that holds the
    rank, so three passes reach a width of 2 ** -33, finer than 32-bit hashes; then the smallest value inside is taken.
    """
    values = df.select(order.alias("v"))
    low, width, below = [0.0] * len(ranks), 1.0, [0] * len(ranks)
    for _ in range(3):
        step = width / parts
        inside = F.array(*(F.struct(F.lit(i).alias("i"), F.floor((F.col("v") - a) / step).alias("b")) for i, a in enumerate(low)))
        counts = values.select(F.explode(inside).alias("s")).where((F.col("s.b") >= 0) & (F.col("s.b") < parts)).groupBy("s.i", "s.b").count().collect()
        table: dict[int, dict[int, int]] = {}
        for i, b, n in counts:
            table.setdefault(i, {})[b] = n
        for i, rank in enumerate(ranks):
            for b in sorted(table.get(i, {})):
                if below[i] + table[i][b] > rank:
                    low[i] += b * step
                    break
                below[i] += table[i][b]
        width = step
    one = values.agg(*(F.min(F.when(F.col("v") >= a, F.col("v"))).alias(f"v{i}") for i, a in enumerate(low))).first()
    return [(one[f"v{i}"], below[i]) for i in range(len(ranks))]


def fraction_members(df: DataFrame, key: Sequence[str], order: Column, fractions: Sequence[float]) -> tuple[list[Column], list[int]]:
    """For each fraction the condition that its rows meet, and how many they are: exactly max(1, int(n · fraction)), the first by ``order``, a hash in [0, 1), and of equal hashes by ``key``, which is unique.

    Nothing is sorted but the rows that share the hash at the cut. Smaller fractions lie in larger ones.
    """
    n = df.count()
    sizes = [min(n, max(1, int(n * f))) for f in fractions]
    if not n:
        return [F.lit(False) for _ in fractions], [0] * len(fractions)
    out = []
    for size, (value, below) in zip(sizes, rank_values(df, order, [s - 1 for s in sizes])):
        ties = df.where(order == value).select(*key).orderBy(*key).limit(size - below).collect()
        last = ties[-1]
        upto = reduce(lambda rest, c: (F.col(c) < F.lit(last[c])) | ((F.col(c) == F.lit(last[c])) & rest), reversed(key), F.lit(True))
        out.append((order < value) | ((order == value) & upto))
    return out, sizes


def train_fraction(train: DataFrame, key: Sequence[str], order: Column, fraction: float) -> DataFrame:
    """Exactly max(1, int(n · fraction)) rows, as ``fraction_members`` says; no rows of an empty table."""
    return train.where(fraction_members(train, key, order, [fraction])[0][0])


def scaling_curve(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: Sequence[str], order: Column, fractions: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """(fraction, n_train, metrics...) of logistic regressions on growing parts of the training rows, all fitted in the same passes; parts of one class are left out."""
    known, asked = train.where(F.col(label).isNotNull()), test.where(F.col(label).isNotNull())
    members, sizes = fraction_members(known, key, order, fractions)
    models = logistic_fits(known, features, label, [LinearFit(m) for m in members])
    each = [asked.select(F.lit(float(f)).alias("fraction"), F.lit(n).alias("n_train"), F.col(label).cast("int").alias("y"), m.probability().alias("score")) for f, n, m in zip(fractions, sizes, models) if m is not None]
    if not each:
        raise ValueError("no part of the training rows has both classes")
    return all_metrics(reduce(DataFrame.union, each), ["fraction", "n_train"])
