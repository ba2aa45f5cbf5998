"""Fits against brute-force versions, studies on made data with a known signal."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingspark.operators import boosting as B
from filingspark.operators import linear as L
from filingspark.operators import models as M
from filingspark.plans import splits as S
from filingspark.sources.external import exists

NAMES = tuple(f"f{i}" for i in range(5))


def made(n=1200, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, len(NAMES))), 3)
    y = (x[:, 0] - x[:, 1] + np.where(x[:, 2] > 0, x[:, 3], -x[:, 3]) + rng.normal(size=n) * 0.5 > 0).astype(int)
    x[rng.random(x.shape) < 0.1] = np.nan
    return x, y


@pytest.fixture(scope="module")
def rows(spark):
    x, y = made()
    data = [(i, 2000 + i % 8, *(None if v != v else float(v) for v in r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    schema = "id long, fiscal_year int, " + ", ".join(f"{c} double" for c in NAMES) + ", y int"
    return spark.createDataFrame(data, schema).repartition(5).persist()


def area(y, score):
    order = np.argsort(score, kind="stable")
    _, at, n = np.unique(score[order], return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    t = y[order]
    return (rank[t == 1].sum() - t.sum() * (t.sum() + 1) / 2) / (t.sum() * (t == 0).sum())


def newton(x, y, c):
    """The penalised likelihood's optimum, on arrays."""
    x = np.nan_to_num(x)
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(len(x))]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (y == 0).sum()))
    b, ridge = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], 1 / c), 0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z.T * (w * p * (1 - p))) @ z + np.diag(ridge), z.T @ (w * (p - y)) + ridge * b)
    return 1 / (1 + np.exp(-z @ b))


def test_all_regressions_in_one_pass_equal_brute_force(rows):
    fits = [L.LinearFit(F.lit(True), 0.01), L.LinearFit(F.lit(True), 1.0), L.LinearFit(F.col("id") < 500, 1.0), L.LinearFit(F.col("y") == 1)]
    models = L.logistic_fits(rows, NAMES, "y", fits)
    assert models[3] is None
    x, y = made()
    for model, (m, c) in zip(models, ((slice(None), 0.01), (slice(None), 1.0), (slice(500), 1.0))):
        got = {r.id: r.s for r in rows.select("id", model.probability().alias("s")).collect()}
        want = newton(x[m], y[m], c)
        assert np.abs(np.array([got[i] for i in range(len(want))]) - want).max() < 1e-6


def grown(x, y, fit, edges, row):
    """A booster that looks at every row of every node, split and side: (margins, trees)."""
    bins = B.binned(x, edges)
    pos = 1.0 if fit.balanced else (y == 0).sum() / y.sum()
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (y == 0).sum())) if fit.balanced else np.where(y == 1, pos, 1.0)
    margin = np.full(len(y), np.log(weight[y == 1].sum() / weight[y == 0].sum()))
    one = 1 << 24
    for number in range(fit.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint(weight * (p - y) * one), np.rint(weight * p * (1 - p) * one)
        used = np.flatnonzero(B.sampled(row, fit.subsample, fit.seed, number))
        columns = B.columns_of(fit, number)

        def grow(own, every, level):
            value = lambda i: (g[i].sum() / one) ** 2 / (h[i].sum() / one + fit.l2)
            best = None
            if level < fit.depth:
                for missing in (True, False):
                    for c in columns:
                        for b in range(64):
                            left = np.where(bins[own, c] == B.MISSING, missing, bins[own, c] <= b)
                            a, z = own[left], own[~left]
                            if min(len(a), len(z)) < max(1, fit.min_rows) or min(h[a].sum(), h[z].sum()) < fit.min_weight * one:
                                continue
                            gain = value(a) + value(z) - value(own)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                                best = (gain, c, b, missing, a, z)
            if best is None:
                margin[every] += -fit.rate * (g[own].sum() / one) / (h[own].sum() / one + fit.l2)
                return
            _, c, b, missing, a, z = best
            left = np.where(bins[every, c] == B.MISSING, missing, bins[every, c] <= b)
            grow(a, every[left], level + 1)
            grow(z, every[~left], level + 1)

        grow(used, np.arange(len(y)), 0)
    return margin


@pytest.mark.parametrize("how", [{}, {"balanced": True, "l2": 0.0, "min_weight": 1e-3, "min_rows": 20, "subsample": 1.0, "colsample": 1.0}])
def test_trees_equal_a_booster_that_sees_every_row(spark, how):
    x, y = made(300, 1)
    data = [(i, *(None if v != v else float(v) for v in r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id long, " + ", ".join(f"{c} double" for c in NAMES) + ", y int")
    fit = B.TreeFit("y", NAMES, rounds=4, depth=3, rate=0.3, **how)
    forest = B.boosted_fits(df, [fit, B.TreeFit("y", NAMES[:2], rounds=2, depth=2)], refresh=3, key=["id"])[0]
    assert len(forest.trees) == 4
    got = forest.margin_of(B.binned(x, forest.edges))
    row = np.array([r.h for r in df.orderBy("id").select(F.xxhash64("id").alias("h")).collect()])
    want = grown(x, y, fit, forest.edges, row)
    assert np.abs(got - want).max() < 1e-6


def test_trees_are_the_same_on_any_partitions(rows):
    how = dict(rounds=3, depth=3)
    a, b = (M.boosted_trees(rows.repartition(n), NAMES, "y", **how) for n in (1, 7))
    assert all((s == t).all() for x, z in zip(a.trees, b.trees) for s, t in zip(x, z))


def test_defaults_are_of_full_size():
    fit = B.TreeFit("y", NAMES)
    assert (fit.rounds, fit.depth, fit.rate, fit.subsample, fit.colsample) == (500, 6, 0.05, 0.8, 0.8)


def test_trees_find_the_interaction_and_use_missing_values(spark, rows):
    train, test = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    model = M.boosted_trees(train, NAMES, "y", rounds=15, depth=4, rate=0.3)
    got = M.scored(model, test, ["y"]).toPandas()
    linear = M.scored(M.logistic_regression(train, NAMES, "y"), test, ["y"]).toPandas()
    assert area(got.y.to_numpy(), got.score.to_numpy()) > 0.85
    assert area(linear.y.to_numpy(), linear.score.to_numpy()) > 0.75
    told = spark.createDataFrame([(None if i % 2 else float(i % 5), i % 2) for i in range(200)], "f double, y int")
    seen = M.scored(M.boosted_trees(told, ["f"], "y", rounds=3, depth=2, rate=0.5, colsample=1.0), told, ["y"]).toPandas()
    assert area(seen.y.to_numpy(), seen.score.to_numpy()) == 1.0
    with pytest.raises(ValueError):
        M.boosted_trees(told.where("y = 1"), ["f"], "y")


def test_grid_validates_on_training_years_and_names_the_best(rows):
    found = M.temporal_grid(rows, NAMES, "y", (1e-6, 1.0), [{"rounds": 6, "depth": 3, "rate": 0.4}], folds=2).orderBy("place").collect()
    assert [r.n_folds for r in found] == [2, 2, 2] and sum(r.best for r in found) == 1
    assert max(found, key=lambda r: r.mean_auroc).best == 1
    assert found[2].mean_auroc > 0.75 > 0.5 < found[1].mean_auroc
    # by hand: learn before a year, test on it
    areas = []
    for year in (2006, 2007):
        from filingspark.operators.features import PanelScaler

        scaler = PanelScaler(NAMES).fit(rows.where(F.col("fiscal_year") < year))
        model = M.logistic_regression(scaler.transform(rows.where(F.col("fiscal_year") < year)), NAMES, "y")
        s = M.scored(model, scaler.transform(rows.where(F.col("fiscal_year") == year)), ["y"]).toPandas()
        areas.append(area(s.y.to_numpy(), s.score.to_numpy()))
    assert found[1].mean_auroc == pytest.approx(np.mean(areas), abs=1e-9)
    with pytest.raises(ValueError):
        M.temporal_grid(rows.where("fiscal_year < 2002"), NAMES, "y", (1.0,), folds=2)


def test_benchmark_has_metrics_sectors_and_gate(rows):
    m = rows.withColumns({"split": F.when(F.col("fiscal_year") < 2006, "train").otherwise("test"), "sector_idx": (F.col("id") % 3).cast("int"), "rare": F.when(F.col("id") < 5, 1).otherwise(0)})
    scores = M.benchmark_scores(m, ["y", "rare"], {"lr": NAMES}, {"gbt": {"features": NAMES, "rounds": 8, "depth": 3, "rate": 0.4}}, ["sector_idx"])
    metrics, sectors, gate = M.benchmark(scores, "gbt", "lr", 4, 0.0, 1)
    got = {(r.outcome, r.model): r.auroc for r in metrics.collect()}
    assert set(got) == {("y", "lr"), ("y", "gbt")} and min(got.values()) > 0.7  # rare has too few positives
    assert sectors.count() == 8 and sectors.where("sector_idx = 3 and n_rows = 0 and auroc is null").count() == 2
    g = gate.first()
    assert g.outcomes == 1 and bool(g.passed) == (got["y", "gbt"] >= got["y", "lr"])


def panel_of(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(900):
        year, a, b = 1995 + i % 6, *rng.normal(10, 3, 2)
        data.append((f"{i // 6:010d}", year, date(year, 12, 31), date(year + 1, 3, 1), float(a), float(b), int(a - b + rng.normal() > 0)))
    return spark.createDataFrame(data, "cik string, fiscal_year int, period_end date, filed_date date, total_assets double, net_income double, y int")


def test_walk_forward_runs_a_torn_fold_again_and_skips_a_whole_one(spark, tmp_path, monkeypatch):
    p, folds = panel_of(spark), S.fold_table(spark, "1996-12-31", "1999-12-31")
    run = lambda: M.walk_forward(p, folds, ["total_assets", "net_income"], ["y"], str(tmp_path), "v", {"rounds": 4, "depth": 2, "rate": 0.5}, method="zscore")
    first = sorted(map(tuple, run().collect()))
    assert {r[0] for r in first} == {0, 1} and min(r[5] for r in first) > 0.6
    (tmp_path / "v" / "fold=1" / "_SUCCESS").unlink()  # a job that died while it wrote
    for f in (tmp_path / "v" / "fold=1").glob("part-*"):
        f.unlink()
    calls = []
    real = M.build_feature_matrix
    monkeypatch.setattr(M, "build_feature_matrix", lambda *a, **k: calls.append(1) or real(*a, **k))
    for _ in range(2):
        again = sorted(map(tuple, run().collect()))
        assert len(calls) == 1 and [r[:3] for r in again] == [r[:3] for r in first]
        assert all(a == pytest.approx(b, abs=1e-6) for r, s in zip(again, first) for a, b in zip(r[3:], s[3:]))
    assert exists(spark, f"{tmp_path}/v/fold=1/_SUCCESS")


def test_train_fraction_is_exact_nested_and_sorts_nothing(spark, rows):
    order = F.pmod(F.xxhash64("id"), F.lit(40)) / 64.0  # many rows share a hash
    want = [r.id for r in rows.orderBy(order, "id").select("id").collect()]
    for f in (0.0, 0.1, 0.333, 0.75, 1.0):
        part = M.train_fraction(rows, ["id"], order, f)
        assert sorted(r.id for r in part.select("id").collect()) == sorted(want[: max(1, int(len(want) * f))])
    assert "Sort" not in M.train_fraction(rows, ["id"], order, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert M.train_fraction(rows.where("false"), ["id"], order, 0.5).count() == 0


def test_scaling_curve(rows):
    train, test = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    got = {r.fraction: r for r in M.scaling_curve(train, test, NAMES, "y", ["id"], F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)).collect()}
    n = train.count()
    assert {f: r.n_train for f, r in got.items()} == {f: max(1, int(n * f)) for f in (0.1, 0.25, 0.5, 0.75, 1.0)}
    assert got[1.0].auroc > 0.75


def test_of_two_children_only_the_smaller_is_summed(rows, monkeypatch):
    seen = []
    real = B._level_sums

    def spy(state, arrays, asked, recent, growing, place, weights, fits, number, level, *rest):
        sums = real(state, arrays, asked, recent, growing, place, weights, fits, number, level, *rest)
        seen.append((level, len(asked[0][0]), int(sums[0][2][:, 0].sum())))
        return sums

    monkeypatch.setattr(B, "_level_sums", spy)
    M.boosted_trees(rows, NAMES, "y", rounds=2, depth=3, subsample=1.0)
    n = rows.count()
    assert {level for level, _, _ in seen} == {0, 1, 2} and all(nodes == max(1, 2 ** (level - 1)) and (level == 0 or k <= n / 2) for level, nodes, k in seen)


def test_walk_forward_derives_ratios_and_changes_once(spark, monkeypatch):
    calls = []
    real = M.derived
    monkeypatch.setattr(M, "derived", lambda *a, **k: calls.append(1) or real(*a, **k))
    monkeypatch.setattr(M, "benchmark_scores", lambda *a: spark.createDataFrame([], "outcome string, model string, y int, score double"))
    assert M.walk_forward(panel_of(spark), S.fold_table(spark, "1996-12-31", "1999-12-31"), ["total_assets", "net_income"], ["y"], method="zscore").count() == 0
    assert len(calls) == 1
