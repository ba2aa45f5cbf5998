import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingspark.functions.normal import normal_quantile
from filingspark.operators import market as M, ordered, quantiles as Q
from filingspark.operators.features import PanelScaler, build_feature_matrix, class_balance, labelled_rows
from filingspark.operators.metrics import ranking
from filingspark.operators.quantiles import knots, quantiles

R = random.Random(3)
GROUPS = {"one": [5.0], "two": [1.0, 2.0], "ties": [3.0] * 50 + [4.0] * 3, "few": [R.gauss(0, 1) for _ in range(79)], "many": [round(R.gauss(0, 1), 2) for _ in range(5000)]}


@pytest.fixture(scope="module")
def values(spark):
    rows = [(k, v) for k, vs in GROUPS.items() for v in vs] + [("few", None), ("none", None)]
    R.shuffle(rows)
    return spark.createDataFrame(rows, "k string, x double").repartition(5).cache()


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_quantiles_are_exact(values, accuracy):
    probs = [0.0, 0.01, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {r.k: r for r in quantiles(values, ["k"], "x", probs, accuracy).collect()}
    assert set(got) == set(GROUPS)
    for k, vs in GROUPS.items():
        assert got[k].n == len(vs) and got[k].q == pytest.approx(list(np.quantile(vs, probs)))
    whole = quantiles(values, [], "x", [0.5], accuracy).first()
    assert whole.q[0] == pytest.approx(np.median([v for vs in GROUPS.values() for v in vs]))
    assert quantiles(values.limit(0), [], "x", [0.5]).count() == quantiles(values.limit(0), ["k"], "x", [0.5]).count() == 0


def test_knots_are_exact(values):
    got = {r.k: r.knots for r in knots(values, ["k"], "x", 200, 15).collect()}
    for k, vs in GROUPS.items():
        assert got[k] == pytest.approx(list(np.quantile(vs, np.linspace(0, 1, max(2, min(200, len(vs)))))))


@pytest.mark.parametrize("many", [0, 10**6])
def test_columns_have_their_quantiles_in_common_passes(spark, many, monkeypatch):
    rng = np.random.default_rng(5)
    n = 20_000
    cols = {"normal": rng.normal(size=n), "ties": rng.integers(0, 7, n).astype("f8"), "skew": np.exp(3 * rng.normal(size=n)), "few": np.full(n, np.nan), "none": np.full(n, np.nan), "same": np.full(n, 2.5)}
    cols["few"][[3, 700, 9000]] = 1.0, 5.0, -2.0
    rows = [tuple(None if np.isnan(c[i]) else float(c[i]) for c in cols.values()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(6).cache()
    probs = [0.0, 0.01, 0.5, 0.99, 1.0]
    want = {c: list(np.quantile(v[~np.isnan(v)], probs)) for c, v in cols.items() if c != "none"}
    found = Q.column_quantiles(df, list(cols), probs, many=many)
    assert set(found) == set(want) and all(found[c] == pytest.approx(want[c]) for c in want)
    assert Q.column_quantiles(df.where("false"), list(cols), probs) == {} == Q.column_quantiles(df, [], probs)
    monkeypatch.setattr(Q, "_apart", lambda brackets: ([9.0], [9.5]))  # no rank is there: exact all the same
    found = Q.column_quantiles(df.select("normal", "few"), ["normal", "few"], probs, many=many)
    assert all(found[c] == pytest.approx(want[c]) for c in ("normal", "few"))


def test_a_sketch_that_comes_out_another_way_each_time_changes_nothing(spark, values, monkeypatch):
    """On a cluster the parts of a sketch arrive in any order: if it's computed twice, its two results differ."""
    ends = F.udf(lambda lo, hi: sorted(random.SystemRandom().uniform(lo, hi) for _ in range(9)), "array<double>")
    monkeypatch.setattr(F, "percentile_approx", lambda c, probs, accuracy: ends(F.min(c), F.max(c)))
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.k: r.knots for r in knots(values, ["k"], "x", 200, 9).collect()}
        scores = values.where("k = 'many'").select("k", F.col("x").alias("score"), (F.col("x") > 0.5).cast("int").alias("y"))
        area = ranking(scores, ["k"]).first()
        days = spark.range(400).select(F.lit("a").alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"), (F.col("id") % 5 == 0).cast("int").alias("kind"))
        found = ordered.next_row(days.withColumn("row", F.when(F.col("kind") == 1, F.col("d"))), "k", "d", "kind", "row", hot=10).select(F.datediff("__next", "d").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
    for k, vs in GROUPS.items():
        m = max(2, min(200, len(vs)))
        assert got[k] == pytest.approx(list(np.quantile(vs, np.linspace(0, 1, m))))
    assert (area.n_rows, area.auroc) == (5000, 1.0)
    assert sorted(r.n or 0 for r in found) == sorted([1, 2, 3, 4] * 79 + [0] * 4)


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [1e-9, 1e-4, 0.02, 0.3, 0.5, 0.9, 0.9999]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect()
    assert all(r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-9) if r.p in ps else r.z is None for r in got)


def test_describe_histogram_boxplot(values):
    d = M.describe(values.where("k = 'many'"), "x").first()
    assert d.p25 == pytest.approx(np.quantile(GROUPS["many"], 0.25)) and d.n == 5000
    assert M.describe(values.limit(0), "x").first().n == 0
    assert sum(r.n for r in M.histogram(values, "x", 7).collect()) == sum(map(len, GROUPS.values()))
    assert M.histogram(values.where("k = 'one'"), "x", 7).first().n == 1 and M.histogram(values.limit(0), "x", 7).count() == 0
    b = {r.k: r for r in M.boxplot(values, "k", "x").collect()}
    assert (b["ties"].q1, b["ties"].high) == (3.0, 3.0) and "none" not in b


def test_quantile_scores_of_ties_and_ends(spark):
    x = [1.0, 2.0, 2.0, 2.0, 3.0, 4.0, 5.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    s = PanelScaler(["x"], 0.0, 1.0, "quantile").fit(df)
    got = {r.v: r.x for r in s.transform(df.select("x", F.col("x").alias("v"))).collect()}
    assert got[1.0] == -got[5.0] == pytest.approx(-5.199337582605575)
    assert got[2.0] == pytest.approx(-0.43072729929545756) and got[3.0] == pytest.approx(0.43072729929545756)
    assert s.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        PanelScaler(["x"], method="other")
    with pytest.raises(ValueError):
        s.transform(df.select(F.col("x").alias("y")))


def test_feature_matrix_prunes_on_train_and_flags(spark):
    rows = [(f"{c}", y, float(y - 2014 + c), None if y < 2017 else 1.0) for c in range(3) for y in range(2015, 2019)]
    p = spark.createDataFrame(rows, "cik string, fiscal_year int, total_assets double, net_income double").withColumns({"period_end": F.make_date("fiscal_year", F.lit(12), F.lit(31)), "filed_date": F.make_date(F.col("fiscal_year") + 1, F.lit(2), F.lit(15))})
    companies = spark.createDataFrame([("0", "2834"), ("1", None)], "cik string, sic_code string")
    df, scaler, features, categorical = build_feature_matrix(p, ["total_assets", "net_income"], ("2016-12-31", "2017-12-31", "2018-12-31"), companies, method="zscore")
    assert "net_income" not in df.columns and "total_assets" in features and categorical == ["sector_idx"]
    assert {"total_assets_missing", "is_first_year", "yoy_total_assets"} <= set(features) and set(features) <= set(df.columns)
    assert {r.split: r.n for r in df.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 6, "val": 3, "test": 3}
    assert df.where("split = 'train'").agg(F.avg("total_assets")).first()[0] == pytest.approx(0)
    alone = build_feature_matrix(p, ["total_assets"], None, None, use_ratios=False, use_yoy=False, use_flags=False)
    assert alone[2] == ["total_assets"] and alone[3] == [] and alone[0].select("split").distinct().collect()[0][0] == "train"


def test_labelled_rows_and_balance(spark):
    df = spark.createDataFrame([(1, None, "train"), (None, 2.0, "train"), (0, 3.0, "test")], "y int, x double, split string")
    assert [(r.y, r.x) for r in labelled_rows(df, "y", ["x"]).orderBy("y").collect()] == [(0, 3.0), (1, 0.0)]
    b = {r.split: r for r in class_balance(df.withColumn("o", F.lit("z")), ["o"], least=1).collect()}
    assert b["train"].pos_weight == 0 and b["train"].skipped == b["test"].skipped == 1
