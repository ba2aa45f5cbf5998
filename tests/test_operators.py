from datetime import date

import pytest
from pyspark.sql import functions as F

from filingspark.functions.exprs import clip, normalize_key, require_columns, safe_div
from filingspark.operators import market as M
from filingspark.operators import metrics as X
from filingspark.operators import panel as P
from filingspark.operators.features import PanelScaler
from filingspark.plans import splits as S
from filingspark.sources import landed


def test_normalize_key_pads_but_never_cuts(spark):
    df = spark.createDataFrame([(" 7 ",), ("12345678901",), ("nan",), ("",), (None,)], "k string")
    assert [r[0] for r in df.select(normalize_key(F.col("k"), 10, True)).collect()] == ["0000000007", "12345678901", None, None, None]


def test_safe_div_and_clip(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1e-9), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div(F.col("a"), F.col("b"))).collect()] == [0.5, None, None]
    assert [r[0] for r in df.select(clip(F.col("a"), F.lit(2.0), F.lit(3.0))).collect()] == [2.0, 2.0, None]
    with pytest.raises(ValueError):
        require_columns(df, ["z"])


def test_asof_next(spark):
    e = spark.createDataFrame([("A", date(2024, 1, 2)), ("A", date(2024, 1, 9)), ("B", date(2024, 1, 1)), (None, date(2024, 1, 1))], "ticker string, at date")
    p = spark.createDataFrame([("A", date(2024, 1, 2), 1.0), ("A", date(2024, 1, 5), 2.0)], "ticker string, dt date, close double")
    got = {(r.ticker, r.at): r.close for r in M.asof_next(e, p, "ticker", "at", ["close"]).collect()}
    assert got == {("A", date(2024, 1, 2)): 1.0, ("A", date(2024, 1, 9)): None, ("B", date(2024, 1, 1)): None, (None, date(2024, 1, 1)): None}


def test_perfect_scores_and_one_class(spark):
    p = spark.createDataFrame([("x", 0, 0.1), ("x", 0, 0.2), ("x", 1, 0.8), ("x", 1, 0.9), ("z", 1, 0.5)], "outcome string, y int, score double")
    r = {x.outcome: x for x in X.all_metrics(p, ["outcome"]).collect()}
    assert (r["x"].auroc, r["x"].auprc, r["x"].f1, r["x"].threshold) == (1.0, 1.0, 1.0, 0.8)
    assert r["z"].auroc is None and r["z"].f1 is None


def test_auroc_of_reversed_scores(spark):
    p = spark.range(500).select(F.lit("a").alias("m"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.pmod(F.xxhash64("id"), F.lit(50)) / 50).alias("score"))
    one = X.ranking(p, ["m"]).first().auroc
    other = X.ranking(p.repartition(7).withColumn("score", 1 - F.col("score")), ["m"]).first().auroc
    assert one + other == pytest.approx(1.0)


def test_decline_label(spark):
    df = spark.createDataFrame([(-0.3, False), (-0.2, False), (None, False), (0.5, True)], "r double, d boolean")
    assert [x[0] for x in df.select(M.stock_decline(F.col("r"), F.col("d"))).collect()] == [1, 0, None, 1]


def test_window_edges(spark):
    g = spark.createDataFrame([("a", date(2020, 1, 1))], "cik string, period_end date")
    for day, want in ((date(2020, 1, 1), 1), (date(2020, 12, 31), 1), (date(2021, 1, 1), 0)):
        e = spark.createDataFrame([("a", day)], "cik string, event_date date")
        assert P.event_in_window(g, e, "cik", "period_end", 365, "label").first().label == want


def test_yoy_gap_and_negative_base(spark):
    df = spark.createDataFrame([("a", 2015, -2.0), ("a", 2016, 2.0), ("a", 2018, 9.0)], "cik string, fiscal_year int, x double").withColumn("filed_date", F.make_date("fiscal_year", F.lit(2), F.lit(1)))
    assert [(r.is_first_year, r.yoy_x) for r in P.yoy(df, ["x"]).orderBy("fiscal_year").collect()] == [(1, 0.0), (0, 2.0), (1, 0.0)]


def test_scaler_fits_on_train_only(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    s = PanelScaler(["x"], 0.0, 1.0)
    with pytest.raises(RuntimeError):
        s.transform(train)
    rows = [r.x for r in s.fit(train).transform(spark.createDataFrame([(2.0,), (None,), (99.0,)], "x double")).collect()]
    assert rows[0] == rows[1] == 0.0 and rows[2] == pytest.approx(1 / 0.816496580927726)
    with pytest.raises(ValueError):
        PanelScaler(["y"]).fit(train)


def test_splits(spark):
    assert S.fold_table(spark, "2020-12-31", "2021-12-31").count() == 0
    with pytest.raises(ValueError):
        S.temporal_cv(spark.createDataFrame([(2020,), (None,)], "fiscal_year int"), 3)


def test_index_without_rows(spark):
    assert landed.parse_index_lines(spark.createDataFrame([("f", "Form Type   Company"), ("f", "-----")], "file string, value string")).count() == 0


def test_provenance_round_trip(spark, tmp_path):
    landed.write_with_provenance(spark.range(3), f"{tmp_path}/d", {"built": "now"})
    df, p = landed.read_with_provenance(spark, f"{tmp_path}/d")
    assert df.count() == 3 and p == {"built": "now"}
    spark.range(1).write.parquet(f"{tmp_path}/e")
    assert landed.read_with_provenance(spark, f"{tmp_path}/e")[1] == {}
