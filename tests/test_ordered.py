"""Ordered look-ups, also where one key holds most rows, the bootstrap, streams and sourcing."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from filingspark.operators import bootstrap as T
from filingspark.operators import joins as J
from filingspark.operators import labels as B
from filingspark.operators import market as M
from filingspark.operators import metrics as X
from filingspark.operators import panel as P
from filingspark.sources import external, landed
from filingspark.streaming.streams import LatestState, latest

DAY = date(2000, 1, 1)


def days(rng, n, keys="aaaaaaab"):
    return [(rng.choice(keys), DAY + timedelta(rng.randrange(400))) for _ in range(n)]


@pytest.mark.parametrize("hot", [5, 10**9])
def test_hot_keys_give_the_same_rows(spark, hot):
    rng = random.Random(1)
    grid, events = [*days(rng, 300), ("c", DAY), (None, DAY), ("a", None)], [*days(rng, 60), ("d", DAY), (None, DAY), ("a", None)]
    g = spark.createDataFrame(grid, "cik string, period_end date")
    e = spark.createDataFrame(events, "cik string, event_date date")
    near = lambda k, d: int(any(k == x and k is not None and d is not None and t is not None and d <= t <= d + timedelta(5) for x, t in events))
    got = sorted((str(r.cik), str(r.period_end), r.y) for r in P.event_in_window(g, e, "cik", "period_end", 5, "y", hot).collect())
    assert got == sorted((str(k), str(d), near(k, d)) for k, d in grid)

    spans = [(k, t, None if t is None else t + timedelta(rng.randrange(9))) for k, t in events]
    s = spark.createDataFrame(spans, "cik string, start_date date, end_date date")
    meets = lambda k, d: int(any(k == x and k is not None and d is not None and a is not None and a <= d + timedelta(5) and b >= d for x, a, b in spans))
    got = sorted((str(r.cik), str(r.period_end), r.y) for r in P.interval_overlap(g, s, "cik", "period_end", 5, "y", hot).collect())
    assert got == sorted((str(k), str(d), meets(k, d)) for k, d in grid)

    series = sorted({(k, t) for k, t in events if k and t})
    p = spark.createDataFrame([(k, t, float(i)) for i, (k, t) in enumerate(series)], "cik string, dt date, close double")
    after = lambda k, d: min((t for x, t in series if x == k and d is not None and t >= d), default=None)
    got = sorted((str(r.cik), str(r.period_end), str(r.ref_date), str(r.close)) for r in M.asof_next(g, p, "cik", "period_end", ["close"], hot).collect())
    want = [(str(k), str(d), str(t), str(float(series.index((k, t))) if t else None)) for k, d in grid for t in [after(k, d)]]
    assert got == sorted(want)


def test_one_key_of_many_rows_spreads_over_tasks(spark):
    from filingspark.operators.ordered import ranged

    rows = spark.range(60_000).select(F.lit("a").alias("k"), F.date_add(F.lit(DAY), (F.col("id") % 3000).cast("int")).alias("at"))
    placed, split = ranged(rows, "k", "at", hot=1000)
    sizes = [r["count"] for r in placed.groupBy("__range").count().collect()]
    assert split and len(sizes) > 200 and max(sizes) < 60_000 / 100


def test_many_events_of_one_key_end_in_linear_time(spark):
    n = 100_000
    day = lambda c: F.date_add(F.lit(DAY), (c % 20_000).cast("int"))
    g = spark.range(n).select(F.lit("a").alias("cik"), day(F.col("id") * 7).alias("period_end"))
    e = spark.range(n).select(F.lit("a").alias("cik"), day(F.col("id") * 2).alias("event_date"))
    assert P.event_in_window(g, e, "cik", "period_end", 1, "y").agg(F.sum("y"), F.count("*")).first()[1] == n


def test_poisson_cells(spark):
    for k in (1, 7, 400):
        low, cdf = T.poisson_range(k)[0], T.poisson_cdf(k)
        mass = [b - a for a, b in zip([0.0, *cdf], cdf)]
        assert cdf[-1] == pytest.approx(1, abs=1e-9)
        assert sum((low + i) * m for i, m in enumerate(mass)) == pytest.approx(k, rel=1e-9)
        assert sum((low + i - k) ** 2 * m for i, m in enumerate(mass)) == pytest.approx(k, rel=1e-6)
    cells = spark.range(200).select(F.col("id").cast("string").alias("c"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(250.0).alias("k"))
    w = {r.k: r for r in T.drawn(cells.withColumn("kk", F.col("k")), [F.col("c")], 100, 1).groupBy(F.col("kk").alias("k")).agg((F.sum("w") / 10_000).alias("mean"), (F.sum(F.col("w") * F.col("w")) / 10_000).alias("square")).collect()}
    for k in (3.0, 250.0):
        assert w[k].mean == pytest.approx(k, rel=0.05) and w[k].square - w[k].mean ** 2 == pytest.approx(k, rel=0.1)


def test_bootstrap_interval_covers_and_costs_by_cells(spark):
    p = spark.range(4000).select(F.lit("m").alias("model"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("score"), F.col("id"))
    p = p.withColumn("y", (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(100)) / 100 < F.col("score")).cast("int"))
    b = T.bootstrap_auroc(p, ["model"], 200).first()
    r = X.ranking(p, ["model"]).first()
    q1, q2 = r.auroc / (2 - r.auroc), 2 * r.auroc**2 / (1 + r.auroc)
    n, m = r.n_pos, r.n_rows - r.n_pos
    se = math.sqrt((r.auroc * (1 - r.auroc) + (n - 1) * (q1 - r.auroc**2) + (m - 1) * (q2 - r.auroc**2)) / (n * m))
    assert b.low < b.estimate < b.high and b.high - b.low == pytest.approx(2 * 1.96 * se, rel=0.25)
    again = p.union(p).union(p)  # three times the rows, the same cells
    rows = lambda df: T.drawn(df.groupBy("model", "score", "y").agg(F.count("*").cast("double").alias("k")), [F.col("model"), T.scaled(F.col("score")), F.col("y").cast("string")], 20, 42).count()
    assert rows(again) <= 200 * 20
    assert T.bootstrap_auroc(again, ["model"], 200).first().high - b.estimate < b.high - b.estimate


def test_latest_state_is_bounded_replayed_and_late(spark, tmp_path):
    schema = "k long, at int, v string"
    kind = spark.createDataFrame([], schema).schema
    state = LatestState(spark, f"{tmp_path}/s", kind, "k", ["at"], 4)
    assert state.read().count() == 0
    batch = lambda rows: spark.createDataFrame(rows, schema)
    state.upsert(batch([(i, 1, "a") for i in range(50)]), 0)
    state.upsert(batch([(1, 5, "new"), (2, 0, "late"), (60, 1, "a")]), 1)
    state.upsert(batch([(1, 9, "replayed")]), 1)  # batch 1 is there already
    for n in range(2, 8):
        state.upsert(batch([(3, n, f"v{n}")]), n)
    got = {r.k: (r["at"], r.v) for r in state.read().collect()}
    assert len(got) == 51 == state.read().count()
    assert (got[1], got[2], got[3], got[60]) == ((5, "new"), (1, "a"), (7, "v7"), (1, "a"))
    kept = [p for p in (tmp_path / "s" / "data").glob("version=*/bucket=*")]
    assert len(kept) <= 6  # four buckets, and what the commit before still names
    assert len(list((tmp_path / "s" / "commits").iterdir())) == 2


def test_latest_over_three_runs(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, at int, v string").schema
    out = None
    for run, rows in enumerate(([(1, 3, "x"), (2, 1, "x")], [(1, 2, "late"), (2, 4, "y")], [(2, 3, "late"), (3, 1, "z")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = latest(spark, f"{tmp_path}/in", schema, "k", ["at"], f"{tmp_path}/state", f"{tmp_path}/check", buckets=4)
        assert out.count() == (2, 2, 3)[run]
    assert sorted(map(tuple, out.collect())) == [(1, 3, "x"), (2, 4, "y"), (3, 1, "z")]


def test_index_quarters_prune_skip_and_fail(spark, tmp_path):
    line = "10-K        " + "Some Company".ljust(62) + "123         2001-02-03  edgar/data/1.txt"
    for y, q in ((2000, 1), (2001, 1), (2001, 3)):
        rows = [("Form Type CIK",), (line.replace("2001", str(y)),)]
        spark.createDataFrame(rows, "value string").coalesce(1).write.text(f"{tmp_path}/i/year={y}/quarter={q}")
    df = landed.read_index_quarters(spark, f"{tmp_path}/i", 2001, 2002)
    assert sorted((r.year, r.quarter, r.cik) for r in df.collect()) == [(2001, 1, "0000000123"), (2001, 3, "0000000123")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(FileNotFoundError):
        landed.read_index_quarters(spark, f"{tmp_path}/i", 1990, 1991)


def test_primary_listing_comes_first(spark):
    c = spark.createDataFrame([("1", "A", "OTC"), ("1", "Z", "NYSE"), ("2", "B", None), ("2", "C", "OTC")], "cik string, ticker string, exchange string")
    assert sorted((r.cik, r.ticker) for r in P.primary_listing(c).collect()) == [("1", "Z"), ("2", "B")]


def test_events_by_phrase_and_form(spark):
    f = spark.createDataFrame([("a", "7", "8-K", "2001-01-02", "see ITEM 1.03 here"), ("b", "7", "10-K", "2001-01-03", "item 1.03"), ("c", "8", "8-K ", "bad", "item 1.03"), ("d", "9", "8-K", "2001-01-05", "bankruptcy or receivership"), ("e", None, "8-K", "2001-01-05", "item 1.03"), ("f", "7", "8-K", "2001-01-02", "item 1.03"), ("g", "7", None, "2001-01-09", "item 1.03")], "adsh string, cik string, form string, file_date string, text string")
    u = spark.createDataFrame([("0000000007",)], "cik string")
    assert [(r.cik, str(r.event_date)) for r in B.sourced_events(f, B.BANKRUPTCY_RULES, u).collect()] == [("0000000007", "2001-01-02")]


def test_match_report_and_samples(spark, tmp_path):
    df = spark.createDataFrame([(1, "p"), (2, "f"), (3, None), (4, None)], "i int, matched string")
    r = J.match_report(df, "p", "f", F.col("i") == 4).first()
    assert (r.n, r.n_primary, r.n_fallback, r.n_unmatched, r.recovered, r.n_unmatched_listed) == (4, 1, 1, 2, 0.3333, 1)
    external.write_csv_sample(df, f"{tmp_path}/s")
    assert sorted(spark.read.csv(f"{tmp_path}/s", header=True).columns) == ["i", "matched"]
    with pytest.raises(FileNotFoundError):
        external.load_dataset(spark, str(tmp_path), "none")


def test_the_published_table_needs_no_shuffle_of_bucketed_tables(spark):
    """Every join and window of the chain is by company: with all tables in buckets by it, no row moves."""
    from filingspark.functions.concepts import FEATURES
    from filingspark.operators.publish import publish
    from filingspark.sources.places import bucketed, co_partitioned

    end = "make_date(2000 + cast(id % 5 as int), 12, 31)"
    base = spark.range(200).selectExpr("lpad(cast(id div 5 as string), 10, '0') as cik", "2000 + cast(id % 5 as int) as fiscal_year", f"{end} as period_end")
    panel = base.select("*", F.date_add("period_end", 60).alias("filed_date"), *(F.lit(1.0).alias(f) for f in FEATURES))
    labels = base.select("cik", "period_end", *(F.lit(1).alias(o) for o in B.OUTCOMES), F.lit("none").alias("earnings_restate_source"))
    market = base.select("cik", "period_end", F.lit(0.1).alias("fwd_ret_252d"), F.lit(0.1).alias("mkt_adj_252d"), F.lit(False).alias("delisted"))
    companies = base.select("cik", F.lit("t").alias("ticker"), F.lit("s").alias("sector"), F.lit("1").alias("sic_code")).distinct()
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cuts = ("2001-12-31", "2002-12-31", "2004-12-31")
        plain = publish(panel, labels, market, companies, cuts)
        shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert shuffles(plain) >= 5
        want = sorted(map(str, plain.collect()))
        co_partitioned(spark)
        near = publish(*(bucketed(t, "cik", 4) for t in (panel, labels, market, companies)), cuts)
        assert shuffles(near) == 0
        assert sorted(map(str, near.collect())) == want and len(want) == 200
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_missing_column_is_null(spark):
    from filingspark.functions.exprs import col_or_null

    df = spark.createDataFrame([(1.5,)], "a double")
    assert tuple(df.select(col_or_null(df, "a"), col_or_null(df, "b")).first()) == (1.5, None)
