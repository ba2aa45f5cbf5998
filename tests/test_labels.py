from datetime import date

import pytest
from pyspark.sql import functions as F

from filingspark.operators import facts as A
from filingspark.operators import joins as J
from filingspark.operators import labels as B
from filingspark.operators import market as M
from filingspark.operators import metrics as X
from filingspark.operators import panel as P
from filingspark.operators import publish as U
from filingspark.operators import reports as R
from filingspark.operators.bootstrap import bootstrap_auroc, poisson_cdf
from filingspark.sources import external, landed


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([("0000000001", date(2018, 12, 31)), ("0000000002", date(2018, 12, 31))], "cik string, period_end date")


def got(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("cik").collect()]


def test_restatement_sources(spark, grid):
    filings = spark.createDataFrame([("1", " 10-K/A ", date(2019, 6, 1)), ("2", "NT 10-K/A", date(2020, 6, 1))], "cik string, form_type string, date_filed date")
    registry = spark.createDataFrame([("0000000001", date(2018, 12, 31)), ("0000000001", date(2018, 12, 31)), (None, None)], "cik string, period_end date")
    name = ("earnings_restate", "earnings_restate_source")
    assert got(B.restate_reconciled(grid, filings, registry), *name) == [(1, "both"), (1, "edgar")]
    assert got(B.restate_reconciled(grid, None, registry), *name) == [(1, "xbrl"), (0, "none")]
    assert got(B.restate_reconciled(grid, filings.limit(0), None), *name) == [(0, "none"), (0, "none")]
    assert got(B.restate_reconciled(grid, None, None), *name) == [(None, None)] * 2
    assert got(B.restate_strict(grid, filings), "earnings_restate") == [(1,), (0,)]
    assert got(B.restate_strict(grid, None), "earnings_restate") == [(None,)] * 2


def test_external_sources(spark, grid):
    ext = spark.createDataFrame([("1", date(2018, 12, 31), "1", 1), ("1", date(2018, 12, 31), "0", 2), ("2", date(2018, 12, 31), "x", 1)], "cik string, period_end date, bankruptcy string, place int")
    assert got(B.external_label(grid, ext, "bankruptcy", [F.col("place")]), "bankruptcy") == [(1,), (None,)]
    vendor = spark.createDataFrame([("0000000002", "03", date(2019, 5, 1)), ("0000000001", "06", date(2019, 5, 1))], "cik string, cstat_dlrsn string, cstat_dldte date")
    assert got(B.bankruptcy_label(grid, vendor, ext), "bankruptcy") == [(0,), (1,)]
    assert got(B.bankruptcy_label(grid, vendor, ext.where("place = 1"), source="external_csv"), "bankruptcy") == [(1,), (None,)]
    assert got(B.bankruptcy_label(grid, vendor.drop("cstat_dldte"), None), "bankruptcy") == [(None,)] * 2
    spans = spark.createDataFrame([("2", date(2018, 1, 1), date(2018, 12, 31))], "cik string, start_date date, end_date date")
    assert got(B.enforcement_label(grid, spans.withColumn("cik", F.lpad("cik", 10, "0"))), "sec_enforcement") == [(0,), (1,)]
    assert got(B.enforcement_label(grid, spans.drop("cik")), "sec_enforcement") == [(None,)] * 2
    assert got(B.enforcement_label(grid, spans.select("cik")), "sec_enforcement") == [(0,), (0,)]
    assert got(B.audit_label(grid, ext), "audit_qualification") == [(None,)] * 2


def test_label_database_and_stats(spark, grid):
    market = grid.withColumns({"mkt_adj_252": F.when(F.col("cik") == "0000000001", -0.5), "delisted": F.lit(None).cast("boolean")})
    rows = B.build_labels(market, 252)
    assert got(rows, "stock_decline", "bankruptcy") == [(1, None), (None, None)]
    s = {r.label: r for r in B.label_stats(rows.drop("bankruptcy")).collect()}
    assert (s["bankruptcy"].n_missing, s["bankruptcy"].positive_rate, s["stock_decline"].n_pos) == (2, None, 1)
    assert tuple(B.label_overview(rows).first()) == (2, 0, 0)


def test_audit_buckets(spark):
    d = date(2018, 12, 31)
    registry = spark.createDataFrame([(c, d) for c in "abcde" for _ in range(2)] + [("f", d)], "cik string, period_end date")
    labels = spark.createDataFrame([("a", d, 1), ("b", d, 0)], "cik string, period_end date, earnings_restate int")
    filings = spark.createDataFrame([("a", "10-K/A", date(2019, 1, 1)), ("c", "10-K/A", date(2020, 5, 1)), ("c", "10-K/A", date(2019, 5, 1)), ("d", "10-K/A", date(2019, 5, 1)), ("e", "NT 10-K/A", date(2019, 5, 1))], "cik string, form_type string, date_filed date")
    assert got(B.amendment_audit(registry, labels, filings), "bucket") == [("both",), ("xbrl_only",), ("edgar_misses_by_window",), ("label_only",), ("edgar_misses_by_form",)]


FACTS = "cik string, tag string, unit string, pos long, val double, fy int, fp string, form string, filed date, period_end date"


def test_annual_facts(spark):
    d, e = date(2021, 2, 1), date(2020, 12, 31)
    rows = [
        ("1", "Assets", "USD", 0, 1.0, 2020, "FY", "10-K", d, e), ("1", "Assets", "USD", 1, 2.0, 2020, "FY", "10-K", d, e), ("1", "Assets", "USD", 2, 9.0, 2020, "Q1", "10-K", date(2022, 1, 1), e),
        ("1", "Cash", "USD", 0, 5.0, 2020, "FY", "10-K", d, e), ("1", "LongTermDebtNoncurrent", "USD", 0, 4.0, 2020, "FY", "10-K", d, e),
        ("1", "StockholdersEquity", "USD", 0, 7.0, 2021, "FY", "10-K", date(2022, 2, 1), date(2021, 12, 31)), ("1", "Revenues", "shares", 0, 7.0, 2019, "FY", "10-K", d, e), ("1", "Assets", "USD", 3, 3.0, 2020, "FY", "10-K/A", date(2021, 9, 1), e),
    ]
    f = spark.createDataFrame(rows, FACTS)
    r = {x.fiscal_year: x for x in A.annual_facts(f, 2012, 2024).collect()}
    assert set(r) == {2020, 2021} and (r[2020].total_assets, r[2020].cash_equivalents, r[2020].total_debt) == (1.0, 5.0, 4.0)
    assert r[2021].period_end is None and r[2021].total_equity == 7.0 and r[2021].total_debt is None and r[2020].period_end == e
    assert sorted((x.fiscal_year, x.form) for x in A.amendment_registry(f, 2012, 2024).collect()) == [(2020, "10-K"), (2020, "10-K/A"), (2021, "10-K")]
    assert A.annual_facts(f, 2023, 2024).count() == 0


def test_coverage_counts_filings_since_the_cutoff(spark):
    rows = [("1", "10-K", date(y, 3, 1)) for y in (2010, 2012, 2013, 2015)] + [("1", "10-K/A", date(2014, 3, 1)), ("2", "10-K", date(2012, 1, 1))]
    c = {r.cik: r for r in P.filing_coverage(spark.createDataFrame(rows, "cik string, form_type string, date_filed date"), 2010, 2016, "2012-01-01").collect()}
    assert (c["1"].n_filings, c["1"].n_since, c["1"].coverage, c["1"].has_gap, c["1"].gap_years) == (4, 3, 0.75, True, [2011, 2014])
    assert (c["2"].coverage, c["2"].has_gap, c["2"].is_current) == (1.0, False, False)


def test_index_numbers_at_either_end_and_files_without_header(spark):
    row = lambda number: f"{'10-K':12}{'ACME CORP':62}{number} 2020-02-14  edgar/data/1/a.txt"
    lines = [("a", "Form Type   Company Name   CIK"), ("a", "-" * 90), ("a", row(f"{'320193':12}")), ("a", row(f"{'320193':>17}") + "  extra"), ("b", row("7"))]
    rows = landed.parse_index_lines(spark.createDataFrame(lines, "file string, value string")).collect()
    assert [(r.cik, r.company_name) for r in rows] == [("0000320193", "ACME CORP")] * 2


def test_absent_feature_and_small_classes(spark):
    df = spark.createDataFrame([("a", 2015, 1.0), ("a", 2016, 2.0)], "cik string, fiscal_year int, x double").withColumn("filed_date", F.lit("2017-01-01").cast("date"))
    assert [r.yoy_z for r in P.yoy(df, ["z"]).orderBy("fiscal_year").collect()] == [0.0, None]
    assert df.select(X.hanley_mcneil(F.lit(0.7), F.lit(1), F.lit(50)).alias("s")).first().s is None


def test_grid_prices_and_folds(spark):
    from filingspark.plans.splits import fold_table

    c = spark.createDataFrame([("1", [2019, 2020], "02-29"), ("2", [2020], "630"), ("3", [], "1231"), ("4", [2020], None)], "cik string, filing_years array<int>, fiscal_year_end string")
    assert {(r.cik, str(r.period_end)) for r in M.company_year_grid(c).collect()} == {("1", "2019-12-31"), ("1", "2020-02-29"), ("2", "2020-06-30"), ("4", "2020-12-31")}
    raw = spark.createDataFrame([("A", date(2020, 1, 1), 1.0, None), ("A", date(2020, 1, 2), None, None), ("A", date(2020, 1, 3), None, 5.0)], "ticker string, dt date, `Adj Close` double, volume double")
    assert M.standard_prices(raw).count() == 1
    with pytest.raises(ValueError):
        M.standard_prices(raw.drop("Adj Close"))
    assert fold_table(spark, "1700-12-31", "2020-12-31").count() == 319


def test_publish_keeps_the_first_filed_row(spark):
    p = spark.createDataFrame([("1", "T", 2018, date(2018, 12, 29), date(2019, 2, 1)), ("1", "T", 2018, date(2018, 12, 29), date(2019, 8, 1)), ("2", "U", 2018, date(2018, 12, 1), date(2019, 2, 1))], "cik string, ticker string, fiscal_year int, period_end date, filed_date date")
    labels = spark.createDataFrame([(c, date(2018, 12, 31), 1) for c in "12"], "cik string, period_end date, earnings_restate int")
    market = labels.select("cik", "period_end", F.lit(0.5).alias("fwd_ret_252d"), F.lit(0.1).alias("mkt_adj_252d"), F.lit(False).alias("delisted")).where("cik = '1'")
    companies = spark.createDataFrame([("1", "Energy", "1300")], "cik string, sector string, sic_code string")
    rows = U.publish(p, labels, market, companies, ("2018-12-31", "2019-12-31", "2020-12-31")).collect()
    assert [(r.cik, r.filed_date, r.split, r.delisted, r.sector) for r in rows] == [("1", date(2019, 2, 1), "train", False, "Energy")]
    assert tuple(U.amendment_label_audit(p, labels).first())[:2] == (1, 1)
    with pytest.raises(ValueError):
        U.publish(p, labels.union(labels), market, companies, ("2018-12-31", "2019-12-31", "2020-12-31")).count()
    with pytest.raises(ValueError):
        U.panel_label_join(p, labels.limit(0), require_rows=True)


def test_outside_files(spark, tmp_path):
    (tmp_path / "sec_enforcement.csv").write_text(" CIK ,Period_End\n7,2020-12-31\n8,never\n")
    e = external.external_label(spark, f"file:{tmp_path}", "sec_enforcement")
    assert [(r.cik, str(r.period_end)) for r in e.orderBy("cik").collect()] == [("0000000007", "2020-12-31"), ("0000000008", "None")]
    assert external.external_label(spark, f"file:{tmp_path}", "bankruptcy") is None
    with pytest.raises(FileNotFoundError, match="labels"):
        external.load_dataset(spark, f"file:{tmp_path}", "labels")
    with pytest.raises(FileNotFoundError):
        external.crossref(spark, f"file:{tmp_path}/none.csv")
    (tmp_path / "v.csv").write_text("gvkey,cik,exchg,dlrsn\n1,nan,11,03\n2,,x,44\n")
    assert [(r.gvkey, r.cik, r.exchange_name, r.delist_reason) for r in external.crossref(spark, f"file:{tmp_path}/v.csv").orderBy("gvkey").collect()] == [("000001", None, "NYSE", "Bankruptcy"), ("000002", None, "Other", "Unknown")]


def test_reports(spark):
    s = spark.createDataFrame([("x", "base", 0, 0.5), ("x", "r1", 1, 0.6), ("x", "r2", 2, 0.6), ("y", "base", 0, 0.7), ("y", "r1", 1, 0.6), ("z", "base", 0, None)], "outcome string, variant string, place int, value double")
    assert sorted(tuple(r)[:5] for r in R.best_variant(s, "base").collect()) == [("x", 0.5, 0.6, "r1", 0.1), ("y", 0.7, 0.7, "none", 0.0)]
    m = spark.createDataFrame([("a", o, 0.9) for o in "pq"] + [("b", o, 0.5) for o in "pq"] + [("a", "r", 0.9)], "model string, outcome string, value double")
    assert tuple(R.gate_conditional(m, "a", "b", 0.01).first()) == (2, 2, 3, "CONDITIONAL_GO")


def test_bootstrap_brackets_the_estimate(spark):
    assert poisson_cdf(1)[:2] == pytest.approx([0.36787944, 0.73575888])
    p = spark.range(300).select(F.lit("m").alias("m"), "id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.pmod(F.xxhash64("id"), F.lit(50)) / 100 + F.when(F.col("id") % 3 == 0, 0.2).otherwise(0)).alias("score"))
    r = bootstrap_auroc(p, ["m"], 40).first()
    assert r.low < r.estimate < r.high and r.high - r.low < 0.3
    one = bootstrap_auroc(p.where("y = 1"), ["m"], 5).first()
    assert one.estimate is None and one.low is None


def test_near_duplicate_keys_in_lookup(spark):
    d = spark.createDataFrame([("1", "a"), ("1", "b"), (None, "c")], "cik string, sic_code string")
    assert J.lookup(spark.createDataFrame([("1",), (None,)], "cik string"), d, "cik", ["sic_code"], [F.col("sic_code")]).orderBy("cik").collect()[1].sic_code == "a"
