"""Every query against its SQL on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from filingspark import registry
from filingspark.views import view

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (int, float, Decimal)):
        return f"{float(v):.4f}"
    return str(v)[:10] if hasattr(v, "year") else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    names = sorted(df.columns)
    rel = duck.execute(registry.oracle_sql()[name])
    theirs = [d[0] for d in rel.description]
    assert sorted(theirs) == names
    want = sorted(tuple(cell(r[theirs.index(n)]) for n in names) for r in rel.fetchall())
    assert sorted(tuple(cell(r[n]) for n in names) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["facts_explode_all", "close_wide_all", "sic_join", "crossref_merge"])
def test_no_subset_of_ids_is_read(spark, name):
    plan = registry.queries()[name](spark, DIR)._jdf.queryExecution().analyzed().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x]
    assert not [x for x in filters if "%" in x or "0000000100" in x]


def test_all_companies_and_tickers(spark):
    q = registry.queries()
    assert q["facts_explode_all"](spark, DIR).select("cik").distinct().count() == view(spark, DIR, "fact").select("cik").distinct().count() > 99
    assert q["close_wide_all"](spark, DIR).count() == q["prices_scan"](spark, DIR).count()


@pytest.mark.parametrize("name", ["lr_scores", "lr_traditional_scores", "gbt_full_scores", "gbt_raw_scores"])
def test_models_score(spark, name):
    rows = registry.queries()[name](spark, DIR).collect()
    assert len(rows) == len({(r.cik, r.fiscal_year) for r in rows}) > 100 and all(0 <= r.score <= 1 for r in rows)


def test_studies(spark):
    """On the given tables the outcomes have no signal, so areas are only bounded; tests/test_models.py has floors."""
    q = registry.queries()
    grid = q["temporal_grid"](spark, DIR).collect()
    assert len(grid) == 4 and sum(r.best for r in grid) == 1 and all(0 < r.mean_auroc < 1 for r in grid)
    folds = q["walk_forward"](spark, DIR).collect()
    assert {r.model for r in folds} == {"lr", "gbt"} and len({r.fold for r in folds}) > 1
    curve = q["scaling_curve"](spark, DIR).collect()
    assert len(curve) == 5 and all(0 < r.auroc < 1 for r in curve)
