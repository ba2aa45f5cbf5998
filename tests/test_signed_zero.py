"""A score that rounds to zero is 0, not -0, as ``F.round`` gives it."""

import duckdb

from filingspark import registry
from filingspark.queries_features import _COLS

DIR = "/root/testdata/sf0.1"


def test_the_sql_of_normal_scores_gives_no_negative_zero():
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    signed = " or ".join(f"({c} = 0 and cast({c} as varchar) like '-%')" for c in _COLS)
    n, zeros = con.execute(f"select count(*) filter ({signed}), count(*) filter (total_assets = 0) from ({registry.oracle_sql()['scaler_quantile']}) t").fetchone()
    assert n == 0 < zeros
