"""Steps that read a table many times read a written copy, not the joins that give it."""

import pytest

from filingspark import queries_features as N, queries_models as QM, queries_panel as Q, queries_sourcing as S

DIR = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def from_copy(df):
    return df.inputFiles() and not [f for f in df.inputFiles() if f.startswith(f"file://{DIR}/")]


def caught(monkeypatch, module, name, run):
    """The first argument that ``run`` gives to the function ``name``."""

    def stop(first, *rest, **named):
        raise Seen(first)

    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Seen) as e:
        run()
    return e.value.args[0]


def test_models_read_a_written_panel_and_metrics_written_scores(spark, monkeypatch):
    assert from_copy(QM._matrix(spark, DIR))
    assert from_copy(caught(monkeypatch, QM.M, "benchmark", lambda: QM._bench(spark, DIR)))


def test_walk_forward_reads_a_written_panel(spark, monkeypatch):
    assert from_copy(caught(monkeypatch, QM.M, "walk_forward", lambda: QM.walk_forward(spark, DIR)))


def test_feature_matrix_reads_written_features(spark):
    assert from_copy(N.feature_matrix(spark, DIR))


def test_exact_fractions_read_written_keys(spark, monkeypatch):
    assert from_copy(caught(monkeypatch, S.D, "fraction_members", lambda: S.train_fraction_exact(spark, DIR)))


def test_facts_are_dealt_out_by_company_once(spark):
    docs = Q._documents(Q.view(spark, DIR, "fact"))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.split("SortMergeJoin")[0].split("BroadcastHashJoin")[0].count("Exchange hashpartitioning") == 1
