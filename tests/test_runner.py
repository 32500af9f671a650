import pytest

from threshfold.operators.review import GateError
from threshfold.plans import runner as R
from threshfold.plans.study_queries import QUERIES


def test_stages_are_resumed_and_gates_stop(spark, tmp_path):
    calls = []

    def stage(name, **row):
        def f(spark, d):
            calls.append(name)
            return spark.createDataFrame([tuple(row.values())], list(row))

        return f

    state = {"ok": False}
    queries = {"capture_lag": stage("capture_lag", n=1), "precision_recall": lambda s, d: stage("precision_recall", passes=state["ok"], tp=3)(s, d), "bootstrap_ci": stage("bootstrap_ci", label="w", verdict="NULL")}
    stages = (("capture_lag", None), ("precision_recall", "passes"), ("bootstrap_ci", None))
    with pytest.raises(GateError):
        R.run(spark, "d", f"{tmp_path}/o", stages, queries)
    assert calls == ["capture_lag", "precision_recall"]
    assert R.run(spark, "d", f"{tmp_path}/o", stages, queries, frozenset({"precision_recall"})) == ["bootstrap_ci"]
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/o/writeup").collect())
    assert "## Extraction" in text and "* NULL: 1" in text and "Against factors" not in text
    assert R.run(spark, "d", f"{tmp_path}/o", stages, queries, frozenset({"precision_recall"})) == []


def test_all_stages_are_registered():
    assert {n for n, _ in R.STAGES} <= set(QUERIES) and set(R.SECTIONS) <= {n for n, _ in R.STAGES}
