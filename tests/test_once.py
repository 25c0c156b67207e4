"""What several parts of a query read is made once."""

from shellac.operators import audit, diff
from shellac.plans import registry

DATA = "/root/testdata/sf0.001"


def test_imports_are_compared_once_for_both_histories(spark, monkeypatch):
    made, compared = [], diff.multiset_diff
    monkeypatch.setattr(diff, "multiset_diff", lambda *a: made.append(1) or compared(*a))
    answers = {(r["kept"], r["id"]): r["can"] for r in registry.QUERIES["can_reconstruct"](spark, DATA).collect()}
    assert len(made) == 2 and answers[0, 1] and answers[0, 2] and not answers[0, 3]


def test_mismatches_are_found_once(spark, monkeypatch):
    made, found = [], audit.matrix_mismatches
    monkeypatch.setattr(audit, "matrix_mismatches", lambda *a: made.append(1) or found(*a))
    open_ = registry.QUERIES["open_mismatches"](spark, DATA)
    assert len(made) == 1 and "Join" in (plan := open_._jdf.queryExecution().optimizedPlan().toString()) and "b_side_title" not in plan
