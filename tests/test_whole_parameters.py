"""The registered queries of resampling and models are the surveyed jobs in full."""

import inspect

import pytest

from cohortspark.operators import evaluate as E
from cohortspark.operators import models as M
from cohortspark.plans import evaluation_queries as Q


def called(monkeypatch, spark, sf, module, operator, query):
    """The parameters that a query gives its operator, defaults included."""
    real, seen = getattr(module, operator), {}

    class Called(Exception):
        pass

    def note(*a, **k):
        bound = inspect.signature(real).bind(*a, **k)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Called

    monkeypatch.setattr(module, operator, note)
    with pytest.raises(Called):
        query(spark, sf)
    return seen


def test_replicates(monkeypatch, spark, sf):
    for query in (Q.bootstrap_ci, Q.bootstrap_difference):
        assert called(monkeypatch, spark, sf, E, "bootstrap_ci", query)["n"] == 1000
        monkeypatch.undo()
    assert called(monkeypatch, spark, sf, E, "subgroup_interaction", Q.subgroup_interaction)["n"] == 1000


def test_grids(monkeypatch, spark, sf):
    tree = called(monkeypatch, spark, sf, M, "train_trees", Q.train_trees)
    assert tree["grid"] is None and tree["rounds"] == 100
    monkeypatch.undo()
    cv = called(monkeypatch, spark, sf, M, "train_trees_cv", Q.train_trees_cv)
    assert cv["grid"] is None and cv["k"] == 5 and cv["rounds"] == 100
    monkeypatch.undo()
    assert called(monkeypatch, spark, sf, M, "linear_probe", Q.linear_probe)["grid"] is None
    monkeypatch.undo()
    assert {(p["depth"], p["rate"], p["leaves"]) for p in M.tree_grid()} == {(d, r, n) for d in (3, 6, 0) for r in (0.02, 0.1, 0.5) for n in (10, 25, 100)}
