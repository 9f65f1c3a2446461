"""Registered query plans: each maps one or more operators of the source
system onto the benchmark tables, paired with an equivalent SQL text that an
independent engine can run on the same parquet files."""

from __future__ import annotations

import importlib

_MODULES = ["summary_queries", "change_queries", "scoring_queries", "scalar_queries", "feature_queries", "training_queries", "clinical_queries", "model_queries"]


def _load():
    queries, oracle = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(f"{__name__}.{name}")
        queries.update(mod.QUERIES)
        oracle.update(mod.ORACLE)
    return queries, oracle


def all_queries():
    return _load()[0]


def all_oracles():
    return _load()[1]
