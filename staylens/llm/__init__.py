"""Training-data operators (one module per operator) and their registered
queries. Nothing outside this subpackage imports it; ``queries()`` and
``oracles()`` are what the repository's entry file picks up."""

from __future__ import annotations

import importlib
import sys

from pyspark import cloudpickle

#: Tasks get this subpackage's functions by value: executors needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MODULES = ["ann", "bpe", "decontaminate", "gru_lm", "langid", "licenses", "omh_dedup", "partenum", "prefix_trie", "resample", "sharding", "secrets", "warc"]


def _collect(attribute):
    out = {}
    for name in _MODULES:
        out.update(getattr(importlib.import_module(f"{__name__}.{name}"), attribute))
    return out


def queries():
    return _collect("QUERIES")


def oracles():
    return _collect("ORACLE")
