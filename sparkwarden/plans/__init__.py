"""Whole plans: the corpus scan and the registered queries."""

from __future__ import annotations

import importlib

_MODULES = ["history_queries", "store_queries", "package_queries", "detection_queries", "source_queries", "stream_queries"]


def load_queries():
    from .registry import ORACLES, QUERIES

    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
