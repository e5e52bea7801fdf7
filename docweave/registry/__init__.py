"""Query registry: every operator of the inventory as a callable
``(spark, sf_dir) -> DataFrame`` plus, where SQL can express it, the
equivalent DuckDB SQL over the same tables."""

from __future__ import annotations

import importlib

MODULES = ["retrieval", "html", "text", "chat", "lexical", "topics", "graph",
           "sources", "evaluate", "streams"]


def _load():
    qs, sqls = {}, {}
    for m in MODULES:
        mod = importlib.import_module(f"docweave.registry.{m}")
        qs.update(mod.QUERIES)
        sqls.update(mod.ORACLE)
    return qs, sqls


def all_queries():
    return _load()[0]


def all_oracles():
    return _load()[1]
