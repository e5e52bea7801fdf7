"""Telling a missing source from a failing one."""

from __future__ import annotations

from pyspark.errors import AnalysisException

#: Spark's error conditions for a path that isn't there or holds no file yet.
_MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def missing_path(e: AnalysisException) -> bool:
    return (e.getCondition() or "").split(".")[0] in _MISSING
