"""Registered queries of the engine, each with the SQL that DuckDB can run beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.plans import assembling, building, detecting, measuring, planning, recording

FLAGSHIP = "e11_redact_documents"

Query = Callable[[SparkSession, str], DataFrame]

_ALL = detecting.ALL | recording.ALL | measuring.ALL | building.ALL | assembling.ALL | planning.ALL


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
