"""All registered queries of the library, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return keep


def _load() -> None:
    from . import cohort_queries, diagnosis_queries, event_queries, experiment_queries, funnel_queries  # noqa: F401
    from . import metric_queries, mix_queries, source_queries, targeting_queries  # noqa: F401


_load()
