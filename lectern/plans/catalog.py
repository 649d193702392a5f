"""The registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lectern.session import ship

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables as a query, with its DuckDB SQL where there is one."""

    def register(f: Callable[[Tables], DataFrame]):
        @wraps(f)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(Tables(ship(spark), folder))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _load() -> None:
    from lectern.plans import queries_eval, queries_graph, queries_knowledge, queries_library, queries_more, queries_retrieval, queries_sources, queries_text  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
