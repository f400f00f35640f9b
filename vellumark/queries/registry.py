"""Registration of driver queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumark.plans.domain import frame, oracle

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """The function gets tables by name: the store's, or the folder's."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            known: dict[str, DataFrame] = {}
            return f(lambda table: frame(spark, sf_dir, table, known))

        QUERIES[name] = run
        if sql:
            ORACLE[name] = oracle(sql)
        return f

    return add
