"""Shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

WORDS_SQL = r"list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda w: lower(w))"


def words_sql(x: str) -> str:
    return WORDS_SQL.format(x=x)


TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts are spread."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def spread(rows: DataFrame) -> DataFrame:
    """Rows with much work each: those in fewer files than there are cores are dealt anew, since a row group is one task's work."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows._jdf.inputFiles()) < cores else rows


class Registry:
    """Collects a module's queries with their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add
