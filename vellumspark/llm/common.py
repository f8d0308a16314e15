"""Session helpers that every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import scratch as fresh_dir, ship_package, shared as shared_dir, stored as materialize

__all__ = ["fresh_dir", "materialize", "shared_dir", "ship_package", "small_batches", "table"]

#: Rows, and bytes, in one Arrow batch: the texts of a batch must fit a Python worker together.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Before Python runs on executors: bound the Arrow batches, in which whole texts travel.

    The session's bounds are only lowered, and stay so: a returned table is computed later.
    """
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    held = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if held > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
