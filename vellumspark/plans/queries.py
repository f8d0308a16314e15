"""All registered queries on the driver's tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import acts, chunks, corpus, files, search, text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for part in (text, search, chunks, acts, corpus, files):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
