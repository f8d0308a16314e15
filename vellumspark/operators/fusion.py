"""Reciprocal rank fusion of two ranked lists, payloads, and reranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

RRF_K, CANDIDATES, RERANKED = 60, 30, 30


def filters(values: dict[str, object]) -> Column:
    """All ``column = value`` for the values that are neither empty nor zero; text columns compare in lower case."""
    parts = [F.lower(F.col(k)) == v.lower() if isinstance(v, str) else F.col(k) == F.lit(v) for k, v in values.items() if v]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def rrf(dense: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """``qid, id, rrf, rank_dense, rank_bm25`` of the union of two lists (``qid, id, rank``)."""
    one = lambda d, name: d.select("qid", "id", "rank", F.lit(name).alias("of"))
    rank = lambda name: F.max(F.when(F.col("of") == name, F.col("rank")))
    both = one(dense, "dense").unionByName(one(lexical, "bm25"))
    return both.groupBy("qid", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), rank("dense").alias("rank_dense"), rank("bm25").alias("rank_bm25"))


def fused_order(first: list[Column] | None = None) -> list[Column]:
    """Best fused score first; on ties the dense list's order, then the lexical one's."""
    return [*(first or []), F.round("rrf", 12).desc(), F.col("rank_dense").asc_nulls_last(), F.col("rank_bm25").asc_nulls_last()]


def top(rows: DataFrame, k: int, order: list[Column], name: str = "place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col(name) <= k)


def with_payload(rows: DataFrame, lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """Payload of each hit: the dense list's whole struct if it has one, else the lexical one's, else the id alone."""
    joined = rows.join(lexical.withColumnRenamed("payload", "p_bm25"), "id", "left").join(dense.withColumnRenamed("payload", "p_dense"), "id", "left")
    return joined.withColumn("payload", F.coalesce("p_dense", "p_bm25")).drop("p_dense", "p_bm25")


def rerank(rows: DataFrame, query_text: Column, text: Column, score: Callable[[Column, Column], Column], k: int, logit: bool = True) -> DataFrame:
    """The first ``RERANKED`` fused candidates, ordered anew by a model's score.

    ``score`` maps query and text columns to a logit, which is squashed to 0..1, or to that itself.
    """
    short = top(rows, RERANKED, fused_order())
    given = score(query_text, F.coalesce(text, F.lit("")))
    scored = short.withColumn("rerank", 1 / (1 + F.exp(-given)) if logit else given)
    return top(scored, k, fused_order([F.round("rerank", 9).desc()]), "rank")
