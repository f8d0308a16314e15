"""Retrieval quality, latency and judge metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KS = (5, 10, 20)


def question_metrics(rows: DataFrame, ids: str = "retrieved_ids", relevant: str = "relevant_ids") -> DataFrame:
    """Adds ``hit_5``, ``hit_10``, ``hit_20`` and ``rr`` (null for negative questions)."""
    positive = F.col("tipo_query") != "negative"
    hit = lambda k: F.when(positive, F.arrays_overlap(F.slice(ids, 1, k), F.col(relevant)).cast("int"))
    places = F.filter(F.transform(F.col(ids), lambda x, i: F.when(F.array_contains(F.col(relevant), x), i + 1)), lambda p: p.isNotNull())
    rr = F.when(positive, F.coalesce(1.0 / F.get(places, F.lit(0)), F.lit(0.0)))
    return rows.withColumns({f"hit_{k}": hit(k) for k in KS} | {"rr": rr})


def averages() -> list[Column]:
    return [F.round(F.avg(f"hit_{k}"), 4).alias(f"hit_{k}") for k in KS] + [F.round(F.avg("rr"), 4).alias("mrr"), F.count("*").alias("n")]


def summary(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Macro averages over the questions that are not negative."""
    positive = rows.where("tipo_query <> 'negative'")
    return (positive.groupBy(by) if by else positive.groupBy()).agg(*averages())


def judge_means(rows: DataFrame) -> DataFrame:
    """Means over the verdicts that are not -1; all samples count in ``n_llm_eval``."""
    mean = lambda c: F.round(F.avg(F.when(F.col(c) >= 0, F.col(c))), 4).alias(c)
    return rows.agg(mean("faithfulness"), mean("relevance"), F.count("*").alias("n_llm_eval"))


def not_found_rate(rows: DataFrame) -> DataFrame:
    return rows.where("tipo_query = 'negative'").agg(F.round(F.avg(F.col("not_found").cast("int")), 4).alias("rate"), F.count("*").alias("n"))
