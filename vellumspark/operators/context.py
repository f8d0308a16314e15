"""Numbered contexts, citations and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import label_line, strip
from ..profiles import NOT_FOUND

RULE = "─" * 60


def context_entry(n: Column, label: Column, url: Column, text: Column) -> Column:
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), label, F.lit("\nURL: "), url, F.lit("\n" + RULE + "\n"), text)


def context_blocks(hits: DataFrame, key: str = "qid", rank: str = "rank") -> DataFrame:
    """One row per query: its context, the number of texts in it and their numbers.

    ``hits`` has ``tipo_ato, year, title, section, url, text`` and the rank, which is the
    number; hits without text are left out and their numbers stay free.
    """
    text = strip(F.coalesce("text", F.lit("")))
    label = label_line(F.col("tipo_ato"), F.col("year"), F.col("title"), F.col("section"))
    full = hits.where(text != "").select(key, F.col(rank).alias("n"), context_entry(F.col(rank), label, F.coalesce("url", F.lit("")), text).alias("entry"))
    return full.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "entry"))).alias("all")).select(
        key, F.array_join(F.transform("all", lambda x: x["entry"]), "\n\n").alias("context"), F.size("all").alias("n_chunks"), F.transform("all", lambda x: x["n"]).alias("numbers")
    )


def cited(answer: Column) -> Column:
    """Cited numbers, each once, in order of first use."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def citations(answers: DataFrame, meta: DataFrame, key: str = "qid") -> DataFrame:
    """``key, pos, n`` and the columns of ``meta(key, n, ...)`` for each citation that exists."""
    used = answers.select(key, F.posexplode(cited(F.col("answer"))).alias("pos", "n"))
    return used.join(meta, [key, "n"])


def is_not_found(answer: Column) -> Column:
    """Whether the answer says so, in any case of letters."""
    return F.contains(F.lower(answer), F.lit(NOT_FOUND.lower()))
