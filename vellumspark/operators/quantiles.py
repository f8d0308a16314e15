"""Exact quantiles of groups by radix selection: no group's values ever meet in one place.

Equal values are counted first.  Then each wanted rank of a group narrows to one bucket of a histogram
of ``BUCKETS`` equal parts between the least and the largest value that it can still be, and again within that
bucket's own least and largest, until few distinct values are left.  A pass moves a histogram for each
wanted rank; only the last step ranks values, at most ``FEW`` of them for each.

Values are finite; nulls are left out; a group without values is not in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import stored

BUCKETS, FEW = 1024, 4096


def counted(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, v, c``: distinct values of each group and how often they occur."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))


def at_ranks(each: DataFrame, by: list[str], wanted: dict[str, Column]) -> DataFrame:
    """``by, n`` and a column for each wanted rank: the value number ``k`` (from 1) in order, ``k`` told from ``n``."""
    each = stored(each, "values")
    ends = each.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("want"), k.cast("long").alias("k")) for name, k in wanted.items()]))
    state = ends.select(*by, "n", "d", "lo", "hi", F.lit(0).cast("long").alias("below"), ranks.alias("w")).select(*by, "n", "d", "lo", "hi", "below", "w.*")
    state = stored(state, "ranks")
    same = [each[c].eqNullSafe(F.col(f"_{c}")) for c in by]
    open_ = (F.col("lo") < F.col("hi")) & (F.col("d") > FEW)

    def inside(some: DataFrame) -> DataFrame:
        """The values that a wanted rank can still be."""
        named = some.withColumnsRenamed({c: f"_{c}" for c in by})
        joined = each.join(named, same)
        return joined.where(F.col("v").between(F.col("lo"), F.col("hi"))).drop(*[f"_{c}" for c in by])

    while not (left := state.where(open_)).isEmpty():
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS))
        parts = inside(left).groupBy(*by, "n", "want", "k", "below", bucket.alias("bucket")).agg(F.sum("c").alias("c"), F.count("*").alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("below") + F.sum("c").over(Window.partitionBy(*by, "want").orderBy("bucket"))
        found = parts.withColumn("upto", upto).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k")))
        narrowed = found.select(*by, "n", "d", "lo", "hi", (F.col("upto") - F.col("c")).alias("below"), "want", "k")
        state = stored(narrowed.unionByName(state.where(~open_)), "ranks")
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*by, "want").orderBy("v"))
    last = inside(state.where("lo < hi")).withColumn("upto", upto).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k")))
    both = last.select(*by, "n", "want", "v").unionByName(state.where("lo = hi").select(*by, "n", "want", F.col("lo").alias("v")))
    return both.groupBy(*by, "n").agg(*[F.max(F.when(F.col("want") == name, F.col("v"))).alias(name) for name in wanted])


def _exclusive(n: Column) -> tuple[Column, Column]:
    """Rank below the ninth decile by the exclusive method, and tenths of the way to the next; the last one for few values."""
    j = F.least(F.greatest(F.floor(9 * (n + 1) / F.lit(10.0)).cast("long"), F.lit(1)), n - 1)
    return F.when(n >= 10, j).otherwise(n), F.when(n >= 10, 9 * (n + 1) - 10 * j).otherwise(F.lit(0))


def spreads(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, median, p90``: the median by interpolation and the ninth decile by the exclusive method (the largest of under ten)."""
    n = F.col("n")
    j, tenths = _exclusive(n)
    ranks = {"low": F.floor((n - 1) / 2) + 1, "high": F.ceil((n - 1) / 2) + 1, "a": j, "b": F.least(j + 1, n)}
    found = at_ranks(counted(rows, by, value), by, ranks)
    p90 = F.when(n >= 10, (F.col("a") * (10 - tenths) + F.col("b") * tenths) / F.lit(10.0)).otherwise(F.col("a"))
    return found.select(*by, ((F.col("low") + F.col("high")) / 2).alias("median"), p90.alias("p90"))


def latencies(rows: DataFrame, by: list[str], value: str, percents: dict[str, int]) -> DataFrame:
    """``by`` and for each name the value at ``n * percent / 100``, cut, in order, to one digit."""
    rank = lambda p: F.greatest(F.lit(1), F.floor(F.col("n") * p / F.lit(100.0)))
    found = at_ranks(counted(rows, by, value), by, {name: rank(p) for name, p in percents.items()})
    return found.select(*by, *[F.round(name, 1).alias(name) for name in percents])
