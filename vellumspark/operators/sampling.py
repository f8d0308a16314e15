"""Deterministic samples: the order of a hash stands for a shuffle.

Sizes and constraints are what matters; members are drawn by md5 of seed and key, so a sample
is the same on every run and engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..profiles import PRIORITY_TYPES

SEED = 42
TARGET = {"factual": 30, "conceptual": 15, "comparative": 10, "multi_hop": 15, "negative": 10}


def shuffled(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), key.cast("string")))


#: A stratum's sample is cut by so many parts of the shuffle's hash before it is ranked.
PARTS = 4096


def stratified(rows: DataFrame, strata: list[str], key: str, fraction: float, seed: int = SEED) -> DataFrame:
    """``max(1, round(n * fraction))`` rows of each stratum, halves to even.

    The counts of the hash's parts say where each stratum's sample ends; only the rows of that
    one part are ranked, so no task sorts a stratum.
    """
    if not 0 < fraction <= 1:
        raise ValueError("the fraction is above 0 and at most 1")
    h = shuffled(F.col(key), seed)
    placed = rows.withColumns({"__h": h, "__part": F.conv(F.substring(h, 1, 3), 16, 10).cast("int")})
    sizes = placed.groupBy(*strata, "__part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*strata).orderBy("__part"))  # PARTS rows a stratum
    take = F.greatest(F.lit(1), F.bround(F.sum("n").over(Window.partitionBy(*strata)) * F.lit(float(fraction)))).cast("long")
    cuts = sizes.select(*strata, "__part", (upto - F.col("n")).alias("before"), upto.alias("upto"), take.alias("take"))
    cut = cuts.where("before < take and upto >= take").select(*strata, F.col("__part").alias("cut"), (F.col("take") - F.col("before")).alias("left"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in strata]
    near = placed.alias("r").join(cut.alias("s"), reduce(lambda x, y: x & y, same)).where("__part <= cut").select("r.*", "cut", "left")
    whole = near.where("__part < cut")
    edge = near.where("__part = cut").withColumn("__place", F.row_number().over(Window.partitionBy(*strata).orderBy("__h", key))).where("__place <= left")
    return whole.select(*rows.columns).union(edge.select(*rows.columns))


def round_robin(rows: DataFrame, cells: list[str], key: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows, one of each cell in turn, cells in shuffled order."""
    cell = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in cells])
    turn = F.row_number().over(Window.partitionBy(*cells).orderBy(shuffled(F.col(key), seed), key))
    # no cell gives more than n rows, so each task keeps its first n of a cell only
    near = rows.withColumns({"turn": turn, "cell": shuffled(cell, seed)}).where(F.col("turn") <= n)
    return near.orderBy("turn", "cell", key).limit(n)


def good_chunks(rows: DataFrame, least_chars: int = 300, kinds: tuple[str, ...] = PRIORITY_TYPES) -> DataFrame:
    return rows.where((F.length("text") >= least_chars) & F.col("tipo_ato").isin(*kinds))


def pairs(rows: DataFrame, key: str, doc: str, kind: str, year: str, n: int, same_kind: bool, seed: int = SEED) -> DataFrame:
    """``n`` pairs of chunks of different documents, of one kind (different years first) or of two.

    Pairs are drawn within a pool: the first ``2 n`` chunks of each kind in shuffled order, and
    the first chunk of each of its first ``n + 1`` documents and years; for pairs of two kinds,
    of the first ``n + 1`` kinds.  So if there are ``n`` such pairs in all, ``n`` come back, and
    what is paired grows with ``n`` and the kinds, not with the rows.
    """
    short = rows.select(key, doc, kind, year, shuffled(F.col(key), seed).alias("h"))

    def head(some: DataFrame, by: list[str], most: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("h", key))
        return some.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")

    first = [head(short, [kind], 2 * n)]
    first += [head(head(short, [kind, other], 1), [kind], n + 1) for other in (doc, year)]
    pool = reduce(DataFrame.union, first).distinct()
    if not same_kind:
        few = head(head(short, [kind], 1).withColumn("__all", F.lit(0)), ["__all"], n + 1).select(F.col(kind).alias("__kind"))
        pool = pool.join(F.broadcast(few), F.col(kind) == F.col("__kind"), "left_semi")  # n + 1 rows
    a, b = pool.alias("a"), pool.alias("b")
    later = F.struct("a.h", f"a.{key}") < F.struct("b.h", f"b.{key}")
    other_doc = F.col(f"a.{doc}") != F.col(f"b.{doc}")
    if same_kind:
        tried = a.join(b, (F.col(f"a.{kind}") == F.col(f"b.{kind}")) & later & other_doc)
        first_years = F.coalesce(F.col(f"a.{year}") == F.col(f"b.{year}"), F.lit(False))
    else:
        tried = a.join(F.broadcast(b), (F.col(f"a.{kind}") != F.col(f"b.{kind}")) & later & other_doc)  # (n + 1) * (4 n + 2) rows at most
        first_years = F.lit(False)
    out = tried.select(F.struct(*[f"a.{c}" for c in (key, doc, kind, year)]).alias("a"), F.struct(*[f"b.{c}" for c in (key, doc, kind, year)]).alias("b"), first_years.alias("__same"), F.col("a.h").alias("ha"), F.col("b.h").alias("hb"))
    return out.orderBy("__same", "ha", "hb", f"a.{key}", f"b.{key}").limit(n).select("a", "b")


def negatives(rows: DataFrame, key: str, n: int, seed: int = SEED, kinds: tuple[str, ...] = PRIORITY_TYPES) -> DataFrame:
    """Short whole documents (C) of 200 characters; prose windows (B) of 300 only if those are too few."""
    c = good_chunks(rows.where("tier = 'C'"), 200, kinds).withColumn("turn", F.lit(0))
    b = good_chunks(rows.where("tier = 'B'"), 300, kinds).withColumn("turn", F.lit(1))
    enough = c.limit(n).count() >= n
    pool = c if enough else c.unionByName(b)
    return pool.orderBy(shuffled(F.col(key), seed), key).limit(n).drop("turn")


def trim(rows: DataFrame, target: dict[str, int] | None = None, kind: str = "tipo_query", order: str = "ord") -> DataFrame:
    """The first rows of each kind, as many as the target says; ids were given before, so gaps stay."""
    target = TARGET if target is None else target
    most = F.create_map(*[F.lit(x) for kv in target.items() for x in kv])
    place = F.row_number().over(Window.partitionBy(kind).orderBy(order))
    # the largest target first: each task then keeps no more rows of a kind than that
    near = rows.withColumn("place", place).where(F.col("place") <= max(target.values(), default=0))
    return near.where(F.col("place") <= F.coalesce(F.try_element_at(most, F.col(kind)), F.lit(0))).drop("place")


def question_id(n: Column) -> Column:
    return F.format_string("gs_%03d", n)


def public_columns(rows: DataFrame) -> DataFrame:
    """Without the columns whose name begins with an underscore."""
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])
