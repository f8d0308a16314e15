"""Connected components of a link table, by alternating star contraction.

The graph stays in tables: each round joins every link with the smallest neighbour of its
end and is written to the shared folder, so a lost executor costs one round at most.  The
smallest neighbours are an aggregate with partial sums; they are written before the join, so
that both sides of it are plain shuffles and Spark may split a hub's links over many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import materialize


def local_components(label: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Labels (index of the smallest member) after joining the pairs of indices."""
    i = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.int64)
    j = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.int64)
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every end of a link; the root is the smallest node of its component.

    ``links`` has two columns of one type, ``a`` and ``b``.  Self links are ignored.
    """
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _sum(links)
    for _ in range(rounds):
        if not before[0]:
            break
        # large star: the larger neighbours of u go to the smallest of u and its neighbours
        ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
        both = links.select(ends).select("e.u", "e.v")
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        links = materialize(links.withColumnsRenamed({"b": "u"}).join(least, "u").select("a", F.col("m").alias("b")).where("a <> b").distinct(), "links")
        # small star: u and its smaller neighbours go to the smallest of them
        least = materialize(links.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = links.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        links = materialize(moved.select("e.a", "e.b").where("a <> b").distinct(), "links")
        after = _sum(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
