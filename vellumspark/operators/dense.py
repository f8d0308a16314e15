"""Exact cosine search over stored vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import ship_package, stored
from .lexical import ranked

#: Bytes of query vectors that are sent to every task at most; more are joined block by block.
BROADCAST_BYTES = 8 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, id, score`` for ``vectors(id, v)`` and ``queries(qid, v)``; a query never meets itself
    (ids of different types name different things).

    A stated query set against all rows: the queries go to the vectors in blocks of a proven
    size, one broadcast each.
    """
    unit = vectors.select("id", "v", norm(F.col("v")).alias("vn")).where("vn > 0")
    asked = queries.select("qid", F.col("v").alias("qv"), norm(F.col("v")).alias("qn")).where("qn > 0")
    size = queries.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).head()[0] * 8
    blocks = max(1, -(-int(size) // BROADCAST_BYTES))
    parts = [asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k) for k in range(blocks)]
    score = dot(F.col("v"), F.col("qv")) / (F.col("vn") * F.col("qn"))
    other = F.col("qid") != F.col("id") if dict(queries.dtypes)["qid"] == dict(vectors.dtypes)["id"] else F.lit(True)
    found = [unit.crossJoin(F.broadcast(p)).where(other).select("qid", "id", score.alias("score")) for p in parts]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def same_size(vectors: DataFrame, queries: DataFrame) -> None:
    """Raises unless the questions' vectors are as long as the stored ones (``v``): another model made them."""
    sizes = [d.where("v is not null").select(F.size("v").alias("n")).head() for d in (vectors, queries)]
    if all(sizes) and sizes[0].n != sizes[1].n:
        raise ValueError(f"stored vectors have {sizes[0].n} values, the questions' {sizes[1].n}")


#: Vectors of a task that are compared at once, and scores that are held at once.
ROWS, TILE = 8192, 1 << 21


def _plain(ids: pd.Series) -> np.ndarray:
    return ids.to_numpy().astype(str) if ids.dtype == object else ids.to_numpy()


def _some_at_once(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Rows with vectors of this length, ``ROWS`` or more at once but for the last."""
    waiting, n = [], 0
    for pdf in batches:
        waiting.append(pdf[pdf["v"].map(len) == width])
        n += len(waiting[-1])
        if n >= ROWS:
            yield pd.concat(waiting)
            waiting, n = [], 0
    if n:
        yield pd.concat(waiting)


def _nearest(shared, k: int, same_ids: bool):
    """The best ``k`` vectors of each task for every query of a block: products of matrices, ranked as ``ranked`` does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q = shared.value
        held: list = [None] * len(qid)  # per query: scores by nine digits, ids, scores
        for pdf in _some_at_once(batches, q.shape[1]):
            x, ids = np.stack(pdf["v"].to_numpy()).astype(float), _plain(pdf["id"])
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            rows = max(1, TILE // len(ids))
            for at in range(0, len(qid), rows):
                score = q[at : at + rows] @ x.T
                if same_ids:
                    own = np.minimum(np.searchsorted(ids, qid[at : at + rows]), len(ids) - 1)
                    for i in np.flatnonzero(ids[own] == qid[at : at + rows]):
                        score[i, ids == qid[at + i]] = -np.inf
                digits = score.round(9)
                if np.isnan(digits).any():
                    digits[np.isnan(digits)] = np.inf  # as Spark orders them
                last = len(ids) - min(k, len(ids))
                least = np.partition(digits, last, axis=1)[:, last]
                for i in range(len(score)):
                    floor = least[i] if held[at + i] is None or len(held[at + i][0]) < k else max(least[i], held[at + i][0][-1])
                    near = np.flatnonzero(digits[i] >= floor)  # ties of the last one too
                    near = near[score[i, near] != -np.inf]
                    if not len(near):
                        continue
                    best = digits[i, near], ids[near], score[i, near]
                    if held[at + i] is not None:
                        best = tuple(map(np.concatenate, zip(held[at + i], best)))
                    first = np.lexsort((best[1], -best[0]))[:k]
                    held[at + i] = tuple(b[first] for b in best)
        for i, best in enumerate(held):
            if best is not None:
                yield pd.DataFrame({"asked": i, "id": best[1], "score": best[2]})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 30, keep: Column | None = None) -> DataFrame:
    """Top ``k`` per query by cosine; ``keep`` filters the vectors before.

    A stated query set against all rows: queries go out in blocks of ``BROADCAST_BYTES``, each task compares
    them with its vectors and passes on ``k`` for each query.  Vectors that are null, zero or hold a
    null take no part, nor do those of another length than a query's.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    fine = lambda d: d.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & (norm(F.col("v")) > 0))
    same_ids = dict(queries.dtypes)["qid"] == dict(vectors.dtypes)["id"]
    unit = fine(vectors if keep is None else vectors.where(keep)).select("id", "v").where(F.col("id").isNotNull())
    # a small file is one task's work otherwise
    unit = unit.repartition(spark.sparkContext.defaultParallelism)
    asked = stored(fine(queries).where(F.col("qid").isNotNull()).select("qid", "v", F.size("v").alias("n")), "dense-asked")
    out = None
    for width in sorted(asked.groupBy("n").agg(F.count("*").alias("rows")).collect(), key=lambda r: r.n):  # a row a length
        blocks = -(-width.rows * width.n * 8 // BROADCAST_BYTES)
        for b in range(blocks):
            some = asked.where((F.col("n") == width.n) & (F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)).select("qid", "v").toPandas()
            if not len(some):
                continue
            q = np.array(some["v"].tolist(), float)
            q /= np.sqrt((q * q).sum(axis=1))[:, None]
            shared = spark.sparkContext.broadcast((_plain(some["qid"]), q))
            found = unit.mapInPandas(_nearest(shared, k, same_ids), f"asked int, id {dict(vectors.dtypes)['id']}, score double")
            named = F.broadcast(spark.createDataFrame(list(zip(range(len(some)), some["qid"].tolist())), f"asked int, qid {dict(queries.dtypes)['qid']}"))
            part = found.join(named, "asked").select("qid", "id", "score")
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, id {dict(vectors.dtypes)['id']}, score double")
    return ranked(out, k)
