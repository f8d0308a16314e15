"""Vector search that filters inside its index: cells of near vectors that tell which rows they hold.

Centres are fitted on at most ``SAMPLE`` vectors, every vector is filed under its nearest centre, and a summary
counts the rows of each cell by the values of the filter columns.  A filter is asked of the summary first:
cells without a fitting row are never read, and a question's nearest cells are taken until they hold
enough rows *that fit*.  How many are enough is measured when the index is built, on stored vectors
against all others.  Fewer fitting rows than that are compared one by one, so a narrow filter is exact.

Cosines of what remains are exact, in double precision, and ranked as by the plain search.  Cells of over
``PART_ROWS`` rows are read in parts, so equal vectors, which share a cell, are no single task's work.
The questions of a part are dealt in groups of at most ``GROUP``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.files import remove
from ..sources.scratch import ship_package, stored
from .lexical import ranked

#: Vectors that centres are fitted on, and centres at most: with these the fitted table is bounded, whatever is stored.
SAMPLE, CELLS, ROUNDS = 20_000, 4096, 12
#: Stored vectors that measure how far a search must go, and the share of true neighbours they must find.
ASKED, NEIGHBOURS, RECALL = 200, 10, 0.97
PART_ROWS, GROUP = 20_000, 256


@dataclass(frozen=True)
class CellIndex:
    """``vectors(id, v, <columns>, part, cell)``, ``centres(cell, centre)``, ``summary(cell, <columns>, n)`` and the rows that are enough."""

    vectors: DataFrame
    centres: DataFrame
    summary: DataFrame
    enough: int

    @staticmethod
    def load(spark: SparkSession, path: str) -> "CellIndex":
        read = lambda part: spark.read.parquet(f"{path}/{part}")
        return CellIndex(read("vectors"), read("centres"), read("summary"), read("enough").head().enough)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fitted(sample: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        near = np.concatenate([(sample[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        full = np.linalg.norm(sums, axis=1) > 0
        centres = np.where(full[:, None], _unit(sums), centres)
    return centres


def _usable(vectors: DataFrame) -> DataFrame:
    """Vectors with a direction: not null, finite, and not all zero."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False)))


def store_cells(vectors: DataFrame, path: str, columns: list[str], enough: int | None = None) -> CellIndex:
    """Build and write the index of ``vectors(id, v, <columns>)``.  ``enough`` is measured unless it is given."""
    spark = vectors.sparkSession
    ship_package(spark)
    remove(spark, path)
    rows = stored(_usable(vectors.select("id", F.col("v").cast("array<double>").alias("v"), *columns)), "vectors")
    n = rows.count()
    if not n:
        raise ValueError("no vectors to index")
    share = min(1.0, 1.5 * SAMPLE / max(n, 1))
    some = rows.select("v").sample(share, seed=1) if share < 1 else rows.select("v")
    sample = _unit(np.array([r.v for r in some.limit(SAMPLE).collect()], float))
    cells = max(1, min(CELLS, int(np.sqrt(n)), len(sample) // 4))
    centres = fitted(sample, cells)

    def file(batches):
        for pdf in batches:
            x = _unit(np.stack(pdf["v"].to_numpy()).astype(float))
            yield pdf.assign(cell=(x @ centres.T).argmax(1).astype("int32"))

    filed = stored(rows.mapInPandas(file, StructType([*rows.schema.fields, StructField("cell", IntegerType())])), "filed")
    sizes = filed.groupBy("cell").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / PART_ROWS)).cast("int")
    placed = filed.join(F.broadcast(sizes), "cell").withColumn("part", part).drop("size")  # a row for each cell
    placed.repartition("cell", "part").sortWithinPartitions("cell", "part", *columns).write.partitionBy("cell").parquet(f"{path}/vectors")
    table = [(k, c.tolist()) for k, c in enumerate(centres)]
    spark.createDataFrame(table, "cell int, centre array<double>").write.parquet(f"{path}/centres")
    filed.groupBy("cell", *columns).agg(F.count("*").alias("n")).write.parquet(f"{path}/summary")
    if enough is None:
        enough = _measured(CellIndex(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centres"), spark.read.parquet(f"{path}/summary"), n), n)
    spark.createDataFrame([(int(enough),)], "enough long").write.parquet(f"{path}/enough")
    return CellIndex.load(spark, path)


def _measured(index: CellIndex, n: int) -> int:
    """Rows that must be compared for ``RECALL``: where, in the order of its cells, each true neighbour of asked vectors is met."""
    asked = index.vectors.orderBy(F.xxhash64(F.lit(2), "id")).limit(ASKED).select(F.col("id").alias("qid"), "v")
    asked = stored(asked, "asked")
    exact = search(index, asked, NEIGHBOURS + 1).where("qid <> id")
    # rows up to and with each cell of a question
    order = Window.partitionBy("qid").orderBy(F.col("near").desc(), "cell")
    sizes = index.summary.groupBy("cell").agg(F.sum("n").alias("n"))
    met = _nearness(index, asked).join(sizes, "cell").withColumn("upto", F.sum("n").over(order))
    homes = index.vectors.select("id", "cell").join(F.broadcast(exact.select("id").distinct()), "id", "left_semi")  # ASKED * NEIGHBOURS ids
    depth = exact.join(homes, "id").join(met.select("qid", "cell", "upto"), ["qid", "cell"])
    found = depth.agg(F.percentile("upto", F.lit(RECALL)).alias("upto")).head().upto
    return int(min(n, found or n))


def _nearness(index: CellIndex, queries: DataFrame) -> DataFrame:
    """``qid, cell, near``: how near each question (``qid, v``) is to each centre."""
    table = index.centres.orderBy("cell").collect()  # CELLS rows at most
    centres, named = np.array([r.centre for r in table]), [r.cell for r in table]

    def run(batches):
        for pdf in batches:
            if len(pdf):
                near = _unit(np.stack(pdf["v"].to_numpy()).astype(float)) @ centres.T
                yield pd.DataFrame({"qid": np.repeat(pdf["qid"].to_numpy(), len(named)), "cell": named * len(pdf), "near": near.ravel()})

    ship_package(queries.sparkSession)
    kind = f"qid {dict(queries.dtypes)['qid']}, cell int, near double"
    return _usable(queries.select("qid", F.col("v").cast("array<double>").alias("v"))).mapInPandas(run, kind)


def chosen(index: CellIndex, queries: DataFrame, keep: Column | None = None) -> DataFrame:
    """``qid, cell, n``: the cells that a question reads, and how many rows that fit each holds."""
    fit = index.summary if keep is None else index.summary.where(keep)
    fit = fit.groupBy("cell").agg(F.sum("n").alias("n"))
    near = _nearness(index, queries).join(F.broadcast(fit), "cell")  # a row for each cell
    before = Window.partitionBy("qid").orderBy(F.col("near").desc(), "cell").rowsBetween(Window.unboundedPreceding, -1)
    return near.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < index.enough).select("qid", "cell", "n")


def search(index: CellIndex, queries: DataFrame, k: int = 30, keep: Column | None = None) -> DataFrame:
    """Top ``k`` per query (``qid, v``) by cosine, as ``qid, id, score, rank``; ``keep`` is a condition on the index's columns."""
    rows = index.vectors if keep is None else index.vectors.where(keep)
    wanted = stored(chosen(index, queries, keep), "chosen")
    # cells that nobody asks for are not read
    cells = [r.cell for r in wanted.select("cell").distinct().collect()]
    rows = rows.where(F.col("cell").isin(cells))
    parts = rows.select("cell", "part").distinct()
    groups = F.pmod(F.xxhash64("qid"), F.ceil(F.count("*").over(Window.partitionBy("cell")) / GROUP)).cast("int")
    dealt = stored(wanted.withColumn("group", groups).select("qid", "cell", "group"), "dealt")
    asked = dealt.join(queries.select("qid", F.col("v").cast("array<double>").alias("v")), "qid").join(parts, "cell")
    held = rows.select("cell", "part", "id", "v").join(dealt.select("cell", "group").distinct(), "cell")
    id_kind, qid_kind = dict(rows.dtypes)["id"], dict(queries.dtypes)["qid"]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": [], "id": [], "score": []})
        ids, out = left["id"].to_numpy(), []
        for row, scores in zip(right["qid"], _unit(np.stack(right["v"].to_numpy())) @ _unit(np.stack(left["v"].to_numpy())).T):
            own = ids != row if id_kind == qid_kind else np.ones(len(ids), bool)
            mine, at = np.round(scores[own], 9), np.flatnonzero(own)
            if len(at) > k:  # all that tie with the k-th stay; their order is by id
                fit = mine >= np.partition(mine, -k)[-k]
                mine, at = mine[fit], at[fit]
            first = np.lexsort((ids[at].astype(str) if id_kind == "string" else ids[at], -mine))[:k]
            out.append(pd.DataFrame({"qid": row, "id": ids[at[first]], "score": scores[at[first]]}))
        return pd.concat(out)

    asked = asked.select(F.col("cell").alias("in_cell"), F.col("part").alias("in_part"), F.col("group").alias("of"), "qid", "v")
    found = held.groupBy("cell", "part", "group").cogroup(asked.groupBy("in_cell", "in_part", "of")).applyInPandas(best, f"qid {qid_kind}, id {id_kind}, score double")
    return ranked(found, k)
