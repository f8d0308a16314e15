"""Nearest neighbours: score-aware quantisation, four-bit table scans, exact reranking.

Vectors are grouped by value first: copies are one entry with the ``KEEP`` smallest ids, so a
vector that fills a third of the table is scanned once and can't crowd out other neighbours.

* Cells: each entry goes to the nearest of about as many centres as the root of the number of
  entries; a cell with many entries is dealt into parts of bounded size.
* Codes: what is left of the centre, brought to length one, is cut into pieces of ``SUB`` values, each replaced by one
  of 16 words.  Words are chosen and trained by the anisotropic loss: the part of the error
  that is parallel to what is left weighs ``ETA`` times the rest, since it is that part which
  changes large inner products.
* Scan: nearness of q and x is ``-|q - x|^2 / 2``, that is ``(q - c).r - |r|^2 / 2 - |q - c|^2 / 2`` for the centre
  c and ``r = x - c``.  Lengths are exact, ``(q - c).r`` is read from tables of 256 sums, one for each pair
  of four-bit codes.  So errors are as large as the cell, however far from zero it lies.
* Each query probes its best cells.  How many is measured when the index is built: as many as
  hold ``PROBE_TARGET`` of the true neighbours of ``PROBE_ASKED`` sampled vectors among the
  sample.  Clustered vectors need few cells, vectors without any structure most of them.  The best candidates are compared exactly with
  the original vectors in double precision.
* How many candidates is measured over the whole index: the exact neighbours of ``DEPTH_ASKED``
  of the queries among all vectors are ranked by their codes among all probed ones, and as many are
  compared as hold ``DEPTH_TARGET`` of them, ``RERANK`` at least.  The probes are raised likewise.

Centres and words are trained on at most ``SAMPLE`` vectors, those of the smallest id hashes;
every vector is indexed.

Queries and codes meet in bundles of neighbouring cells, about ``BLOCK_ROWS`` entries each, in
tasks of one bundle and at most about ``QUERY_ROWS`` of the queries; neither side is broadcast.
Codes of a bundle that more queries probe are sent once for each such part of them.  A query asks
the bundle of its best cell first.  The nearness of the last of the candidates found there goes
with it to the other bundles, which pass on only what is at least as near, and never more than
the number of candidates: what leaves the scan grows with the bundles, not with the entries.

``search(..., exact=True)`` compares all vectors instead: a stated set of queries, in blocks of
``QUERY_BYTES``, against every task's vectors, each of which passes its nearest on.

Defined results: vectors that are null, empty, zero or hold a null or a value that isn't
finite take no part, nor do rows without an id; repeated rows of one id and vector are
neighbours of one another's vector but never of their own id; other columns are not read; of vectors with different lengths the most
frequent length takes part (ties: the shorter); ties in distance go to the smaller id; fewer
candidates than asked for give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize, small_batches, table

SUB, WORDS = 2, 16
#: Threshold of the score-aware loss, as a share of a vector's length.
THRESHOLD = 0.2
SAMPLE, ROUNDS = 20_000, 8
#: Entries of a bundle of cells, or of a part of a large cell.
BLOCK_ROWS = 8192
#: Queries that meet a bundle in one task, and bytes of the queries that are compared exactly at once.
QUERY_ROWS, QUERY_BYTES = 4096, 8 << 20
#: Share of the sample's true neighbours that the probed cells must hold, and vectors that are asked.
PROBE_TARGET, PROBE_ASKED = 0.98, 256
RERANK = 100
#: Share of the true neighbours among all vectors that the compared candidates must hold, and vectors that are asked.
DEPTH_TARGET, DEPTH_ASKED = 0.96, 128


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    return rows.where(F.size("v") == (lengths[0] if lengths else 0))


def _first_ids(keep: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: dict[bytes, list[int]] = {}
            for i, v in zip(pdf["vec_id"], pdf["v"]):
                held.setdefault((np.asarray(v, float) + 0.0).tobytes(), []).append(i)
            yield pd.DataFrame({"v": [np.frombuffer(k) for k in held], "ids": [sorted(x)[:keep] for x in held.values()]})

    return run


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """``v`` and its smallest ids; each task sends a vector once however often it has it."""
    parts = rows.mapInPandas(_first_ids(keep), "v array<double>, ids array<long>")
    some = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep)
    return parts.groupBy("v").agg(some.alias("ids")).select(F.col("ids")[0].alias("entry"), "v", "ids")


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centre)
        count = np.bincount(near, minlength=len(centre))
        total = np.stack([np.bincount(near, x[:, j], len(centre)) for j in range(x.shape[1])], axis=1)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
        if len(empty := np.flatnonzero(count == 0)):
            centre[empty] = x[rng.choice(len(x), len(empty))]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 1024] @ centre.T - half, axis=1) for i in range(0, len(x), 1024)]) if len(x) else np.empty(0, np.int64)


def _in_line(centre: np.ndarray) -> np.ndarray:
    """The centres in order of their main direction, so that numbers next to each other are neighbours."""
    main = np.linalg.svd(centre - centre.mean(axis=0), full_matrices=False)[2][0]
    return centre[np.argsort(centre @ main, kind="stable")]


def bundles(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each cell, by the cells' sizes, and the parts that each bundle is dealt into."""
    bundle, held, number = np.zeros(len(sizes), np.int64), 0, 0
    for cell, size in enumerate(sizes):
        if held and held + size > BLOCK_ROWS:
            number, held = number + 1, 0
        bundle[cell] = number
        held += size
    return bundle, np.maximum(1, np.ceil(np.bincount(bundle, sizes) / BLOCK_ROWS)).astype(np.int64)


class Codebook:
    """Centres of the cells and 16 words for each piece of what is left."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.dim = sample.shape[1]
        self.pieces = math.ceil(self.dim / SUB)
        self.pieces += self.pieces % 2
        self.eta = max(1.0, (self.dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        self.centre = _in_line(kmeans(sample, cells, ROUNDS))
        cell = nearest(sample, self.centre)
        left, unit, _ = self._split(sample, cell)
        self.word = np.stack([np.resize(kmeans(left[:, m], WORDS, 4, m), (WORDS, SUB)) for m in range(self.pieces)])
        for _ in range(ROUNDS):
            self._train(left, unit, self._chosen(left, unit))
        self.n_probe = self._tuned(sample, cell)

    def _tuned(self, sample: np.ndarray, cell: np.ndarray, k: int = 10) -> int:
        """The fewest probes that reach the target."""
        asked = sample[:PROBE_ASKED]
        far = (sample**2).sum(axis=1) / 2 - asked @ sample.T
        far[np.arange(len(asked)), np.arange(len(asked))] = np.inf
        true = np.argsort(far, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        if not true.size:
            return len(self.centre)
        place = np.argsort(self.probes(asked, len(self.centre)), axis=1)
        needed = np.sort(np.take_along_axis(place, cell[true], 1).ravel())
        return int(needed[math.ceil(PROBE_TARGET * len(needed)) - 1]) + 1

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.pieces * SUB - self.dim))).reshape(len(x), self.pieces, SUB)

    def _split(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is left of the centres as unit vectors, the direction whose errors weigh more, which is the same, and the lengths."""
        left = x - self.centre[cell]
        scale = np.maximum(np.linalg.norm(left, axis=1), 1e-300)
        left = self._padded(left / scale[:, None])
        return left, left, scale

    def _choose(self, left: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Codes of least loss, one piece at a time with the others held."""
        n, at = len(left), np.arange(len(left))
        plain = ((left[:, :, None] - self.word) ** 2).sum(axis=3)
        along = ((left[:, :, None] - self.word) * unit[:, :, None]).sum(axis=3)
        code = plain.argmin(axis=2)
        total = np.take_along_axis(along, code[:, :, None], 2).sum(axis=(1, 2))
        for _ in range(2):
            for m in range(self.pieces):
                rest = total - along[at, m, code[:, m]]
                code[:, m] = (plain[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = rest + along[at, m, code[:, m]]
        return code.reshape(n, self.pieces)

    def _chosen(self, left: np.ndarray, unit: np.ndarray, rows: int = 1024) -> np.ndarray:
        """``_choose`` for many vectors, some at a time."""
        return np.concatenate([self._choose(left[i : i + rows], unit[i : i + rows]) for i in range(0, len(left), rows)])

    def _train(self, left: np.ndarray, unit: np.ndarray, code: np.ndarray) -> None:
        """Words of least loss for the codes: a small linear system each."""
        at = np.arange(self.pieces)
        error = ((left - self.word[at, code]) * unit).sum(axis=2)
        for m in range(self.pieces):
            rest = error.sum(axis=1) - error[:, m]
            for c in range(WORDS):
                mine = code[:, m] == c
                if mine.any():
                    u, x = unit[mine, m], left[mine, m]
                    a = np.eye(SUB) * len(x) + (self.eta - 1) * u.T @ u
                    b = x.sum(axis=0) + (self.eta - 1) * (u * (rest[mine] + (x * u).sum(axis=1))[:, None]).sum(axis=0)
                    self.word[m, c] = np.linalg.solve(a, b)
            error[:, m] = ((left[:, m] - self.word[m, code[:, m]]) * unit[:, m]).sum(axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes (two in a byte) and length of what is left for each vector."""
        cell = nearest(x, self.centre)
        left, unit, scale = self._split(x, cell)
        code = self._chosen(left, unit)
        return cell, (code[:, 0::2] | code[:, 1::2] << 4).astype(np.uint8), scale

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n cells whose centres are nearest to each query."""
        score = q @ self.centre.T - (self.centre**2).sum(axis=1) / 2
        return np.argsort(-score, axis=1, kind="stable")[:, :n]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte of codes the 256 sums of inner products."""
        one = np.einsum("qms,mcs->qmc", self._padded(q), self.word)
        return (one[:, 1::2, :, None] + one[:, 0::2, None, :]).reshape(len(q), -1, 256)

    @staticmethod
    def sums(table_of: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Inner products of each query, by its tables, and each code."""
        near = np.zeros((len(table_of), len(code)))
        for b in range(code.shape[1]):
            near += table_of[:, b][:, code[:, b]]
        return near


def sample_of(entries: DataFrame, size: int = SAMPLE) -> np.ndarray:
    """At most ``size`` vectors, those of the smallest hashes of their ids."""
    rows = entries.orderBy(F.xxhash64("entry"), "entry").limit(size).select("v").toPandas()["v"]
    return np.array(rows.tolist(), float)


def _encode(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), float)
            cell, code, scale = shared.value.encode(x)
            yield pd.DataFrame({"entry": pdf["entry"], "cell": cell, "scale": scale, "code": [c.tobytes() for c in code]})

    return run


def _probe(shared, n: int, bundle: np.ndarray):
    """For each query the bundles that hold its best cells, with those cells; ``first``: that of the best one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = shared.value.probes(np.array(pdf["v"].tolist(), float), n).astype(np.int32)
            for query, v, mine in zip(pdf["entry"], pdf["v"], cells):
                of = bundle[mine]
                each = np.unique(of)
                yield pd.DataFrame({"query": query, "v": [v] * len(each), "bundle": each, "cells": [mine[of == b] for b in each], "first": each == of[0]})

    return run


def _scan(shared, top: int):
    """A part of a bundle: its codes (``v`` null) and the queries that probe it; at most ``top`` entries for each."""

    def best(who: np.ndarray, at: np.ndarray, near: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best of each query; raises its floor to the last of them."""
        order = np.lexsort((at, -near, who))
        who, at, near = who[order], at[order], near[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        last = place == top - 1
        floor[who[last]] = np.maximum(floor[who[last]], near[last])
        kept = place < top
        return who[kept], at[kept], near[kept]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf["code"].notna()
        codes, queries = pdf[mine].sort_values("id"), pdf[~mine]
        codes = codes.sort_values("cell", kind="stable")
        out = {"query": np.empty(0, np.int64), "entry": np.empty(0, np.int64), "near": np.empty(0)}
        if not len(codes) or not len(queries):
            return pd.DataFrame(out)
        book, entry = shared.value, codes["id"].to_numpy()
        code = np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(codes), -1)
        scale = codes["scale"].to_numpy()
        held, start = np.unique(codes["cell"].to_numpy().astype(np.int64), return_index=True)
        end = np.append(start[1:], len(codes))
        of_centre = np.concatenate([book.sums(book.tables(book.centre[[c]]), code[a:b])[0] for c, a, b in zip(held, start, end)])
        parts = []
        for begin in range(0, len(queries), 64):
            some = queries.iloc[begin : begin + 64]
            q, floor = np.array(some["v"].tolist(), float), some["floor"].to_numpy(float, na_value=-np.inf).copy()
            table_of = book.tables(q)
            asks = np.zeros((len(q), len(book.centre)), bool)
            for i, cells in enumerate(some["cells"]):
                asks[i, cells] = True
            found, waiting = [], 0
            for c, a, b in zip(held, start, end):
                who = np.flatnonzero(asks[:, c])
                near = (book.sums(table_of[who], code[a:b]) - of_centre[a:b]) * scale[a:b] - scale[a:b] ** 2 / 2
                near -= ((q[who] - book.centre[c]) ** 2).sum(axis=1)[:, None] / 2
                i, j = np.nonzero(near >= floor[who, None])  # ties go on: the smaller id may be elsewhere
                found.append((who[i], entry[a + j], near[i, j]))
                waiting += len(i)
                if waiting > 4 * top * len(q):
                    found = [best(*(np.concatenate(x) for x in zip(*found)), floor)]
                    waiting = len(found[0][0])
            who, at, near = best(*(np.concatenate(x) for x in zip(*found)), floor)
            parts.append((some["id"].to_numpy()[who], at, near))
        return pd.DataFrame(dict(zip(out, (np.concatenate(x) for x in zip(*parts)))))

    return run


def _exact(shared, k: int, skip_own: bool):
    """The nearest entries in each task of the asked vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, q = shared.value
        for pdf in batches:
            pdf = pdf.sort_values("entry")
            x, entry = np.array(pdf["v"].tolist(), float), pdf["entry"].to_numpy()
            for at in range(0, len(q), 256):
                far = (x**2).sum(axis=1) / 2 - q[at : at + 256] @ x.T
                if skip_own:
                    far[own[at : at + 256, None] == entry] = np.inf
                order = np.argsort(far, axis=1, kind="stable")[:, :k]
                out = pd.DataFrame({"asked": np.repeat(np.arange(at, at + len(far)), order.shape[1]), "entry": entry[order].ravel(), "far": np.take_along_axis(far, order, 1).ravel()})
                yield out[np.isfinite(out["far"])]

    return run


def exact_best(entries: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """``query, entry``: the ``top`` nearest of all entries for each of ``asked`` (``entry, v``), by comparing all."""
    spark = entries.sparkSession
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).head()
    found, blocks = [], max(1, math.ceil(n * (width or 0) * 8 / QUERY_BYTES))
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("entry"), F.lit(blocks)) == b).select("entry", "v").toPandas()
        if len(some):
            shared = spark.sparkContext.broadcast((some["entry"].to_numpy(), np.array(some["v"].tolist(), float)))
            close = entries.select("entry", "v").mapInPandas(_exact(shared, top, False), "asked int, entry long, far double")
            named = F.broadcast(spark.createDataFrame([(i, int(e)) for i, e in enumerate(some["entry"])], "asked int, query long"))
            found.append(materialize(_top(close, "asked", ["far", "entry"], top).join(named, "asked").select("query", "entry"), "ann-exact"))
            shared.unpersist()
    return functools.reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query long, entry long")


def _ahead(shared):
    """How many probed entries of each task come before each true neighbour by their codes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, q, probed, asked, limit = shared.value
        table_of, count = book.tables(q), np.zeros(len(asked), np.int64)
        for pdf in batches:
            near = _nearness(book, q, table_of, pdf)
            near[~probed[:, pdf["cell"].to_numpy()]] = -np.inf
            near.sort(axis=1)
            for i, (a, at) in enumerate(zip(asked, limit)):
                count[i] += near.shape[1] - np.searchsorted(near[a], at, "right")
        yield pd.DataFrame({"i": np.arange(len(asked)), "n": count})

    return run


def _nearness(book: Codebook, q: np.ndarray, table_of: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
    near, scale = book.sums(table_of, code), rows["scale"].to_numpy()
    for cell, at in rows.groupby("cell", sort=False).indices.items():
        centre = book.centre[cell]
        near[:, at] -= book.sums(book.tables(centre[None]), code[at])
        near[:, at] = near[:, at] * scale[at] - scale[at] ** 2 / 2 - ((q - centre) ** 2).sum(axis=1)[:, None] / 2
    return near


def measured(entries: DataFrame, asked: DataFrame, coded: DataFrame, book: Codebook, k: int) -> tuple[int, int]:
    """Probes and candidates that hold the targets' shares of the queries' true neighbours among all entries."""
    spark = entries.sparkSession
    chosen = F.broadcast(asked.orderBy(F.xxhash64("entry"), "entry").limit(DEPTH_ASKED).select("v"))
    some = entries.join(chosen, "v", "left_semi").select("entry", "v").toPandas()
    q = np.array(some["v"].tolist(), float)
    own = spark.sparkContext.broadcast((some["entry"].to_numpy(), q))
    close = entries.select("entry", "v").mapInPandas(_exact(own, k, True), "asked int, entry long, far double")
    true = _top(close, "asked", ["far", "entry"], k).select("asked", "entry").join(coded, "entry").toPandas()
    if not len(true):
        return book.n_probe, RERANK
    asked = true["asked"].to_numpy()
    place = np.argsort(book.probes(q, len(book.centre)), axis=1)
    at = place[asked, true["cell"].to_numpy()]
    n_probe = max(book.n_probe, int(np.sort(at)[math.ceil(PROBE_TARGET * len(at)) - 1]) + 1)
    limit = _nearness(book, q, book.tables(q), true)[asked, np.arange(len(true))]
    shared = spark.sparkContext.broadcast((book, q, place < n_probe, asked, limit))
    ahead = coded.mapInPandas(_ahead(shared), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas().set_index("i")["n"]
    rank = np.where(at < n_probe, ahead.reindex(range(len(true))).to_numpy() + 1, np.inf)
    depth = np.sort(rank)[math.ceil(DEPTH_TARGET * len(rank)) - 1]
    return n_probe, max(RERANK, int(depth) + 1)


def coded_best(entries: DataFrame, asked: DataFrame, k: int, n: int) -> DataFrame:
    """``query, entry``: the candidates of each of ``asked`` by its codes, as many as were measured."""
    spark = entries.sparkSession
    book = Codebook(sample_of(entries), math.isqrt(n - 1) + 1)
    shared = spark.sparkContext.broadcast(book)
    coded = materialize(entries.select("entry", "v").mapInPandas(_encode(shared), "entry long, cell int, scale double, code binary"), "ann-codes")
    n_probe, depth = measured(entries, asked, coded, book, k)
    sizes = coded.groupBy("cell").count().toPandas()  # a row for each centre, of which there are at most SAMPLE
    entries_in = np.zeros(len(book.centre), np.int64)
    entries_in[sizes["cell"]] = sizes["count"]
    bundle, parts = bundles(entries_in)
    placed = F.broadcast(spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(bundle)), "bundle": bundle, "parts": parts[bundle]})))
    dealt = F.broadcast(spark.createDataFrame(pd.DataFrame({"bundle": np.arange(len(parts)), "parts": parts})))
    probed = materialize(asked.mapInPandas(_probe(shared, n_probe, bundle), "query long, v array<double>, bundle long, cells array<int>, first boolean"), "ann-probes")

    # a large cell has several parts; a query goes to each of them, an entry to one, for each part of the queries
    one = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)

    def scanned(asking: DataFrame) -> DataFrame:
        load = materialize(asking.groupBy("bundle").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("turns")), "ann-load")
        left = coded.join(placed, "cell").join(load.hint("merge"), "bundle").select(
            "bundle", one("entry", "parts").alias("part"), every("turns").alias("turn"), F.col("entry").alias("id"), "cell", "scale", "code", none("array<double>", "v"), none("array<int>", "cells"), none("double", "floor")
        )
        right = asking.join(dealt, "bundle").join(load.hint("merge"), "bundle").select(
            "bundle", every("parts").alias("part"), one("query", "turns").alias("turn"), F.col("query").alias("id"), none("int", "cell"), none("double", "scale"), none("binary", "code"), "v", "cells", "floor"
        )
        return left.union(right).groupBy("bundle", "part", "turn").applyInPandas(_scan(shared, depth), "query long, entry long, near double")

    order = [F.desc("near"), "entry"]
    first = scanned(probed.where("first").withColumn("floor", F.lit(None).cast("double")))
    first = materialize(_top(first, "query", order, depth).select("query", "entry", "near"), "ann-first")
    floor = first.groupBy("query").agg(F.when(F.count("*") >= depth, F.min("near")).alias("floor"))
    rest = scanned(probed.where("not first").join(floor.hint("merge"), "query", "left"))
    return _top(first.union(rest), "query", order, depth)


def search(vectors: DataFrame, is_query, k: int = 10, exact: bool = False) -> DataFrame:
    """The ``k`` nearest other rows of each row that ``is_query`` holds for.

    ``query_id, rank, vec_id, score``; the score is the Euclidean distance.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    rows = materialize(usable(vectors), "ann-rows")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    entries = materialize(distinct_vectors(rows, k + 1), "ann-entries")
    n = entries.count()
    if not n:
        return empty
    asked = distinct_vectors(rows.where(is_query), 1).select("entry", "v")
    best = exact_best(entries, asked, 2 * k + 10) if exact else coded_best(entries, asked, k, n)

    queries = asked.select(F.col("entry").alias("query"), F.col("v").alias("qv"))
    gap = F.sqrt(F.aggregate(F.zip_with("qv", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    compared = best.join(entries, "entry").join(queries, "query").select("query", "ids", gap.alias("score"))
    # an entry stands for its smallest ids; only then is a query told from its copies
    ranked = _top(compared.select("query", "score", F.explode("ids").alias("vec_id")), "query", ["score", "vec_id"], k + 1)
    ranked = materialize(ranked.select("query", "score", "vec_id"), "ann-ranked")
    # each query row takes its own vector's list, without itself
    named = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")).join(queries, "qv").select("query_id", "query")
    whole = named.join(ranked, "query").where("query_id <> vec_id")
    return _top(whole, "query_id", ["score", "vec_id"], k).select("query_id", F.col("place").cast("int").alias("rank"), "vec_id", "score")


def _top(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
