"""Audit of how a language's sources differ in their words, by a systolic rotation.

Terms are counted for each source of each language, and those of at least ``LEAST_DOCS`` of the language's
documents are kept.  A source's vector holds the smoothed share ``p`` of every kept term, in billionths.
Terms are dealt into blocks, and a language's sources into at most ``CELLS`` cells of as many sources each.
One row holds a cell's vectors of one block: compressed (zstandard), only terms that a source has,
and one value for all others.

The rows are dealt to partitions by language, block and cell, and stay there.  Then copies of
them go round as in a tournament: in each round every cell meets another one, the copy of the later
goes to where the earlier lives, and both directions are told from the meeting, since the distance
of two sources is the same from either.  After the last round each cell has met each other once;
sources of one cell meet at home.  A round's results are a table of their own, so an executor that is
lost costs parts of one round.  There are ``CELLS - 1`` rounds however many sources there are: with more of
these the blocks get smaller, so that a cell's vectors of one block have about ``ENTRIES`` values.

While a cell is packed, a heap for each of its sources keeps the terms that stand out most there;
the heaps of all blocks are merged at the end.

Shares are whole numbers throughout: decimals of 38 digits divide exactly, sums of ``p`` fit 64 bits.

Defined results: null texts, languages and sources read as ''; a source without a kept term has the same share of
each and may still be compared; a language without kept terms gives distances of 0; repeated rows count
as often as they stand there; a text of any length is counted in parts of ``PART`` bytes, cut between terms;
columns besides text, language and source are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import fresh_dir, materialize, small_batches, table

LEAST_DOCS, SMOOTHING, UNIT, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Cells of a language at most, and about how many values a cell's vectors of one block have.
CELLS, ENTRIES = 16, 1 << 18
#: Terms that a counting worker holds before it hands them on, and bytes of a text counted at once.
HELD, PART = 200_000, 1 << 20

#: Bytes of terms: letters (A-Z lower-cased) and all beyond ASCII; others part them.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_END = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


# -- counting -------------------------------------------------------------------------------


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, part by part."""
    at = 0
    while at < len(text):
        cut = _END.search(text, at + PART) if at + PART < len(text) else None
        end = cut.end() if cut else len(text)
        yield text[at:end].translate(TERM_BYTES).split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs``: occurrences and documents so far; a group's documents stand under the term ''."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed() -> pa.RecordBatch:
        rows = [(lang, source, term, n, docs[term]) for (lang, source), (times, docs) in held.items() for term, n in times.items()]
        rows += [(lang, source, b"", 0, docs[b""]) for (lang, source), (_, docs) in held.items()]
        held.clear()
        lang, source, term, n, docs = zip(*rows)
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = {b""}
            for terms in _terms(text):
                times.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(docs) for _, docs in held.values()) > HELD:
            yield handed()
    if held:
        yield handed()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` of every group and term; the term '' stands for the group itself."""
    small_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text").cast("binary").alias("text"))
    parts = rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# -- shares ---------------------------------------------------------------------------------


def share(n: str, total: str, terms: str) -> Column:
    """``1 + floor(UNIT * (n + SMOOTHING) / (total + SMOOTHING * terms))``, exact; 0 for no terms."""
    whole = lambda x: f"cast({x} as decimal(20, 0))"
    return F.expr(f"case when {terms} > 0 then 1 + (({whole(n)} + {SMOOTHING}) * {whole(UNIT)}) div ({whole(total)} + {whole(terms)} * {SMOOTHING}) else 0L end")


def _languages(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, sources, terms, total, size, cells, blocks``: what a language has, sources a cell, cells and blocks."""
    sums = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("total"))
    out = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(sums, "lang", "left")
    out = out.select("lang", "sources", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("terms", "total")])
    out = out.withColumn("size", F.ceil(F.col("sources") / CELLS)).withColumn("cells", F.ceil(F.col("sources") / F.col("size")))
    return out.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("size") / ENTRIES)))


# -- cells ----------------------------------------------------------------------------------


def _packed(width: int, seats: list[tuple[int, int, np.ndarray, np.ndarray]]) -> bytes:
    """Vectors of a cell in one block: for each seat the share of absent terms, and places and shares of the others."""
    head = np.array([width, len(seats), *[v for seat, rest, at, _ in seats for v in (seat, rest, len(at))]], "<i8")
    at = [np.diff(x[2], prepend=0) for x in seats]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *[a.astype("<i4").tobytes() for a in at], *[x[3].astype("<i4").tobytes() for x in seats]]))


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Seats, and a row of shares for each, absent terms filled in."""
    data = zstandard.ZstdDecompressor().decompress(raw)
    width, n = np.frombuffer(data, "<i8", 2)
    seat, rest, size = np.frombuffer(data, "<i8", 3 * n, 16).reshape(n, 3).T
    body = np.frombuffer(data, "<i4", 2 * int(size.sum()), 16 + 24 * n)
    at, p = body[: len(body) // 2], body[len(body) // 2 :]
    out = np.repeat(rest[:, None], width, axis=1)
    ends = np.cumsum(size)
    for k in range(n):
        mine = slice(ends[k] - size[k], ends[k])
        out[k, np.cumsum(at[mine])] = p[mine]
    return seat, out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row from the rows of a cell in a block: its packed vectors and the heap of each seat.

    A row with a width gives the seat's share of absent terms; the others are terms that it has.
    """
    first = pdf["width"].notna()
    rest = pdf[first].sort_values("seat")
    mine = pdf[~first].sort_values(["seat", "place"])
    seats, heap = [], []
    bounds = np.searchsorted(mine["seat"].to_numpy(), rest["seat"].to_numpy())
    for seat, p, a, b in zip(rest["seat"], rest["p"], bounds, [*bounds[1:], len(mine)]):
        part = mine.iloc[a:b]
        seats.append((int(seat), int(p), part["place"].to_numpy(np.int64), part["p"].to_numpy(np.int64)))
        over = part[part["p"] > part["q"]]
        best = heapq.nsmallest(TOP_TERMS, zip((over["q"] - over["p"]).tolist(), [t.encode() for t in over["term"]]))
        heap += [{"seat": int(seat), "value": -v, "term": t.decode()} for v, t in best]
    key = {c: [pdf[c].iloc[0]] for c in ("lang", "block", "cell")}
    return pd.DataFrame(key | {"vectors": [_packed(int(rest["width"].iloc[0]), seats)], "heap": [heap]})


def _cells(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells (``lang, cells, block, cell, vectors, heap``), seats (``lang, source, seat, cell``) and languages."""
    groups = counts.where("term = ''").select("lang", "source")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    kept = materialize(kept.select("lang", "term", "n"), "audit-terms")
    languages = materialize(_languages(groups, kept), "audit-languages")
    dealt = kept.join(languages.select("lang", "terms", "total", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
    dealt = materialize(dealt.select("lang", "term", "block", place.alias("place"), share("n", "total", "terms").alias("q")), "audit-places")
    order = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    seats = groups.withColumn("seat", order).join(languages.select("lang", "size"), "lang").select("lang", "source", "seat", F.floor(F.col("seat") / F.col("size")).alias("cell"))
    seats = materialize(seats, "audit-seats")

    # merged at every size: the plan, and what it moves, does not change as the corpus grows
    held = materialize(counts.where("n > 0").join(dealt.hint("merge"), ["lang", "term"]).select("lang", "source", "term", "n", "block", "place", "q"), "audit-held")
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    named = seats.join(sums, ["lang", "source"], "left").join(languages.select("lang", "terms", "blocks"), "lang").withColumn("own", F.coalesce("own", F.lit(0)))
    named = materialize(named, "audit-sums")
    had = held.join(named.hint("merge"), ["lang", "source"]).select("lang", "block", "cell", "seat", "place", share("n", "own", "terms").alias("p"), "q", "term", F.lit(None).cast("long").alias("width"))
    widths = dealt.groupBy("lang", "block").agg(F.count("*").alias("width"))
    rest = named.select("lang", "cell", "seat", share("0", "own", "terms").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).join(widths, ["lang", "block"], "left")
    rest = rest.select("lang", "block", "cell", "seat", F.lit(0).alias("place"), "p", F.lit(0).cast("long").alias("q"), F.lit("").alias("term"), F.coalesce("width", F.lit(0)).cast("long").alias("width"))
    kind = "lang string, block long, cell long, vectors binary, heap array<struct<seat: long, value: long, term: string>>"
    cells = had.unionByName(rest).groupBy("lang", "block", "cell").applyInPandas(_pack, kind)
    return materialize(cells.join(languages.select("lang", "cells"), "lang"), "audit-cells"), seats, languages


# -- rotation -------------------------------------------------------------------------------


def partner(cell: Column, cells: Column, turn: int) -> Column:
    """Whom a cell meets in a round (circle method); null if nobody.  Cells are evened up by an empty one that stays."""
    n = cells + cells % 2 - 1
    facing = F.pmod(F.lit(turn) - cell, n)
    stays = F.pmod(F.lit(turn) * F.floor((n + 1) / 2), n)
    other = F.when(cell == n, stays).when(facing == cell, n).otherwise(facing)
    return F.when((F.lit(turn) < n) & (other < cells), other)


def _distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``lang, a, b, value``: distances of the sources of two cells in one block; at home, of one cell's."""
    for pdf in batches:
        for lang, mine, other in zip(pdf["lang"], pdf["vectors"], pdf["peer"]):
            seat, p = _unpacked(mine)
            others, q = (seat, p) if other is None else _unpacked(other)
            for k in range(len(seat)):
                from_ = k + 1 if other is None else 0
                yield pd.DataFrame({"lang": lang, "a": seat[k], "b": others[from_:], "value": np.abs(q[from_:] - p[k]).sum(axis=1)})


def rotated(cells: DataFrame, rounds: int) -> DataFrame:
    """``lang, a, b, value``: for each block and each two sources of a language, once, their distance there."""
    spark = cells.sparkSession
    where = fresh_dir(spark, "audit-rounds")
    kind = "lang string, a long, b long, value long"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    resident = cells.select("lang", "cells", "block", "cell", "vectors").repartition(n, "lang", "block", "cell").persist(StorageLevel.MEMORY_AND_DISK)
    resident.select("lang", "vectors", F.lit(None).cast("binary").alias("peer")).mapInPandas(_distances, kind).write.parquet(f"{where}/home")
    for turn in range(rounds):
        met = partner(F.col("cell"), F.col("cells"), turn)
        travelling = cells.select("lang", "block", "cell", met.alias("met"), "vectors").where("met < cell").select("lang", "block", F.col("met").alias("cell"), F.col("vectors").alias("peer"))
        # the residents lie as the join wants them: only the copies move
        meeting = resident.join(travelling.hint("shuffle_hash"), ["lang", "block", "cell"]).select("lang", "vectors", "peer")
        meeting.mapInPandas(_distances, kind).write.parquet(f"{where}/round{turn}")
    resident.unpersist()
    return spark.read.schema(kind).parquet(f"{where}/home", *[f"{where}/round{turn}" for turn in range(rounds)])


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to all other sources, and the terms that stand out."""
    counts = materialize(term_counts(docs), "audit-counts")
    cells, seats, languages = _cells(counts)
    most = languages.agg(F.max(F.col("cells") + F.col("cells") % 2 - 1)).head()[0] or 0
    sums = rotated(cells, int(most)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda at, as_: seats.select("lang", F.col("seat").alias(at), F.col("source").alias(as_))
    pairs = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    heaps = cells.select("lang", F.explode("heap").alias("h")).select("lang", F.col("h.seat").alias("a"), F.col("h.term").alias("item"), F.col("h.value").alias("value"))
    terms = heaps.join(name("a", "source"), ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= TOP_TERMS))


def op11_systolic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The same from one table of all terms, every pair by a join.
ORACLE_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS own FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, kept.term, coalesce(c.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + {SMOOTHING})) // (own + {SMOOTHING} * v) AS p, 1 + ({UNIT}::HUGEINT * (kept.n + {SMOOTHING})) // (total + {SMOOTHING} * v) AS q
  FROM s JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM every) WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
