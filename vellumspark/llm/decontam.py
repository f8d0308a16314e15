"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over windows of four or five words ignore some positions, so a window still hashes
alike when words there were replaced.  No pattern of replaced words that the verdict accepts
goes without a hit: the four masks see every one in passages of ``SPAN`` words or more, and
passages with fewer words get masks of their own for the patterns that the four don't see.

The masked hashes of all windows of the documents are joined with those of the benchmark, and
around each hit the passage is laid over the document on the hit's diagonal and compared word
by word (by 64-bit hashes of the words).  Both sides of the join are tables; the benchmark is
never collected.  Before the join most windows are left out by a Bloom filter of the
benchmark's hashes.  Its size is bounded (``FILTER_BITS``); a benchmark that fills it lets
more windows through to the join and loses nothing.

Documents are compared in blocks of ``BLOCK`` words, so no task holds a long text for each of
its hits.

A document leaks a passage if the best stretch of the diagonal (each equal word counts 1, each
other one -``MISS``, so at least four in five are equal) has ``RUN`` equal words, or all but a
fifth of a shorter passage; or if ``OVERLAP`` of the whole passage's words are equal there.

Defined results: words are runs of letters and digits, lower-cased; passages without words,
null ones and null or empty texts never match; passages with the same words are one, under the
smallest id (null: -1); rows without an id and repeated rows are judged like others, each on
its own; texts and passages of any length are compared whole; columns besides id and text are
kept and not read; empty tables give empty results.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize, small_batches, table

# The masks; ones are compared, zeros are ignored.
MASKS = ("1111", "11101", "10111", "11011")
#: Passages with fewer words have masks of their own.
SPAN = 10
RUN, MISS, OVERLAP = 13, 4, 0.7
#: Bits of the filter: so many for each hash of the benchmark, within these powers of two.
BITS_PER_HASH, FILTER_BITS = 256, (16, 26)
#: Words of a document that are compared at once.
BLOCK = 4096
#: Words whose hashes a worker remembers, and words of several texts that are hashed together.
CACHED_WORDS, TOGETHER = 200_000, 1 << 16
WORD = re.compile(r"[^\W_]+")

_RNG = np.random.default_rng(20)
_COEF = _RNG.integers(1, 1 << 63, SPAN + 1, dtype=np.uint64) | np.uint64(1)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # the mask itself is the salt
    out = np.full(n, np.uint64(int(_COEF[-1]) * int(mask, 2) % (1 << 64)))
    for j, c in enumerate(mask):
        if c == "1":
            out += ids[j : j + n] * _COEF[j]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def best_stretch(equal: np.ndarray) -> int:
    """Equal words in the stretch with the largest sum of 1 for equal and -MISS for other words."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISS))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[0])
    return int(equal[start:end].sum())


def verdict(equal: np.ndarray, length: int) -> tuple[bool, int, float]:
    """Whether the equal words of a passage laid over a text make a leak; their number and share."""
    matched = int(equal.sum())
    need = min(RUN, math.ceil(0.8 * length))
    return best_stretch(equal) >= need or matched >= OVERLAP * length, matched, matched / length


def sees(mask: str, pattern: str) -> bool:
    """Whether a window of the pattern (ones are equal words) has ones wherever the mask has."""
    return any(all(p == "1" or m == "0" for m, p in zip(mask, pattern[at:])) for at in range(len(pattern) - len(mask) + 1))


@functools.cache
def short_masks(length: int) -> tuple[str, ...]:
    """Masks for passages of so many words: the sparsest accepted patterns that ``MASKS`` don't see."""
    found: list[str] = []
    for pattern in sorted(("".join(x) for x in itertools.product("01", repeat=length)), key=lambda x: x.count("1")):
        if "1" in pattern and verdict(np.array([c == "1" for c in pattern]), length)[0] and not any(sees(m, pattern) for m in (*MASKS, *found)):
            found.append(pattern.strip("0"))
    return tuple(found)


def _masks(lengths: set[int]) -> list[tuple[str, set[int] | None]]:
    """Each mask, and the lengths of the passages that it is for (none: all)."""
    own: dict[str, set[int]] = {}
    for n in sorted(n for n in lengths if n < SPAN):
        for m in short_masks(n):
            own.setdefault(m, set()).add(n)
    return [(m, None) for m in MASKS] + list(own.items())


_known: dict[str, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word."""
    words, known = words_of(text), _known
    if len(known) > CACHED_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = [word_hashes(t) for t in pdf["text"]]
        out = pd.DataFrame({"item": pdf["item_id"], "words": [w.view(np.int64) for w in words]})
        yield out[[len(w) > 0 for w in words]]


def passages(benchmark: DataFrame) -> DataFrame:
    """``item``, ``words`` (their hashes) of each passage with words; equal ones under the smallest id."""
    texts = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1).cast("long")).alias("item_id"), "text").where("text is not null")
    some = texts.mapInPandas(_passages, "item long, words array<long>")
    return some.groupBy("words").agg(F.min("item").alias("item_id")).select(F.monotonically_increasing_id().alias("item"), "item_id", "words")


def _seeds(masks: list[tuple[str, set[int] | None]]):
    """All windows of the passages: masked hash, passage, place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, words in zip(pdf["item"], pdf["words"]):
                words = np.asarray(words, np.int64).view(np.uint64)
                for m, own in masks:
                    if own is None or len(words) in own:
                        h = _hashes(words, m)
                        yield pd.DataFrame({"h": h.view(np.int64), "item": item, "place": np.arange(len(h), dtype=np.int32)})

    return run


def _filter_of(seeds: DataFrame) -> np.ndarray:
    """The filter's bits, packed; two for each hash.  At most 2 ** FILTER_BITS[1] bits reach the driver."""
    n = seeds.count()
    bits = min(max(FILTER_BITS[0], math.ceil(math.log2(max(1, BITS_PER_HASH * n)))), FILTER_BITS[1])
    one = F.shiftrightunsigned("h", 64 - bits)
    two = F.shiftrightunsigned("h", 64 - 2 * bits).bitwiseAND(F.lit((1 << bits) - 1))
    each = seeds.select(F.explode(F.array(one, two)).alias("bit"))
    held = each.groupBy(F.shiftright("bit", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit & 7 as int))")).alias("set")).toPandas()
    out = np.zeros(1 << (bits - 3), np.uint8)
    out[held["byte"].to_numpy()] = held["set"].to_numpy()
    return out


def windows(texts: list[np.ndarray], masks: list[str], held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place of all windows of some texts that the filter lets through, by text."""
    bits = int(held.size * 8).bit_length() - 1
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    words, of = np.concatenate([np.empty(0, np.uint64), *texts]), np.repeat(np.arange(len(texts)), size)
    found, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for m in masks:
        h = _hashes(words, m)
        one = h >> np.uint64(64 - bits)
        at = np.flatnonzero(held[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8) & 1)
        two = h[at] >> np.uint64(64 - 2 * bits) & np.uint64((1 << bits) - 1)
        at = at[(held[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        at = at[of[at] == of[at + len(m) - 1]]  # no window reaches into the next text
        found.append(h[at])
        places.append(at)
    h, at = np.concatenate(found), np.concatenate(places)
    order = np.argsort(of[at], kind="stable")
    h, at = h[order], at[order]
    return h, of[at], at - (np.cumsum(size) - size)[of[at]]


def _seen(shared):
    """The windows of each text that pass the filter; no arrays if none does."""

    def run(text: pd.Series) -> pd.DataFrame:
        masks, held = shared.value
        hashes, places, waiting, count = [], [], [], 0

        def drain() -> None:
            h, of, at = windows(waiting, masks, held)
            cut = np.searchsorted(of, np.arange(len(waiting) + 1))
            for a, b in zip(cut, cut[1:]):
                hashes.append(h[a:b].view(np.int64) if b > a else None)
                places.append(at[a:b].astype(np.int32) if b > a else None)
            waiting.clear()

        for t in text:
            waiting.append(word_hashes(t))
            count += len(waiting[-1])
            if count > TOGETHER:
                drain()
                count = 0
        drain()
        return pd.DataFrame({"h": hashes, "at": places})

    return F.pandas_udf(run, "h array<long>, at array<int>", F.PandasUDFType.SCALAR)


def _blocks(size: int):
    """The words of each text in blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, number, parts = [], [], []
            for row, text in zip(pdf["row"], pdf["text"]):
                words = word_hashes(text).view(np.int64)
                cut = range(0, len(words), size)
                rows += [row] * len(cut)
                number += range(len(cut))
                parts += [words[i : i + size] for i in cut]
            yield pd.DataFrame({"row": rows, "block": number, "words": parts})

    return run


def _best_stretch(equal: Column) -> Column:
    """As ``best_stretch``, over an array of booleans."""
    start = F.struct(*[F.lit(0).alias(k) for k in ("sum", "equal", "best_sum", "best")])

    def step(s: Column, e: Column) -> Column:
        total = s["sum"] + F.when(e, 1).otherwise(-MISS)
        lost = total < 0
        total, count = F.when(lost, 0).otherwise(total), F.when(lost, 0).otherwise(s["equal"] + e.cast("int"))
        more = total > s["best_sum"]
        return F.struct(total.alias("sum"), count.alias("equal"), F.greatest(total, s["best_sum"]).alias("best_sum"), F.when(more, count).otherwise(s["best"]).alias("best"))

    return F.aggregate(equal, start, step, lambda s: s["best"])


def flagged(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` with ``__vs_row`` and the windows that the filter lets through, the benchmark's passages and their windows; all written."""
    spark = docs.sparkSession
    small_batches(spark)
    items = materialize(passages(benchmark), "leak-passages")
    lengths = {r.n for r in items.where(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct().collect()}  # SPAN values at most
    masks = _masks(lengths)
    seeds = materialize(items.mapInPandas(_seeds(masks), "h long, item long, place int"), "leak-seeds")
    shared = spark.sparkContext.broadcast(([m for m, _ in masks], _filter_of(seeds)))
    found = docs.withColumns({"__vs_row": F.monotonically_increasing_id(), "__vs_seen": _seen(shared)(docs["text"])})
    found = found.withColumn("__vs_windows", F.when(F.col("__vs_seen.h").isNotNull(), F.arrays_zip("__vs_seen.h", "__vs_seen.at"))).drop("__vs_seen")
    return materialize(found, "leak-windows"), items, seeds


def leaks(found: DataFrame, items: DataFrame, seeds: DataFrame, block: int = BLOCK) -> DataFrame:
    """``row, item_id, matched, overlap``: each passage that a row leaks once, on its best diagonal."""
    some = found.where("__vs_windows is not null").select(F.col("__vs_row").alias("row"), F.explode("__vs_windows").alias("w"))
    hits = some.select("row", F.col("w.h").alias("h"), F.col("w.at").alias("at")).join(seeds.hint("merge"), "h")
    lines = materialize(hits.select("row", "item", (F.col("at") - F.col("place")).alias("d")).distinct(), "leak-diagonals")
    rows = lines.select(F.col("row").alias("__vs_hit")).distinct()
    texts = found.where("__vs_windows is not null").select(F.col("__vs_row").alias("row"), "text")
    texts = texts.join(rows.hint("merge"), F.col("row") == F.col("__vs_hit"), "left_semi")
    words = texts.mapInPandas(_blocks(block), "row long, block int, words array<long>").withColumnRenamed("words", "__vs_text")
    # the part of the passage over each block that it reaches into
    n = F.size("words")
    reach = F.sequence(F.floor(F.greatest("d", F.lit(0)) / block).cast("int"), F.floor(F.greatest(F.col("d") + n - 1, F.lit(0)) / block).cast("int"))
    laid = lines.join(items.hint("merge"), "item").select("row", "item", "item_id", "d", n.alias("n"), "words", F.explode(reach).alias("block"))
    both = laid.join(words.hint("merge"), ["row", "block"])
    begin = F.greatest(F.col("block") * block, F.col("d"))
    end = F.least(F.col("block") * block + F.size("__vs_text"), F.col("d") + F.col("n"))
    one = F.slice("words", begin - F.col("d") + 1, F.greatest(end - begin, F.lit(0)))
    two = F.slice("__vs_text", begin - F.col("block") * block + 1, F.greatest(end - begin, F.lit(0)))
    part = both.select("row", "item", "item_id", "d", "n", F.struct("block", F.zip_with(one, two, lambda x, y: x == y).alias("equal")).alias("part"))
    whole = part.groupBy("row", "item", "d").agg(F.first("item_id").alias("item_id"), F.first("n").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["equal"])).alias("equal"))
    judged = whole.select("row", "item_id", "n", _best_stretch(F.col("equal")).alias("stretch"), F.size(F.filter("equal", lambda e: e)).alias("matched"))
    leak = (F.col("stretch") >= F.least(F.lit(RUN), F.ceil(F.lit(0.8) * F.col("n")))) | (F.col("matched") >= F.lit(OVERLAP) * F.col("n"))
    best = judged.where(leak).groupBy("row", "item_id").agg(F.max(F.struct("matched", (F.col("matched") / F.col("n")).alias("overlap"))).alias("b"))
    return best.select("row", "item_id", "b.matched", "b.overlap")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leaking row: its id, the passages' ids and the largest share of one of them."""
    found, items, seeds = flagged(docs.select("doc_id", "text"), benchmark)
    of = leaks(found, items, seeds).groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("overlap").alias("overlap"), F.max("matched").alias("matched"))
    ids = found.where("__vs_windows is not null").select(F.col("__vs_row").alias("row"), "doc_id")
    return ids.join(of.hint("merge"), "row").select("doc_id", "item_ids", "overlap", "matched")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that leak a passage; same columns.  Only rows with hits are shuffled."""
    found, items, seeds = flagged(docs, benchmark)
    rows = leaks(found, items, seeds).select(F.col("row").alias("__vs_leak")).distinct()
    clean = found.where("__vs_windows is null")
    left = found.where("__vs_windows is not null").join(rows.hint("merge"), F.col("__vs_row") == F.col("__vs_leak"), "left_anti")
    return clean.union(left).select(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
