"""SimHash near-duplicates: pigeonhole blocks, joined, then verified by Hamming distance.

A fingerprint takes the majority of each bit over the XXH64 hashes of a document's word
shingles.  Two fingerprints that differ in at most ``BITS`` (4) bits agree in all but four of
their blocks, so each distinct fingerprint is dealt under every choice of all but four blocks
and compared with those that agree there.  Equal fingerprints are one row from the start, so
copies never meet each other.  The number of blocks follows the number of distinct
fingerprints, so that a key has about as many bits as they take: six blocks (15 keys of 20 to 22
bits) up to 16 million, seven (35 keys of 27 or 28) up to two billion, eight (70 keys of 32)
beyond.  So a bucket's expected size doesn't grow with the corpus.

A bucket with more than ``RUN_MAX`` fingerprints isn't compared pair by pair: all its
fingerprints are dealt once under every value within two bits of them instead (2,081 each).
Two fingerprints are within four bits exactly if they meet under such a value, at most 2,081
fingerprints can meet there, and each is linked to the smallest only.  So the work grows with
the bucket, not with its square, and no link between different fingerprints is lost.

The pipeline's near duplicates (``drop_near_duplicates``) have a law of their own: five-word
shingle sets with a Jaccard similarity of 0.8 or more.  First comes the method above: fingerprints of
the five-word shingles, dealt in blocks, linked within four bits; each text is compared with the
smallest of its component.  Four bits are few for a similarity of 0.8 (texts so alike differ in 9 or 10
on average), so the rest is found beside them: texts that share one of 40 bands of
six minima with another go on; at a similarity of 0.8 that leaves out 5 pairs in a million.  Of
all these, shingles are ordered from the rarest to the most frequent: two sets that are so alike
share one of their rarest fifth, and where they share the first one says how much they can have
in common at most.  So in a cloud of copies that were edited too much, each text's own shingles
keep it from meeting the others.  Texts made of the same sentences have no shingles of their own:
they meet, but two bits of each of the 240 minima go with a text, and a pair is made only if at
most ``DIFFER`` of them differ, which costs a few operations on eight longs where two texts meet
and leaves out one pair in a million at a similarity of 0.8.

Defined results: a null or empty text, or one of white space only, has fingerprint zero and
is linked like any other; fewer words than a shingle form one shingle; rows that share an id
are each fingerprinted, and a null id takes no part in the choice of the smallest id unless a
component has no other; texts of any length are read whole; other columns, whatever their
names, are kept by ``drop_near_duplicates`` and not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from .common import materialize, small_batches, table
from .components import connected_components, local_components

SHINGLE, BITS, SEED = 4, 4, 42
#: Blocks, and fingerprints up to which so many are enough: eight of them a bucket by chance.
BLOCKS = ((6, 1 << 24), (7, 1 << 31), (8, 1 << 63))
RUN_MAX = 4096
#: Hashes whose bits are counted at once.
COUNTED = 1 << 15
#: Near duplicates of the pipeline: words of a shingle; bands, and minima in each.
NEAR_SHINGLE, BANDS, MINIMA = 5, 40, 6
#: Minima, by two bits of each, that may differ; 36 of the 240 do on average at a similarity of 0.8.
DIFFER = 68

_RNG = np.random.default_rng(8)
_FLIP, _ODD = (_RNG.integers(1, 1 << 63, BANDS * MINIMA, dtype=np.uint64) for _ in range(2))
_ODD |= np.uint64(1)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of ASCII-lower-cased words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    width = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(width + 1) - 1
    first, last = (end - width)[: len(words) - size + 1].tolist(), end[size - 1 :].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED].astype(">u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(count * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: pd.Series) -> pd.Series:
    """The fingerprint of each text as a signed long."""
    return pd.Series(np.fromiter((majority(shingle_hashes(t)) for t in text), np.uint64, len(text)).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, a hash of the text and its fingerprint; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.pandas_udf(fingerprint, LongType())("text").alias("fp"))


def blocks_for(prints: int) -> int:
    """How many blocks so many distinct fingerprints are cut into."""
    return next(n for n, most in BLOCKS if prints <= most)


def block_masks(blocks: int) -> list[int]:
    """The masks that each keep all but ``BITS`` of the blocks, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in map(sum, itertools.combinations(each, blocks - BITS))]


def _links(run_max: int):
    """Over rows sorted by key: links within each run, or the members of runs that are too long."""

    def out(a, b, hot):
        return pd.DataFrame({"a": a, "b": b, "hot": np.full(len(a), hot)})

    def verify(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        n, at, d = len(key), np.arange(len(key)), 1
        label, pending, waiting = np.arange(n), [], 0
        while len(at):
            at = at[at + d < n]
            at = at[key[at] == key[at + d]]
            near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= BITS]
            pending.append((near, near + d))
            waiting += len(near)
            if waiting > 500_000:
                label, pending, waiting = local_components(label, pending), [], 0
            d += 1
        label = local_components(label, pending)
        moved = np.flatnonzero(label != np.arange(n))
        return out(fp[moved].view(np.int64), fp[label[moved]].view(np.int64), False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fp, long_key = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for pdf in itertools.chain(batches, [None]):
            if pdf is not None:
                key = np.concatenate([key, pdf["key"].to_numpy()])
                fp = np.concatenate([fp, pdf["fp"].to_numpy().view(np.uint64)])
            if long_key is not None:
                rest = int(np.searchsorted(key, long_key, "right"))
                yield out(fp[:rest].view(np.int64), fp[:rest].view(np.int64), True)
                key, fp = key[rest:], fp[rest:]
                if len(key):
                    long_key = None
            if not len(key):
                continue
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            sizes = np.diff(starts)
            if pdf is not None:  # the last run may go on in the next batch
                if sizes[-1] <= run_max:
                    starts, sizes = starts[:-1], sizes[:-1]
                else:
                    long_key = key[-1]
            big = np.repeat(sizes > run_max, sizes)
            cut = starts[-1]
            if big.any():
                yield out(fp[:cut][big].view(np.int64), fp[:cut][big].view(np.int64), True)
            if cut:
                yield verify(key[:cut][~big], fp[:cut][~big])
            key, fp = key[cut:], fp[cut:]

    return run


def _near_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    flips = np.concatenate([[np.uint64(0)], bit, bit[i] | bit[j]])
    for pdf in batches:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        for at in range(0, len(fp), 64):
            some = fp[at : at + 64]
            yield pd.DataFrame({"key": (some[:, None] ^ flips).ravel().view(np.int64), "fp": np.repeat(some, len(flips)).view(np.int64)})


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by key and fingerprint: each fingerprint and the first one under its key."""
    key, hub = None, None
    for pdf in batches:
        k, fp = pdf["key"].to_numpy(), pdf["fp"].to_numpy()
        start = np.concatenate([[True], k[1:] != k[:-1]])
        first = fp[np.maximum.accumulate(np.where(start, np.arange(len(k)), 0))]
        if key is not None:
            first[k == key] = hub
        key, hub = k[-1], first[-1]
        far = fp != first
        yield pd.DataFrame({"a": fp[far], "b": first[far]}).drop_duplicates()


def near_links(prints: DataFrame, run_max: int = RUN_MAX, blocks: int | None = None) -> DataFrame:
    """Links ``a, b`` that join all fingerprints of ``prints`` (column ``fp``, distinct) within four bits."""
    masks = block_masks(blocks or blocks_for(prints.count()))
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]))
    dealt = prints.select(keys.alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    found = materialize(dealt.mapInPandas(_links(run_max), "a long, b long, hot boolean"), "simhash-links")
    hot = found.where("hot").select(F.col("a").alias("fp")).distinct()
    near = hot.mapInPandas(_near_values, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    links = found.where("not hot").select("a", "b")
    return links.union(near.mapInPandas(_stars, "a long, b long")).distinct()


def components(prints: DataFrame, run_max: int = RUN_MAX, blocks: int | None = None) -> DataFrame:
    """``fp``, ``root`` and ``component_id`` (smallest ``doc_id`` of the component) for the rows of ``prints``."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    root = connected_components(near_links(distinct.select("fp"), run_max, blocks))  # node, root
    of = distinct.join(root, distinct.fp == root.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    of = materialize(of, "simhash-roots")
    least = materialize(of.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-least")
    return materialize(of.join(least, "root").select("fp", "root", "component_id"), "simhash-components")


def simhash_groups(docs: DataFrame, run_max: int = RUN_MAX) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of each document."""
    prints = materialize(fingerprints(docs), "simhash-prints")
    of = components(prints, run_max)
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of ``BANDS * MINIMA`` functions of the shingle hashes."""
    low = np.full(BANDS * MINIMA, ~np.uint64(0))
    for at in range(0, len(hashes), 512):
        np.minimum(low, ((hashes[at : at + 512, None] ^ _FLIP) * _ODD).min(axis=0), out=low)
    return low


def band_hashes(low: np.ndarray) -> np.ndarray:
    """One value for each band of minima."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(MINIMA):
        out = (out ^ low[j::MINIMA]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def planes(low: np.ndarray) -> np.ndarray:
    """Two bits of each of the minima: longs of all first bits, then longs of all second ones."""
    mixed = (low ^ low >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(62)
    bits = np.stack([mixed & np.uint64(1), mixed >> np.uint64(1)]).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(bits, axis=1).reshape(-1).view(np.int64)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles."""
    return np.unique(shingle_hashes(text, NEAR_SHINGLE))


def _sketch(text: pd.Series) -> pd.DataFrame:
    hashes = [shingle_hashes(t, NEAR_SHINGLE) for t in text]
    low = [minima(np.unique(h)) for h in hashes]
    fp = np.fromiter(map(majority, hashes), np.uint64, len(hashes)).view(np.int64)
    return pd.DataFrame({"fp": fp, "bands": [band_hashes(x) for x in low], "planes": [planes(x) for x in low]})


def _set(text: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).view(np.int64) for t in text], dtype=object)


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs ``a, b`` whose sets have a Jaccard similarity of 0.8 or more."""
    of = lambda end: sets.select(F.col("node").alias(end), F.col("set").alias(f"set_{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    sizes = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("i"), (F.size("set_a") + F.size("set_b")).alias("s"))
    return sizes.where("5 * i >= 4 * (s - i)").select("a", "b")


def _shared(texts: DataFrame) -> DataFrame:
    """``__vs_node``: the texts that share a band with another."""
    dealt = texts.select("node", F.explode("s.bands").alias("key"))
    keys = dealt.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    return dealt.join(keys.hint("merge"), "key", "left_semi").select(F.col("node").alias("__vs_node")).distinct()


def _met(texts: DataFrame) -> DataFrame:
    """Pairs ``a, b``: each text and the smallest of those that its fingerprint leads to, within ``BITS`` bits a step."""
    prints = texts.select(F.col("node").alias("doc_id"), F.col("s.fp").alias("fp"))
    return prints.join(components(prints), "fp").where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))


def rare_shingles(sets: DataFrame) -> DataFrame:
    """``g, node, n, own, pos``: the shingles among which a text shares one with each that is alike.

    A text's shingles are ordered by the number of texts that hold them; ``pos`` is the place in
    that order, ``own`` the number of those that no other text has.  Of ``n`` the first
    ``n - ceil(0.8 n) + 1`` are enough, and those that are its own meet none.
    """
    each = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("g"))
    often = each.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(often.hint("merge"), "g").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("held"))
    placed = shared.select("node", "n", (F.col("n") - F.size("held")).alias("own"), F.posexplode("held").alias("k", "x"))
    return placed.select("x.g", "node", "n", "own", (F.col("own") + F.col("k")).alias("pos")).where("pos <= n - ceil(0.8 * n)")


#: Whether two texts that first share a shingle at their places may be alike: sizes, and what can follow in both.
_MAY = "5 * least({x}.n, {y}.n) >= 4 * greatest({x}.n, {y}.n) and 9 * least({x}.n - {x}.pos, {y}.n - {y}.pos) >= 4 * ({x}.n + {y}.n)"


#: Whether few enough of the minima of two texts differ.
_LONGS = -(-BANDS * MINIMA // 64)
_CLOSE = " + ".join(f"bit_count(({{x}}.planes[{i}] ^ {{y}}.planes[{i}]) | ({{x}}.planes[{i + _LONGS}] ^ {{y}}.planes[{i + _LONGS}]))" for i in range(_LONGS)) + f" <= {DIFFER}"


def _close(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those pairs ``a, b`` whose minima may belong to sets that are alike."""
    both = pairs.alias("p").join(marks.alias("x"), F.expr("p.a = x.node")).join(marks.alias("y"), F.expr("p.b = y.node"))
    return both.where(_CLOSE.format(x="x", y="y")).select("p.a", "p.b")


def jaccard_links(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``a, b`` that join all texts of a Jaccard similarity of 0.8 or more.

    ``texts`` has a row for each distinct text: ``node`` (hash of the text) and its sketch ``s``
    (``fp``, ``bands``, ``planes``).
    Each text is compared first with the smallest one of its fingerprint's component, and with one of
    those that hold the same rare shingle, the one with the fewest shingles of its own; then all that
    may be alike and aren't joined yet.
    """
    same = materialize(_met(texts), "near-met")
    ends = same.select(F.explode(F.array("a", "b")).alias("__vs_node"))
    nodes = materialize(_shared(texts).union(ends).distinct(), "near-nodes")
    named = docs.select(F.xxhash64("text").alias("node"), "text")
    some = named.join(nodes.hint("merge"), F.col("node") == F.col("__vs_node"), "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = materialize(some.select("node", F.pandas_udf(_set, "array<long>")("text").alias("set")), "near-sets")
    marks = materialize(texts.join(nodes.hint("merge"), F.col("node") == F.col("__vs_node"), "left_semi").select("node", "s.planes"), "near-marks")
    empty = sets.where(F.size("set") == 0).select(F.col("node").alias("a"))
    alike = empty.crossJoin(F.broadcast(empty.agg(F.min("a").alias("b")))).where("a <> b")  # with one row
    rare = materialize(rare_shingles(sets), "near-rare")
    hubs = materialize(rare.groupBy("g").agg(F.min(F.struct("own", "node", "n", "pos")).alias("hub"), F.count("*").alias("texts")).where("texts > 1").select("g", "hub"), "near-hubs")
    met = rare.join(hubs.hint("merge"), "g")
    stars = met.alias("x").where("node <> hub.node").where(_MAY.format(x="x", y="hub"))
    stars = materialize(_close(stars.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct(), marks), "near-stars")
    links = materialize(_alike(same.union(stars).distinct(), sets).union(alike), "near-star-links")
    root = connected_components(links)
    rooted = met.join(root.hint("merge"), "node", "left").select("g", "node", "n", "pos", F.col("hub.node").alias("hub"), F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted.where("node <> hub").join(marks.hint("merge"), "node"), "near-rooted")
    x, y = rooted.alias("x"), rooted.alias("y")
    apart = x.join(y.hint("merge"), F.expr(f"x.g = y.g and x.node < y.node and x.root <> y.root and {_MAY.format(x='x', y='y')} and {_CLOSE.format(x='x', y='y')}"))
    rest = materialize(apart.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "near-rest")
    return links.union(materialize(_alike(rest, sets), "near-links"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keep one document of each group: the smallest id, without ids the smallest text hash.

    A group is joined by five-word shingle sets with a Jaccard similarity of 0.8 or more, which
    fingerprints, then minima propose; texts without words have equal sets.
    """
    small_batches(docs.sparkSession)
    sketch = F.pandas_udf(_sketch, "fp long, bands array<long>, planes array<long>")("text")
    prints = materialize(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sketch.alias("s")), "near-prints")
    texts = materialize(prints.groupBy(F.col("text_hash").alias("node")).agg(F.first("s").alias("s")), "near-texts")
    prints = prints.drop("s")
    of = connected_components(jaccard_links(texts, docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    rooted = prints.join(of, prints.text_hash == of.node, "left").select("doc_id", "text_hash", F.coalesce("root", "text_hash").alias("root"))
    keep = rooted.groupBy("root").agg(first).select(F.col("first.doc_id").alias("__vs_id"), F.col("first.text_hash").alias("__vs_hash"))
    keep = materialize(keep, "near-keep")
    kept = docs.join(keep.hint("merge"), docs["doc_id"].eqNullSafe(F.col("__vs_id")) & (F.xxhash64(docs["text"]) == F.col("__vs_hash")), "left_semi")
    again = prints.groupBy("doc_id", "text_hash").count().where("count > 1")
    # whole rows may repeat; only then do the texts need another comparison
    return kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
