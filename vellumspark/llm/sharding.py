"""Sharding by fixed virtual slots.

A record's hash puts it into one of ``SLOTS`` virtual slots for good.  What changes is the
slot-to-shard map: it is built from the bytes that each slot holds, carries a version, is kept
under the caller's path, and is edited (slots move, records never rehash) when shards are added
or grow uneven.  Each edit is a new version beside the older ones.

A slot that holds more than ``1 / SPLIT`` of a shard, as when many rows share an id, is split:
the map lists its parts, and each of its records falls into one of them by a hash of its text
and, since rows may be equal in all, of its place in the table of records.  So the law holds
whatever the keys are.

Defined results: the law is ``bytes``; a null text counts 0 bytes and hashes as the empty text;
records without an id are spread by their text; rows that share an id share a slot but not
always a shard; equal rows may be told apart by their shard only; long texts are records like
others, and a shard is uneven by at most the largest; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import fresh_dir, materialize, table

SLOTS = 8192
#: No slot holds a larger share of a shard's bytes, unless it is one record.
SPLIT = 64
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """The fixed virtual slot of a record."""
    return F.pmod(F.xxhash64(doc_id, F.when(doc_id.isNull(), text)), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """Version and shard of every slot; the parts of slots that were split, and what the last edit moved.

    ``splits`` has the slot, the number of its second part and how many parts there are; the
    first part keeps the slot's number, the others are listed after all slots.
    """

    version: int
    shards: int
    shard_of: tuple[int, ...]
    splits: tuple[tuple[int, int, int], ...] = field(default=())
    moves: tuple[tuple[int, int, int], ...] = field(default=())

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "shards": self.shards, "shard_of": self.shard_of, "splits": self.splits, "moves": self.moves})

    @staticmethod
    def from_json(text: str) -> "SlotMap":
        raw = json.loads(text)
        return SlotMap(raw["version"], raw["shards"], tuple(raw["shard_of"]), *(tuple(map(tuple, raw[k])) for k in ("splits", "moves")))


def split_slots(slot_bytes: list[int], shards: int, largest: int, before: tuple = (), slots: int = SLOTS) -> tuple[tuple[int, int, int], ...]:
    """Parts of the slots that are too large for even shards; earlier splits stay as they are."""
    room = max(1, largest, sum(slot_bytes) // (shards * SPLIT))
    split, out = {s for s, _, _ in before}, list(before)
    after = slots + sum(n - 1 for _, _, n in before)
    for slot in range(min(slots, len(slot_bytes))):
        if slot not in split and slot_bytes[slot] > 2 * room:
            parts = math.ceil(slot_bytes[slot] / room)
            out.append((slot, after, parts))
            after += parts - 1
    return tuple(out)


def initial_map(slot_bytes: list[int], shards: int, splits: tuple = ()) -> SlotMap:
    """Largest slot first, each to the shard with the fewest bytes so far."""
    load = [(0, 0, s) for s in range(shards)]
    heapq.heapify(load)
    where = [0] * len(slot_bytes)
    for slot in sorted(range(len(slot_bytes)), key=lambda i: (-slot_bytes[i], i)):
        size, slots, shard = heapq.heappop(load)
        where[slot] = shard
        heapq.heappush(load, (size + slot_bytes[slot], slots + 1, shard))
    return SlotMap(1, shards, tuple(where), splits)


def rebalance(old: SlotMap, slot_bytes: list[int], shards: int | None = None, tolerance: float = 0.01, splits: tuple | None = None) -> SlotMap:
    """The next version: slots leave the fullest shards for the emptiest until all are near the mean.

    Few slots move: the largest one that fits the gap is taken each time, so a new shard is
    filled from the others and nothing moves between shards that are even already.
    """
    shards = shards or old.shards
    if shards < old.shards:
        raise ValueError("shards are only added")
    # parts of slots that were split since the last version start where their slot is
    where, load = list(old.shard_of), [0] * shards
    for slot, first, parts in splits if splits is not None else old.splits:
        where += [where[slot]] * (first + parts - 1 - len(where))
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot in sorted(range(len(where)), key=lambda i: (slot_bytes[i], i)):
        load[where[slot]] += slot_bytes[slot]
        held[where[slot]].append(slot)
    mean, moves = sum(load) / shards, []
    while True:
        low = min(range(shards), key=lambda s: (load[s], s))
        high = max(range(shards), key=lambda s: (load[s], -s))
        gap = load[high] - load[low]
        slot = next((s for s in reversed(held[high]) if 0 < slot_bytes[s] < gap), None)
        if slot is None or (load[high] - mean <= tolerance * mean and mean - load[low] <= tolerance * mean):
            break
        # the slot that brings both sides closest, not the largest one, when that would swap their roles
        slot = min((s for s in held[high] if 0 < slot_bytes[s] < gap), key=lambda s: (abs(gap - 2 * slot_bytes[s]), s))
        held[high].remove(slot)
        held[low].append(slot)
        load[high] -= slot_bytes[slot]
        load[low] += slot_bytes[slot]
        where[slot] = low
        moves.append((slot, high, low))
    return SlotMap(old.version + 1, shards, tuple(where), old.splits if splits is None else splits, tuple(moves))


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """One file per version; an older version is never overwritten."""
    spark.createDataFrame([(slot_map.to_json(),)], "value string").coalesce(1).write.text(f"{path}/v{slot_map.version:06d}")


def load_map(spark: SparkSession, path: str, version: int) -> SlotMap:
    return SlotMap.from_json(spark.read.text(f"{path}/v{version:06d}").head()[0])


def latest_map(spark: SparkSession, path: str) -> SlotMap | None:
    """The newest version under a path; none if nothing was saved there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # a version counts once its writer is done
    found = [f.getPath().getName() for f in store.listStatus(folder) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if store.exists(folder) else []
    versions = [int(name[1:]) for name in found if name[1:].isdigit()]
    return load_map(spark, path, max(versions)) if versions else None


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Id, size, text checksum, place and virtual slot of each document; the text itself stays behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        slot_of(F.col("doc_id"), F.col("text"), slots).alias("virtual_slot"),
        F.monotonically_increasing_id().alias("place"),
    )


def split_records(recs: DataFrame, splits: tuple) -> DataFrame:
    """``recs`` with the parts of split slots for slots."""
    if not splits:
        return recs
    listed = F.broadcast(recs.sparkSession.createDataFrame(list(splits), "virtual_slot int, first int, parts int"))  # SLOTS rows at most
    part = F.pmod(F.xxhash64("text_crc32", "size", "place"), F.col("parts")).cast("int")
    unit = F.when(F.col("parts").isNull() | (part == 0), F.col("virtual_slot")).otherwise(F.col("first") + part - 1)
    return recs.join(listed, "virtual_slot", "left").withColumn("virtual_slot", unit).drop("first", "parts")


def slot_stats(recs: DataFrame, units: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: a list of fixed length, whatever the table's size."""
    size, rows = [0] * units, [0] * units
    for slot, b, n in recs.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect():
        size[slot], rows[slot] = b, n
    return size, rows


def assign(recs: DataFrame, slot_map: SlotMap, slot_rows: list[int]) -> DataFrame:
    """Shard and gapless place in the shard for each record.

    A place is the rows of the shard's earlier slots plus the rank in the own slot, so ranks
    are taken within a slot (or a part of one) and never over a whole shard.
    """
    spark, before, base = recs.sparkSession, [0] * slot_map.shards, []
    for slot, shard in enumerate(slot_map.shard_of):
        base.append((slot, shard, before[shard]))
        before[shard] += slot_rows[slot]
    places = spark.createDataFrame(base, "virtual_slot int, shard int, base long")  # slots and their parts
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (
        recs.withColumn("rank", rank)
        .join(F.broadcast(places), "virtual_slot")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"))
    )


def shard_documents(docs: DataFrame, path: str, shards: int = 40, slots: int = SLOTS) -> DataFrame:
    """Spread documents over ``shards`` shards of near-equal bytes.

    The map is kept under ``path``: the first call makes version 1, each later one edits the
    newest version for the documents and shards at hand and saves the next.
    """
    spark = docs.sparkSession
    recs, old = materialize(records(docs, slots), "shard-records"), latest_map(spark, path)
    size, _ = slot_stats(recs, slots)
    largest = recs.agg(F.max("size")).head()[0] or 0
    splits = split_slots(size, shards, largest, old.splits if old else (), slots)
    recs = split_records(recs, splits)
    size, rows = slot_stats(recs, max([slots, *(first + parts - 1 for _, first, parts in splits)]))
    slot_map = rebalance(old, size, shards, splits=splits) if old else initial_map(size, shards, splits)
    save_map(spark, slot_map, path)
    return assign(recs, slot_map, rows)


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards, by a map of their own."""
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_dir(spark, "slot-map"))
