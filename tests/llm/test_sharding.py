import random
import zlib

import xxhash
from pyspark.sql import functions as F

from vellumspark.llm import sharding


def brute_slot(doc_id):
    """xxhash64 of an id, as Spark has it: a number's eight bytes, seed 42."""
    h = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)
    return (h - (1 << 64) if h >> 63 else h) % sharding.SLOTS


def brute_shards(docs, shards=40):
    """Shard and slot of each document, for ids that don't repeat and slots that needn't be split."""
    size = {i: len(t.encode()) + 16 for i, t in docs.items()}
    held = [[] for _ in range(sharding.SLOTS)]
    for i in sorted(docs):
        held[brute_slot(i)].append(i)
    load, where = [0] * shards, {}
    count = [0] * shards
    for slot in sorted(range(sharding.SLOTS), key=lambda s: (-sum(size[i] for i in held[s]), s)):
        shard = min(range(shards), key=lambda k: (load[k], count[k], k))
        where[slot] = shard
        load[shard] += sum(size[i] for i in held[slot])
        count[shard] += 1
    out, at = {}, [0] * shards
    for slot in range(sharding.SLOTS):
        for i in held[slot]:
            out[i] = (where[slot], at[where[slot]])
            at[where[slot]] += 1
    return out


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.op5_virtual_slots(spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in text.items()}
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 40 and r.map_version == 1
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    loads = [sum(r.size for r in x) for x in by.values()]
    assert max(loads) - min(loads) <= max(r.size for r in rows)
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == brute_shards(text)


def test_a_new_shard_takes_slots_and_nothing_else_moves():
    rng = random.Random(2)
    size = [rng.randrange(50, 150) for _ in range(sharding.SLOTS)]
    one = sharding.initial_map(size, 40)
    two = sharding.rebalance(one, size, 41)
    changed = [i for i, (a, b) in enumerate(zip(one.shard_of, two.shard_of)) if a != b]
    assert changed and {two.shard_of[i] for i in changed} == {40} and two.version == 2
    load = [0] * 41
    for s, b in zip(two.shard_of, size):
        load[s] += b
    assert max(load) < 1.02 * sum(load) / 41 and min(load) > 0.98 * sum(load) / 41
    assert len(changed) < 1.1 * sharding.SLOTS / 41
    assert sharding.rebalance(two, size).shard_of == two.shard_of


def test_second_version_under_the_same_path(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: r for r in sharding.shard_documents(docs, str(tmp_path), 40).collect()}
    two = {r.doc_id: r for r in sharding.shard_documents(docs, str(tmp_path), 41).collect()}
    assert {r.map_version for r in one.values()} == {1} and {r.map_version for r in two.values()} == {2}
    assert sharding.latest_map(spark, str(tmp_path)).version == 2 and sharding.load_map(spark, str(tmp_path), 1).shards == 40
    moved = [i for i in one if one[i].shard != two[i].shard]
    assert 40 in {two[i].shard for i in moved} and all(one[i].virtual_slot == two[i].virtual_slot for i in one)
    assert 0 < sum(one[i].size for i in moved) < 3 * sum(r.size for r in one.values()) / 41
    # more documents: the third version takes them in and moves little
    more = docs.union(docs.where("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000))
    three = {r.doc_id: r for r in sharding.shard_documents(more, str(tmp_path), 41).collect()}
    assert sum(two[i].shard == three[i].shard for i in two) > 0.7 * len(two) and {r.map_version for r in three.values()} == {3}


def test_the_law_holds_with_repeated_ids_and_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(7, "x" * rng.randrange(50)) for _ in range(3000)] + [(8, "same text of a row")] * 3000 + [(100 + i, "y" * rng.randrange(50)) for i in range(3000)] + [(None, "z")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shards, version in ((20, 1), (21, 2)):
        got = sharding.shard_documents(docs, str(tmp_path), shards).collect()
        assert sorted(((r.doc_id or 0), r.size) for r in got) == sorted(((i or 0), len(t) + 16) for i, t in rows)
        load, by = [0] * shards, {}
        for r in got:
            load[r.shard] += r.size
            by.setdefault(r.shard, []).append(r.slot)
        assert max(load) - min(load) < 0.1 * sum(load) / shards, load
        assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_saved_versions_nulls_long_texts_and_empty(spark, tmp_path):
    one = sharding.initial_map([3, 1, 2, 0], 2, ((1, 4, 3),))
    sharding.save_map(spark, one, str(tmp_path / "a"))
    assert sharding.load_map(spark, str(tmp_path / "a"), 1) == one == sharding.latest_map(spark, str(tmp_path / "a"))
    assert sharding.latest_map(spark, str(tmp_path / "none")) is None
    docs = spark.createDataFrame([(None, "a", 1), (None, None, 1), (None, None, 1), (3, "é", 2), (3, "é", 2), (4, "l" * 300_000, 3)], "doc_id long, text string, shard int")
    rows = sharding.shard_documents(docs, str(tmp_path / "b"), 3).collect()
    assert sorted(r.size for r in rows) == [16, 16, 17, 18, 18, 300_016]
    assert sharding.shard_documents(docs.limit(0), str(tmp_path / "c"), 3).count() == 0
