import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vellumspark.llm import simhash
from vellumspark.llm.components import connected_components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(prints):
    """Smallest id reachable, by comparing all pairs."""
    up = {d: d for d in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4 and (x := top(a)) != (y := top(b)):
                up[max(x, y)] = min(x, y)
    return {d: top(d) for d in ids}


def test_whole_table_equals_brute_force(spark, sf):
    prints = {r.doc_id: brute_print(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = simhash.op8_simhash(spark, sf).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == groups(prints)


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.blocks_for(n) for n in (0, 1 << 24, (1 << 24) + 1, 1 << 31, 1 << 40)] == [6, 6, 7, 7, 8]
    for blocks, keys in ((6, 15), (7, 35), (8, 70)):
        masks = [m & (1 << 64) - 1 for m in simhash.block_masks(blocks)]
        assert len(masks) == keys and all(64 * (blocks - 4) // blocks - 2 <= m.bit_count() <= 64 * (blocks - 4) // blocks + 2 for m in masks)
        rng = random.Random(blocks)
        for _ in range(300):  # any four bits leave a mask untouched
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not m & flips for m in masks)


def test_long_texts(spark):
    texts = ["word " * 100_000, "word " * 100_000 + "end", "x" * 500_000, " ".join(f"w{i % 5000}" for i in range(100_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: int(r.fingerprint, 16) for r in simhash.simhash_groups(docs).collect()} == {i: brute_print(t) for i, t in enumerate(texts)}
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == set(jaccard_groups(dict(enumerate(texts))).values())


@pytest.mark.parametrize("run_max, blocks", [(4096, None), (3, None), (4096, 7), (3, 8)])
def test_dense_and_chained_fingerprints(spark, run_max, blocks):
    rng = random.Random(run_max)
    prints, base = {}, rng.getrandbits(64)
    for i in range(60):  # a ball, chains and strangers
        prints[i] = base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        prints[100 + i] = rng.getrandbits(64)
        prints[200 + i] = prints.get(199 + i, 0) ^ sum(1 << b for b in rng.sample(range(64), 4))
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    got = simhash.components(spark.createDataFrame(signed, "doc_id long, fp long"), run_max, blocks).collect()
    of = {r.fp: r.component_id for r in got}
    assert {i: of[p] for i, p in signed} == groups(prints)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(250)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for x in linked}


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text, 1), (5, text, 1), (9, text + " x", 2), (None, text, 3), (None, "alone " * 9, 4), (1, None, 5), (2, "", 6), (3, "other words here and there", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.component_id for r in kept.collect()) == [1, 4, 5, 7]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def jaccard_groups(texts):
    """The smallest id of each text's group, by comparing all pairs."""
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    up, at = {i: i for i in sets}, {}
    for i, s in sets.items():
        for g in s or {None}:
            at.setdefault(g, []).append(i)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sorted(sets):
        for j in {j for g in sets[i] or {None} for j in at[g] if j < i}:
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and (x := top(i)) != (y := top(j)):
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def test_pipeline_groups_equal_brute_force_jaccard(spark):
    rng = random.Random(8)
    rows = []
    for base in range(40):  # edits that leave a similarity of about 0.5 to 1, in chains
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 200))]
        for _ in range(6):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    want = set(jaccard_groups(dict(rows)).values())
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == want and len(want) < 200


def test_a_cloud_of_edited_copies_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):  # up to 16 of 150 words replaced: most pairs are less alike than 0.8
        words = list(base)
        for k in rng.sample(range(150), rng.randrange(17)):
            words[k] = f"n{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    asked, plain = [], simhash._alike

    def alike(pairs, sets):
        asked.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(simhash, "_alike", alike)
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(jaccard_groups(dict(rows)).values())
    assert sum(asked) < 4 * len(rows), asked


def test_texts_of_the_same_sentences_make_few_pairs(spark, monkeypatch):
    rng = random.Random(21)
    sentences = [" ".join(f"s{i}w{k}" for k in range(12)) for i in range(30)]
    rows = [(i, " ".join(sentences[k] for k in sorted(rng.sample(range(30), 21)))) for i in range(500)]
    for i in range(0, 60, 3):  # and some that are alike
        rows.append((len(rows), rows[i][1] + " and a few words more"))
    asked, plain = [], simhash._alike

    def alike(pairs, sets):
        asked.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(simhash, "_alike", alike)
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(jaccard_groups(dict(rows)).values())
    assert sum(asked) < len(rows) ** 2 / 20, asked


def test_minima_of_alike_sets_seldom_differ_too_much():
    n = simhash.BANDS * simhash.MINIMA
    lost = sum(math.comb(n, k) * 0.15**k * 0.85 ** (n - k) for k in range(simhash.DIFFER + 1, n + 1))
    assert lost < 1.5e-6
    rng, differ = np.random.default_rng(5), []
    for _ in range(200):  # a similarity of 0.8: on average 15 % differ
        both, own = rng.integers(0, 1 << 63, 80, dtype=np.uint64), rng.integers(0, 1 << 63, (2, 10), dtype=np.uint64)
        x, y = (simhash.planes(simhash.minima(np.concatenate([both, o]))).view(np.uint64) for o in own)
        half = len(x) // 2
        differ.append(int(np.bitwise_count((x ^ y)[:half] | (x ^ y)[half:]).sum()))
    assert 34 < np.mean(differ) < 38 and 4.5 < np.std(differ) < 6.5 and max(differ) <= simhash.DIFFER


def test_fingerprints_propose_near_duplicates_of_the_pipeline(spark, monkeypatch):
    """Without any band that is shared, close copies are still found, and compared by their sets."""
    rng = random.Random(17)
    rows = []
    for base in range(10):
        words = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:-1] + ["n"]))]
    texts = [(r[0], simhash.fingerprint([r[1]])[0]) for r in rows]
    assert all((a ^ b).item().bit_count() <= simhash.BITS for (_, a), (_, b) in zip(texts[::2], texts[1::2]))
    monkeypatch.setattr(simhash, "_shared", lambda texts: texts.select(F.col("node").alias("__vs_node")).limit(0))
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(jaccard_groups(dict(rows)).values()) == set(range(0, 20, 2))
    far = [(0, rows[0][1]), (1, rows[2][1])]  # a component is no proof
    monkeypatch.setattr(simhash, "_met", lambda texts: texts.agg(F.max("node").alias("a"), F.min("node").alias("b")))
    assert simhash.drop_near_duplicates(spark.createDataFrame(far, "doc_id long, text string")).count() == 2
