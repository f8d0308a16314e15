import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import decontam


def brute(text, passages):
    """Every diagonal of every passage, without hashing: id, equal words and share on the best one."""
    number, out = {}, []
    words = np.array([number.setdefault(w, len(number)) for w in decontam.words_of(text)], int)
    for i, passage in passages:
        own, best = np.array([number.get(w, -1) for w in passage]), None
        wide = np.concatenate([np.full(len(own) - 1, -2), words, np.full(len(own) - 1, -2)])
        if not len(words):
            continue
        count = sum((wide[k : len(wide) - len(own) + 1 + k] == w).astype(int) for k, w in enumerate(own))
        for d in np.flatnonzero(count >= min(decontam.RUN, 0.7 * len(own))).tolist():
            equal = wide[d : d + len(own)] == own
            leak, matched, share = decontam.verdict(equal, len(own))
            if leak and (best is None or matched > best[0]):
                best = (matched, share)
        if best:
            out.append((i, *best))
    return out


def passages_of(rows):
    same = {}
    for i, t in rows:
        if w := tuple(decontam.words_of(t)):
            same.setdefault(w, []).append(i)
    return sorted((min(v), list(k)) for k, v in same.items())


def leaked(spark, texts, rows, block=decontam.BLOCK):
    """The operator's leaks of each text, by its number."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(rows, "item_id long, text string")
    found, items, seeds = decontam.flagged(docs, bench)
    named = found.select(F.col("__vs_row").alias("row"), "doc_id")
    out = {i: [] for i in range(len(texts))}
    for r in decontam.leaks(found, items, seeds, block).join(named, "row").collect():
        out[r.doc_id].append((r.item_id, r.matched, r.overlap))
    return {i: sorted(x) for i, x in out.items()}


def test_equal_to_brute_force_with_substitutions(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([3, 7, 9, 10, 15, 30, 45, 60, 60])]
    texts = []
    for _ in range(90):
        words = rng.choices(vocabulary, k=120)
        item = rows[rng.randrange(len(rows))][1].split()
        for k in range(len(item)):
            if rng.random() < 0.12:
                item[k] = "other"
        at = rng.randrange(100)
        texts.append(" ".join(words[:at] + item + words[at:]))
    passages = passages_of(rows)
    # blocks of 50 words: passages reach over their ends
    assert leaked(spark, texts, rows, 50) == {i: brute(t, passages) for i, t in enumerate(texts)}


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    passages = passages_of([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():  # long texts too
        if found := brute(r.text, passages):
            want[r.doc_id] = (sorted(i for i, *_ in found), max(x[2] for x in found), max(x[1] for x in found))
    got = {r.doc_id: (r.item_ids, r.overlap, r.matched) for r in decontam.op2_decontaminate(spark, sf).collect()}
    assert got == want and want


@pytest.mark.parametrize("bits", [decontam.FILTER_BITS, (6, 6)])
def test_stage_nulls_repeats_long_texts_and_a_full_filter(spark, monkeypatch, bits):
    monkeypatch.setattr(decontam, "FILTER_BITS", bits)  # a filter that lets all windows through changes nothing
    passage = "the quick brown fox jumps over the lazy dog while seven wizards brew a strong potion"
    bench = spark.createDataFrame([(4, passage), (2, passage.upper() + "!"), (9, None), (8, " .. "), (7, "tiny item"), (None, "nameless words of a passage")], "item_id long, text string")
    long = " ".join(f"v{i % 977}" for i in range(30_000))
    rows = [(1, "so " + passage.replace("fox", "cat"), 1), (2, "clean text", 2), (3, None, 3), (None, "", 4), (5, "a tiny item here", 5), (6, passage[:30], 6), (7, f"{long} {passage} {long}", 7), (5, "a tiny item here", 8), (None, "nameless words of a passage", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = sorted((r.doc_id or 0, r.item_ids) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(0, [-1]), (1, [2]), (5, [7]), (5, [7]), (7, [2])]
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == [2, 3, 4, 6]
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == 9
    assert decontam.contaminated(docs.limit(0), bench).count() == 0


def test_stretches_equal_the_plain_rule(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() < 0.8 for _ in range(rng.randrange(40))]) for i in range(300)]
    some = spark.createDataFrame(rows, "i int, equal array<boolean>").select("i", decontam._best_stretch(F.col("equal")).alias("n"))
    assert {r.i: r.n for r in some.collect()} == {i: decontam.best_stretch(np.array(e, bool)) for i, e in rows}


def test_every_accepted_pattern_leaves_a_hit():
    for n in range(1, 19):  # all patterns that the masks don't see, word by word
        masks = [m for m, own in decontam._masks({n}) if own is None or n in own]
        unseen = [""]
        for _ in range(n):
            longer = [p + c for p in unseen for c in "01"]
            unseen = [p for p in longer if not any(decontam.sees(m, p[-len(m) :]) for m in masks)]
        assert not [p for p in unseen if decontam.verdict(np.array([c == "1" for c in p]), n)[0]]
    # longer: the most equal words in any pattern of n words without a hit, by its last four
    most = {"": 0}
    for n in range(1, 401):
        after = {}
        for last, equal in most.items():
            for c in "01":
                p = last + c
                if not any(decontam.sees(m, p[-len(m) :]) for m in decontam.MASKS):
                    after[p[-4:]] = max(after.get(p[-4:], 0), equal + (c == "1"))
        most = after
        if n >= decontam.SPAN:
            assert max(most.values()) < decontam.OVERLAP * n
    # 13 equal words of a stretch with four in five equal: some five of them in a row have one other at most
    assert all(any(decontam.sees(m, p) for m in decontam.MASKS) for p in ("11111", "01111", "10111", "11011", "11101", "11110"))


def test_regular_and_random_replacements_are_found(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([2, 4, 5, 6, 7, 8, 9, 10, 16, 20, 25, 30, 59])]
    passages, texts = passages_of(rows), []
    for number, (i, passage) in enumerate(rows * 12):
        item = passage.split()
        if number < 2 * len(rows):
            item[number // len(rows) + 2 :: 5 - number // len(rows)] = ["other"] * len(item[number // len(rows) + 2 :: 5 - number // len(rows)])
        else:
            for k in rng.sample(range(len(item)), int(0.3 * len(item))):
                item[k] = "other"
        texts.append(" ".join(["before it"] + item + rng.choices(vocabulary, k=30)))
        texts.append(" ".join(item[1:]))  # without the first word, at the very start of the text
    assert leaked(spark, texts, rows) == {i: brute(t, passages) for i, t in enumerate(texts)}
