import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from vellumspark.llm import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, orders):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(orders[0], orders[1] + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, orders=(1, 1), buckets=10_000, seed=2024, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *runs(t, orders)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, x in own for f in x), Counter(bucket(f) for x in target for f in runs(x, orders)[1])
    sall, tall = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (sall + buckets) / ((s[b] + 1.0) * (tall + buckets))))
    rows = []
    for i, n, x in own:
        weight = sum(gain(bucket(f)) for f in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


WORDS = "The the THE été Été 漢字 don't x1 1 ß a,b c. d! ﬁ Ünder".split()
DOCS = [(k, " ".join(WORDS[(k * j) % len(WORDS)] for j in range(k % 37))) for k in range(120)] + [(500, None), (501, ""), (502, "..."), (None, "null id " * 12), (None, None), (503, "word " * 40_000 + "A b"), (7, "twice " * 30), (7, "twice " * 30)]
TARGET = ["the été x1", None, "", "a b c d the THE", "漢字"]


@pytest.mark.parametrize("orders, buckets, percent", [((1, 1), 10_000, 10), ((1, 3), 50, 35), ((2, 2), 7, 100), ((3, 4), 1000, 0)])
def test_equals_brute_force(spark, orders, buckets, percent):
    docs, target = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = found(resample.resample(docs, target, orders, buckets, percent=percent))
    assert got == brute(DOCS, TARGET, orders, buckets, percent=percent)


def test_ranks_of_equal_scores_and_many_bins(spark):
    """Scores over many bins of the histogram, with ties between rows and ids."""
    rows = [(k // 2, 20 + k % 3, 1, 0, (k * 7919) % 4001 - 2000) for k in range(6000)] + [(k, 19, 1, 0, 9999) for k in range(50)] + [(None, 20, 1, 0, 2000)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words int, n_features long, weight long, score long")
    got = resample.draw(scored, 20, 30).collect()
    want = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))[: 6001 * 30 // 100]
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(r[0], r[4]) for r in want]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(want) + 1)) and len(got) == len(rows)


def test_odd_tables(spark):
    docs, target = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert resample.resample(docs.limit(0), target).collect() == []
    assert found(resample.resample(docs, target.limit(0))) == brute(DOCS, [])
    clash = docs.selectExpr("*", "'x' as word", "3 as bucket", "4 as score", "5 as `row`", "6 as n_words")
    assert found(resample.resample(clash, target)) == brute(DOCS, TARGET)
    with pytest.raises(ValueError):
        resample.resample(docs, target, (2, 1))


def test_whole_table_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = sorted(((i, n, w, s, r) for i, _, n, w, s, r in brute(docs, target)), key=str)
    assert found(resample.op13_position_ngrams(spark, sf)) == want
