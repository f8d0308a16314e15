import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellumspark.llm import secrets


@pytest.fixture(scope="module")
def words(spark, sf):
    return secrets.dictionary(spark.read.parquet(f"{sf}/documents.parquet"))


@pytest.fixture(scope="module")
def model(spark, words):
    return secrets.train(secrets.labelled_findings(spark), words)


def proposed(text):
    for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}", text or ""):
        before = text[max(0, m.start() - secrets.BESIDE) : m.start()]
        if re.search("[0-9]|[a-z][A-Z]", m.group()) or re.search(secrets.ASSIGNS, before):
            yield m.start(), m.end(), m.group(), before, text[m.end() : m.end() + secrets.BESIDE]


def test_candidates_equal_plain_regular_expressions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((r.doc_id, *x) for r in docs.collect() for x in proposed(r.text))
    got = secrets.candidates(docs, F.col("source")).collect()
    assert sorted((r.doc_id, r.start, r.end, r.candidate, r.before, r.after) for r in got) == want


def test_keys_without_digits_and_long_ones_are_proposed(spark):
    texts = ['token = "' + "abcdefghij" * 8 + '0123456789ABCDEF"', 'password = "correcthorsebatterystaple"', "id AbCdEfGhIjKlMnOpQrSt", "some-hyphenated-words-here", "AKIA" + "QWERTZUIOPASDFGH", "secret: ABCDEFGHIJKLMNOPQRST"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in secrets.candidates(docs, F.lit("")).collect()) == [0, 1, 2, 5]


def test_many_candidates_in_one_text_take_linear_time(spark):
    import time

    def seconds(n):
        docs = spark.createDataFrame([(1, "word 0123456789abcdef01 " * n)], "doc_id long, text string")
        began = time.time()
        assert secrets.candidates(docs, F.lit("")).where("before <> ' x'").count() == n
        return time.time() - began

    seconds(1_000)
    assert seconds(32_000) < 3 * seconds(16_000) + 2


def test_dictionary_holds_the_words_of_most_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    count = Counter(w for r in docs.collect() for w in set(re.findall("(?<![a-z])[a-z]{4,32}(?![a-z])", r.text.lower())))
    want = sorted(count, key=lambda w: (-count[w], w))[:300]
    assert [r.word for r in secrets.common_words(docs, 300).collect()] == want
    pattern = re.compile(secrets.longest_match(["ab", "abc", "abcde", "b", "bx", "q"]))
    assert [m.group() for m in pattern.finditer("abcd abcdebx zqab")] == ["abc", "abcde", "bx", "q", "ab"]


def brute_features(c, before, after, path, held):
    n, low, at, left = len(c), c.lower(), 0, 0
    while at < n:  # the longest word of the dictionary at each place
        size = max((k for k in range(1, min(33, n - at) + 1) if low[at : at + k] in held), default=0)
        left, at = left + (size == 0), at + max(1, size)
    kind = lambda x: "d" if x.isdigit() else "u" if x.isupper() else "l" if x.islower() else "m"
    has = lambda pattern, s: float(bool(re.search(pattern, s)))
    return [
        min(n, 256.0), sum(kind(a) != kind(b) for a, b in zip(c, c[1:])) / n, sum(x.isdigit() for x in c) / n, sum(x.isupper() for x in c) / n, sum(x in "+/_=-" for x in c) / n,
        has("^([0-9a-f]+|[0-9A-F]+)$", c), len(set(c)) / min(n, 64), 1 - left / n, has(secrets.ASSIGNS, before), has(secrets.SECRETIVE, before), has(secrets.HARMLESS, before + " " + after),
        has(secrets.EXAMPLE, before + c + after), has(secrets.EXAMPLE_PATH, path), has("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", c), float(before[-1:] in list("\"'`") and after[:1] in list("\"'`")),
    ]


def brute_score(forest, x):
    total = 0.0
    for tree in forest.trees:
        node = tree._java_obj.rootNode()
        while node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        stats = list(node.impurityStats().stats())
        total += stats[1] / sum(stats)
    return total / len(forest.trees)


def test_features_and_scores_equal_brute_force(spark, sf, model, words):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {*secrets.USUAL, *(r.word for r in secrets.common_words(docs).collect())}
    made = [(r.candidate, r.before, r.after, r.path) for r in secrets.labelled_findings(spark, 60, 50_000).collect()]
    found = [(c, b, a, r.source or "") for r in docs.collect() for _, _, c, b, a in proposed(r.text)]
    # one whose second half has other characters than its first 64
    rows = [*made, *random.Random(1).sample(found, min(60, len(found))), ("a1" * 40 + "BCDEFGHIJ" * 14, "token = ", ";", "src/x")]
    some = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, candidate string, before string, after string, path string")
    exact = some.select("i", *[x.alias(f) for f, x in secrets.features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"), words).items()])
    inputs = {r.i: list(r)[1:] for r in exact.collect()}
    for r in secrets.judged(some, model, words).collect():
        want = brute_features(*rows[r.i], held)
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(inputs[r.i], want)), (rows[r.i], inputs[r.i], want)
        assert abs(r.score - brute_score(model.stages[1], inputs[r.i])) < 2e-6 and r.is_secret == (r.score >= secrets.THRESHOLD)


def test_held_out_labels(spark, model, words):
    trained = secrets.labelled_findings(spark).select("candidate").distinct()
    rows = secrets.labelled_findings(spark, 3000, 100_000).join(trained, "candidate", "left_anti")
    got = secrets.judged(rows, model, words).select((F.col("is_secret") == (F.col("label") == 1)).alias("right")).collect()
    assert len(got) > 2000 and sum(r.right for r in got) > 0.97 * len(got)


def test_planted_secrets_and_false_positives(spark, model, words):
    rows = [
        (1, 'of token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and on', "main", 1),
        (2, "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff fixed it", "main", 1),
        (3, "token: your-token-here-xxxx-1", "tests/a", 1),
        (4, "id 123e4567-e89b-12d3-a456-426614174000 in the list", "main", 1),
        (5, None, None, 1),
        (6, "", "main", 1),
        (7, 'x api_key = "hT5wq0ZbLk3VnR8sYc2Jd9Fm" y', None, 1),
        (7, 'x api_key = "hT5wq0ZbLk3VnR8sYc2Jd9Fm" y', None, 1),
        (8, "a" * 300_000 + "1", "main", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    got = secrets.scan(docs, model, words).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in got if r.is_secret) == [(1, 12, 52), (7, 13, 37), (7, 13, 37)]
    assert {2, 3, 4} <= {r.doc_id for r in got if not r.is_secret}
    assert secrets.scan(docs.limit(0), model, words).count() == 0
    assert secrets.common_words(docs.limit(0)).count() == 0


def test_whole_table_finds_the_tokens(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((r.doc_id, m.start(1), m.end(1)) for r in docs.collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text))
    got = sorted((r.doc_id, r.start, r.end) for r in secrets.op1_secrets(spark, sf).collect() if r.is_secret)
    assert got == want and want
