import hashlib
import re

from vellumspark.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    spans = []
    for o, (kind, pattern, ok) in enumerate(BASE):
        spans += [(m.start(), o, m.end(), kind) for m in re.finditer(pattern, text or "") if ok(m.group())]
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    return [sum(s[3] == k for s in spans) for k, *_ in BASE], hashlib.sha256(joined.encode()).hexdigest()


TEXTS = [
    None, "", "no data", "a@b.c._x@y.z and a@b@c.d; x@y.", "é a@b.cc 😀 q.w+e%r-t@mail-1.example.org.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.03.255 1.2.3 99999999999999999999.1.1.1", "1.2.3.4" * 50,
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111", "79927398713 799273987130 0000000000000000",
    "call +1 (743) 555-3824 or +49 30 1234567 or +12 or +1 ( ) -", "+1 +2 +3 555-3824-1234", "1" * 30000, "a" * 60000, "a@" + "b" * 60000,
    "x@" * 5000, "1 " * 20000, "+" + "1 " * 20000, "1.1." * 5000, "IBAN DE89 3704 0044 0532 0130 00 x", "DE89370400440532013001", "ssn 078-05-1120 and 078-05-1120",
]


def test_base_spans_equal_plain_regular_expressions(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pii.find_pii(docs).collect():
        counts, digest = brute(TEXTS[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, TEXTS[r.doc_id][:80]
        assert r.base_sha256 == digest, TEXTS[r.doc_id][:80]


def test_checksums_and_context_add_spans(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 x", "DE89370400440532013001", "ssn 078-05-1120", "number 078-05-1120"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert got == {0: "iban:5:32", 1: "", 2: "ssn:4:15", 3: ""}


def test_account_numbers_end_where_their_country_says(spark):
    texts = [
        "IBAN DE89370400440532013000 BIC COBADEFF", "GB82WEST12345698765432 REF 12", "pay NO93 8601 1117 947 NOW", "DE8937040044053201300 0 X", "XX89370400440532013000", "DE89370400440532013000A",
        "first DE89370400440532013000, GB82 WEST 1234 5698 7654 32, then FR1420041010050500013M02606 AND",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("iban")] for r in pii.find_pii(docs).collect()}
    assert got == {0: ["iban:5:27"], 1: ["iban:0:22"], 2: ["iban:4:22"], 3: ["iban:0:23"], 4: [], 5: [], 6: ["iban:6:28", "iban:30:57", "iban:64:91"]}


def test_time_grows_with_the_text_only(spark):
    import time

    from pyspark.sql import functions as F

    def seconds(n):
        docs = spark.createDataFrame([(1, "mail a@b.cc " * n)], "doc_id long, text string")
        began = time.time()
        assert pii.find_pii(docs).where(F.col("n_email") == n).count() == 1
        return time.time() - began

    seconds(2_000)
    assert seconds(40_000) < 3 * seconds(20_000) + 2


def test_scores_follow_the_words_beside(spark):
    import random

    rng = random.Random(6)
    words = ["card", "visa", "host", "mail", "4111111111111111", "1.2.3.4", "a@b.cc", "plain", "Ωmega", "x" * 30, "+49 30 1234567"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(docs).collect():
        t = texts[r.doc_id]
        for span, score in zip(filter(None, r.spans.split(",")), r.scores):
            kind, start, end = span.split(":")
            base, more, told = pii.SCORES[kind]
            near = t[max(0, int(start) - pii.CONTEXT) : int(start)] + " " + t[int(end) : int(end) + pii.CONTEXT]
            assert score == (base + more if re.search(rf"(?i)(?<![a-z0-9])(?:{told})", near) else base), (t, span)


def test_whole_table_and_clashing_columns(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("found", F.lit(1)).withColumn("spans", F.lit("x"))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == brute(text[r.doc_id])


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert pii.find_pii(spark.createDataFrame([], schema)).count() == 0
    got = pii.find_pii(spark.createDataFrame([(None, "a@b.c")] * 2, schema)).collect()
    assert [r.n_email for r in got] == [1, 1]


def test_sql_finds_the_same(spark):
    import duckdb

    texts = [t for t in TEXTS if t is None or len(t) < 3000] + ["x IBAN DE89 3704 0044 0532 0130 00 y", "ssn 078-05-1120;call +49 30 1234567, visa 4111 1111 1111 1111", "ecarte 4111111111111111"]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.sql(pii.ORACLE_SQL)
    want = {r[0]: dict(zip(found.columns, r)) for r in found.fetchall()}
    got = {r.doc_id: r.asDict() for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_cards_of_separated_digits(spark):
    texts = ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "x 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 y", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert [got[i].n_card for i in range(3)] == [1, 1, 0]
    for i, t in enumerate(texts):
        r = got[i]
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == brute(t)
