import math
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from vellumspark.llm import language

ORDERS = (5, 4, 3, 2, 1)



def letters(text):
    low, out, run = text.lower(), [], ""
    for c in low + " ":
        if c.isalpha():
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def brute_grams(word, order):
    padded = f" {word} " if order > 1 else word
    return [padded[i : i + order] for i in range(max(1, len(padded) - order + 1))]


def brute_counts(rows, words=language.MODEL_WORDS, grams=language.MODEL_GRAMS):
    """Log frequencies of words and n-grams from (text, lang) rows."""
    count = defaultdict(Counter)  # (order or 0, lang)
    for text, lang in rows:
        if text is not None and lang is not None:
            count[0, lang].update(letters(text))
    langs = sorted({k for _, k in count})
    for lang in langs:
        for word, n in count[0, lang].items():
            for order in ORDERS:
                for g in brute_grams(word, order):
                    count[order, lang][g] += n
    part = lambda k: ((h := xxhash.xxh64_intdigest(k.encode(), 42)) - (h >> 63 << 64)) % language.PARTS
    model = {}
    for order in (0, *ORDERS):
        kept = set()
        for lang in langs:
            of = count[order, lang]
            kept |= set(sorted(of, key=lambda k: (-of[k], part(k), k))[: grams if order else words])
        total = {lang: sum(count[order, lang][k] for k in kept) for lang in langs}
        model[order] = {k: [math.log((count[order, lang][k] + 0.5) / (total[lang] + 0.5 * len(kept))) for lang in langs] for k in kept}
    return langs, model


def brute_predict(counts, text):
    langs, model = counts
    words = letters(text or "")
    if not words or not langs:
        return "und", 0.0
    total = [0.0] * len(langs)
    for w in words:
        if w in model[0]:
            known = [model[0][w]]
        else:
            known = next((k for order in ORDERS if (k := [model[order][g] for g in brute_grams(w, order) if g in model[order]])), [])
        for i in range(len(langs)):
            total[i] += sum(k[i] for k in known) / max(1, len(known))
    total = [t * min(1, language.SCORED_WORDS / len(words)) for t in total]
    best = max(range(len(langs)), key=lambda i: (total[i], -i))
    return langs[best], 1 / sum(math.exp(t - total[best]) for t in total)


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_contract(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = language.op7_language(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text))
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert len(held) > 200
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) > 0.97 * len(held)


@pytest.mark.parametrize("sizes", [(language.MODEL_WORDS, language.MODEL_GRAMS), (150, 90)])
def test_predictions_equal_a_plain_count(spark, sf, monkeypatch, sizes):
    monkeypatch.setattr(language, "MODEL_WORDS", sizes[0])
    monkeypatch.setattr(language, "MODEL_GRAMS", sizes[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    model = brute_counts([(r.text, r.lang) for r in docs if not is_held_out(r.doc_id)], *sizes)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.op7_language(spark, sf).collect()}
    for r in docs:
        lang, score = brute_predict(model, r.text)
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 1e-6


def test_labels_of_held_out_rows_and_sources_are_not_read(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    changed = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    key = lambda d: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.identify(d).collect())
    assert key(docs) == key(changed)


def test_word_counts(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([("the cat", "en"), ("The dog the", "en"), ("le chat", "fr"), ("le chien Été", "fr"), (None, "fr"), ("x", None)])]
    counts = {(r.lang, r.word): r.n for r in language.word_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert counts == {("en", "the"): 3, ("en", "cat"): 1, ("en", "dog"): 1, ("fr", "le"): 2, ("fr", "chat"): 1, ("fr", "chien"): 1, ("fr", "été"): 1}
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("the")[0] == "en" and model.predict("chats")[0] == "fr" and model.predict("dogg")[0] == "en"


def test_a_flat_vocabulary_loses_no_language(spark, monkeypatch):
    monkeypatch.setattr(language, "MODEL_WORDS", 500)
    flat = [f"{a}{b}{c}" for a in "abcdefghijklmn" for b in "abcdefghijklmn" for c in "abcdefghijklmn"]
    rows = [(1, " ".join(flat), "aa"), (2, "zu zu zu yx yx wv", "bb")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "bb"] and len(model.words) == 503
    assert model.predict("abc mnm")[0] == "aa" and model.predict("zu yx")[0] == "bb"


def test_letters_are_letters(spark):
    rows = [(0, "the cat", "en"), (1, "²½Ⅷ٣ ¹", "en"), (2, "x²y", "en"), (3, "ʰ", "en"), (4, "漢字", "zh"), (5, "१२ ½", None)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1] == got[5] == "und" and "und" not in (got[0], got[2], got[3], got[4])
    for text in ("x²y Ⅷa 1b_c", "Straße, DÉJÀ vu 1a", "½x", "İx ǅ", "plain words_here 2"):
        assert language.words_of(text) == letters(text)


def test_nulls_letters_ties_repeats_and_empty(spark):
    rows = [(0, "the cat and the dog", "en", 1), (1, "le chat et le chien", "fr", 2), (1, "le chat et le chien", "fr", 2), (4, None, "en", 3), (None, "the cat", None, 4), (5, "12 34 !!", "fr", 5), (6, "", "en", 6), (7, "a" * 200_000, "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {(r.doc_id, r.lang_pred) for r in language.identify(docs).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (None, "en"), (1, "fr")} <= got and language.identify(docs).count() == len(rows)
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} >= {1, 2, 4} and not {r.score for r in kept.collect()} & {3, 5, 6}
    assert language.identify(docs.limit(0)).count() == 0 and language.keep_identified(docs.limit(0)).count() == 0
    alike = [(i, "same words", k) for i, k in enumerate("zyzyzyzyzyzy")]
    tied = {r.lang_pred for r in language.identify(spark.createDataFrame(alike, "doc_id long, text string, lang string")).collect()}
    assert len(tied) == 1
