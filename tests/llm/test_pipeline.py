import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from vellumspark.llm import language

from .test_decontam import brute as brute_leaks, passages_of
from .test_language import brute_counts, brute_predict, is_held_out
from .test_lines import brute as brute_lines
from .test_simhash import jaccard_groups


def brute_run(docs, bench):
    """What is left of ``(doc_id, text, lang)`` rows with distinct ids: id to text."""
    model = brute_counts([(t, k) for i, t, k in docs if i is not None and not is_held_out(i)])
    rows = [(i, t) for i, t, _ in docs if (p := brute_predict(model, t))[0] != "und" and p[1] >= language.MIN_SCORE]
    rows = list(brute_lines(rows).items())
    of = jaccard_groups(dict(rows))
    rows = [(i, t) for i, t in rows if of[i] == i]
    passages = passages_of(bench)
    return {i: t for i, t in rows if not brute_leaks(t, passages)}


def test_stages_equal_brute_force(spark, sf):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = brute_run(docs, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: (r.text, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got} == {i: (t, sp.encode(t), t) for i, t in rows.items()}
    assert 0.5 * len(docs) < len(got) < len(docs)


def test_odd_rows_through_all_stages(spark, sf, tmp_path):
    """Nulls, empty and long texts, copies, ties and extra columns beside ordinary documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    some = {r.doc_id: r for r in docs.collect()}
    passage = bench.head().text
    base = next(r.text for r in some.values() if r.lang == "en" and 900 < len(r.text) < 3000)
    words = base.split(" ")
    odd = [
        (None, "en"), ("", "en"), (" \n\t ", None), ("12 34 ½", "de"), (base, None), (base, "en"), (base + " end", "en"), (" ".join(words[::-1]), "en"), ("\n".join([base.replace("\n", " ")] * 60), "en"),
        (" ".join(words[5:60]) + " " + passage + " " + " ".join(words[60:90]), "en"), (passage.upper(), "en"), ("\n" * 40, "fr"), ("the " * 30_000, "en"), ("word", "en"), ("word", "fr"),
    ]
    made = spark.createDataFrame([(10_000 + i, t, k, None, None) for i, (t, k) in enumerate(odd)], docs.schema)
    both = docs.union(made).withColumns({"id": F.lit("x"), "h": F.lit(None).cast("int"), "node": F.lit(1), "row": F.lit(2.5)})
    both.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = brute_run([(r.doc_id, r.text, r.lang) for r in both.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id: r.text for r in got} == rows and 10_009 not in rows and 10_010 not in rows and 10_000 not in rows


def test_repeated_rows_and_null_ids_stay_defined(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(20).union(docs.limit(20)).union(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    kept = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert 20 <= len(rows) == len(set(rows)) and len([t for _, t in rows if t]) == len({t for _, t in rows if t})


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumn("fp", F.lit(1)).withColumn("leaks", F.lit("x")).withColumn("pos", F.lit(None).cast("int"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count()
