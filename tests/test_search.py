"""Search, fusion, contexts and metrics against plain restatements."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from vellumspark.operators import context, dense, evaluate, fusion, lexical, models, sampling
from vellumspark.profiles import NOT_FOUND


def plain_bm25(docs, question):
    tokens = {i: [w.lower() for w in re.findall(r"\w+", t)] for i, t in docs}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = Counter(w for t in tokens.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    out = {}
    for i, t in tokens.items():
        tf, score = Counter(t), 0.0
        for w in re.findall(r"\w+", question.lower()):
            if tf[w]:
                score += idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if score > 0:
            out[i] = score
    return out


def test_bm25(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)] + ["ação", "x²"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(60)]
    asked = [(0, "w1 w2 w2 AÇÃO"), (1, "unknown"), (2, ""), (3, "w5 x² w39")]
    index = lexical.build_index(spark.createDataFrame(docs, "id int, text string"), "id")
    index.save(f"file://{tmp_path}/index")
    index = lexical.LexicalIndex.load(spark, f"file://{tmp_path}/index")
    got = {}
    for r in lexical.scores(index, spark.createDataFrame(asked, "q int, text string"), "q").collect():
        got.setdefault(r.qid, {})[r.id] = r.score
    for q, text in asked:
        want = plain_bm25(docs, text)
        assert set(got.get(q, {})) == set(want) and all(abs(got[q][i] - s) < 1e-9 for i, s in want.items())


def test_filters_never_change_scores(spark):
    docs = spark.createDataFrame([(1, "a b c", "ren"), (2, "a b", "prt"), (3, "d", "ren"), *[(i, f"z{i}", "dsp") for i in range(4, 9)]], "id int, text string, kind string")
    index, asked = lexical.build_index(docs, "id"), spark.createDataFrame([(9, "a d")], "q int, text string")
    whole = {r.id: r.score for r in lexical.search(index, asked, "q").collect()}
    some = {r.id: r.score for r in lexical.search(index, asked, "q", 30, docs, fusion.filters({"kind": "REN", "year": 0, "x": ""})).collect()}
    assert set(some) == {1, 3} and all(abs(whole[i] - s) < 1e-12 for i, s in some.items())


def test_cosine_search_passes_on_no_more_than_k_for_each_task(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"é{i % 290:03d}", [float(rng.randrange(-1, 2)) for _ in range(4)]) for i in range(300)]  # ties, and ids on two rows
    vectors = spark.createDataFrame(rows, "id string, v array<float>").repartition(3)
    asked = vectors.where("id < 'é040'").withColumnRenamed("id", "qid")
    left, plain = [], dense.ranked
    want = sorted((r.qid, r.rank, r.id) for r in plain(dense.cosine_scores(vectors, asked), 6).collect())
    monkeypatch.setattr(dense, "ranked", lambda found, k: left.append(found.count()) or plain(found, k))
    monkeypatch.setattr(dense, "ROWS", 20)
    monkeypatch.setattr(dense, "TILE", 100)
    assert sorted((r.qid, r.rank, r.id) for r in dense.search(vectors, asked, 6).collect()) == want
    assert left[0] <= 6 * asked.count() * spark.sparkContext.defaultParallelism


def test_cosine_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(50)] + [(99, [0.0] * 5)]
    vectors = spark.createDataFrame(rows, "id int, v array<float>")
    asked = vectors.where("id < 6").withColumnRenamed("id", "qid")
    one = sorted((r.qid, r.rank, r.id) for r in dense.search(vectors, asked, 7).collect())
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 64)
    assert one == sorted((r.qid, r.rank, r.id) for r in dense.search(vectors, asked, 7).collect())
    for q, v in rows[:6]:
        cos = lambda w, v=v: sum(a * b for a, b in zip(v, w)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in w))
        best = sorted((i for i, w in rows if i != q and any(w)), key=lambda i: -cos(dict(rows)[i]))[:7]
        assert [i for a, _, i in one if a == q] == best


def test_fusion_and_its_ties(spark):
    lists = lambda x: spark.createDataFrame(x, "qid int, id string, rank int")
    got = fusion.rrf(lists([(1, "a", 1), (1, "b", 22), (2, "d", 1)]), lists([(1, "a", 2), (1, "b", 14), (2, "l", 1)]))
    rows = {(r.qid, r.id): r for r in got.collect()}
    assert round(rows[1, "a"].rrf, 4) == 0.0325 and round(rows[1, "b"].rrf, 4) == 0.0257
    first = fusion.top(got.where("qid = 2"), 2, fusion.fused_order()).orderBy("place").collect()
    assert [r.id for r in first] == ["d", "l"] and first[1].rank_dense is None


def test_only_thirty_candidates_are_reranked(spark):
    rows = [(1, f"d{i:02d}", 1.0 / (i + 1), i + 1, None, "q w", "q" if i < 35 else "q w") for i in range(40)]
    frame = spark.createDataFrame(rows, "qid int, id string, rrf double, rank_dense int, rank_bm25 int, question string, text string")
    got = fusion.rerank(frame, F.col("question"), F.col("text"), models.overlap_logit, 50).orderBy("rank").collect()
    assert [r.id for r in got] == [f"d{i:02d}" for i in range(30)] and abs(got[0].rerank - 0.5) < 1e-9


class FakeEmbedder:
    def encode(self, texts, return_dense=True, return_sparse=True):
        return {"dense_vecs": [[float(len(t)), 1.0] for t in texts], "lexical_weights": [{1: 0.5} for _ in texts]}


class FakeReranker:
    def compute_score(self, pairs, normalize=True):
        scores = [len(q) / 10 + len(t) / 100 for q, t in pairs]
        return scores[0] if len(scores) == 1 else scores


def test_model_adapters(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(70)] + [(70, None)], "id int, text string")
    got = models.embed(rows, "text", FakeEmbedder).collect()
    assert all(r.dense == [float(r.id % 70), 1.0] and r.sparse == {1: 0.5} for r in got)
    scored = rows.where("text is not null").coalesce(1).select("id", models.rerank_scores(F.lit("ab"), F.col("text"), FakeReranker, 23).alias("s")).collect()
    assert all(abs(r.s - 0.2 - r.id / 100) < 1e-9 for r in scored)
    assert [sum(r.v) for r in rows.where("id < 2").select(models.hash_embedding(F.col("text")).alias("v")).collect()] == [0.0, 1.0]


def test_contexts_and_citations(spark):
    hits = [(1, 1, "ren", 2020, "T", "Art. 1", "u1", " one "), (1, 2, "ren", 0, "T", "", "u2", None), (1, 3, "prt", 2021, "", "s", "u3", "three")]
    rows = spark.createDataFrame(hits, "qid int, rank int, tipo_ato string, year int, title string, section string, url string, text string")
    block = context.context_blocks(rows).head()
    rule = "─" * 60
    assert block.context == f"[1] REN | 2020 | T | Art. 1\nURL: u1\n{rule}\none\n\n[3] PRT | 2021 | s\nURL: u3\n{rule}\nthree" and block.numbers == [1, 3]
    answer = spark.createDataFrame([(1, "as [3] and [1], [3], [7]")], "qid int, answer string")
    meta = rows.select("qid", F.col("rank").alias("n"), "url")
    assert [(r.n, r.url) for r in context.citations(answer, meta).orderBy("pos").collect()] == [(3, "u3"), (1, "u1")]
    flags = spark.createDataFrame([(NOT_FOUND.upper(),), ("here [1]",)], "a string").select(context.is_not_found(F.col("a")).alias("x")).collect()
    assert [r.x for r in flags] == [True, False]
    said = context.context_blocks(rows).select(models.extract_answer(F.col("context"), F.col("n_chunks")).alias("a")).head().a
    assert said == "one [1]"


def test_metrics(spark):
    rows = [("a", "factual", list("xyz"), ["y"]), ("b", "factual", [], ["y"]), ("c", "negative", list("xyz"), []), ("d", "multi_hop", [str(i) for i in range(20)], ["12", "7"])]
    got = evaluate.question_metrics(spark.createDataFrame(rows, "id string, tipo_query string, retrieved_ids array<string>, relevant_ids array<string>"))
    of = {r.id: (r.hit_5, r.hit_10, r.hit_20, r.rr) for r in got.collect()}
    assert of == {"a": (1, 1, 1, 0.5), "b": (0, 0, 0, 0.0), "c": (None,) * 4, "d": (0, 1, 1, 0.125)}
    one = evaluate.summary(got).head()
    assert (one.hit_5, one.hit_10, one.hit_20, one.mrr, one.n) == (0.3333, 0.6667, 0.6667, 0.2083, 3)
    verdicts = spark.createDataFrame([(1, 0), (-1, 1), (0, -1)], "faithfulness int, relevance int")
    assert tuple(evaluate.judge_means(verdicts).head()) == (0.5, 0.5, 3)


def test_samples(spark):
    rows = spark.createDataFrame([(i, f"k{i % 3}", i % 4 if i % 7 else None, i // 2) for i in range(200)], "id int, kind string, year int, doc int")
    got = sampling.stratified(rows, ["kind", "year"], "id", 0.13)
    sizes, all_sizes = Counter((r.kind, r.year) for r in got.collect()), Counter((r.kind, r.year) for r in rows.collect())
    assert got.columns == rows.columns and sizes == {k: max(1, round(n * 0.13)) for k, n in all_sizes.items()}
    assert [r.id for r in sampling.stratified(rows, ["kind"], "id", 0.1, 1).orderBy("id").collect()] != [r.id for r in sampling.stratified(rows, ["kind"], "id", 0.1, 2).orderBy("id").collect()]
    turn = sampling.round_robin(rows, ["kind", "year"], "id", 30).collect()
    assert len(turn) == 30 and max(Counter((r.kind, r.year) for r in turn).values()) <= 3
    for same in (True, False):
        pairs = sampling.pairs(rows, "id", "doc", "kind", "year", 10, same).collect()
        assert len(pairs) == 10 and all(p.a.doc != p.b.doc and (p.a.kind == p.b.kind) == same for p in pairs)
    kept = sampling.trim(spark.createDataFrame([("factual", i) for i in range(40)] + [("other", 1)], "tipo_query string, ord int"))
    assert sorted(r.ord for r in kept.collect()) == list(range(30))
    assert sampling.public_columns(spark.createDataFrame([(1, 2)], "a int, _b int")).columns == ["a"]


def test_stored_index_is_built_once_for_each_version(spark, tmp_path, monkeypatch):
    calls, plain = [], lexical.append
    monkeypatch.setattr(lexical, "append", lambda *a, **k: calls.append(1) or plain(*a, **k))
    path, root = f"file://{tmp_path}/docs", f"file://{tmp_path}/index"
    rows = spark.createDataFrame([(1, "a b b"), (2, ""), (3, None)], "id int, text string")
    rows.write.parquet(path)
    for _ in range(2):
        index = lexical.stored_index(spark.read.parquet(path), "id", root)
        assert {(r.term, r.tf, r.dl) for r in index.postings.collect()} == {("a", 1, 3), ("b", 2, 3)} and index.lengths.count() == 3
    assert len(calls) == 1
    rows.union(rows).write.mode("overwrite").parquet(path)
    assert lexical.stored_index(spark.read.parquet(path), "id", root).lengths.count() == 6 and len(calls) == 2
