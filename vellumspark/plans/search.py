"""Queries on lexical, dense and fused search, contexts and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import cells, context, dense, evaluate, fusion, lexical, models, quantiles
from ..sources.scratch import kept, scratch
from .common import Registry, table, words_sql

query = Registry()

BM25_SQL = f"""tok AS (SELECT doc_id AS id, {words_sql('text')} AS t FROM documents),
len AS (SELECT id, len(t) AS dl FROM tok),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tok) GROUP BY ALL),
corp AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM post, corp GROUP BY term),
mean AS (SELECT avg(raw) AS mean_idf FROM raw),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean_idf ELSE raw END AS idf FROM raw, mean),
asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({words_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT qid, post.id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM asked JOIN idf USING (term) JOIN post USING (term) JOIN len ON len.id = post.id, corp GROUP BY ALL HAVING score > 0)"""

DENSE_SQL = """dq AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE {where}),
ds AS (SELECT qid, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], qv) AS score FROM embeddings, dq WHERE vec_id <> qid)"""


def top_sql(source: str, k: int, name: str, where: str = "true") -> str:
    return f"{name} AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)::INT AS rank FROM {source} WHERE {where}) WHERE rank <= {k})"


def _index(spark, sf_dir) -> lexical.LexicalIndex:
    """The documents' index; the first query on a version of the table builds it."""
    return lexical.stored_index(table(spark, sf_dir, "documents"), "doc_id", kept(spark, "lexical"))


def _named(ranked: DataFrame, score: int = 6) -> DataFrame:
    return ranked.select(F.col("qid").alias("item_id"), F.col("rank"), F.col("id").alias("doc_id"), F.round("score", score).alias("score"))


@query(f"WITH {BM25_SQL} SELECT n, round(avgdl, 6) AS avgdl, round(mean_idf, 6) AS mean_idf, (SELECT count(*) FROM idf) AS n_terms, (SELECT sum(tf)::BIGINT FROM post) AS n_tokens FROM corp, mean")
def corpus_stats(spark, sf_dir):
    index = _index(spark, sf_dir)
    # two tables of one row
    more = index.terms.agg(F.count("*").alias("n_terms")).crossJoin(index.lengths.agg(F.sum("dl").alias("n_tokens")))
    return index.corpus.crossJoin(more).select("n", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"), "n_terms", "n_tokens")


@query(f"WITH {BM25_SQL} SELECT term, df, round(idf, 6) AS idf FROM idf ORDER BY df DESC, term LIMIT 50")
def term_idf_top(spark, sf_dir):
    return _index(spark, sf_dir).terms.orderBy(F.desc("df"), "term").limit(50).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25_SQL}, {top_sql('sc', 10, 'best')} SELECT qid AS item_id, rank, id AS doc_id, round(score, 6) AS score FROM best")
def bm25_topk(spark, sf_dir):
    return _named(lexical.search(_index(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", 10))


@query(f"WITH {BM25_SQL}, en AS (SELECT sc.* FROM sc JOIN documents ON doc_id = id WHERE lang = 'en' AND source = 'src0'), {top_sql('en', 10, 'best')} SELECT qid AS item_id, rank, id AS doc_id, round(score, 6) AS score FROM best")
def bm25_topk_filtered(spark, sf_dir):
    payload = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    keep = fusion.filters({"lang": "EN", "source": "src0", "year": 0})
    return _named(lexical.search(_index(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", 10, payload, keep))


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _asked(vectors: DataFrame, where: str) -> DataFrame:
    return vectors.where(where).select(F.col("id").alias("qid"), "v")


@query(f"WITH {DENSE_SQL.format(where='vec_id % 20 = 0')}, {top_sql('ds', 10, 'best')} SELECT qid AS item_id, rank, id AS doc_id, round(score, 6) AS score FROM best")
def dense_topk(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return _named(dense.search(vectors, _asked(vectors, "id % 20 = 0"), 10))


@query(
    f"WITH {DENSE_SQL.format(where='vec_id % 20 = 0')}, fs AS (SELECT ds.* FROM ds JOIN embeddings ON vec_id = id WHERE label = 3), {top_sql('fs', 10, 'best')} SELECT qid AS item_id, rank, id AS doc_id, round(score, 6) AS score FROM best"
)
def dense_topk_filtered(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return _named(dense.search(vectors, _asked(vectors, "id % 20 = 0"), 10, fusion.filters({"label": 3})))


SMOKE = (0, 20, 40, 60, 80)


@query(f"""WITH {DENSE_SQL.format(where="vec_id % 25 = 0")}, {top_sql("ds", 5, "best", "id % 10 = 3")} SELECT qid, rank, id AS vec_id, round(score, 6) AS score FROM best""")
def cells_topk_filtered(spark, sf_dir):
    """The filter chooses cells by their summary; it fits fewer rows than a search compares, so all that fit are."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (2000 + F.col("vec_id") % 10).alias("year"))
    index = cells.store_cells(rows, scratch(spark, "cells"), ["year"])
    asked = rows.where("id % 25 = 0").select(F.col("id").alias("qid"), "v")
    return cells.search(index, asked, 5, fusion.filters({"year": 2003})).select("qid", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


class Letters:
    """A model for the query below: it tells texts by how often some letters stand in them."""

    def encode(self, texts, return_dense=True, return_sparse=True):
        counts = [[float(t.count(c)) for c in "aeiost"] for t in texts]
        return {"dense_vecs": counts, "lexical_weights": [{k: v for k, v in enumerate(x) if v} for x in counts]}

    def compute_score(self, pairs, normalize=True):
        return [1 / (1 + abs(len(q) - len(t)) / 10) for q, t in pairs]


LETTERS_SQL = ", ".join(f"len(text) - len(replace(text, '{c}', ''))" for c in "aeiost")


@query(
    f"""WITH d AS (SELECT doc_id, text, [{LETTERS_SQL}]::DOUBLE[] AS v FROM documents WHERE len(text) BETWEEN 1 AND 400), q AS (SELECT item_id, text AS asked, [{LETTERS_SQL}]::DOUBLE[] AS qv FROM benchmark),
    c AS (SELECT item_id, doc_id, asked, text, list_cosine_similarity(v, qv) AS cosine FROM d, q WHERE list_sum(v) > 0 AND list_sum(qv) > 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(cosine, 9) DESC, doc_id) AS near FROM c),
    s AS (SELECT *, 1 / (1 + abs(len(asked) - len(text)) / 10::DOUBLE) AS score FROM n WHERE near <= 20)
    SELECT item_id, doc_id, round(cosine, 6) AS cosine, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, near)::INT AS rank FROM s QUALIFY rank <= 5"""
)
def modelled_search(spark, sf_dir):
    """Texts and questions through a model's embedder, the nearest through its reranker."""
    texts = table(spark, sf_dir, "documents").where(F.length("text").between(1, 400)).select("doc_id", "text")
    vectors = models.embed(texts, "text", Letters).select(F.col("doc_id").cast("string").alias("id"), F.col("dense").alias("v"), "text", "doc_id")
    asked = models.embed(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("asked")), "asked", Letters).select(F.col("item_id").alias("qid"), F.col("dense").alias("v"), "asked")
    dense.same_size(vectors, asked)
    near = dense.cosine_scores(vectors, asked.select("qid", "v")).withColumn("doc_id", F.col("id").cast("long"))
    near = lexical.ranked(near, 20, key="doc_id").select("qid", "doc_id", F.col("score").alias("cosine"), F.col("rank").alias("near"))
    rows = near.join(texts, "doc_id").join(asked.select("qid", "asked"), "qid")
    scored = rows.withColumn("score", models.rerank_scores(F.col("asked"), F.col("text"), Letters))
    best = fusion.top(scored, 5, [F.round("score", 9).desc(), F.col("near")], "rank")
    return best.select(F.col("qid").alias("item_id"), "doc_id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {DENSE_SQL.format(where=f'vec_id IN {SMOKE}')}, {top_sql('ds', 3, 'best')} SELECT qid AS item_id, rank, id AS doc_id, round(score, 6) AS score, (SELECT count(*) FROM embeddings) AS points_count FROM best")
def dense_smoke(spark, sf_dir):
    """The three nearest of five fixed questions, and how many points there are."""
    vectors = _vectors(spark, sf_dir)
    found = _named(dense.search(vectors, _asked(vectors, f"id in {SMOKE}"), 3))
    return found.crossJoin(F.broadcast(vectors.agg(F.count("*").alias("points_count"))))  # one row


@query(
    f"""WITH {BM25_SQL}, own AS (SELECT sc.* FROM sc JOIN documents ON doc_id = id WHERE CASE qid % 3 WHEN 0 THEN true WHEN 1 THEN lang = 'en' ELSE lang = 'en' AND source = 'src1' END), {top_sql('own', 20, 'best')}
    SELECT qid AS item_id, rank, id AS doc_id, round(score, 6) AS score FROM best"""
)
def golden_filters(spark, sf_dir):
    """Each question is searched under its own filters; those with the same ones together."""
    items, index = table(spark, sf_dir, "benchmark"), _index(spark, sf_dir)
    payload = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    parts = []
    for k, values in enumerate(({}, {"lang": "EN"}, {"lang": "en", "source": "src1"})):
        parts.append(lexical.search(index, items.where(F.col("item_id") % 3 == k), "item_id", 20, payload, fusion.filters(values)))
    return _named(reduce(DataFrame.unionByName, parts))


FUSED_SQL = f"""WITH {BM25_SQL}, {DENSE_SQL.format(where='vec_id IN (SELECT item_id FROM benchmark)')},
{top_sql('sc', 30, 'lx')}, {top_sql('ds', 30, 'dn')},
un AS (SELECT qid, id, rank, 1 AS d FROM dn UNION ALL SELECT qid, id, rank, 0 FROM lx),
fu AS (SELECT qid, id, sum(1 / (60 + rank)::DOUBLE) AS rrf, max(CASE WHEN d = 1 THEN rank END) AS rank_dense, max(CASE WHEN d = 0 THEN rank END) AS rank_bm25 FROM un GROUP BY ALL),
pl AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, rank_dense ASC NULLS LAST, rank_bm25 ASC NULLS LAST)::INT AS place FROM fu)"""


def _fused(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    items, vectors = table(spark, sf_dir, "benchmark"), _vectors(spark, sf_dir)
    asked = vectors.join(items.select(F.col("item_id").alias("id")), "id", "left_semi").select(F.col("id").alias("qid"), "v")
    lx, dn = lexical.search(_index(spark, sf_dir), items, "item_id", 30), dense.search(vectors, asked, 30)
    return fusion.rrf(dn, lx), lx, dn


@query(f"{FUSED_SQL} SELECT qid AS item_id, place AS rank, id AS doc_id, round(rrf, 6) AS rrf, rank_dense, rank_bm25 FROM pl WHERE place <= 10")
def rrf_hybrid(spark, sf_dir):
    best = fusion.top(_fused(spark, sf_dir)[0], 10, fusion.fused_order())
    return best.select(F.col("qid").alias("item_id"), F.col("place").alias("rank"), F.col("id").alias("doc_id"), F.round("rrf", 6).alias("rrf"), "rank_dense", "rank_bm25")


@query(
    f"{FUSED_SQL} SELECT qid AS item_id, id AS doc_id, coalesce('dense ' || label, 'bm25 ' || source) AS kind FROM pl LEFT JOIN (SELECT vec_id AS id, label FROM embeddings) e USING (id) LEFT JOIN (SELECT doc_id AS id, source FROM documents) d USING (id) WHERE place <= 10"
)
def rrf_payload_coalesce(spark, sf_dir):
    best = fusion.top(_fused(spark, sf_dir)[0], 10, fusion.fused_order())
    lx = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.struct(F.concat(F.lit("bm25 "), "source").alias("kind")).alias("payload"))
    dn = _vectors(spark, sf_dir).select("id", F.struct(F.concat(F.lit("dense "), F.col("label").cast("string")).alias("kind")).alias("payload"))
    return fusion.with_payload(best, lx, dn).select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "payload.kind")


RERANKED_SQL = f"""{FUSED_SQL}, sh AS (SELECT pl.*, coalesce(d.text, '') AS text, b.text AS question FROM pl LEFT JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = qid WHERE place <= 30),
rr AS (SELECT qid, id, rrf, rank_dense, rank_bm25, 1 / (1 + exp(-(8::DOUBLE * len(list_intersect(list_distinct({words_sql('question')}), {words_sql('text')})) / len(list_distinct({words_sql('question')})) - 4))) AS rerank FROM sh),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rerank, 9) DESC, round(rrf, 12) DESC, rank_dense ASC NULLS LAST, rank_bm25 ASC NULLS LAST)::INT AS rank FROM rr)"""


def _reranked(spark, sf_dir, k: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    # only the candidates that will be reranked fetch their text
    short = fusion.top(_fused(spark, sf_dir)[0], fusion.RERANKED, fusion.fused_order()).drop("place")
    return fusion.rerank(short.join(docs, "id", "left").join(items, "qid"), F.col("question"), F.col("text"), models.overlap_logit, k)


@query(f"{RERANKED_SQL} SELECT qid AS item_id, rank, id AS doc_id, round(rerank, 6) AS rerank FROM rk WHERE rank <= 10")
def rerank_candidates(spark, sf_dir):
    return _reranked(spark, sf_dir, 10).select(F.col("qid").alias("item_id"), "rank", F.col("id").alias("doc_id"), F.round("rerank", 6).alias("rerank"))


METRICS_SQL = f"""WITH {BM25_SQL}, {top_sql('sc', 20, 'best')},
rel AS (SELECT item_id AS qid, list(doc_id) AS relevant FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL),
rows AS (SELECT b.item_id, CASE WHEN relevant IS NULL THEN 'negative' WHEN b.item_id % 2 = 0 THEN 'factual' ELSE 'multi_hop' END AS tipo_query, coalesce(relevant, []) AS relevant,
  coalesce((SELECT list(id ORDER BY rank) FROM best WHERE best.qid = b.item_id), []) AS ids FROM benchmark b LEFT JOIN rel ON rel.qid = b.item_id),
m AS (SELECT *, list_has_any(ids[1:5], relevant)::INT AS h5, list_has_any(ids[1:10], relevant)::INT AS h10, list_has_any(ids[1:20], relevant)::INT AS h20,
  coalesce(1 / list_min(list_filter(list_transform(ids, lambda x, i: CASE WHEN list_contains(relevant, x) THEN i END), lambda p: p IS NOT NULL))::DOUBLE, 0) AS rr FROM rows)"""
METRIC_COLUMNS = "round(avg(h5), 4) AS hit_5, round(avg(h10), 4) AS hit_10, round(avg(h20), 4) AS hit_20, round(avg(rr), 4) AS mrr, count(*) AS n FROM m WHERE tipo_query <> 'negative'"


def _relevant(items: DataFrame, docs: DataFrame, index: lexical.LexicalIndex) -> DataFrame:
    """Documents that contain a passage.  Both are joined on the passage's rarest inner word, then compared whole."""
    words = lexical.word_tokens(F.col("text"))
    inner = items.select("item_id", F.explode(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(1)))).alias("term"))
    rare = inner.join(index.terms, "term").groupBy("item_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    near = rare.join(index.postings, "term").select("item_id", F.col("id").alias("doc_id"))
    both = near.join(items.withColumnRenamed("text", "passage"), "item_id").join(docs.select("doc_id", "text"), "doc_id")
    return both.where(F.contains("text", F.col("passage"))).groupBy("item_id").agg(F.collect_list("doc_id").alias("relevant_ids"))


def _questions(spark, sf_dir) -> DataFrame:
    items, docs, index = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), _index(spark, sf_dir)
    best = lexical.search(index, items, "item_id", 20)
    found = best.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("retrieved_ids"))
    rows = items.join(_relevant(items, docs, index), "item_id", "left").join(found, F.col("qid") == F.col("item_id"), "left")
    none = F.array().cast("array<bigint>")
    kind = F.when(F.col("relevant_ids").isNull(), "negative").when(F.col("item_id") % 2 == 0, "factual").otherwise("multi_hop")
    return evaluate.question_metrics(rows.select("item_id", kind.alias("tipo_query"), F.coalesce("relevant_ids", none).alias("relevant_ids"), F.coalesce("retrieved_ids", none).alias("retrieved_ids")))


@query(f"{METRICS_SQL} SELECT {METRIC_COLUMNS}")
def retrieval_metrics(spark, sf_dir):
    return evaluate.summary(_questions(spark, sf_dir))


@query(f"{METRICS_SQL} SELECT tipo_query, {METRIC_COLUMNS} GROUP BY tipo_query")
def metrics_by_type(spark, sf_dir):
    return evaluate.summary(_questions(spark, sf_dir), "tipo_query")


@query(
    """WITH s AS (SELECT event_type, list(round(value * 1000) ORDER BY value) AS s, count(*) AS n FROM events GROUP BY event_type)
    SELECT event_type, round(s[greatest(1, floor(n * 50 / 100.0)::INT)], 1) AS p50, round(s[greatest(1, floor(n * 95 / 100.0)::INT)], 1) AS p95 FROM s"""
)
def latency_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 1000).alias("ms"))
    return quantiles.latencies(rows, ["event_type"], "ms", {"p50": 50, "p95": 95})


@query(
    """WITH s AS (SELECT l_returnflag, l_linestatus, list(l_quantity ORDER BY l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY ALL),
    j AS (SELECT *, least(greatest((9 * (n + 1)) // 10, 1), n - 1) AS j FROM s), d AS (SELECT *, 9 * (n + 1) - 10 * j AS d FROM j)
    SELECT l_returnflag || l_linestatus AS kind, (s[j] * (10 - d) + s[j + 1] * d) / 10.0 AS p90 FROM d"""
)
def p90_quantity(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("kind"), "l_quantity")
    return quantiles.spreads(rows, ["kind"], "l_quantity").select("kind", "p90")


CONTEXT_SQL = f"""WITH {BM25_SQL}, {top_sql('sc', 5, 'best')},
hit AS (SELECT best.qid, best.rank, d.*, upper(d.source) || ' | ' || d.lang || ' | ' || CASE WHEN d.doc_id % 2 = 0 THEN 'par' ELSE 'sec' END AS label FROM best JOIN documents d ON d.doc_id = best.id WHERE best.rank <> 2),
ctx AS (SELECT qid, string_agg('[' || rank || '] ' || label || chr(10) || 'URL: u/' || doc_id || chr(10) || repeat('─', 60) || chr(10) || regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), chr(10) || chr(10) ORDER BY rank) AS context, count(*)::INT AS n_chunks FROM hit GROUP BY qid)"""


def _hits(spark, sf_dir) -> DataFrame:
    """The five best documents of each passage; the second has no text, as a hit without a stored one."""
    best = lexical.search(_index(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", 5)
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    section = F.when(F.col("id") % 2 == 0, "par").otherwise("sec")
    rows = best.join(docs, "id").select("qid", "rank", "id", F.col("source").alias("tipo_ato"), F.lit(0).alias("year"), F.col("lang").alias("title"), section.alias("section"), F.concat(F.lit("u/"), F.col("id").cast("string")).alias("url"), F.when(F.col("rank") != 2, F.col("text")).alias("text"))
    return rows


@query(f"{CONTEXT_SQL} SELECT qid AS item_id, md5(context) AS digest, n_chunks FROM ctx")
def context_block(spark, sf_dir):
    return context.context_blocks(_hits(spark, sf_dir)).select(F.col("qid").alias("item_id"), F.md5("context").alias("digest"), "n_chunks")


@query("SELECT conv_id, turn, CASE WHEN turn = (turn + 3) % 5 THEN [turn, 7]::INT[] WHEN turn = 7 THEN [7, (turn + 3) % 5]::INT[] WHEN (turn + 3) % 5 = 7 THEN [turn, 7]::INT[] ELSE [turn, (turn + 3) % 5, 7]::INT[] END AS raw, [1]::INT[] AS one FROM conversations")
def cited_indices(spark, sf_dir):
    turn = F.col("turn")
    other = ((turn + 3) % 5).cast("string")
    answer = F.concat(F.lit("as ["), turn.cast("string"), F.lit("] says ["), other, F.lit("] and [7], see ["), turn.cast("string"), F.lit("] [x] [ 3]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", context.cited(answer).alias("raw"), context.cited(F.lit("[1][1]")).alias("one"))


@query(
    f"""{CONTEXT_SQL}, meta AS (SELECT qid, rank AS n, doc_id FROM hit), ans AS (SELECT qid, unnest([3, 2, 1, 9]) AS n, unnest([0, 1, 2, 3]) AS pos FROM ctx)
    SELECT qid AS item_id, pos::INT AS pos, n::INT AS n, doc_id FROM ans JOIN meta USING (qid, n)"""
)
def citations_join(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    answers = context.context_blocks(hits).select("qid", F.lit("first [3] then [2], [3] and [1], not [9]").alias("answer"))
    meta = hits.where("text is not null").select("qid", F.col("rank").alias("n"), F.col("id").alias("doc_id"))
    return context.citations(answers, meta).select(F.col("qid").alias("item_id"), "pos", "n", "doc_id")


@query(
    f"""{CONTEXT_SQL}, b AS (SELECT qid, n_chunks, context, regexp_extract(context, '^\\[(\\d+)\\]', 1) AS n, split_part(split_part(context, repeat('─', 60) || chr(10), 2), chr(10) || chr(10) || '[', 1) AS body FROM ctx)
    SELECT qid AS item_id, replace(body, chr(10), ' ')[1:160] || ' [' || n || ']' AS answer, false AS not_found FROM b"""
)
def generated_answers(spark, sf_dir):
    blocks = context.context_blocks(_hits(spark, sf_dir))
    answer = models.extract_answer(F.col("context"), F.col("n_chunks"))
    return blocks.select(F.col("qid").alias("item_id"), answer.alias("answer"), context.is_not_found(answer).alias("not_found"))


@query(
    f"{METRICS_SQL}, t AS (SELECT m.item_id, tipo_query, coalesce((SELECT max(score) FROM best WHERE best.qid = m.item_id), 0) < 60 AS not_found FROM m) SELECT round(avg(not_found::INT), 4) AS rate, count(*) AS n FROM t WHERE tipo_query = 'negative'"
)
def not_found_rate(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    top = lexical.search(_index(spark, sf_dir), items, "item_id", 1).select("qid", "score")
    answer = models.extract_answer(F.lit(""), F.when(F.coalesce("score", F.lit(0.0)) < 60, 0).otherwise(1))
    rows = _questions(spark, sf_dir).join(top, F.col("qid") == F.col("item_id"), "left")
    return evaluate.not_found_rate(rows.select("tipo_query", context.is_not_found(answer).alias("not_found")))


@query(
    f"""{CONTEXT_SQL}, v AS (SELECT qid, CASE WHEN qid % 4 = 0 THEN -1 ELSE (n_chunks >= 4)::INT END AS faithfulness, CASE WHEN qid % 5 = 0 THEN -1 ELSE 1 END AS relevance FROM ctx)
    SELECT round(avg(CASE WHEN faithfulness >= 0 THEN faithfulness END), 4) AS faithfulness, round(avg(CASE WHEN relevance >= 0 THEN relevance END), 4) AS relevance, count(*) AS n_llm_eval FROM v"""
)
def judge_means(spark, sf_dir):
    blocks = context.context_blocks(_hits(spark, sf_dir))
    answer = models.extract_answer(F.col("context"), F.col("n_chunks"))
    relevance = F.when(F.col("qid") % 5 == 0, models.judge_overlap(F.lit(""), F.col("context"))).otherwise(models.judge_overlap(answer, F.concat_ws(" ", "context", answer)))
    faithful = F.when(F.col("qid") % 4 == 0, -1).otherwise((F.col("n_chunks") >= 4).cast("int"))
    return evaluate.judge_means(blocks.select(faithful.alias("faithfulness"), relevance.alias("relevance")))


QUERIES, ORACLES = query.queries, query.oracles
