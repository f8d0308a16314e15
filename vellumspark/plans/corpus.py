"""Queries on deduplication, resumption, samples and profiles."""

from __future__ import annotations


from pyspark.sql import Window, functions as F

from ..functions.text import is_pdf_url
from ..operators import chunking, corpus, sampling
from ..profiles import PLAIN
from ..sources.scratch import scratch
from ..streaming.resume import ingest
from .common import Registry, table

query = Registry()

# Each page as an occurrence of one of fifty addresses, over http or https, most of them PDFs.
OCCURRENCES_SQL = r"""occ AS (SELECT page_id, (2015 + page_id % 8)::INT AS ano, 't' || page_id AS titulo, CASE WHEN page_id % 5 = 0 THEN 'Voto' ELSE 'Texto' END AS tipo,
CASE WHEN page_id % 2 = 0 THEN 'http' ELSE 'https' END || '://example.org/f' || (page_id * 7 % 50) || CASE WHEN page_id * 7 % 50 % 9 = 0 THEN '.html' ELSE '.PDF?v=' || (page_id * 7 % 50) END AS url FROM pages)"""


def _occurrences(spark, sf_dir):
    i = F.col("page_id")
    k = i * 7 % 50
    url = F.concat(F.when(i % 2 == 0, "http").otherwise("https"), F.lit("://example.org/f"), k.cast("string"), F.when(k % 9 == 0, ".html").otherwise(F.concat(F.lit(".PDF?v="), k.cast("string"))))
    title = F.concat(F.lit("t"), i.cast("string"))
    return table(spark, sf_dir, "pages").select(i.alias("ord"), (2015 + i % 8).cast("int").alias("ano"), title.alias("titulo"), F.when(i % 5 == 0, "Voto").otherwise("Texto").alias("tipo"), url.alias("url"), title.alias("arquivo"))


@query(
    f"""WITH {OCCURRENCES_SQL}, ok AS (SELECT *, regexp_replace(url, '^http://', 'https://') AS u FROM occ WHERE ends_with(lower(regexp_replace(url, '[?#].*$', '')), '.pdf'))
    SELECT u AS url, arg_min(titulo, page_id) AS arquivo, arg_min(ano, page_id) AS ano_destino, count(*)::INT AS n_fontes, string_agg(ano || titulo || tipo, ',' ORDER BY page_id) AS fontes FROM ok GROUP BY u"""
)
def url_dedup_first(spark, sf_dir):
    tasks = corpus.download_tasks(_occurrences(spark, sf_dir))
    each = F.transform("fontes", lambda x: F.concat(x["ano"].cast("string"), x["titulo"], x["tipo"]))
    return tasks.select("url", "arquivo", "ano_destino", F.size("fontes").alias("n_fontes"), F.array_join(each, ",").alias("fontes"))


@query(f"WITH {OCCURRENCES_SQL} SELECT count_if(NOT ends_with(lower(regexp_replace(url, '[?#].*$', '')), '.pdf'))::BIGINT AS n_skipped, count(*) AS n FROM occ")
def non_pdf_skip_count(spark, sf_dir):
    return corpus.skipped_urls(_occurrences(spark, sf_dir))


@query("SELECT page_id, ends_with(lower(regexp_replace(url, '[?#].*$', '')), '/en/25') AS is_25 FROM pages")
def url_predicate(spark, sf_dir):
    shaped = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(F.endswith(F.regexp_replace("url", "[?#].*$", ""), F.lit("/en/25")), ".pdf#p").otherwise(".html"))
    return table(spark, sf_dir, "pages").select("page_id", is_pdf_url(shaped).alias("is_25"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf_dir):
    return corpus.not_done(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_manifest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return corpus.latest(rows, "user_id", "at").select("user_id", "event_id", "event_type")


@query("""WITH m AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id) SELECT 'u' || m.user_id AS url FROM m JOIN events USING (event_id) WHERE value > 10""")
def completed_urls(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    manifest = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("local_path"), F.struct("ts", "event_id").alias("downloaded_at"))
    files = events.select(F.col("event_id").alias("path"), F.when(F.col("value") > 10, 1).otherwise(0).alias("size"))
    return corpus.completed(manifest, files)


@query(
    """SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang, source) AS n FROM documents) WHERE k <= greatest(1, round_even(n * 0.1::DOUBLE, 0))"""
)
def stratified_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return sampling.stratified(docs, ["lang", "source"], "doc_id", 0.1)


@query(
    """SELECT doc_id, turn FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42' || doc_id), doc_id)::INT AS turn, md5('42' || lang || '|' || source) AS cell FROM documents) ORDER BY turn, cell, doc_id LIMIT 50"""
)
def round_robin_sample(spark, sf_dir):
    return sampling.round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 50).select("doc_id", "turn")


def _pairs_sql(same: bool) -> str:
    few = "" if same else "AND lang IN (SELECT lang FROM (SELECT lang, min(struct_pack(h := h, k := doc_id)) AS f FROM h GROUP BY lang) ORDER BY f LIMIT 21)"
    fits = "a.lang = b.lang" if same else "a.lang <> b.lang"
    order = "(a.source = b.source)::INT, " if same else ""
    return f"""WITH h AS (SELECT doc_id, lang, source, md5('42' || doc_id) AS h FROM documents WHERE lang IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS p, row_number() OVER (PARTITION BY lang, source ORDER BY h, doc_id) AS y FROM h),
    f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS py FROM k WHERE y = 1),
    pool AS (SELECT doc_id, lang, source, h FROM k WHERE p <= 40 {few} UNION SELECT doc_id, lang, source, h FROM f WHERE py <= 21 {few})
    SELECT a.doc_id AS a, b.doc_id AS b FROM pool a JOIN pool b ON {fits} AND (a.h, a.doc_id) < (b.h, b.doc_id) ORDER BY {order}a.h, b.h LIMIT 20"""


def _pairs(spark, sf_dir, same):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("doc"), "lang", "source")
    return sampling.pairs(docs, "doc_id", "doc", "lang", "source", 20, same).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"))


@query(_pairs_sql(True))
def pair_sample_same(spark, sf_dir):
    return _pairs(spark, sf_dir, True)


@query(_pairs_sql(False))
def pair_sample_other(spark, sf_dir):
    return _pairs(spark, sf_dir, False)


@query(
    """WITH t AS (SELECT doc_id, source, length(text) AS n, CASE WHEN greatest(1, floor(length(text) / 3.7::DOUBLE)) <= 1500 THEN 'C' ELSE 'B' END AS tier FROM documents WHERE source IN ('src1', 'src2')),
    c AS (SELECT * FROM t WHERE tier = 'C' AND n >= 200), pool AS (SELECT * FROM c UNION ALL SELECT * FROM t WHERE tier = 'B' AND n >= 300 AND (SELECT count(*) FROM c) < 30)
    SELECT doc_id, tier FROM pool ORDER BY md5('42' || doc_id), doc_id LIMIT 30"""
)
def negative_sample(spark, sf_dir):
    docs = chunking.with_estimate(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("tipo_ato")))
    rows = docs.withColumn("tier", F.when(F.col("n_tokens_est") <= PLAIN.most_tokens, "C").otherwise("B"))
    return sampling.negatives(rows, "doc_id", 30, kinds=("src1", "src2")).select("doc_id", "tier")


@query(
    """WITH o AS (SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) AS ord FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY ord) AS k FROM o)
    SELECT conv_id, turn, role, printf('gs_%03d', ord) AS id FROM k WHERE k <= CASE role WHEN 'user' THEN 30 WHEN 'assistant' THEN 20 ELSE 0 END"""
)
def trim_to_target(spark, sf_dir):
    target = {"user": 30, "assistant": 20}
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("tipo_query"))
    # the rows of each kind before one are counted by ranges of conversations, then within its own range
    place = F.struct("conv_id", "turn")
    kept = sampling.trim(rows.withColumn("ord", place), target).drop("ord")
    block = F.floor(F.col("conv_id") / 64)
    before = rows.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    starts = before.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row a range
    wanted = kept.select(block.alias("block")).distinct()
    inside = rows.withColumn("block", block).join(wanted, "block", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy("conv_id", "turn")))
    placed = inside.join(starts, "block").select("conv_id", "turn", "tipo_query", (F.col("start") + F.col("k")).alias("n"))
    return placed.join(kept, ["conv_id", "turn", "tipo_query"], "left_semi").select("conv_id", "turn", F.col("tipo_query").alias("role"), sampling.question_id(F.col("n")).alias("id"))


@query("SELECT doc_id, text, n_chars FROM documents WHERE length(text) >= 300 AND source IN ('src1', 'src2', 'src3')")
def good_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumnsRenamed({"source": "tipo_ato", "lang": "_lang"})
    return sampling.public_columns(sampling.good_chunks(rows, 300, ("src1", "src2", "src3")).drop("tipo_ato"))


@query(
    """SELECT count(*) AS n, count_if(toxic = 0 OR toxic IS NULL)::BIGINT AS n_ok, count_if(length(text) < 60)::BIGINT AS short, count_if(quality = 1)::BIGINT AS good FROM documents LEFT JOIN labels USING (doc_id)"""
)
def corpus_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return corpus.profile(rows, {"short": F.length("text") < 60, "good": F.col("quality") == 1}, F.when(F.col("toxic") == 1, "toxic"))


@query(
    """WITH d AS (SELECT *, len(string_split(text, chr(10)))::INT AS pages, octet_length(encode(text))::DOUBLE AS size FROM documents),
    s AS (SELECT lang, count(*) AS n, list(pages ORDER BY pages) AS p, list(size ORDER BY size) AS z FROM d GROUP BY lang),
    j AS (SELECT *, least(greatest((9 * (n + 1)) // 10, 1), n - 1) AS j FROM s),
    q AS (SELECT lang, (p[j] * (10 - (9 * (n + 1) - 10 * j)) + p[j + 1] * (9 * (n + 1) - 10 * j)) / 10.0 AS pages_p90, (z[j] * (10 - (9 * (n + 1) - 10 * j)) + z[j + 1] * (9 * (n + 1) - 10 * j)) / 10.0 AS size_p90 FROM j)
    SELECT lang, count(*) AS n, min(pages) AS pages_min, max(pages) AS pages_max, quantile_cont(pages, 0.5)::DOUBLE AS pages_median, round(avg(n_chars), 4) AS chars_mean, quantile_cont(size, 0.5) AS size_p50,
    count_if(length(text) < 60)::BIGINT AS short, any_value(pages_p90)::DOUBLE AS pages_p90, any_value(size_p90)::DOUBLE AS size_p90 FROM d JOIN q USING (lang) GROUP BY lang"""
)
def profile_by_type(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumns({"pages": F.size(F.split("text", "\n", -1)), "size": F.octet_length("text").cast("double")})
    return corpus.profile_by_kind(rows, "lang", "pages", "n_chars", "size", {"short": F.length("text") < 60})


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, min(doc_id) LIMIT 10")
def top_creators(spark, sf_dir):
    return corpus.counts(table(spark, sf_dir, "documents"), "source", 10, "doc_id")


@query("SELECT unnest([0, 1])::INT AS run, (SELECT count(*) FROM events) AS rows_in_sink")
def stream_resume(spark, sf_dir):
    """The same files are ingested twice and must be there once."""
    root = scratch(spark, "ingest")
    schema = table(spark, sf_dir, "events").schema
    counts = [ingest(spark, f"{sf_dir}/events.parquet*", schema, f"{root}/sink", f"{root}/checkpoint") for _ in range(2)]
    return spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "run int, rows_in_sink long")


QUERIES, ORACLES = query.queries, query.oracles
