"""Queries on structure markers and chunks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ..functions.text import tokens_parsed
from ..operators import chunking, structure
from ..profiles import MARKERS, PLAIN
from .common import Registry, table

query = Registry()

#: Prose with the markers of acts.
MARKED = replace(PLAIN, markers=MARKERS)

# Paragraphs of each document: spans between runs of newlines, long ones cut.
PARAGRAPHS_SQL = r"""g AS (SELECT doc_id, text, string_split_regex(text, '\n+') AS gaps, list_transform(regexp_extract_all(text, '\n+'), lambda x: length(x)) AS hits FROM {source}),
u AS (SELECT doc_id, unnest(range(1, len(gaps) + 1)) AS i, gaps, hits FROM g),
s AS (SELECT doc_id, i, (coalesce(list_sum(list_transform(gaps[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(hits[1:i - 1]), 0))::INT AS s, length(gaps[i])::INT AS n FROM u),
cut AS (SELECT doc_id, i, s + unnest(CASE WHEN n <= 6000 THEN [0] ELSE range(0, n, 2000) END)::INT AS s, s + n AS e, n FROM s WHERE n > 0),
para AS (SELECT doc_id, s, CASE WHEN n <= 6000 THEN e ELSE least(e, s + 2000) END::INT AS e, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS i FROM cut)"""

# The greedy merge, one step a paragraph; ``done`` is the window that the step closes.
WINDOWS_SQL = (
    PARAGRAPHS_SQL
    + """, fold AS (
SELECT doc_id, i, s AS cs, e AS ce, 0 AS closed, NULL::INT AS ds, NULL::INT AS de FROM para WHERE i = 1
UNION ALL
SELECT p.doc_id, p.i,
  CASE WHEN p.e - f.cs <= 2000 THEN f.cs WHEN f.closed > 0 OR f.ce - f.cs >= 60 THEN greatest(f.cs, p.s - 200) ELSE p.s END,
  p.e,
  f.closed + (p.e - f.cs > 2000 AND f.ce - f.cs >= 60)::INT,
  CASE WHEN p.e - f.cs > 2000 AND f.ce - f.cs >= 60 THEN f.cs END, CASE WHEN p.e - f.cs > 2000 AND f.ce - f.cs >= 60 THEN f.ce END
FROM fold f JOIN para p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
wins AS (SELECT doc_id, ds AS s, de AS e, i FROM fold WHERE ds IS NOT NULL
UNION ALL SELECT doc_id, arg_max(cs, i), arg_max(ce, i), max(i) + 1 FROM fold GROUP BY doc_id HAVING arg_max(ce, i) - arg_max(cs, i) >= 60),
bare AS (SELECT doc_id, text FROM {source} WHERE doc_id NOT IN (SELECT doc_id FROM wins)),
fixed AS (SELECT doc_id, k * 2000 AS s, least(length(text), (k + 1) * 2000)::INT AS e, k AS i FROM (SELECT *, unnest(range(0, (length(text) + 1999) // 2000)) AS k FROM bare) WHERE least(length(text), (k + 1) * 2000) - k * 2000 >= 60),
allw AS (SELECT doc_id, s, e, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS k FROM (SELECT * FROM wins UNION ALL SELECT * FROM fixed))"""
)


def _trim_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


@query("SELECT doc_id, k::INT AS k, (k * 2000)::INT AS s, least(length(text), (k + 1) * 2000)::INT AS e FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1999) // 2000)) AS k FROM documents) WHERE least(length(text), (k + 1) * 2000) - k * 2000 >= 60")
def chunk_fixed_windows(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.fixed_windows(F.col("text"), 2000, 60)).alias("k", "w"))
    return cut.select("doc_id", "k", "w.s", "w.e")


@query(f"WITH RECURSIVE {WINDOWS_SQL.format(source='documents')} SELECT doc_id, k, s::INT AS s, e::INT AS e FROM allw")
def chunk_greedy(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.windows(F.col("text"), PLAIN)).alias("k", "w"))
    return cut.select("doc_id", "k", "w.s", "w.e")


@query("SELECT doc_id, greatest(1, floor(length(text) / 3.7::DOUBLE))::INT AS n_tokens_est, CASE WHEN doc_id % 10 = 0 THEN 'A' WHEN floor(length(text) / 3.7::DOUBLE) <= 1500 THEN 'C' ELSE 'B' END AS tier FROM documents")
def chunk_tier_route(spark, sf_dir):
    t = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("Art. 1º "), "text")).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", structure.structure(t, MARKED).alias("structure"), tokens_parsed(F.col("text")).alias("n_tokens_est"))
    return rows.select("doc_id", "n_tokens_est", chunking.tier(F.col("structure"), F.col("n_tokens_est"), MARKED).alias("tier"))


def _plain_chunks(spark, sf_dir) -> DataFrame:
    from ..schemas import NODES

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), "source", "text", F.array().cast(NODES).alias("structure"))
    return chunking.chunk_documents(chunking.with_estimate(docs), PLAIN)


_B = "(SELECT * FROM documents WHERE greatest(1, floor(length(text) / 3.7::DOUBLE)) > 1500)"
CHUNKS_SQL = f"""WITH RECURSIVE {WINDOWS_SQL.format(source=_B)},
ch AS (SELECT a.doc_id, source, 'B' AS tier, a.doc_id || '__b_' || printf('%03d', k) AS chunk_id, {_trim_sql('text[s + 1:e]')} AS text FROM allw a JOIN documents d ON d.doc_id = a.doc_id
UNION ALL SELECT doc_id, source, 'C', doc_id || '__doc', {_trim_sql('text')} FROM documents WHERE greatest(1, floor(length(text) / 3.7::DOUBLE)) <= 1500),
chunk AS (SELECT *, length(text)::INT AS n_chars, greatest(1, round_even(length(text) / 4::DOUBLE, 0))::INT AS n_tokens_est FROM ch WHERE tier = 'C' OR length(text) >= 60)"""


@query(f"{CHUNKS_SQL} SELECT doc_id, tier, chunk_id, n_chars, n_tokens_est, md5(text) AS digest FROM chunk")
def chunk_documents(spark, sf_dir):
    return _plain_chunks(spark, sf_dir).select("doc_id", "tier", "chunk_id", "n_chars", "n_tokens_est", F.md5("text").alias("digest"))


@query(f"{CHUNKS_SQL} SELECT tier, source, count(*) AS n, sum(n_tokens_est)::BIGINT AS n_tokens, max(n_chars) AS longest FROM chunk GROUP BY ALL")
def chunk_summary(spark, sf_dir):
    return _plain_chunks(spark, sf_dir).groupBy("tier", "source").agg(F.count("*").alias("n"), F.sum("n_tokens_est").alias("n_tokens"), F.max("n_chars").alias("longest"))


# A conversation as an act: each turn is a line under a marker.
ACTS_SQL = """lines AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Art. ' || turn || 'º' WHEN 'assistant' THEN '§ ' || turn || 'º' ELSE 'ANEXO' END AS label,
  CASE role WHEN 'user' THEN 'artigo' WHEN 'assistant' THEN 'paragrafo' ELSE 'anexo' END AS type, CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 4 ELSE 0 END AS rank,
  replace(text, chr(10), ' ') AS body FROM conversations WHERE text IS NOT NULL),
placed AS (SELECT *, coalesce(sum(length(label) + 1 + length(body) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start,
  (sum(length(label) + 1 + length(body) + 1) OVER (PARTITION BY conv_id) - 1)::INT AS total FROM lines)"""


def _acts(spark, sf_dir) -> DataFrame:
    label = F.when(F.col("role") == "user", F.concat(F.lit("Art. "), F.col("turn").cast("string"), F.lit("º"))).when(F.col("role") == "assistant", F.concat(F.lit("§ "), F.col("turn").cast("string"), F.lit("º"))).otherwise("ANEXO")
    line = F.concat_ws(" ", label, F.replace("text", F.lit("\n"), F.lit(" ")))
    turns = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: x["line"]), "\n")
    return turns.select("conv_id", text.alias("text")).withColumn("structure", structure.structure(F.col("text"), MARKED))


def _nodes(spark, sf_dir) -> DataFrame:
    return _acts(spark, sf_dir).select("conv_id", F.explode("structure").alias("n")).select("conv_id", "n.*")


@query(f"WITH {ACTS_SQL} SELECT conv_id, type, label, start FROM placed")
def structure_markers(spark, sf_dir):
    return _nodes(spark, sf_dir).select("conv_id", "type", "label", "start")


@query(f"WITH {ACTS_SQL} SELECT a.conv_id, a.start, coalesce(min(b.start), any_value(a.total))::INT AS \"end\" FROM placed a LEFT JOIN placed b ON b.conv_id = a.conv_id AND b.start > a.start AND b.rank <= a.rank GROUP BY a.conv_id, a.start")
def node_end(spark, sf_dir):
    return _nodes(spark, sf_dir).select("conv_id", "start", "end")


@query(f"WITH {ACTS_SQL} SELECT conv_id, start, CASE WHEN type = 'paragrafo' THEN coalesce(last_value(CASE WHEN type = 'artigo' THEN label END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY start), '') ELSE '' END AS parent FROM placed")
def asof_parent(spark, sf_dir):
    return _nodes(spark, sf_dir).select("conv_id", "start", "parent")


@query(
    f"""WITH {ACTS_SQL}, e AS (SELECT a.conv_id, a.type, a.label, a.start, coalesce(min(b.start), any_value(a.total))::INT AS stop FROM placed a LEFT JOIN placed b ON b.conv_id = a.conv_id AND b.start > a.start AND b.rank <= a.rank GROUP BY ALL)
    SELECT a.conv_id, a.label AS article, p.label AS paragraph FROM e a JOIN e p ON p.conv_id = a.conv_id AND a.type = 'artigo' AND p.type = 'paragrafo' AND p.start >= a.start AND p.stop <= a.stop"""
)
def range_containment(spark, sf_dir):
    """Paragraphs of each article, in the document's own row: no join at all."""
    rows = _acts(spark, sf_dir).select("conv_id", F.explode(F.filter("structure", lambda n: n["type"] == "artigo")).alias("a"), "structure")
    inside = F.filter("structure", lambda p: (p["type"] == "paragrafo") & (p["parent"] == F.col("a.label")) & (p["start"] >= F.col("a.start")) & (p["end"] <= F.col("a.end")))
    return rows.select("conv_id", F.col("a.label").alias("article"), F.explode(inside).alias("p")).select("conv_id", "article", F.col("p.label").alias("paragraph"))


QUERIES, ORACLES = query.queries, query.oracles
