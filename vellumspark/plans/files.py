"""Queries on sources and sinks: the files are made from the tables first, then read or written by the operators."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators import corpus, evaluate, models
from ..operators.cleaning import looks_scanned, page_text
from ..schemas import PAYLOAD, PAYLOAD_SMALL
from ..sources import files, readers, writers
from ..sources.config import parse_settings
from ..sources.scratch import scratch
from .chunks import _plain_chunks
from .common import Registry, table

query = Registry()

# Each page as an entry of the metadata of its year and day; some lack a file name.
ENTRIES_SQL = r"""ent AS (SELECT page_id, (2015 + page_id % 8)::INT AS ano, page_id % 3 AS day, 't ' || page_id AS titulo, CASE WHEN page_id % 5 = 0 THEN 'Voto' ELSE 'Texto' END AS tipo,
CASE WHEN page_id % 2 = 0 THEN 'http' ELSE 'https' END || '://example.org/f' || (page_id * 7 % 50) || CASE WHEN page_id * 7 % 50 % 9 = 0 THEN '.html' ELSE '.pdf' END AS url, 'f' || page_id || '.pdf' AS arquivo FROM pages WHERE page_id % 11 <> 0)"""


def _metadata(spark, sf_dir) -> DataFrame:
    """The entries, written as one file for each year (and one without a year in its name, which is not read)."""
    i = F.col("page_id")
    k = i * 7 % 50
    url = F.concat(F.when(i % 2 == 0, "http").otherwise("https"), F.lit("://example.org/f"), k.cast("string"), F.when(k % 9 == 0, ".html").otherwise(".pdf"))
    name = F.when(i % 11 == 0, "").otherwise(F.concat(F.lit(" f"), i.cast("string"), F.lit(".pdf ")))
    pdf = F.struct(url.alias("url"), name.alias("arquivo"), F.when(i % 5 == 0, "Voto").otherwise("Texto").alias("tipo"))
    record = F.to_json(F.struct(F.concat(F.lit(" t "), i.cast("string"), F.lit(" ")).alias("titulo"), F.array(pdf).alias("pdfs")))
    rows = table(spark, sf_dir, "pages").select((2015 + i % 8).alias("ano"), (i % 3).alias("day"), i.alias("i"), record.alias("record"))
    joined = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c]), ", ")
    days = rows.groupBy("ano", "day").agg(joined("record", "i").alias("records"))
    block = F.format_string('"2020-01-%02d": {"registros": [%s]}', (F.col("day") + 1).cast("int"), F.col("records"))
    years = days.select("ano", "day", block.alias("block")).groupBy("ano").agg(joined("block", "day").alias("blocks"))
    content = F.concat(F.lit("{"), "blocks", F.lit(', "zz": "no object"}'))
    made = years.select(F.format_string("x_%d_metadados.json", F.col("ano").cast("int")).alias("path"), content.alias("content"))
    root = scratch(spark, "metadata")
    files.write_files(made.union(made.limit(1).select(F.lit("extra_metadados.json"), "content")), root)
    return readers.read_metadata(spark, f"{root}/*_metadados.json")


@query(f"WITH {ENTRIES_SQL} SELECT ano, titulo, tipo, url, arquivo FROM ent")
def metadata_entries(spark, sf_dir):
    return _metadata(spark, sf_dir).select("ano", "titulo", "tipo", "url", "arquivo")


@query(
    f"""WITH {ENTRIES_SQL}, ok AS (SELECT *, regexp_replace(url, '^http://', 'https://') AS u FROM ent WHERE tipo = 'Voto' AND ends_with(url, '.pdf'))
    SELECT u AS url, arg_min(arquivo, (ano, day, page_id)) AS arquivo, arg_min(ano, (ano, day, page_id)) AS ano_destino, count(*)::INT AS n_fontes FROM ok GROUP BY u"""
)
def metadata_tasks_of_kind(spark, sf_dir):
    return corpus.download_tasks(_metadata(spark, sf_dir), "Voto").select("url", "arquivo", "ano_destino", F.size("fontes").alias("n_fontes"))


@query(f"WITH {ENTRIES_SQL} SELECT count_if(NOT ends_with(url, '.pdf'))::BIGINT AS n_skipped, count(*) AS n FROM ent WHERE tipo = 'Voto'")
def skipped_of_kind(spark, sf_dir):
    return corpus.skipped_urls(_metadata(spark, sf_dir), "Voto")


@query("SELECT event_id AS a, event_type AS b, NULL::VARCHAR AS line FROM events WHERE event_id % 10 > 1 UNION ALL SELECT NULL, NULL, '{\"a\": ' || event_id FROM events WHERE event_id % 10 = 1")
def json_lines_tolerant(spark, sf_dir):
    i = F.col("event_id")
    line = F.when(i % 10 == 0, "  ").when(i % 10 == 1, F.concat(F.lit('{"a": '), i.cast("string"))).otherwise(F.to_json(F.struct(i.alias("a"), F.col("event_type").alias("b"))))
    path = scratch(spark, "lines")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    rows, bad = readers.read_json_lines(spark, path, "a bigint, b string", strict=False)
    return rows.select("a", "b", F.lit(None).cast("string").alias("line")).union(bad.select(F.lit(None).cast("bigint"), F.lit(None).cast("string"), "line"))


@query("SELECT n_nationkey AS a, n_name AS b FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) + sum((n_nationkey % 5 = 0)::INT) OVER (ORDER BY n_nationkey) AS line FROM nation) WHERE line <= 14")
def json_lines_strict(spark, sf_dir):
    """The first 14 lines of a file, blank ones among them; a bad line would end the query."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b"))
    line = F.concat(F.when(F.col("a") % 5 == 0, "\n").otherwise(""), F.to_json(F.struct("a", "b")), F.lit("\n"))
    whole = rows.select("a", line.alias("line")).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "line"))), lambda x: x["line"]), "").alias("content"))  # 25 rows
    root = scratch(spark, "lines")
    files.write_files(whole.select(F.lit("nations.jsonl").alias("path"), "content"), root)
    return readers.read_json_lines(spark, f"{root}/nations.jsonl", "a int, b string", limit=14)[0]


# Each passage as a file of some year and type.
FILES_SQL = "f AS (SELECT item_id, 2015 + item_id % 8 AS y, ['ren', 'dsp', 'Voto', 'x_'][item_id % 4 + 1] AS kind, CASE WHEN item_id % 6 = 0 THEN '' ELSE '%PDF-' END || text AS content FROM benchmark)"


def _passage_files(spark, sf_dir) -> DataFrame:
    i = F.col("item_id")
    year, kind = (2015 + i % 8).cast("string"), F.element_at(F.array(*map(F.lit, ("ren", "dsp", "Voto", "x_"))), (i % 4 + 1).cast("int"))
    content = F.concat(F.when(i % 6 == 0, "").otherwise("%PDF-"), "text")
    rows = table(spark, sf_dir, "benchmark").select(F.concat(year, F.lit("/"), kind, year, F.lit("00"), i.cast("string"), F.lit(".pdf")).alias("path"), content.alias("content"))
    root = scratch(spark, "files")
    files.write_files(rows.union(rows.limit(1).select(F.lit("2015/notes.txt"), "content")), root)
    return readers.read_page_files(spark, root)


@query(
    rf"""WITH {FILES_SQL} SELECT y || '/' || kind || y || '00' || item_id AS doc_id, kind || y || '00' || item_id || '.pdf' AS filename, CASE WHEN kind = 'x_' THEN 'outros' ELSE lower(kind) END AS tipo_ato, y::INT AS year,
    octet_length(encode(content))::BIGINT AS size_bytes, sha256(content) AS sha256, starts_with(content, '%PDF-') AS is_pdf FROM f"""
)
def page_files(spark, sf_dir):
    return _passage_files(spark, sf_dir).drop("content")


def _extract(raw: bytes) -> list:
    """Stand-in extractor: two pages of a file's words; the second page of some can't be read, and no file without its mark."""
    if not raw.startswith(b"%PDF-"):
        raise ValueError("no PDF")
    words = raw[5:].decode().split(" ")
    block = lambda some, at: {"x0": 0.0, "y0": float(at), "x1": 1.0, "y1": at + 1.0, "text": " ".join(some), "type": 0}

    def second() -> dict:
        if len(words) % 3 == 0:
            raise ValueError("broken page")
        return {"width": 100.0, "blocks": [block(words[20:], 2), block(words[10:20], 1)], "tables": []}

    return [{"width": 100.0, "blocks": [block(words[:10], 1)], "tables": []}, second]


@query(
    rf"""WITH {FILES_SQL}, w AS (SELECT y || '/' || kind || y || '00' || item_id AS doc_id, string_split(content[6:], ' ') AS w FROM f WHERE content[1:5] = '%PDF-')
    SELECT doc_id, 1::INT AS page, trim(array_to_string(w[1:10], ' ')) AS text FROM w
    UNION ALL SELECT doc_id, 2, CASE WHEN len(w) % 3 = 0 THEN '' ELSE array_to_string(list_filter([trim(array_to_string(w[11:20], ' ')), trim(array_to_string(w[21:], ' '))], lambda x: x <> ''), chr(10)) END FROM w"""
)
def extracted_pages(spark, sf_dir):
    pages = readers.extract_pages(_passage_files(spark, sf_dir), _extract)
    return pages.select("doc_id", "page", page_text(F.coalesce("blocks", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double,text:string,type:int>>"))).alias("text"))


@query(f"WITH {FILES_SQL} SELECT y || '/' || kind || y || '00' || item_id AS doc_id, 'open_failed' AS error FROM f WHERE content[1:5] <> '%PDF-'")
def unread_files(spark, sf_dir):
    found = _passage_files(spark, sf_dir)
    return readers.unread(found, readers.extract_pages(found, _extract))


# Each order as a page whose lines are its blocks.
BLOCKS_SQL = """b AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 * 0.25::DOUBLE AS y, l_partkey % 90 + l_quantity / 8 AS x, CASE WHEN l_linenumber % 5 = 4 THEN 1 ELSE 0 END AS kind, CASE WHEN l_partkey % 7 = 0 THEN '  ' ELSE l_returnflag || l_partkey END AS t, l_suppkey FROM lineitem)"""


def _order_pages(spark, sf_dir) -> DataFrame:
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    y, x = n % 4 * F.lit(0.25), part % 90 + F.col("l_quantity") / 8
    t = F.when(part % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "l_returnflag", part.cast("string")))
    block = F.struct(x.alias("x0"), y.alias("y0"), (x + 4).alias("x1"), (y + 1).alias("y1"), t.alias("text"), F.when(n % 5 == 4, 1).otherwise(0).alias("type"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(n, "l_suppkey", part, block.alias("block")).alias("s"))
    return rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["block"]).alias("blocks"))


@query(
    f"""WITH {BLOCKS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, t) AS i FROM b)
    SELECT o.l_orderkey, coalesce(string_agg(trim(t), chr(10) ORDER BY round_even(y, 1), round_even(x, 1), i) FILTER (WHERE kind = 0 AND trim(t) <> ''), '') AS text,
    count_if(kind = 0) >= 4 AND count_if(kind = 0 AND x + 2 < 45) >= 2 AND count_if(kind = 0 AND x + 2 > 55) >= 2 AS wide FROM i o GROUP BY o.l_orderkey"""
)
def page_blocks(spark, sf_dir):
    from ..operators.cleaning import is_multi_column

    return _order_pages(spark, sf_dir).select("l_orderkey", page_text(F.col("blocks")).alias("text"), is_multi_column(F.col("blocks"), F.lit(100.0)).alias("wide"))


@query(
    """SELECT conv_id, sum(length(text) // 7) FILTER (WHERE turn < 5) / count(*) FILTER (WHERE turn < 5)::DOUBLE < 100 AND sum(turn % 2) FILTER (WHERE turn < 5) > 0 AS scanned FROM conversations GROUP BY conv_id"""
)
def scanned_documents(spark, sf_dir):
    """Turns as pages with a seventh of their characters; every second one has an image."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.floor(F.length("text") / 7).alias("n")))).alias("p"))
    return rows.select("conv_id", looks_scanned(F.transform("p", lambda x: x["n"]), F.transform("p", lambda x: x["turn"] % 2)).alias("scanned"))


UUID_SQL = """h AS (SELECT doc_id, text, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc/' || doc_id)) AS h FROM documents),
u AS (SELECT doc_id, text, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%02x', ('0x' || h[17:18])::INT & 63 | 128) || h[19:20] || '-' || h[21:32] AS id FROM h)"""


def _upserted(spark, sf_dir) -> DataFrame:
    """Two batches: all documents, then a third of them with another text, one of these twice."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("chunk_id"), "doc_id", F.col("source").alias("tipo_ato"), F.lit(1).alias("version"), "text")
    some = docs.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    path = scratch(spark, "points")
    writers.write_points(docs, path, ["tipo_ato"])
    return writers.write_points(some.union(some.withColumns({"version": F.lit(0), "text": F.lit("older")})), path, ["tipo_ato"])


@query(f"WITH {UUID_SQL} SELECT id, doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN 'new ' || text ELSE text END) AS digest FROM u")
def points_upsert(spark, sf_dir):
    return _upserted(spark, sf_dir).select("id", "doc_id", F.md5("text").alias("digest"))


@query("SELECT count(*) AS points_count, 'green' AS status FROM documents")
def points_stats(spark, sf_dir):
    return writers.collection_stats(_upserted(spark, sf_dir))


@query(f"WITH {UUID_SQL} SELECT id, doc_id, md5(text) AS digest FROM u")
def points_restored(spark, sf_dir):
    """A stored table is kept, its snapshot put back elsewhere, and that is read."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("chunk_id"), "doc_id", "text")
    path, copy, back = scratch(spark, "points"), scratch(spark, "snapshot"), scratch(spark, "restored")
    writers.write_points(docs, path)
    files.snapshot(spark, path, copy)
    files.restore(spark, copy, back)
    return writers.read_points(spark, back).select("id", "doc_id", F.md5("text").alias("digest"))


# What a stand-in for the network says about each page's address.
FETCH_SQL = """g AS (SELECT page_id, 'u/' || page_id AS url, CASE page_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN NULL ELSE 200 END AS status, CASE page_id % 6 WHEN 3 THEN '<html>' ELSE '%PDF-' || page_id END AS content FROM pages)"""


def _get(url: str) -> tuple[int, bytes]:
    k = int(url.split("/")[1])
    if k % 6 == 2:
        raise TimeoutError
    return (404, 503, 0, 200, 200, 200)[k % 6], b"<html>" if k % 6 == 3 else b"%%PDF-%d" % k


def _outcomes(spark, sf_dir) -> DataFrame:
    i = F.col("page_id").cast("string")
    tasks = table(spark, sf_dir, "pages").select(F.concat(F.lit("u/"), i).alias("url"), F.concat(F.lit("2020/f"), i, F.lit(".pdf")).alias("local_path"))
    root = scratch(spark, "fetched")
    files.fetch(tasks, f"{root}/files", _get).write.parquet(f"{root}/outcomes")
    return spark.read.parquet(f"{root}/outcomes")


@query(
    f"""WITH {FETCH_SQL} SELECT url, CASE WHEN page_id % 6 > 3 THEN 'manifest' ELSE 'failures' END AS kind, status::INT AS http_status, CASE WHEN page_id % 6 IN (1, 2) THEN 3 ELSE 1 END::INT AS attempts,
    CASE page_id % 6 WHEN 0 THEN 'http_404' WHEN 1 THEN 'http_503' WHEN 2 THEN 'TimeoutError' WHEN 3 THEN 'not_pdf' END AS error, CASE WHEN page_id % 6 > 3 THEN octet_length(encode(content)) END::BIGINT AS size_bytes, CASE WHEN page_id % 6 > 3 THEN sha256(content) END AS sha256 FROM g"""
)
def fetch_outcomes(spark, sf_dir):
    root = scratch(spark, "manifest")
    writers.write_outcomes(_outcomes(spark, sf_dir), root)
    schema = "url string, http_status int, attempts int, error string, size_bytes bigint, sha256 string"
    part = lambda kind: spark.read.schema(schema).json(f"{root}/{kind}").select("url", F.lit(kind).alias("kind"), "http_status", "attempts", "error", "size_bytes", "sha256")
    return part("manifest").union(part("failures"))


@query("SELECT 'u/' || page_id AS url, octet_length(encode('%PDF-' || page_id))::BIGINT AS size FROM pages WHERE page_id % 6 > 3")
def fetched_files(spark, sf_dir):
    """What a manifest lists is there, whole."""
    i = F.col("page_id").cast("string")
    tasks = table(spark, sf_dir, "pages").select(F.concat(F.lit("u/"), i).alias("url"), F.concat(F.lit("f"), i, F.lit(".pdf")).alias("local_path"))
    root = scratch(spark, "fetched")
    files.fetch(tasks, f"{root}/files", _get).write.parquet(f"{root}/outcomes")
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(f"{root}/files").select(F.regexp_extract("path", r"([^/]*)$", 1).alias("local_path"), F.col("length").alias("size"))
    return spark.read.parquet(f"{root}/outcomes").where("sha256 is not null").join(there, "local_path").select("url", "size")


@query("SELECT count_if(page_id % 6 > 3)::BIGINT AS n_ok, count_if(page_id % 6 <= 3)::BIGINT AS n_failed, true AS timed FROM pages")
def run_counts(spark, sf_dir):
    outcome, began = _outcomes(spark, sf_dir), time.time()
    one = writers.run_summary(outcome, {"n_ok": F.col("sha256").isNotNull(), "n_failed": F.col("sha256").isNull()}, began)
    return one.select("n_ok", "n_failed", (F.col("duration_s") >= 0).alias("timed"))


EVALUATED_SQL = """q AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'negative' ELSE 'factual' END AS tipo_query, list_transform(range(0, 20), lambda k: (item_id * 3 + k * 7) % 40) AS ids FROM benchmark),
m AS (SELECT *, list_position(ids, item_id) AS p FROM q)"""


@query(
    f"""WITH {EVALUATED_SQL} SELECT item_id, CASE WHEN tipo_query = 'factual' THEN (coalesce(p, 99) <= 5)::INT END::BIGINT AS hit_5, CASE WHEN tipo_query = 'factual' THEN (coalesce(p, 99) <= 20)::INT END::BIGINT AS hit_20,
    CASE WHEN tipo_query = 'factual' THEN round(coalesce(1 / p::DOUBLE, 0), 6) END AS rr, count(*) FILTER (WHERE tipo_query = 'factual') OVER () AS n FROM m"""
)
def evaluation_files(spark, sf_dir):
    """Results of each question and the summary, written and read back."""
    i = F.col("item_id")
    ids = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: (i * 3 + k * 7) % 40)
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.when(i % 5 == 0, "negative").otherwise("factual").alias("tipo_query"), ids.alias("retrieved_ids"), F.array(i).alias("relevant_ids"))
    metrics, root = evaluate.question_metrics(rows), scratch(spark, "evaluation")
    writers.write_evaluation(metrics, evaluate.summary(metrics), root)
    results = spark.read.schema("item_id bigint, hit_5 bigint, hit_20 bigint, rr double").json(f"{root}/results")
    whole = spark.read.schema("n bigint").json(f"{root}/summary")
    return results.select("item_id", "hit_5", "hit_20", F.round("rr", 6).alias("rr")).crossJoin(F.broadcast(whole))  # one row


def _document_pages(spark, sf_dir) -> DataFrame:
    """Each document as one page of an act; every ninth can't be read, every fourth has an image."""
    i = F.col("doc_id")
    name = F.concat(F.lit("2020/"), F.when(i % 2 == 0, "ren").otherwise("dsp"), F.lit("2020"), F.lpad(i.cast("string"), 7, "0"))
    block = lambda text, kind: F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"), text.alias("text"), F.lit(kind).alias("type"))
    blocks = F.when(i % 4 == 0, F.array(block(F.col("text"), 0), block(F.lit(""), 1))).otherwise(F.array(block(F.col("text"), 0)))
    error = F.when(i % 9 == 0, "open_failed")
    kinds = dict(x.split(" ", 1) for x in ("blocks array<struct<x0:double,y0:double,x1:double,y1:double,text:string,type:int>>", "tables array<array<array<string>>>"))
    return table(spark, sf_dir, "documents").select(name.alias("doc_id"), F.lit(1).alias("page"), F.lit(100.0).alias("width"), blocks.cast(kinds["blocks"]).alias("blocks"), F.array().cast(kinds["tables"]).alias("tables"), F.col("source").alias("pdf_creator"), error.alias("error"))


@query(
    """SELECT '2020/' || CASE WHEN doc_id % 2 = 0 THEN 'ren' ELSE 'dsp' END || '2020' || lpad(doc_id::VARCHAR, 7, '0') AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ren' ELSE 'dsp' END AS tipo_ato, 2020::BIGINT AS year, length(text) AS size,
    length(text) < 100 AND doc_id % 4 = 0 AS ocr_suspect, CASE WHEN doc_id % 9 = 0 THEN 'open_failed' END AS error, source AS pdf_creator, text[1:300] AS first_text FROM documents"""
)
def profile_report(spark, sf_dir):
    """The profile of every file, from the report that was written."""
    per, root = corpus.page_profile(_document_pages(spark, sf_dir)), scratch(spark, "report")
    writers.write_report({"n": 0}, per, root)
    return spark.read.schema("doc_id string, tipo_ato string, year bigint, size bigint, ocr_suspect boolean, error string, pdf_creator string, first_text string").json(f"{root}/per_pdf")


@query("SELECT '2020/' || CASE WHEN doc_id % 2 = 0 THEN 'ren' ELSE 'dsp' END || '2020' || lpad(doc_id::VARCHAR, 7, '0') AS doc_id, 'open_failed' AS error FROM documents WHERE doc_id % 9 = 0 ORDER BY 1 LIMIT 5")
def first_errors(spark, sf_dir):
    return corpus.first_errors(corpus.page_profile(_document_pages(spark, sf_dir)), "error", "doc_id").select("doc_id", "error")


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 2")
def type_samples(spark, sf_dir):
    return corpus.kind_samples(table(spark, sf_dir, "documents"), "source", "doc_id", ["n_chars"])


@query("SELECT source, CASE source WHEN 'src1' THEN coalesce(max(CASE WHEN doc_id = 31 THEN 31 END), min(doc_id)) ELSE min(doc_id) END AS doc_id FROM documents WHERE source IN ('src0', 'src1', 'src2') GROUP BY source")
def named_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"))
    return corpus.samples_of(rows, {"src0": "none", "src1": "000000031", "src2": "none"}, "source", "path").select("source", F.col("path").cast("bigint").alias("doc_id"))


@query("SELECT conv_id, turn, md5(text) AS digest FROM conversations WHERE turn < 3")
def first_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").withColumn("page", F.col("turn") + 1)
    return readers.first_pages(pages).select("conv_id", "turn", F.md5("text").alias("digest"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 7 IN (1, 3) ORDER BY doc_id LIMIT 40")
def limited_documents(spark, sf_dir):
    """Members of a list, and the first 40 by path."""
    return table(spark, sf_dir, "documents").where((F.col("doc_id") % 7).isin(1, 3)).orderBy("doc_id").limit(40).select("doc_id", "lang")


@query(
    """SELECT CASE WHEN doc_id % 4 = 0 THEN printf('%2d. [%.4f] %s | %s', (doc_id % 50 + 1)::INT, n_chars / 1000.0, doc_id::VARCHAR, trim(replace(text, chr(10), ' '))[1:200]) ELSE printf('%2d. [%.4f] %s | ', (doc_id % 50 + 1)::INT, n_chars / 1000.0, doc_id::VARCHAR) END AS line,
    CASE WHEN doc_id % 4 = 0 THEN trim(replace(text, chr(10), ' '))[1:200] ELSE '' END AS shown FROM documents"""
)
def hits_rendered(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50 + 1).cast("int").alias("rank"), (F.col("n_chars") / 1000.0).alias("score"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, F.col("text")).alias("text"))
    return writers.rendered_hits(rows).select("line", F.get_json_object("json", "$.text").alias("shown"))


@query(
    """SELECT conv_id, turn, 'said ' || turn || CASE WHEN turn % 3 > 0 THEN chr(10) || chr(10) || 'Fontes:' || chr(10) || '  [1] c' || conv_id || '  u/1' || CASE WHEN turn % 3 = 2 THEN chr(10) || '  [2] c' || turn || '  ' ELSE '' END ELSE '' END AS shown, (turn % 3)::INT AS n FROM conversations"""
)
def answers_rendered(spark, sf_dir):
    one = lambda n, chunk, url: F.struct(F.lit(n).alias("n"), chunk.alias("chunk_id"), url.cast("string").alias("url"))
    first, second = one(1, F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("u/1")), one(2, F.concat(F.lit("c"), F.col("turn").cast("string")), F.lit(None))
    cited = F.slice(F.array(first, second), F.lit(1), (F.col("turn") % 3).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("said "), F.col("turn").cast("string")).alias("answer"), cited.alias("citations"))
    return writers.rendered_answer(rows).select("conv_id", "turn", "shown", F.size(F.from_json("json", "citations array<struct<n:int>>")["citations"]).alias("n"))


@query("SELECT doc_id, 3::INT AS small, 5::INT AS whole, 9::INT AS of_small, 16::INT AS of_whole FROM documents WHERE greatest(1, floor(length(text) / 3.7::DOUBLE)) <= 1500")
def payload_columns(spark, sf_dir):
    """Of a chunk's columns only the payload's are kept."""
    chunks = _plain_chunks(spark, sf_dir).where("tier = 'C'").select("chunk_id", "doc_id", "tier", "n_chars", "n_tokens_est", "text")
    small, whole = ([c for c in names if c in chunks.columns] for names in (PAYLOAD_SMALL, PAYLOAD))
    return chunks.select(*whole).select("doc_id", *[F.lit(n).alias(k) for k, n in (("small", len(small)), ("whole", len(whole)), ("of_small", len(PAYLOAD_SMALL)), ("of_whole", len(PAYLOAD)))])


@query("""SELECT 'N' || n_nationkey AS name, CASE WHEN n_nationkey % 3 = 0 THEN n_name || '=x' WHEN n_nationkey % 3 = 1 THEN n_name ELSE '' END AS value FROM nation WHERE n_nationkey % 5 > 0""")
def settings_file(spark, sf_dir):
    """A settings file with a line for each nation: quoted, plain and empty values, comments and other lines."""
    i, name = F.col("n_nationkey"), F.col("n_name")
    value = F.when(i % 3 == 0, F.concat(F.lit("'"), name, F.lit("=x'"))).when(i % 3 == 1, F.concat(F.lit('  "'), name, F.lit('" '))).otherwise("")
    line = F.when(i % 10 == 0, F.concat(F.lit(" # N"), name, F.lit("=1"))).when(i % 5 == 0, name).otherwise(F.concat(F.lit(" N"), i.cast("string"), F.lit(" ="), value))
    lines = [r[0] for r in table(spark, sf_dir, "nation").select(line).collect()]  # 25 rows
    return spark.createDataFrame(list(parse_settings("\n".join(lines)).items()), "name string, value string")


@query("SELECT role, count(*) AS n FROM conversations GROUP BY role")
def kind_distribution(spark, sf_dir):
    return corpus.counts(table(spark, sf_dir, "conversations"), "role")


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN greatest(0, (user_id - 10))::DOUBLE WHEN 1 THEN (user_id * 60)::DOUBLE END AS wait, least(60, pow(2, event_id % 8) + 0.5)::DOUBLE AS backoff FROM events"""
)
def retry_waits(spark, sf_dir):
    i, now = F.col("event_id"), F.lit("2024-05-06 07:08:09").cast("timestamp")
    later = F.concat(F.lit("Mon, "), F.date_format(F.timestamp_seconds(F.unix_timestamp(now) + F.col("user_id") * 60), "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    value = F.when(i % 3 == 0, (F.col("user_id") - 10).cast("string")).when(i % 3 == 1, later).otherwise("soon")
    return table(spark, sf_dir, "events").select("event_id", T.retry_after(value, now).alias("wait"), T.backoff(i % 8, F.lit(0.5)).alias("backoff"))


class _Letters:
    """Stand-in embedder: how often the first letters stand in a text."""

    def encode(self, texts: list[str], return_dense: bool = True, return_sparse: bool = True) -> dict:
        return {"dense_vecs": [[t.count(c) for c in "abc"] for t in texts], "lexical_weights": [{str(len(t)): 0.5} for t in texts]}


@query(
    """SELECT doc_id, list_transform(['a', 'b', 'c'], lambda c: length(text) - length(replace(text, c, '')))::FLOAT[] AS dense, length(text)::INT AS token, 0.5::FLOAT AS weight FROM documents"""
)
def embedded_texts(spark, sf_dir):
    rows = models.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _Letters)
    return rows.select("doc_id", "dense", F.map_keys("sparse")[0].alias("token"), F.map_values("sparse")[0].alias("weight"))


class _Unsure:
    """Stand-in generator that answers at the third try, and never for every fourth prompt."""

    def __init__(self):
        self.asked: dict[str, int] = {}

    def complete(self, system: str, prompt: str, max_tokens: int) -> tuple[str, dict[str, int]]:
        self.asked[prompt] = self.asked.get(prompt, 0) + 1
        if self.asked[prompt] < 3 or int(prompt) % 4 == 0:
            raise TimeoutError
        return f'```json\n{{"k": {prompt}}}\n```', {"output_tokens": max_tokens}


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 4 > 0 THEN doc_id END AS k, CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 4 > 0 THEN 1024 ELSE 0 END::INT AS output_tokens FROM documents")
def retried_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).alias("prompt"))
    said = models.generate(rows, _Unsure, tries=models.TRIES)
    return said.select("doc_id", T.json_answer(F.coalesce("answer", F.lit("")), "k bigint")["k"].alias("k"), "output_tokens")


class _Strict:
    """Stand-in judge: says what it is shown."""

    def complete(self, system: str, prompt: str, max_tokens: int) -> str:
        shown = prompt.split("Contextos:\n")[1].split("\n\nResposta:")[0]
        return "none" if "q3" in prompt else f'{{"faithfulness": {int(len(shown) == 3000)}, "answer_relevance": {int("---" in shown)}}}'


@query(
    """WITH t AS (SELECT doc_id % 9 AS g, doc_id, text FROM documents), c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || '---' || chr(10) || text ELSE text END AS held FROM t)
    SELECT doc_id, CASE WHEN doc_id % 9 = 3 THEN -1 ELSE (length(held) >= 3000)::INT END::INT AS faithfulness, CASE WHEN doc_id % 9 = 3 THEN -1 ELSE contains(held[1:3000], '---')::INT END::INT AS relevance FROM c"""
)
def judged_answers(spark, sf_dir):
    contexts = F.when(F.col("doc_id") % 2 == 0, F.array("text", "text")).otherwise(F.array("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("q"), (F.col("doc_id") % 9).cast("string")).alias("question"), contexts.alias("contexts"), F.lit("yes").alias("answer"))
    return models.judge(rows, _Strict).select("doc_id", "faithfulness", "relevance")


QUERIES, ORACLES = query.queries, query.oracles
