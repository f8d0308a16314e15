"""Queries on text scalars and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleaning
from ..profiles import PLAIN, TITLES
from .common import Registry, table, words_sql

query = Registry()


@query(f"SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {words_sql('text')} AS t FROM documents)")
def tokenize_docs(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", T.word_tokens(F.col("text")).alias("t"))
    return words.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("SELECT doc_id, greatest(1, floor(length(text) / 3.7::DOUBLE))::INT AS parsed, greatest(1, round_even(length(text) / 4::DOUBLE, 0))::INT AS chunked FROM documents")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.tokens_parsed(F.col("text")).alias("parsed"), T.tokens_chunked(F.col("text")).alias("chunked"))


@query(
    r"""WITH x AS (SELECT p_partkey, '§ ' || p_partkey || 'º ' || p_name || ' – ' || p_type AS label FROM part),
    y AS (SELECT p_partkey, regexp_replace(replace(replace(replace(lower(label), '§', 'p'), 'º', ''), '°', ''), '[^\p{L}\p{N}_]+', '', 'g') AS s FROM x)
    SELECT p_partkey, CASE WHEN s = '' THEN 'x' ELSE s END AS slug FROM y"""
)
def slug_labels(spark, sf_dir):
    label = F.concat(F.lit("§ "), F.col("p_partkey").cast("string"), F.lit("º "), "p_name", F.lit(" – "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(label).alias("slug"))


@query(
    r"""SELECT doc_id, coalesce(nullif(lower(regexp_extract(lang || doc_id, '(?i)^([a-z]+)\d', 1)), ''), 'outros') AS of_stem,
    coalesce(nullif(regexp_extract(lower(source), '^([a-z]+?)(?:\d|_|$)', 1), ''), 'outro') AS of_file,
    coalesce(nullif(regexp_extract(upper(lang) || ' ' || doc_id, '^\s*([A-Z]{2,5})\b', 1), ''), 'OUTRO') AS of_title FROM documents"""
)
def type_prefix(spark, sf_dir):
    ident = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        T.type_of_stem(F.concat("lang", ident)).alias("of_stem"),
        T.type_of_file(F.col("source")).alias("of_file"),
        T.type_of_title(F.concat_ws(" ", F.upper("lang"), ident)).alias("of_title"),
    )


@query(
    r"""WITH x AS (SELECT page_id, 'ren' || (1980 + page_id % 60) || page_id AS stem, CASE WHEN page_id % 3 = 0 THEN 'misc' ELSE (2000 + page_id % 7)::VARCHAR END AS folder FROM pages),
    y AS (SELECT page_id, folder, try_cast(regexp_extract(stem, '(\d{4})', 1) AS INT) AS y FROM x)
    SELECT page_id, coalesce(CASE WHEN y BETWEEN 1996 AND 2030 THEN y END, CASE WHEN regexp_matches(folder, '^\d+$') THEN folder::INT END, 0)::INT AS year FROM y"""
)
def year_extract(spark, sf_dir):
    n = F.col("page_id")
    stem = F.concat(F.lit("ren"), (1980 + n % 60).cast("string"), n.cast("string"))
    folder = F.when(n % 3 == 0, "misc").otherwise((2000 + n % 7).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", T.year_of(stem, folder).alias("year"))


@query(
    """WITH x AS (SELECT doc_id, replace(replace(replace(text, ' a', chr(160) || chr(8220) || 'a'), 'e', 'e' || chr(769)), '. ', chr(8221) || chr(8203) || '.' || chr(8201)) AS t FROM documents)
    SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(nfc_normalize(t), chr(160), ' '), chr(8201), ' '), chr(8220), '"'), chr(8221), '"'), chr(8216), ''''), chr(8217), ''''), chr(8203), '')) AS digest FROM x"""
)
def normalize_text(spark, sf_dir):
    t = F.replace("text", F.lit(" a"), F.lit("\u00a0\u201ca"))
    t = F.replace(F.replace(t, F.lit("e"), F.lit("e\u0301")), F.lit(". "), F.lit("\u201d\u200b.\u2009"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_chars(t)).alias("digest"))


@query(
    r"""SELECT doc_id, md5(regexp_replace(replace(text, 'ti', 't-' || chr(10) || 'i'), '([A-Za-zÀ-ÿ])-\n([a-zà-ÿ])', '\1\2', 'g')) AS digest FROM documents"""
)
def dehyphenate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.dehyphenate(F.replace("text", F.lit("ti"), F.lit("t-\ni")))).alias("digest"))


@query(
    r"""WITH a AS (SELECT doc_id, regexp_replace(replace(text, '. ', '.  ' || chr(10) || ' ' || chr(10) || chr(10) || chr(9)), '[ \t]+', ' ', 'g') AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\n[ \t]+', chr(10), 'g'), '[ \t]+\n', chr(10), 'g') AS t FROM a),
    c AS (SELECT doc_id, regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g') AS t FROM b)
    SELECT doc_id, md5(regexp_replace(regexp_replace(t, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+', ''), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$', '')) AS digest FROM c"""
)
def collapse_blank(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse_blanks(F.replace("text", F.lit(". "), F.lit(".  \n \n\n\t")))).alias("digest"))


@query(
    r"""SELECT doc_id, md5(regexp_replace(doc_id % 1000 || '.' || chr(10) || ' ' || chr(10) || replace(text, '. ', '.' || chr(10) || '7.' || chr(10) || chr(10)),
    '(?m)^(\d{1,3})\.[ \t]*\n(?:[ \t]*\n)*[ \t]*(\S.*?)[ \t]*$', '\1. \2', 'g')) AS digest FROM documents"""
)
def lone_numbers(spark, sf_dir):
    t = F.concat((F.col("doc_id") % 1000).cast("string"), F.lit(".\n \n"), F.replace("text", F.lit(". "), F.lit(".\n7.\n\n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.join_lone_numbers(t)).alias("digest"))


@query("SELECT doc_id, unnest([12, 13])::INT AS num, unnest(['Documento SIC nº ' || doc_id || '/2020 de origem', 'Nota Técnica nº 5 de outra área']) AS text FROM documents")
def footnotes(spark, sf_dir):
    t = F.concat("text", F.lit("\n\n12 Documento SIC nº "), F.col("doc_id").cast("string"), F.lit("/2020 de origem\n\n13 Nota Técnica nº 5 de outra área\n\n12 SIC repetido, que não fica"))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return rows.select("doc_id", F.explode(T.footnotes(F.col("t"))).alias("f")).select("doc_id", "f.num", "f.text")


@query(
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?m)^\s*Released under the [A-Za-z0-9 .\-]+License\.?\s*$', '', 'g'), '(?m)^\s*Copyright .*$', '', 'g')) AS digest FROM documents"""
)
def boilerplate_removed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.drop_patterns(F.col("text"), PLAIN.boilerplate)).alias("digest"))


@query(
    r"""SELECT source, line, count(*)::BIGINT AS pages FROM (
    SELECT DISTINCT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
    WHERE length(line) BETWEEN 8 AND 200 GROUP BY ALL HAVING count(*) >= 3"""
)
def repeated_lines(spark, sf_dir):
    return cleaning.repeated_lines(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query(
    r"""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    rep AS (SELECT source, line FROM (SELECT DISTINCT source, doc_id, trim(raw) AS line FROM l) WHERE length(line) BETWEEN 8 AND 200 GROUP BY ALL HAVING count(*) >= 3),
    k AS (SELECT doc_id, pos, raw FROM l WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.source = l.source AND rep.line = trim(l.raw)))
    SELECT d.doc_id, md5(coalesce(string_agg(raw, chr(10) ORDER BY pos), '')) AS digest FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id"""
)
def strip_repeated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    repeated = cleaning.repeated_lines(docs, "source", "doc_id", "text")
    return cleaning.drop_repeated(docs, repeated, "source", "text").select("doc_id", F.md5("text").alias("digest"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN false ELSE length(text) / (doc_id % 7)::DOUBLE < 50 END AS suspect FROM documents"""
)
def ocr_suspect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.is_ocr_suspect(F.length("text"), F.col("doc_id") % 7).alias("suspect"))


_TABLES = """WITH t AS (SELECT p_brand, list([CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_size::VARCHAR END, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey::VARCHAR END, CASE WHEN p_size > 20 THEN p_type ELSE '-1,5' END] ORDER BY p_partkey) AS r FROM part GROUP BY p_brand)"""


def _part_tables(spark, sf_dir):
    text = F.col("p_size").cast("string")
    row = F.array(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(text), F.when(F.col("p_partkey") % 11 != 0, F.col("p_partkey").cast("string")), F.when(F.col("p_size") > 20, F.col("p_type")).otherwise("-1,5"))
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))).alias("all"))
    return rows.select("p_brand", F.transform("all", lambda x: x["row"]).alias("r"))


@query(
    _TABLES
    + r""", c AS (SELECT p_brand, len(r) AS n, list_filter(flatten(r), lambda c: c IS NOT NULL AND c <> '') AS c FROM t),
    s AS (SELECT p_brand, n, len(list_filter(c, lambda x: regexp_matches(x, '^[\d.,\-\s]+$'))) / len(c)::DOUBLE AS share FROM c)
    SELECT p_brand, share < 0.7 AND NOT (n > 15 AND share > 0.6) AS semantic FROM s"""
)
def semantic_table(spark, sf_dir):
    return _part_tables(spark, sf_dir).select("p_brand", cleaning.is_semantic_table(F.col("r")).alias("semantic"))


@query(
    _TABLES
    + """, l AS (SELECT p_brand, list_transform(r, lambda x: '| ' || array_to_string(list_transform(x, lambda c: coalesce(trim(c), '')), ' | ') || ' |') AS l FROM t)
    SELECT p_brand, md5(l[1] || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(l[2:], chr(10))) AS digest FROM l"""
)
def table_markdown(spark, sf_dir):
    return _part_tables(spark, sf_dir).select("p_brand", F.md5(cleaning.table_markdown(F.col("r"))).alias("digest"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract(props, '$.k')::BIGINT END AS k FROM events"""
)
def json_repair(spark, sf_dir):
    way = F.col("event_id") % 4
    raw = F.when(way == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(way == 1, F.concat(F.lit("The answer is "), "props", F.lit(" as asked."))).when(way == 2, F.col("props")).otherwise("no { json } here")
    return table(spark, sf_dir, "events").select("event_id", T.json_answer(raw, "k bigint").k.alias("k"))


@query(
    """SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::INT AS size_bytes, starts_with(text, 'The') AS has_magic FROM documents"""
)
def sha256_manifest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size_bytes"), F.startswith("text", F.lit("The")).alias("has_magic"))


@query(
    """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc/' || doc_id || '__b_000')) AS h FROM documents)
    SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%02x', ('0x' || h[17:18])::INT & 63 | 128) || h[19:20] || '-' || h[21:32] AS id FROM h"""
)
def chunk_uuid5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.uuid5(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit("__b_000"))).alias("id"))


@query(
    r"""SELECT doc_id, 'PORTARIA Nº ' || doc_id AS title, CASE WHEN length(s) > 800 THEN regexp_replace(s[1:800], ' [^ ]*$', '') || '...' ELSE s END AS summary
    FROM (SELECT doc_id, trim(string_split(regexp_replace(text, '\s+', ' ', 'g'), '. ')[1] || ' fim') AS s FROM documents)"""
)
def title_summary(spark, sf_dir):
    first = F.element_at(F.split(F.regexp_replace("text", r"\s+", " "), r"\. ", -1), 1)
    t = F.concat(F.lit("Capa\n\nPORTARIA Nº "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.trim(first), F.lit(" fim\n\n"), "text")
    found = T.title_and_summary(t, tuple(x.replace("(?:{agency}\\s+)?", "") for x in TITLES))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("f")).select("doc_id", "f.title", "f.summary")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '48500.' || lpad(doc_id::VARCHAR, 6, '0') || '/' || (2000 + doc_id % 24) || '-' || lpad((doc_id % 97)::VARCHAR, 2, '0') END AS processo FROM documents"""
)
def process_number(spark, sf_dir):
    i = F.col("doc_id")
    number = F.concat(F.lit("Processo nº: 48500. "), F.lpad(i.cast("string"), 6, "0"), F.lit(" / "), (2000 + i % 24).cast("string"), F.lit("-"), F.lpad((i % 97).cast("string"), 2, "0"))
    t = F.concat_ws("\n", "text", F.when(i % 5 != 0, number), F.lit("Processo 1.2/3-4"))
    return table(spark, sf_dir, "documents").select("doc_id", T.process_number(t).alias("processo"))


@query(
    """SELECT page_id, array_to_string(list_filter([upper(split_part(split_part(url, '//', 2), '.', 1)), CASE WHEN page_id % 3 = 0 THEN NULL ELSE (2000 + page_id % 9)::VARCHAR END, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'p' || page_id END], lambda x: x IS NOT NULL AND x <> ''), ' | ') AS label,
    trim(replace(html, chr(10), ' '))[1:200] AS snippet FROM pages"""
)
def label_lines(spark, sf_dir):
    i = F.col("page_id")
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("."), F.lit(1))
    label = T.label_line(host, F.when(i % 3 == 0, 0).otherwise(2000 + i % 9), F.when(i % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("p"), i.cast("string"))), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", label.alias("label"), T.snippet(F.col("html")).alias("snippet"))


QUERIES, ORACLES = query.queries, query.oracles
