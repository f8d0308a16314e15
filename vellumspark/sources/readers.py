"""Sources: nested metadata files, JSON lines, and trees of page files."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import type_of_stem, year_of
from ..schemas import PAGE, RECORD
from .scratch import ship_package

YEAR_IN_NAME = r"_(\d{4})_metadados"


def read_metadata(spark: SparkSession, glob: str, only_year: int | None = None) -> DataFrame:
    """``ord, ano, titulo, tipo, url, arquivo`` of all listed files, in order of file and place.

    One JSON object per file, keyed by date.  Values that are no objects are skipped, as are
    entries without a URL or file name; texts are trimmed.  Files without a year in their name
    are left out; an error is raised if no file matches at all.
    """
    files = spark.read.option("wholetext", True).text(glob).select("value", F.col("_metadata.file_path").alias("file"), F.regexp_extract("_metadata.file_name", YEAR_IN_NAME, 1).try_cast("int").alias("ano"))
    files = files.where("ano is not null" if only_year is None else F.col("ano") == only_year)
    # values first as text: one malformed block must not take the others with it
    blocks = files.select("file", "ano", F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("b", "block"))
    records = blocks.select("file", "ano", "b", F.posexplode(F.from_json("block.value", RECORD).registros).alias("r", "record"))
    entries = records.select("file", "ano", "b", "r", F.trim(F.coalesce("record.titulo", F.lit(""))).alias("titulo"), F.posexplode("record.pdfs").alias("p", "pdf"))
    text = lambda name: F.trim(F.coalesce(f"pdf.{name}", F.lit(""))).alias(name)
    rows = entries.select(F.struct("file", "b", "r", "p").alias("ord"), "ano", "titulo", text("tipo"), text("url"), text("arquivo"))
    return rows.where("url <> '' and arquivo <> ''")


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows and bad lines; blank lines are neither.

    Strict reading raises on a bad line when the rows are read, and its ``limit`` counts all
    lines of the file, blank ones too.  Tolerant reading stops after ``limit`` good rows.
    """
    lines = spark.read.text(path)
    if strict:
        head = lines if limit is None else lines.withColumn("__at", F.monotonically_increasing_id()).orderBy("__at").limit(limit).drop("__at")
        # a bad line has no value of its own to be read
        broken = F.raise_error(F.concat(F.lit("MALFORMED_LINE: "), F.substring("value", 1, 200)))
        row = F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", schema, {"mode": "PERMISSIVE"})).otherwise(F.from_json(broken.cast("string"), schema))
        return head.where("trim(value) <> ''").select(row.alias("row")).select("row.*"), spark.createDataFrame([], "line string")
    each = lines.where("trim(value) <> ''").select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row"), F.try_parse_json("value").isNull().alias("bad"))
    good = each.where("not bad")
    good = good if limit is None else good.withColumn("__at", F.monotonically_increasing_id()).orderBy("__at").limit(limit)
    return good.select("row.*"), each.where("bad").select(F.col("value").alias("line"))


def read_page_files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """Documents of a tree: id (path without ending), type, year, size, checksum and bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    inside = F.regexp_replace("path", F.lit(r"^.*?" + root.split("://")[-1].rstrip("/") + "/"), F.lit(""))
    stem = F.regexp_extract(inside, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return files.select(
        F.regexp_replace(inside, r"\.[^./]*$", "").alias("doc_id"),
        F.regexp_extract(inside, r"([^/]*)$", 1).alias("filename"),
        type_of_stem(stem).alias("tipo_ato"),
        year_of(stem, F.regexp_extract(inside, r"([^/]*)/[^/]*$", 1)).alias("year"),
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
        F.startswith("content", F.lit(b"%PDF-")).alias("is_pdf"),
        "content",
    )


def extract_pages(files: DataFrame, extract: Callable[[bytes], Iterable]) -> DataFrame:
    """Pages (``schemas.PAGE``) by an extractor of the caller's: bytes to pages with blocks and tables.

    A page may be a function that gives it; one that fails is an empty page.  A document that the
    extractor fails on has no pages: ``unread`` tells which.
    """

    def page(one) -> dict:
        try:
            return (one() if callable(one) else one) or {}
        except Exception:  # a broken page must not take the others with it
            return {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, content in zip(pdf["doc_id"], pdf["content"]):
                try:
                    pages = [page(one) for one in extract(bytes(content))]
                except Exception:  # a broken file must not stop the others
                    continue
                if pages:
                    yield pd.DataFrame([{"doc_id": doc_id, "page": i + 1, "width": p.get("width"), "blocks": p.get("blocks", []), "tables": p.get("tables", [])} for i, p in enumerate(pages)])

    ship_package(files.sparkSession)
    return files.select("doc_id", "content").mapInPandas(run, PAGE)


def unread(files: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, error`` of the files that gave no page."""
    return files.select("doc_id").join(pages.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("open_failed").alias("error"))


def first_pages(pages: DataFrame, n: int = 3) -> DataFrame:
    return pages.where(F.col("page") <= n)
