"""Cleaning of page texts and their layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let
from ..functions.text import BREAK, collapse_blanks, dehyphenate, drop_footnotes, drop_patterns, footnotes, join_lone_numbers, normalize_chars, process_number, split_lines, strip, title_and_summary, tokens_parsed, type_of_stem, year_of
from ..profiles import TextProfile
from .structure import structure

#: Columns of a parsed document, in order.
PARSED_FIELDS = ("doc_id", "tipo_ato", "year", "filename", "title", "ementa", "processo", "n_pages", "n_chars", "n_tokens_est", "is_ocr_suspect", "pdf_creator", "text", "structure", "tables", "footnotes")


def page_text(blocks: Column) -> Column:
    """Text blocks in reading order (top, then left); images and blank blocks are skipped."""
    text = F.filter(blocks, lambda b: (b["type"] == 0) & (strip(b["text"]) != ""))
    placed = F.transform(text, lambda b, i: F.struct(F.bround(b["y0"], 1).alias("y"), F.bround(b["x0"], 1).alias("x"), i.alias("i"), strip(b["text"]).alias("text")))
    return F.array_join(F.transform(F.array_sort(placed), lambda b: b["text"]), "\n")


def page_with_tables(pages: DataFrame) -> DataFrame:
    """Pages (``schemas.PAGE``) as ``doc_id, page, text, tables``: text in reading order, and a mark for each table that is kept.

    Marks count all tables of the page, those left out as well.
    """

    def entry(rows: Column, j: Column) -> Column:
        ident = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("t"), (j + 1).cast("string"))
        wide = F.array_max(F.transform(rows, F.size))
        return F.struct(ident.alias("id"), F.col("page").alias("page"), table_markdown(rows).alias("markdown"), F.size(rows).alias("rows"), wide.alias("cols"), is_semantic_table(rows).alias("keep"))

    found = pages.select("doc_id", "page", page_text(F.col("blocks")).alias("body"), F.filter(F.transform("tables", entry), lambda t: t["keep"] & (t["markdown"] != "")).alias("kept"))
    marks = F.array_join(F.transform("kept", lambda t: F.concat(F.lit("\n\n[[TABELA:"), t["id"], F.lit("]]\n"))), "")
    bare = F.transform("kept", lambda t: F.struct(t["id"].alias("id"), t["page"].alias("page"), t["markdown"].alias("markdown"), t["rows"].alias("rows"), t["cols"].alias("cols")))
    return found.select("doc_id", "page", F.concat("body", marks).alias("text"), bare.alias("tables"))


def repeated_lines(pages: DataFrame, doc: str, page: str | None, text: str, least_pages: int = 3, shortest: int = 8, longest: int = 200, head: int | None = None) -> DataFrame:
    """``doc, line, pages``: trimmed lines that stand on at least ``least_pages`` pages of a document.

    Without ``page`` each row is a page.  With ``head`` only so many lines at a page's top are looked at.
    """
    lines = split_lines(F.col(text)) if head is None else F.transform(F.slice(F.split(text, BREAK, head + 1), 1, head), strip)
    found = pages.select(doc, *([page] if page else []), F.explode(F.array_distinct(lines)).alias("line")).where(F.length("line").between(shortest, longest))
    # a page counts once for each of its lines; counted by line and page first, so a frequent line is summed in parts
    once = found.groupBy(doc, "line", page).agg(F.lit(1).alias("one")) if page else found
    return once.groupBy(doc, "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)


def drop_lines(text: Column, repeated: Column, head: int | None = None) -> Column:
    """The text without lines whose trimmed form is in an array; untouched where that is empty or null, and below its ``head`` lines if given."""
    lines = F.split(text, BREAK, -1 if head is None else head + 1)
    top = (lambda x: x) if head is None else lambda x: F.slice(x, 1, head)
    # the few that stand here are found by hash, then told line by line
    here = lambda x: F.array_intersect(F.transform(top(x), strip), F.coalesce(repeated, F.array().cast("array<string>")))
    below = lambda i: F.lit(False) if head is None else i >= head
    left = let(lines, lambda x: let(here(x), lambda gone: F.filter(x, lambda line, i: below(i) | ~F.array_contains(gone, strip(line)))))
    return F.when(F.size(F.coalesce(repeated, F.array().cast("array<string>"))) > 0, F.array_join(left, "\n")).otherwise(text)


def drop_repeated(pages: DataFrame, repeated: DataFrame, doc: str, text: str, head: int | None = None) -> DataFrame:
    """``pages`` without the lines of ``repeated(doc, line)``, each in its own row; a null text stays null."""
    common = repeated.groupBy(doc).agg(F.collect_set("line").alias("__repeated"))
    joined = pages.join(common, doc, "left")
    return joined.select(*[drop_lines(F.col(text), F.col("__repeated"), head).alias(c) if c == text else F.col(c) for c in pages.columns])


def clean(text: Column, repeated: Column, profile: TextProfile) -> dict[str, Column]:
    """The cleaning chain of a document's joined pages: its text and its footnotes."""
    plain = drop_lines(drop_patterns(normalize_chars(text), profile.boilerplate), repeated)
    joined = join_lone_numbers(dehyphenate(plain))
    return {"text": collapse_blanks(drop_footnotes(joined)), "footnotes": footnotes(joined)}


def named(doc_id: Column) -> dict[str, Column]:
    """File name, type and year that an id (relative path without ending) tells."""
    stem, folder = F.regexp_extract(doc_id, r"([^/]*)$", 1), F.regexp_extract(doc_id, r"([^/]*)/[^/]*$", 1)
    return {"filename": F.concat(stem, F.lit(".pdf")), "tipo_ato": type_of_stem(stem), "year": year_of(stem, folder)}


def parse_documents(pages: DataFrame, profile: TextProfile) -> DataFrame:
    """Whole documents (``schemas.PARSED``) from pages.

    ``pages`` has ``doc_id, page, text`` and, if at hand, ``tables`` (as of ``page_with_tables``)
    and ``filename`` and ``pdf_creator``, which are the same on all pages.  A null text is an
    empty page.
    """
    common = repeated_lines(pages, "doc_id", "page", "text").groupBy("doc_id").agg(F.collect_set("line").alias("repeated"))
    in_order = lambda *of: F.array_sort(F.collect_list(F.struct("page", *of)))
    none = F.array().cast("array<struct<id:string,page:int,markdown:string,rows:int,cols:int>>")
    tables = F.flatten(F.transform(in_order(F.coalesce("tables", none).alias("t")), lambda p: p["t"])) if "tables" in pages.columns else F.first(none)
    first = lambda name: F.max(name) if name in pages.columns else F.lit(None).cast("string")
    whole = pages.groupBy("doc_id").agg(
        F.count("*").cast("int").alias("n_pages"),
        F.array_join(F.transform(in_order(F.coalesce("text", F.lit("")).alias("text")), lambda p: p["text"]), "\n\n").alias("text"),
        tables.alias("tables"),
        first("filename").alias("filename"),
        F.coalesce(first("pdf_creator"), F.lit("")).alias("pdf_creator"),
    )
    parts = clean(F.col("text"), F.col("repeated"), profile)
    done = whole.join(common, "doc_id", "left").withColumns(parts)
    own = named(F.col("doc_id").cast("string"))
    done = done.withColumns({k: F.coalesce(k, v) if k == "filename" else v for k, v in own.items()})
    done = done.withColumns({"found": title_and_summary(F.col("text"), profile.titles), "processo": process_number(F.col("text")), "n_chars": F.length("text"), "n_tokens_est": tokens_parsed(F.col("text"))})
    done = done.withColumns({"title": F.col("found.title"), "ementa": F.col("found.summary"), "is_ocr_suspect": is_ocr_suspect(F.length("text"), F.col("n_pages")), "structure": structure(F.col("text"), profile)})
    return done.select(*PARSED_FIELDS)


def is_ocr_suspect(chars: Column, pages: Column) -> Column:
    """Under 50 characters a page."""
    return F.when(pages > 0, chars / pages < 50).otherwise(F.lit(False))


def looks_scanned(chars: Column, images: Column, pages: int = 5) -> Column:
    """By the first pages' characters and images (arrays, in page order): under 100 characters a page, and images."""
    head = F.slice(chars, 1, pages)
    mean = F.aggregate(head, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(head)
    return F.when(F.size(head) > 0, (mean < 100) & (F.aggregate(F.slice(images, 1, pages), F.lit(0).cast("long"), lambda s, x: s + x) > 0)).otherwise(F.lit(False))


def is_multi_column(blocks: Column, width: Column) -> Column:
    """Four or more text blocks, at least two centred left of 45 % and two right of 55 % of the page."""
    text = F.filter(blocks, lambda b: b["type"] == 0)
    centre = F.transform(text, lambda b: (b["x0"] + b["x1"]) / 2)
    return (F.size(text) >= 4) & (F.size(F.filter(centre, lambda c: c < width * 0.45)) >= 2) & (F.size(F.filter(centre, lambda c: c > width * 0.55)) >= 2)


def is_semantic_table(rows: Column) -> Column:
    """A table that is not mostly numbers: under 70 % of its non-empty cells, 60 % if over 15 rows."""
    cells = F.filter(F.flatten(rows), lambda c: c.isNotNull() & (c != ""))
    share = F.size(F.filter(cells, lambda c: c.rlike(r"^[\d.,\-\s]+$"))) / F.size(cells).cast("double")
    return F.when(F.size(cells) > 0, (share < 0.7) & ~((F.size(rows) > 15) & (share > 0.6))).otherwise(F.lit(False))


def table_markdown(rows: Column) -> Column:
    """The table as Markdown, the first row as its header; empty for no rows."""
    cell = lambda c: F.coalesce(strip(F.replace(c, F.lit("\n"), F.lit(" "))), F.lit(""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))

    def whole(wide: Column) -> Column:
        full = lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), wide - F.size(r)))
        rule = F.concat(F.lit("\n"), line(F.array_repeat(F.lit("---"), wide)))
        return F.array_join(F.transform(rows, lambda r, i: F.concat(line(full(r)), F.when(i == 0, rule).otherwise(F.lit("")))), "\n")

    # the width is bound once: in the lambda of the rows it would be sought anew for each of them
    return F.when(F.size(rows) > 0, let(F.array_max(F.transform(rows, F.size)), whole)).otherwise(F.lit(""))
