"""Deduplication, resumption and profiles of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import as_https, is_pdf_url
from .cleaning import is_multi_column, looks_scanned, named
from .quantiles import spreads


def download_tasks(rows: DataFrame, only_kind: str | None = None) -> DataFrame:
    """One task per URL: the first occurrence decides the year, all occurrences are kept as sources.

    ``rows``: ``ord`` (sortable place), ``ano, titulo, tipo, url, arquivo``.
    """
    kept = rows if only_kind is None else rows.where(F.col("tipo") == only_kind)
    usable = kept.where(is_pdf_url(F.col("url"))).withColumn("url", as_https(F.col("url")))
    source = F.struct("ord", F.struct("ano", "titulo", "tipo").alias("of"))
    return usable.groupBy("url").agg(F.min_by("arquivo", "ord").alias("arquivo"), F.min_by("ano", "ord").alias("ano_destino"), F.transform(F.array_sort(F.collect_list(source)), lambda x: x["of"]).alias("fontes"))


def skipped_urls(rows: DataFrame, only_kind: str | None = None) -> DataFrame:
    """How many occurrences (of one kind) are no PDF, counted before anything is deduplicated."""
    kept = rows if only_kind is None else rows.where(F.col("tipo") == only_kind)
    return kept.agg(F.count_if(~is_pdf_url(F.col("url"))).alias("n_skipped"), F.count("*").alias("n"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last")).select(key, "__last.*")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def completed(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """URLs whose last manifest entry names a file that is there and not empty."""
    return latest(manifest, "url", "downloaded_at").join(files.where("size > 0").select(F.col("path").alias("local_path")), "local_path", "left_semi").select("url")


def counts(rows: DataFrame, by: str, top: int | None = None, order: str | None = None) -> DataFrame:
    """Rows by value, most frequent first; ties by first place, or by value."""
    tie = F.min(order).alias("first") if order else F.min(by).alias("first")
    out = rows.groupBy(by).agg(F.count("*").alias("n"), tie).orderBy(F.desc("n"), "first")
    return (out.limit(top) if top else out).select(by, "n")


def profile(rows: DataFrame, flags: dict[str, Column], errors: Column) -> DataFrame:
    """Rows, rows without an error, and how often each flag holds."""
    return rows.agg(F.count("*").alias("n"), F.count_if(errors.isNull()).alias("n_ok"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()])


def first_errors(rows: DataFrame, error: str, order: str, n: int = 5) -> DataFrame:
    return rows.where(F.col(error).isNotNull()).orderBy(order).limit(n)


def samples_of(rows: DataFrame, wanted: dict[str, str], kind: str, path: str) -> DataFrame:
    """One row for each kind: the wanted path if it is there, else the first path of the kind."""
    first = F.coalesce(*[F.when(F.col(kind) == k, F.when(F.col(path) == p, 0)) for k, p in wanted.items()], F.lit(1))
    best = rows.where(F.col(kind).isin(*wanted)).groupBy(kind).agg(F.min_by(path, F.struct(first, path)).alias(path))
    return rows.join(best, [kind, path], "left_semi")


def profile_by_kind(rows: DataFrame, kind: str, pages: str, chars: str, size: str, flags: dict[str, Column]) -> DataFrame:
    """Spread of pages and sizes of each kind, most frequent kinds first."""
    main = rows.groupBy(kind).agg(
        F.count("*").alias("n"),
        F.min(pages).alias("pages_min"),
        F.max(pages).alias("pages_max"),
        F.round(F.avg(chars), 4).alias("chars_mean"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()],
    )
    each = rows.select(kind, F.explode(F.array(F.struct(F.lit("pages").alias("of"), F.col(pages).cast("double").alias("v")), F.struct(F.lit("size").alias("of"), F.col(size).cast("double").alias("v")))).alias("x")).select(kind, "x.of", "x.v")
    spread = spreads(each, [kind, "of"], "v")
    one = lambda name, of: F.max(F.when(F.col("of") == of, F.col(name)))
    spread = spread.groupBy(kind).agg(one("median", "pages").alias("pages_median"), one("p90", "pages").alias("pages_p90"), one("median", "size").alias("size_p50"), one("p90", "size").alias("size_p90"))
    columns = [kind, "n", "pages_min", "pages_max", "pages_median", "chars_mean", "size_p50", *flags, "pages_p90", "size_p90"]
    return main.join(spread, kind).select(*columns).orderBy(F.desc("n"), kind)


def page_profile(pages: DataFrame, first: int = 5) -> DataFrame:
    """One row for each document of pages (``schemas.PAGE``): pages, characters and images of the first ones, flags, a sample.

    Images are blocks of type 1.  ``pdf_creator`` and ``error``, if there, are the same on all pages.
    """
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == 0), lambda b: b["text"]), "\n")
    images = F.size(F.filter("blocks", lambda b: b["type"] == 1))
    page = pages.select("*", F.length(text).cast("long").alias("chars"), images.cast("long").alias("images"), is_multi_column(F.col("blocks"), F.col("width")).alias("wide"), text.alias("all_text"))
    head = page.where(F.col("page") <= first)
    placed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("page", c))), lambda x: x[c])
    by_doc = head.groupBy("doc_id").agg(placed("chars").alias("chars"), placed("images").alias("images"), F.count_if(F.coalesce("wide", F.lit(False))).alias("multi_col_pages"), F.substring(F.array_join(placed("all_text"), "\n"), 1, 300).alias("first_text"))
    optional = [F.max(c).alias(c) for c in ("pdf_creator", "error") if c in pages.columns]
    size = F.sum(F.length("all_text")).alias("size")
    whole = page.groupBy("doc_id").agg(F.count("*").alias("n_pages"), size, *optional)
    mean = F.aggregate("chars", F.lit(0).cast("long"), lambda s, x: s + x) / F.greatest(F.size("chars"), F.lit(1))
    out = whole.join(by_doc, "doc_id", "left").withColumns({"chars_per_page": mean, "ocr_suspect": looks_scanned(F.col("chars"), F.col("images"), first)} | named(F.col("doc_id").cast("string")))
    missing = [F.lit(None).cast("string").alias(c) for c in ("pdf_creator", "error") if c not in out.columns]
    return out.drop("chars", "images").select("*", *missing)


def analysis(pages: DataFrame) -> tuple[DataFrame, dict]:
    """A profile of each document, and the summary: counts, first errors, creators, and each type with two samples."""
    per = page_profile(pages)
    flags = {"n_ocr_suspect": F.col("ocr_suspect"), "n_multi_col": F.col("multi_col_pages") > 0}
    fine = per.where("error is null")
    summary = profile(per, flags, F.col("error")).head().asDict()
    summary["n_error"] = summary["n"] - summary["n_ok"]
    summary["errors_sample"] = [f"{r.filename}: {r.error}" for r in first_errors(per, "error", "doc_id").collect()]
    summary["creators_top"] = [tuple(r) for r in counts(fine.withColumn("pdf_creator", F.coalesce("pdf_creator", F.lit(""))), "pdf_creator", 8, "doc_id").collect()]
    samples: dict[str, list] = {}
    for r in kind_samples(fine, "tipo_ato", "doc_id", ["filename", "year", "n_pages", "first_text"]).collect():  # two of each type
        samples.setdefault(r.tipo_ato, []).append({"file": r.filename, "ano": r.year, "pages": r.n_pages, "first_text": r.first_text})
    kinds = profile_by_kind(fine, "tipo_ato", "n_pages", "chars_per_page", "size", flags).collect()
    summary["tipos_ato"] = {r.tipo_ato: {k: v for k, v in r.asDict().items() if k != "tipo_ato"} | {"samples": samples.get(r.tipo_ato, [])} for r in kinds}
    return per, summary


def kind_samples(rows: DataFrame, kind: str, order: str, columns: list[str], n: int = 2) -> DataFrame:
    """The first ``n`` rows of each kind."""
    place = F.row_number().over(Window.partitionBy(kind).orderBy(order))
    return rows.withColumn("__place", place).where(F.col("__place") <= n).select(kind, order, *columns).orderBy(kind, order)
