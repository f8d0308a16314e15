"""Command line over stored tables: parse, chunk, index, upsert, snapshot, restore, retrieve, smoke, generate, evaluate, golden, download, analyze.

Models are named as ``package.module:name``, which makes one where it runs; without a name stand-ins answer.
"""

from __future__ import annotations

import argparse
import functools
import json
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import chunking, context, corpus, dense, evaluate, fusion, golden, lexical, models, quantiles, sampling
from .operators.cleaning import page_with_tables, parse_documents
from .profiles import PLAIN, TextProfile, legal_profile
from .sources.files import fetch, restore, snapshot, versions
from .sources.readers import read_metadata
from .sources.scratch import scratch, stored
from .sources.writers import append_new, collection_stats, read_points, rendered_answer, rendered_hits, run_summary, write_evaluation, write_outcomes, write_points, write_report


def _profile(args) -> TextProfile:
    return legal_profile(args.agency, args.agency_name or args.agency, args.base_url or "") if args.agency else PLAIN


def _named(name: str | None) -> models.Named | None:
    return models.Named(name) if name else None


def _embedded(rows: DataFrame, load: Callable[[], models.Embedder] | None) -> DataFrame:
    """``rows`` with the model's ``dense`` and ``sparse`` of ``text``, computed once; without a model the stand-in's."""
    if load:
        return stored(models.embed(rows, "text", load), "embedded")
    return rows.withColumns({"dense": models.hash_embedding(F.col("text")), "sparse": F.lit(None).cast("map<int,float>")})


def _vectors(spark: SparkSession, path: str | None, chunks: DataFrame, load: Callable[[], models.Embedder] | None = None) -> DataFrame:
    """Stored vectors (``chunk_id, dense``; a table or points), or the model's, or the stand-in's."""
    if path:
        there = read_points(spark, path) if versions(spark, f"{path}/state") else spark.read.parquet(path)
        return there.select(F.col("chunk_id").alias("id"), F.col("dense").alias("v"))
    return _embedded(chunks.select(F.col("chunk_id").alias("id"), "text"), load).select("id", F.col("dense").alias("v"))


def retrieve(spark: SparkSession, queries: DataFrame, chunks: DataFrame, index: lexical.LexicalIndex, vectors: DataFrame, top_k: int = 10, filters: dict | None = None, rerank: bool = True, reranker: Callable[[], models.Reranker] | None = None) -> DataFrame:
    """Hybrid hits of many questions at once.  ``queries``: ``qid, text`` and ``v``, the question's vector."""
    dense.same_size(vectors, queries)
    keep = fusion.filters({k: v for k, v in (filters or {}).items() if v})
    payload = chunks.withColumnRenamed("chunk_id", "id")
    lx = lexical.search(index, queries, "qid", fusion.CANDIDATES, payload, keep)
    allowed = vectors.join(payload.where(keep).select("id"), "id", "left_semi")
    dn = dense.search(allowed, queries.select("qid", "v"), fusion.CANDIDATES)
    fused = fusion.rrf(dn, lx)
    if rerank:
        short = fusion.top(fused, fusion.RERANKED, fusion.fused_order()).drop("place")
        rows = short.join(payload, "id", "left").join(queries.select("qid", F.col("text").alias("question")), "qid")
        score = (lambda q, t: models.rerank_scores(q, t, reranker)) if reranker else models.overlap_logit
        return fusion.rerank(rows, F.col("question"), F.col("text"), score, top_k, logit=reranker is None).withColumn("score", F.col("rerank"))
    return fusion.top(fused, top_k, fusion.fused_order(), "rank").join(payload, "id", "left").withColumn("score", F.col("rrf"))


def _questions(spark: SparkSession, rows: DataFrame, load: Callable[[], models.Embedder] | None = None) -> DataFrame:
    return _embedded(rows, load).withColumnRenamed("dense", "v").drop("sparse")


def _hits(spark: SparkSession, args) -> DataFrame:
    chunks = spark.read.parquet(args.chunks)
    load = _named(args.embedder)
    asked = _questions(spark, spark.createDataFrame([(0, args.query)], "qid int, text string"), load)
    filters = {"tipo_ato": args.tipo_ato, "year": args.year, "tier": getattr(args, "tier", None)}
    return retrieve(spark, asked, chunks, lexical.LexicalIndex.load(spark, args.index), _vectors(spark, args.vectors, chunks, load), args.top_k, filters, not args.no_rerank, _named(args.reranker))


def _dump(path: str, spark: SparkSession, summary: dict) -> None:
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def parse(spark: SparkSession, args) -> None:
    """Pages (``doc_id, page, text``, or blocks and tables) to documents; ``--resume`` adds those that are not there yet."""
    began, profile = time.time(), _profile(args)
    pages = spark.read.parquet(args.pages)
    if "blocks" in pages.columns:
        more = [c for c in ("filename", "pdf_creator") if c in pages.columns]
        laid = page_with_tables(pages)
        pages = laid.join(pages.select("doc_id", "page", *more), ["doc_id", "page"]) if more else laid
    if args.stems:
        pages = pages.where(F.regexp_extract("doc_id", r"([^/]*)$", 1).isin(*args.stems.split(",")))
    if args.limit:
        pages = pages.join(pages.select("doc_id").distinct().orderBy("doc_id").limit(args.limit), "doc_id", "left_semi")
    if args.resume:
        done = append_new(parse_documents(pages, profile), args.out, "doc_id")
    else:
        parse_documents(pages, profile).write.mode("overwrite").parquet(args.out)
        done = spark.read.parquet(args.out).count()
    took = time.time() - began
    print(json.dumps({"n_docs": done, "seconds": round(took, 1), "docs_per_second": round(done / took, 1)}))


def chunk(spark: SparkSession, args) -> None:
    docs = spark.read.parquet(args.docs)
    docs = docs if args.limit is None else docs.orderBy("doc_id").limit(args.limit)
    kept = docs.drop("tables", "footnotes", "n_pages", "n_chars", "is_ocr_suspect", "pdf_creator", "processo")
    chunking.chunk_documents(kept, _profile(args)).write.mode("overwrite").parquet(args.out)
    chunks = spark.read.parquet(args.out)
    summary = {"n_chunks": chunks.count(), "tiers": {r.tier: r.n for r in corpus.counts(chunks, "tier").collect()}}
    if args.summary_out:
        _dump(args.summary_out, spark, summary)
    print(json.dumps(summary))


def build(spark: SparkSession, args) -> None:
    began, chunks = time.time(), spark.read.parquet(args.chunks)
    chunks = chunks.orderBy("chunk_id").limit(args.limit) if args.limit else chunks
    done = {"n_chunks": chunks.count()}
    if not args.skip_bm25:
        lexical.store_index(chunks, "chunk_id", args.out)
    if args.vectors_out and not args.skip_dense:
        points = write_points(_embedded(chunks, _named(args.embedder)), args.vectors_out, ["tipo_ato", "year"])
        done |= collection_stats(points).head().asDict()
    print(json.dumps(done | {"seconds": round(time.time() - began, 1)}))


def retrieve_one(spark: SparkSession, args) -> None:
    for r in rendered_hits(_hits(spark, args).select("rank", "id", F.round("score", 6).alias("score"), "text")).orderBy("rank").collect():
        print(r.json if args.json else r.line)


def _contexts(hits: DataFrame, top_k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Numbered contexts of each question's first hits, and what the numbers mean."""
    optional = lambda c: F.col(c) if c in hits.columns else F.lit("")
    rows = hits.where(F.col("rank") <= top_k) if top_k else hits
    rows = rows.select("qid", "rank", "id", "text", *[optional(c).alias(c) for c in ("tipo_ato", "year", "title", "url")], optional("section_label").alias("section"))
    return context.context_blocks(rows), rows


def answers(questions: DataFrame, hits: DataFrame, load: Callable[[], models.Generator], top_k: int | None = None) -> DataFrame:
    """``qid``, the answer with its use and time, ``not_found``, ``n_chunks`` and the citations of each question (``qid, text``)."""
    blocks, rows = _contexts(hits, top_k)
    asked = questions.select("qid", F.col("text").alias("question")).join(blocks.select("qid", "context", "n_chunks"), "qid", "left")
    asked = asked.select("qid", F.when(F.coalesce("n_chunks", F.lit(0)) > 0, models.question_prompt(F.col("context"), F.col("question"))).alias("prompt"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    # written once: a model is not asked again for each reader of its answers
    path = scratch(questions.sparkSession, "answers")
    models.generate(asked, load).withColumn("not_found", context.is_not_found(F.col("answer"))).drop("prompt").write.parquet(path)
    said = questions.sparkSession.read.parquet(path)
    cited = context.citations(said, rows.select("qid", F.col("rank").alias("n"), F.col("id").alias("chunk_id"), "url"))
    listed = cited.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n", "chunk_id", "url"))), lambda c: F.struct(c["n"].alias("n"), c["chunk_id"].alias("chunk_id"), c["url"].alias("url"))).alias("citations"))
    return said.join(listed, "qid", "left").withColumn("citations", F.coalesce("citations", F.array().cast(listed.schema["citations"].dataType)))


def generate_one(spark: SparkSession, args, load: Callable[[], models.Generator] | None = None) -> None:
    load = load or _named(args.generator) or models.Extractive
    asked = spark.createDataFrame([(0, args.query)], "qid int, text string")
    row = rendered_answer(answers(asked, _hits(spark, args), load, args.top_k).drop("qid")).head()
    print(row.json if args.json else row.shown)


def smoke(spark: SparkSession, args) -> None:
    """The three nearest chunks of each question by vectors alone, and how many there are."""
    chunks = spark.read.parquet(args.chunks)
    load = _named(args.embedder)
    vectors = _vectors(spark, args.vectors, chunks, load)
    asked = _questions(spark, spark.createDataFrame(list(enumerate(args.queries.split("|"))), "qid int, text string"), load)
    dense.same_size(vectors, asked)
    best = dense.search(vectors, asked.select("qid", "v"), 3).join(chunks.select(F.col("chunk_id").alias("id"), "text"), "id")
    print(json.dumps({"points_count": vectors.count()}))
    for r in rendered_hits(best.select("qid", "rank", "id", "score", "text")).orderBy("qid", "rank").collect():
        print(r.line)


def retrieve_all(spark: SparkSession, asked: DataFrame, args, top_k: int) -> DataFrame:
    """Hits of all questions; those with the same filters are searched together."""
    chunks, index = spark.read.parquet(args.chunks), lexical.LexicalIndex.load(spark, args.index)
    load, reranker, out = _named(args.embedder), _named(args.reranker), []
    vectors, asked = _vectors(spark, args.vectors, chunks, load), _questions(spark, asked, load)
    for kind, year in [tuple(r) for r in asked.select("kind", "year").distinct().orderBy("kind", "year").collect()]:  # a question set is small
        some = asked.where(F.col("kind").eqNullSafe(F.lit(kind)) & F.col("year").eqNullSafe(F.lit(year)))
        out.append(retrieve(spark, some.select("qid", "text", "v"), chunks, index, vectors, top_k, {"tipo_ato": kind, "year": year}, not args.no_rerank, reranker))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def evaluate_all(spark: SparkSession, args, load: Callable[[], models.Generator] | None = None, judge: Callable[[], models.Generator] | None = None) -> None:
    """Retrieval of all questions under their own filters; with ``--with-generation`` answers, their times and the judge's verdicts."""
    load, judge = load or _named(args.generator) or models.Extractive, judge or _named(args.judge)
    rows = spark.read.schema("id string, tipo_query string, pergunta string, resposta_esperada string, docs_relevantes array<string>, tipo_ato_filtro string, year_filtro int").json(args.golden)
    asked = rows.select(F.col("id").alias("qid"), "tipo_query", F.col("pergunta").alias("text"), F.coalesce("docs_relevantes", F.array().cast("array<string>")).alias("relevant_ids"), F.nullif(F.lower("tipo_ato_filtro"), F.lit("")).alias("kind"), F.nullif("year_filtro", F.lit(0)).alias("year"))
    began, path = time.time(), scratch(spark, "hits")
    retrieve_all(spark, asked, args, args.top_k).write.parquet(path)
    hits, n = spark.read.parquet(path), asked.count()
    each_ms = round(1000 * (time.time() - began) / max(1, n), 1)  # all questions are one plan: the time of one is its share
    found = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("retrieved_ids"))
    metrics = evaluate.question_metrics(asked.join(found, "qid", "left").withColumn("retrieved_ids", F.coalesce("retrieved_ids", F.array().cast("array<string>")))).withColumn("retrieval_ms", F.lit(each_ms))
    summary = {"n_questions": n, "all": evaluate.summary(metrics).head().asDict(), "by_type": {r.tipo_query: r.asDict() for r in evaluate.summary(metrics, "tipo_query").collect()}, "retrieval_ms": each_ms}
    if args.with_generation:
        chosen = asked.orderBy("qid").limit(args.gen_limit) if args.gen_limit else asked
        said = answers(chosen.select("qid", "text"), hits, load, args.gen_top_k)
        metrics = metrics.join(said.withColumnRenamed("latency_ms", "gen_latency_ms").withColumn("n_cited", F.size("citations")).drop("citations", "n_chunks"), "qid", "left")
        times = quantiles.latencies(said.withColumn("one", F.lit(0)), ["one"], "latency_ms", {"p50": 50, "p95": 95}).head()
        negative = evaluate.not_found_rate(chosen.select("qid", "tipo_query").join(said.select("qid", "not_found"), "qid")).head()
        summary |= {"n_generated": said.count(), "p50_latency_ms": times.p50 if times else 0.0, "p95_latency_ms": times.p95 if times else 0.0}
        summary |= {"not_found_rate_negative": negative.rate} if negative.n else {}
        texts = hits.where(F.col("rank") <= args.gen_top_k).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("contexts"))
        samples = chosen.where("tipo_query <> 'negative'").select("qid", F.col("text").alias("question")).join(said.where("not not_found").select("qid", "answer"), "qid").join(texts, "qid")
        if judge:
            judged = models.judge(samples, judge)
        else:
            whole = F.array_join(F.slice("contexts", 1, models.JUDGE_CONTEXTS), " ")
            judged = samples.select(models.judge_overlap(F.col("answer"), whole).alias("faithfulness"), models.judge_overlap(F.col("question"), F.col("answer")).alias("relevance"))
        summary |= evaluate.judge_means(judged).head().asDict()
    if args.out:
        write_evaluation(metrics, spark.createDataFrame([(json.dumps(summary, ensure_ascii=False),)], "summary string"), args.out)
    print(json.dumps(summary))


def golden_set(spark: SparkSession, args, load: Callable[[], models.Generator] | None = None) -> None:
    """Questions from sampled chunks by a generator (each tried three times); public and raw sets are written."""
    target = {k: min(v, args.limit) for k, v in sampling.TARGET.items()} if args.limit else None
    samples = golden.sampled(spark.read.parquet(args.chunks), target, args.oversample or 2.0, args.seed if args.seed is not None else sampling.SEED)
    path = scratch(spark, "golden")
    golden.asked(samples, load or golden.Quoting, target).write.parquet(path)
    rows = spark.read.parquet(path)
    rows.coalesce(1).write.mode("overwrite").json(args.raw_out)
    sampling.public_columns(rows).coalesce(1).write.mode("overwrite").json(args.out)
    print(json.dumps({"n": rows.count(), "by_type": {r.tipo_query: r.n for r in corpus.counts(rows, "tipo_query").collect()}}))


def upsert(spark: SparkSession, args) -> None:
    """Chunks with their dense and sparse vectors as points; those with a known id are replaced."""
    chunks = spark.read.parquet(args.chunks)
    whole = chunks if "dense" in chunks.columns else _embedded(chunks, _named(args.embedder))
    points = write_points(whole, args.out, ["tipo_ato", "year"])
    print(json.dumps(collection_stats(points).head().asDict()))


def copy(spark: SparkSession, args) -> None:
    print(json.dumps({"files": snapshot(spark, args.source, args.target)}))


def put_back(spark: SparkSession, args) -> None:
    print(json.dumps({"files": restore(spark, args.source, args.target)}))


def download(spark: SparkSession, args, get: Callable[[str], tuple[int, bytes]] | None = None) -> None:
    """Tasks of metadata files; with an opener they are fetched, otherwise they are listed."""
    began, rows = time.time(), read_metadata(spark, args.metadata, args.only_year)
    tasks = corpus.download_tasks(rows, args.only_kind)
    if args.sample:
        tasks = sampling.stratified(tasks.withColumn("tipo", F.get("fontes", F.lit(0))["tipo"]), ["ano_destino", "tipo"], "url", args.sample).drop("tipo")
    tasks = tasks.orderBy("ano_destino", "url").limit(args.max_downloads) if args.max_downloads else tasks
    tasks = tasks.withColumn("local_path", F.concat_ws("/", F.col("ano_destino").cast("string"), "arquivo"))
    skipped = corpus.skipped_urls(rows, args.only_kind).head().n_skipped
    if get is None:
        tasks.write.mode("overwrite").json(f"{args.out}/tasks")
        print(json.dumps({"n_tasks": tasks.count(), "n_skipped": skipped}))
        return
    path = scratch(spark, "outcomes")
    fetch(tasks, f"{args.out}/files", get).withColumn("downloaded_at", F.current_timestamp()).write.parquet(path)
    outcome = spark.read.parquet(path).join(tasks.select("url", "arquivo", "ano_destino", "fontes"), "url")
    write_outcomes(outcome, args.out)
    one = run_summary(outcome, {"n_ok": F.col("sha256").isNotNull(), "n_failed": F.col("sha256").isNull()}, began).head().asDict()
    print(json.dumps(one | {"n_skipped": skipped}, default=str))


def analyze(spark: SparkSession, args) -> None:
    """Profile of pages (``schemas.PAGE``, with ``images`` if at hand): the whole, each type with two samples, the report."""
    per, summary = corpus.analysis(spark.read.parquet(args.pages))
    if args.report:
        write_report(summary, per, args.report)
    print(json.dumps(summary, ensure_ascii=False, default=str))


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="vellumspark")
    sub = top.add_subparsers(required=True)

    def command(name, run, *needed, **optional):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for x in needed:
            p.add_argument(f"--{x}", required=True)
        for x, kind in optional.items():
            p.add_argument(f"--{x.replace('_', '-')}", **({"action": "store_true"} if kind is bool else {"type": kind}))
        return p

    profile = {"agency": str, "agency_name": str, "base_url": str}
    command("parse", parse, "pages", "out", limit=int, resume=bool, stems=str, **profile)
    command("chunk", chunk, "docs", "out", limit=int, summary_out=str, **profile)
    command("index", build, "chunks", "out", vectors_out=str, embedder=str, limit=int, skip_bm25=bool, skip_dense=bool)
    command("upsert", upsert, "chunks", "out", embedder=str)
    command("snapshot", copy, "source", "target")
    command("restore", put_back, "source", "target")
    search = {"vectors": str, "embedder": str, "reranker": str, "tipo_ato": str, "year": int, "no_rerank": bool, "json": bool}
    for name, run, more in (("retrieve", retrieve_one, {"tier": str}), ("generate", generate_one, {"generator": str})):
        command(name, run, "query", "chunks", "index", **search, **more).add_argument("--top-k", type=int, default=10)
    command("smoke", smoke, "queries", "chunks", vectors=str, embedder=str)
    p = command("evaluate", evaluate_all, "golden", "chunks", "index", vectors=str, embedder=str, reranker=str, generator=str, judge=str, no_rerank=bool, with_generation=bool, gen_limit=int, out=str)
    p.add_argument("--top-k", type=int, default=20)
    p.add_argument("--gen-top-k", type=int, default=10)
    command("golden", golden_set, "chunks", "out", "raw-out", limit=int, oversample=float, seed=int)
    command("download", download, "metadata", "out", only_year=int, only_kind=str, sample=float, max_downloads=int)
    command("analyze", analyze, "pages", report=str)
    args = top.parse_args(argv)
    args.run(SparkSession.builder.appName("vellumspark").getOrCreate(), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
