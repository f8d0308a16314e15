"""Sinks: idempotent tables, split result files and rendered reports."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import snippet, uuid5
from .scratch import stored
from .segments import Segments


#: What points are looked up by: Parquet keeps a Bloom filter of ids, sized by what a file holds;
#: rows of like other values lie together, so that their bounds tell.
BLOOMED, CLUSTERED = ("id", "doc_id"), ("tipo_ato", "tier", "year", "doc_id", "id")


def _save_points(by: list[str] | None):
    def save(part: str, rows: DataFrame, folder: str) -> None:
        if part == "ids":
            return rows.write.parquet(folder)
        out = rows.sortWithinPartitions(*(by or []), *[c for c in CLUSTERED if c in rows.columns and c not in (by or [])]).write
        # a filter is as large as a task's rows need, with room for uneven tasks
        each = 2 * rows.count() // max(1, rows.rdd.getNumPartitions()) + 16
        for c in BLOOMED:
            if c in rows.columns:
                out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(each))
        return (out.partitionBy(*by) if by else out).parquet(folder)

    return save


def _once(rows: DataFrame) -> DataFrame:
    """One row of each id: that of the largest ``version``, if there is such a column, then the largest row."""
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    maps = {f.name for f in rows.schema if f.dataType.typeName() in ("map", "variant")}
    rest = [F.to_json(c) if c in maps else F.col(c) for c in sorted(rows.columns) if c not in ("id", "version")]
    order = F.struct(*([F.col("version")] if "version" in rows.columns else []), *rest)
    return rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), order).alias("__row")).select("__row.*")


def write_points(chunks: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """Put chunks under their name-based id into the table at ``path``; the last write of an id wins.

    A batch is a segment of its own, and the ids that it replaces are masked in older ones (see
    ``segments``): what is written grows with the batch, not with the table.
    """
    spark = chunks.sparkSession
    table, save = Segments(spark, path), _save_points(by)
    keyed = _once(stored(chunks.withColumn("id", uuid5(F.col("chunk_id"))), "points"))
    serial = table.state["serial"] + 1
    segment = table.write("s", serial, {"rows": keyed}, save)
    masks = []
    if table.state["segments"]:
        # only ids are read of what is there
        known = stored(table.live("rows").select("id").join(keyed.select("id"), "id", "left_semi"), "replaced")
        masks = [] if known.isEmpty() else [table.write("m", serial, {"ids": known}, save)]
    table.publish(table.successor([segment], masks=masks))
    while some := table.like():
        serial = table.state["serial"] + 1
        merged = table.write("s", serial, {"rows": table.live("rows", some).drop("serial")}, save)
        table.publish(table.successor([merged], some))
    return read_points(spark, path)


def delete_points(ids: DataFrame, path: str) -> DataFrame:
    """Mask the points of these ids (``id``)."""
    table = Segments(ids.sparkSession, path)
    known = stored(table.live("rows").select("id").join(ids.select("id").distinct(), "id", "left_semi"), "deleted")
    if not known.isEmpty():
        table.publish(table.successor(masks=[table.write("m", table.state["serial"] + 1, {"ids": known}, _save_points(None))]))
    return read_points(ids.sparkSession, path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The points at ``path`` that live."""
    return Segments(spark, path).live("rows").drop("serial")


def collection_stats(points: DataFrame) -> DataFrame:
    """One row: the number of points, whether each id stands once, and the status (green: ready, yellow: ids repeat, grey: empty)."""
    n = points.agg(F.count("*").alias("points_count"), F.countDistinct("id").alias("ids"))
    status = F.when(F.col("points_count") == 0, "grey").when(F.col("points_count") == F.col("ids"), "green").otherwise("yellow")
    return n.select("points_count", status.alias("status"))


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table at ``path`` does not have; how many."""
    spark = rows.sparkSession
    try:
        there = spark.read.parquet(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    before = 0 if there is None else there.count()
    (rows if there is None else rows.join(there, key, "left_anti")).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def write_outcomes(rows: DataFrame, root: str) -> None:
    """Downloads by outcome: ``manifest`` and ``failures``."""
    fine = F.col("http_status").between(200, 299) & F.col("sha256").isNotNull()
    rows.where(fine).write.mode("append").json(f"{root}/manifest")
    rows.where(~F.coalesce(fine, F.lit(False))).write.mode("append").json(f"{root}/failures")


def run_summary(rows: DataFrame, counts: dict[str, Column], started: float) -> DataFrame:
    """One row: counts, start, end and duration in seconds."""
    now = time.time()
    return rows.agg(*[F.count_if(c).alias(k) for k, c in counts.items()]).select("*", F.timestamp_seconds(F.lit(started)).alias("started_at"), F.timestamp_seconds(F.lit(now)).alias("ended_at"), F.lit(round(now - started, 1)).alias("duration_s"))


def write_evaluation(questions: DataFrame, summary: DataFrame, root: str) -> None:
    questions.write.mode("overwrite").json(f"{root}/results")
    summary.coalesce(1).write.mode("overwrite").json(f"{root}/summary")


def write_report(summary: dict, rows: DataFrame, path: str, name: str = "per_pdf") -> None:
    """A profile's report: ``summary.json``'s one object, and a line for each file."""
    spark = rows.sparkSession
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/{name}")


def rendered_answer(rows: DataFrame) -> DataFrame:
    """Text and a JSON object of each answer: ``answer, not_found, citations`` (structs with ``n, chunk_id, url``)."""
    lines = F.array_join(F.transform("citations", lambda c: F.format_string("  [%d] %s  %s", c["n"], c["chunk_id"].cast("string"), F.coalesce(c["url"], F.lit("")))), "\n")
    shown = F.concat("answer", F.when(F.size("citations") > 0, F.concat(F.lit("\n\nFontes:\n"), lines)).otherwise(F.lit("")))
    return rows.select("*", shown.alias("shown"), F.to_json(F.struct(*rows.columns)).alias("json"))


def rendered_hits(hits: DataFrame) -> DataFrame:
    """A line of text and a JSON object for each hit."""
    fields = [c for c in hits.columns if c != "text"]
    line = F.format_string("%2d. [%.4f] %s | %s", F.col("rank"), F.col("score"), F.col("id").cast("string"), snippet(F.coalesce("text", F.lit(""))))
    return hits.select("*", line.alias("line"), F.to_json(F.struct(*fields, snippet(F.coalesce("text", F.lit(""))).alias("text"))).alias("json"))
