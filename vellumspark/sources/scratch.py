"""A folder where driver and executors both can write, and the package for executors that lack it."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process; they go when it ends.
_ROOTS: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session on one machine without that gets a folder of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone already; the folder then stays until the shared one is cleared
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path; it lasts as long as this process."""
    root = shared(spark)
    if root not in _ROOTS:
        _ROOTS[root] = f"{root}/scratch-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _ROOTS[root])
    return f"{_ROOTS[root]}/{name}-{uuid.uuid4().hex}"


def kept(spark: SparkSession, name: str) -> str:
    """A path that later sessions find again."""
    return f"{shared(spark)}/kept/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: the lineage ends there, in files that outlive executors.

    Pages of long texts are large: zstandard streams through them, where the default codec holds each
    whole outside the heap; and a page is closed as soon as it is full.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").option("parquet.page.size.row.check.min", "10").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each session; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_vellum_shipped", False):
        return
    here = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="vellum-")) / f"{here.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in here.rglob("*.py"):
            out.write(f, f.relative_to(here.parent))
    context.addPyFile(str(path))
    context._vellum_shipped = True
