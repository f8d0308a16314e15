"""Files of any store, written from executors, and folders of versions."""

from __future__ import annotations

import hashlib
import posixpath
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .scratch import ship_package, stored


def put(uri: str, content: bytes) -> None:
    """Write one file: under a name of its own first, then moved into place, so no reader sees a part of it."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
    folder = posixpath.dirname(path)
    store.create_dir(folder, recursive=True)
    waiting = posixpath.join(folder, f"_{uuid.uuid4().hex}.tmp")
    with store.open_output_stream(waiting) as out:
        out.write(content)
    store.move(waiting, path)


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Write ``content`` of each row (``path``, ``content``) under ``root``; the table of files, once they are written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size, digest = [], []
            for path, content in zip(pdf["path"], pdf["content"]):
                raw = content.encode() if isinstance(content, str) else bytes(content)
                put(f"{root}/{path}", raw)
                size.append(len(raw))
                digest.append(hashlib.sha256(raw).hexdigest())
            yield pd.DataFrame({"path": pdf["path"], "size_bytes": size, "sha256": digest})

    ship_package(rows.sparkSession)
    listed = f"{root}/_files"
    rows.select("path", "content").mapInPandas(run, "path string, size_bytes long, sha256 string").write.mode("overwrite").parquet(listed)
    return rows.sparkSession.read.parquet(listed)


#: A server's wish to wait is followed up to so many seconds.
LONGEST_WAIT = 60.0


def seconds_to_wait(value: str | None, now: float) -> float | None:
    """Seconds by a Retry-After header (a number or an HTTP date), not below 0; None if it is neither."""
    try:
        return max(0.0, float(value))
    except (TypeError, ValueError):
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError, AttributeError):
        return None


class _Host:
    """What the threads of one host share: when it may be asked again."""

    def __init__(self):
        self.due, self.lock = 0.0, threading.Lock()

    def wait(self) -> None:
        while (left := self.due - time.time()) > 0:
            time.sleep(left)

    def put_off(self, seconds: float) -> None:
        with self.lock:
            self.due = max(self.due, time.time() + min(seconds, LONGEST_WAIT))


def fetch(
    tasks: DataFrame, root: str, get: Callable[[str], tuple], attempts: int = 3, magic: bytes = b"%PDF-", wait: Callable[[int], float | None] = lambda attempt: None, per_host: int = 2
) -> DataFrame:
    """Fetch each task's ``url`` to ``root/local_path``: ``url, local_path, http_status, error, attempts, size_bytes, sha256``.

    ``get`` gives status and bytes, and headers if it has them.  Statuses of 500 and more, 429 and errors are
    tried again after the seconds that ``wait`` gives; others, and content without the magic bytes, are not.

    The tasks of a host go to one Spark task, which asks it ``per_host`` times at once at most; a
    ``Retry-After`` holds for all that is left of the host.  Hosts are fetched side by side.
    """

    def one(url: str, path: str, host: _Host) -> dict:
        row = {"url": url, "local_path": None, "http_status": None, "error": None, "attempts": 0, "size_bytes": None, "sha256": None}
        for attempt in range(1, attempts + 1):
            row["attempts"] = attempt
            host.wait()
            try:
                row["http_status"], content, *headers = get(url)
            except Exception as e:  # any failure of the opener is an outcome
                row |= {"http_status": None, "error": type(e).__name__}
            else:
                if row["http_status"] == 200:
                    if content.startswith(magic):
                        put(f"{root}/{path}", content)
                        return row | {"local_path": path, "error": None, "size_bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}
                    return row | {"error": "not_pdf"}
                row["error"] = f"http_{row['http_status']}"
                if row["http_status"] < 500 and row["http_status"] != 429:
                    return row
                named = {k.lower(): v for k, v in (headers[0] if headers else {}).items()}
                asked = seconds_to_wait(named.get("retry-after"), time.time())
                if asked is not None:
                    host.put_off(asked)
                    continue
            if attempt < attempts:
                time.sleep(min(wait(attempt) or 0, LONGEST_WAIT))
        return row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, host = None, _Host()
        with ThreadPoolExecutor(per_host) as pool:
            for pdf in batches:
                # rows are sorted by host; one that goes on in the next batch keeps its state
                for key, some in pdf.groupby("host", sort=False, dropna=False):
                    name, host = (name, host) if key == name else (key, _Host())
                    out = pd.DataFrame(list(pool.map(one, some["url"], some["local_path"], [host] * len(some))))
                    yield out.astype({"http_status": "Int32", "size_bytes": "Int64"})

    ship_package(tasks.sparkSession)
    cores = tasks.sparkSession.sparkContext.defaultParallelism
    host = F.lower(F.regexp_extract("url", r"^(?:[^:/?#]+://)?([^/?#]*)", 1)).alias("host")
    dealt = tasks.select("url", "local_path", host).repartition(4 * cores, "host").sortWithinPartitions("host")
    return dealt.mapInPandas(run, "url string, local_path string, http_status int, error string, attempts int, size_bytes long, sha256 string")


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions under a path (``v000001`` and so on, with a ``_SUCCESS`` file each), oldest first."""
    folder, store = _fs(spark, path)
    if not store.exists(folder):
        return []
    done = [f.getPath() for f in store.listStatus(folder) if f.getPath().getName()[1:].isdigit() and f.getPath().getName().startswith("v")]
    return sorted(int(p.getName()[1:]) for p in done if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def remove(spark: SparkSession, path: str) -> None:
    folder, store = _fs(spark, path)
    store.delete(folder, True)


# -- snapshots ------------------------------------------------------------------------------

#: Bytes that a task copies at once, and the table of a snapshot's files.
COPY_BYTES, MANIFEST = 8 << 20, "_snapshot"
_LISTED = "path string, length long, modified long"


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, modified`` of all files below ``root``, but for the manifest of a snapshot."""
    folder, store = _fs(spark, root)
    if not store.exists(folder):
        raise FileNotFoundError(root)
    base, found, rows = store.makeQualified(folder).toString().rstrip("/") + "/", store.listFiles(folder, True), []
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString().removeprefix(base)
        if not name.startswith(MANIFEST + "/"):
            rows.append((name, f.getLen(), f.getModificationTime()))
    return spark.createDataFrame(rows, _LISTED)


def _copy(store_from, path_from: str, store_to, path_to: str, expected: str | None) -> str:
    """Copy a file under a name of its own and move it into place if its checksum is the expected one; the checksum."""
    folder, digest = posixpath.dirname(path_to), hashlib.sha256()
    store_to.create_dir(folder, recursive=True)
    waiting = posixpath.join(folder, f"_{uuid.uuid4().hex}.tmp")
    with store_from.open_input_stream(path_from) as src, store_to.open_output_stream(waiting) as out:
        while some := src.read(COPY_BYTES):
            digest.update(some)
            out.write(some)
    if expected in (None, digest.hexdigest()):
        store_to.move(waiting, path_to)
    else:
        store_to.delete_file(waiting)
    return digest.hexdigest()


def _copied(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Copy files in tasks: ``path, length, modified``, the checksum ``sha256`` and what was ``expected``."""
    uri = lambda root: root if "://" in root else "file://" + root
    source, target = uri(source), uri(target)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        (one, top), (other, to) = fs.FileSystem.from_uri(source), fs.FileSystem.from_uri(target)
        for pdf in batches:
            pdf["sha256"] = [_copy(one, f"{top}/{p}", other, f"{to}/{p}", e) for p, e in zip(pdf["path"], pdf["expected"])]
            yield pdf

    ship_package(rows.sparkSession)
    # files are dealt by name: a large folder is not one task's
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return stored(rows.repartition(4 * cores, "path").mapInPandas(run, StructType([*rows.schema.fields, StructField("sha256", StringType())])), "copied")


def _manifest(spark: SparkSession, root: str) -> DataFrame | None:
    done = versions(spark, f"{root}/{MANIFEST}")
    return spark.read.parquet(f"{root}/{MANIFEST}/v{done[-1]:06d}") if done else None


def snapshot(spark: SparkSession, source: str, target: str) -> int:
    """Keep a stored index or table at ``target``; how many files had to be copied.

    Tasks copy the files that differ by name, size or time from the last snapshot there.  A manifest with
    checksums is written when all are in place; files that the source no longer has go after that.
    """
    there, known = _listed(spark, source), _manifest(spark, target)
    same = there.columns
    new = there if known is None else there.join(known, same, "left_anti")
    copied = _copied(new.withColumn("expected", F.lit(None).cast("string")), source, target).drop("expected")
    n = copied.count()
    if known is not None and not n and known.count() == there.count():
        return 0
    number = (versions(spark, f"{target}/{MANIFEST}") or [0])[-1] + 1
    (copied if known is None else copied.unionByName(known.join(there, same, "left_semi"))).write.parquet(f"{target}/{MANIFEST}/v{number:06d}")
    if known is not None:
        for r in known.join(there, "path", "left_anti").select("path").toLocalIterator():
            remove(spark, f"{target}/{r.path}")
        remove(spark, f"{target}/{MANIFEST}/v{number - 1:06d}")
    return n


def restore(spark: SparkSession, kept: str, target: str) -> int:
    """Put a snapshot back at ``target``; how many files.  A file that is not what the manifest says is not put there, and an error names it."""
    known = _manifest(spark, kept)
    if known is None:
        raise FileNotFoundError(f"no snapshot at {kept}")
    copied = _copied(known.withColumnRenamed("sha256", "expected"), kept, target)
    if bad := [r.path for r in copied.where("sha256 <> expected").select("path").limit(10).collect()]:
        raise ValueError(f"damaged: {', '.join(sorted(bad))}")
    return copied.count()
