"""Tables of segments: each batch is a segment of its own, and what it replaces in older ones is masked.

A batch writes its own rows and the ids that it replaces, whatever the size of the table; rows that
stand are not rewritten until segments of like size are merged.  A state lists the segments and masks that
count; it is published once all of its folders are complete, and readers of the one before go on.
Two writers at once: the second to publish the same number fails, and may try again.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import remove, versions

#: States that are kept; a segment's folder goes with the last of them that lists it.
KEPT_STATES = 2
#: So many segments of like size are merged; sizes are alike within this factor.
FAN = 8


class Segments:
    """The table at ``path``; each segment and mask has one or more parts (folders of Parquet)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        found = versions(spark, f"{path}/state")
        self.number = found[-1] if found else 0
        self.state = self._read(self.number) if found else {"serial": 0, "segments": [], "masks": [], "more": {}}

    def _read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/state/v{number:06d}", wholetext=True).head()[0])

    def folder(self, name: str, part: str) -> str:
        return f"{self.path}/{name}/{part}"

    def publish(self, state: dict) -> None:
        row = self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1)
        row.write.mode("errorifexists").text(f"{self.path}/state/v{self.number + 1:06d}")
        self.number, self.state = self.number + 1, state
        found = versions(self.spark, f"{self.path}/state")
        gone, kept = found[:-KEPT_STATES], [self._read(v) for v in found[-KEPT_STATES:]]
        held = {n for s in kept for n in _names(s)}
        for v in gone:
            for name in _names(self._read(v)) - held:
                remove(self.spark, f"{self.path}/{name}")
            remove(self.spark, f"{self.path}/state/v{v:06d}")

    def write(self, kind: str, serial: int, parts: dict[str, DataFrame], save: Callable[[str, DataFrame, str], None]) -> dict:
        """Write the parts of a segment (``s``) or mask (``m``); the first part's rows count."""
        name = f"{kind}{serial:06d}-{uuid.uuid4().hex[:12]}"
        for part, rows in parts.items():
            save(part, rows, self.folder(name, part))
        return {"name": name, "serial": serial, "rows": self.spark.read.parquet(self.folder(name, next(iter(parts)))).count()}

    def hidden(self) -> DataFrame | None:
        """``id, until``: rows of an id in segments below ``until`` are gone; None if there are none."""
        oldest = min((s["serial"] for s in self.state["segments"]), default=0)
        some = [self.spark.read.parquet(self.folder(m["name"], "ids")).select("id", F.lit(m["serial"]).cast("long").alias("until")) for m in self.state["masks"] if m["serial"] > oldest]
        out = None
        for d in some:
            out = d if out is None else out.unionByName(d)
        return None if out is None else out.groupBy("id").agg(F.max("until").alias("until"))

    def live(self, part: str, segments: list[dict] | None = None) -> DataFrame:
        """The part's rows that no mask hides, with their segment's ``serial``."""
        return unmasked(self.rows(part, segments), self.hidden())

    def rows(self, part: str, segments: list[dict] | None = None) -> DataFrame:
        """The part's rows of the segments (of all), hidden ones too."""
        chosen = self.state["segments"] if segments is None else segments
        if not chosen:
            raise FileNotFoundError(f"no segments at {self.path}")
        out = None
        for s in chosen:
            d = self.spark.read.parquet(self.folder(s["name"], part)).withColumn("serial", F.lit(s["serial"]).cast("long"))
            out = d if out is None else out.unionByName(d, allowMissingColumns=True)
        return out

    def like(self) -> list[dict]:
        """Segments to merge: those of the first size of which there are ``FAN``."""
        sizes: dict[int, list[dict]] = {}
        for s in self.state["segments"]:
            sizes.setdefault(int(math.log(s["rows"] + 1, FAN)), []).append(s)
        return next((some for _, some in sorted(sizes.items()) if len(some) >= FAN), [])

    def successor(self, add: list[dict] = (), drop: list[dict] = (), masks: list[dict] = (), **more) -> dict:
        """The state after segments and masks are added and segments dropped; masks that hide nothing any longer go."""
        names = {d["name"] for d in drop}
        segments = [s for s in self.state["segments"] if s["name"] not in names] + list(add)
        oldest = min((s["serial"] for s in segments), default=0)
        kept = [m for m in [*self.state["masks"], *masks] if m["serial"] > oldest]
        return {"serial": self.state["serial"] + 1, "segments": segments, "masks": kept, "more": self.state["more"] | more}


def _names(state: dict) -> set[str]:
    return {x["name"] for x in [*state["segments"], *state["masks"]]} | {v for k, v in state["more"].items() if k == "stats"}


def unmasked(rows: DataFrame, hidden: DataFrame | None) -> DataFrame:
    """``rows(id, serial, ...)`` without those that are hidden."""
    if hidden is None:
        return rows
    gone = hidden.withColumnRenamed("id", "__gone")
    return rows.join(gone, (F.col("id") == F.col("__gone")) & (F.col("serial") < F.col("until")), "left_anti")
