"""Structure markers of a text: where each begins, where it ends, what it belongs to."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.arrays import let, match_spans, prefix_sums
from ..profiles import TextProfile


def markers(text: Column, profile: TextProfile) -> Column:
    """``array<struct<start, ord, rank, type, label, title>>`` by start, then pattern order.

    A start includes the blank line before, which the patterns' leading white space takes in.
    """

    def node(k: int, name: str, pattern: str, rank: int):
        title = (lambda m: F.trim(F.regexp_extract(m["text"], pattern, 2))) if "(.*)" in pattern else (lambda m: F.lit(""))

        def make(m: Column) -> Column:
            label = F.trim(F.regexp_extract(m["text"], pattern, 1))
            return F.struct(m["start"].cast("int").alias("start"), F.lit(k).alias("ord"), F.lit(rank).alias("rank"), F.lit(name).alias("type"), label.alias("label"), title(m).alias("title"))

        return make

    found = [F.transform(match_spans(text, p), node(k, name, p, rank)) for k, (name, (p, rank)) in enumerate(profile.markers.items())]
    return F.array_sort(F.concat(*found))


def node_ends(nodes: Column, length: Column) -> Column:
    """End of each node: the start of the next node of the same or a higher rank, else the text's end.

    ``nodes`` is in order of start.  For each rank at hand the starts that end it are listed once,
    and running counts say which of them is next: the cost grows with the nodes, not their square.
    """

    def ends(n: Column) -> Column:
        def level(r: Column) -> Column:
            closing = lambda x: x["rank"] <= r
            starts = F.transform(F.filter(n, closing), lambda x: x["start"])
            return F.struct(r.alias("rank"), starts.alias("starts"), prefix_sums(F.transform(n, lambda x: closing(x).cast("long"))).alias("seen"))

        levels = F.transform(F.array_distinct(F.transform(n, lambda x: x["rank"])), level)

        def lookup(held: Column) -> Column:
            mine = lambda x: F.get(F.filter(held, lambda level: level["rank"] == x["rank"]), F.lit(0))
            next_start = lambda own, i: F.get(own["starts"], F.get(own["seen"], i).cast("int"))
            return F.transform(n, lambda x, i: F.coalesce(let(mine(x), lambda own: next_start(own, i)), length))

        return let(levels, lookup)

    return let(nodes, ends)


def parents(nodes: Column) -> Column:
    """Label of the last article before each paragraph; empty for all other nodes."""

    def of(n: Column) -> Column:
        article = lambda x: x["type"] == "artigo"
        both = F.struct(F.transform(F.filter(n, article), lambda x: x["label"]).alias("labels"), prefix_sums(F.transform(n, lambda x: article(x).cast("long"))).alias("seen"))
        last = lambda held, i: F.coalesce(F.get(held["labels"], (F.get(held["seen"], i) - 1).cast("int")), F.lit(""))
        return let(both, lambda held: F.transform(n, lambda x, i: F.when(x["type"] == "paragrafo", last(held, i)).otherwise(F.lit(""))))

    return let(nodes, of)


def structure(text: Column, profile: TextProfile) -> Column:
    """The nodes of a parsed document (``schemas.NODES``)."""

    def whole(t: Column, n: Column) -> Column:
        extra = F.arrays_zip(node_ends(n, F.length(t)).alias("end"), parents(n).alias("parent"))
        return F.zip_with(n, extra, lambda x, e: F.struct(x["type"].alias("type"), x["label"].alias("label"), x["start"].alias("start"), e["end"].alias("end"), x["title"].alias("title"), e["parent"].alias("parent")))

    return let(text, lambda t: let(markers(t, profile), lambda n: whole(t, n)))
