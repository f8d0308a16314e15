"""Array expressions that Spark SQL lacks, built from its higher-order functions.

All stay in the JVM.  ``let`` binds a value once: a column that is used inside a lambda would
otherwise be evaluated anew for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Elements that one fold appends to; longer arrays are summed block by block.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column) -> Column:
    none = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("r"))

    def step(acc: Column, v: Column) -> Column:
        s = acc["s"] + v.cast("long")
        return F.struct(s.alias("s"), F.concat(acc["r"], F.array(s)).alias("r"))

    return F.aggregate(values, none, step, lambda acc: acc["r"])


def prefix_sums(values: Column) -> Column:
    """Running totals of an integer array.

    A fold that appends copies what it has, so it runs within blocks and over block totals:
    the cost grows with ``n * BLOCK``, not with ``n * n``.
    """

    def blocks(a: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(a), F.lit(BLOCK)), lambda b: F.slice(a, b, F.lit(BLOCK)))
        inside = F.transform(cut, _running)
        before = lambda w: F.concat(F.array(F.lit(0).cast("long")), _running(F.transform(w, lambda x: F.element_at(x, -1))))
        return let(inside, lambda w: F.flatten(F.zip_with(w, F.slice(before(w), 1, F.size(w)), lambda x, b: F.transform(x, lambda v: v + b))))

    return let(values, lambda a: F.when(F.size(a) > BLOCK, blocks(a)).otherwise(_running(a)))


#: Characters of the blocks that a long text is cut into before parts of it are taken.
CUT = 1 << 14


def with_parts(text: Column, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """``body`` of a function that takes the part of ``text`` from one code point to another, exclusive.

    A substring walks a text from its start; many parts of a long one would walk it as often.
    Here the text is cut into blocks once, and a part walks its own blocks only.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(CUT)), lambda i: F.substring(text, i + 1, F.lit(CUT)))

    def part(held: Column) -> Callable[[Column, Column], Column]:
        at = lambda x: F.floor(x / CUT).cast("int")
        # most parts lie within one block
        whole = lambda s, e: F.when(at(s) == at(e - 1), F.get(held, at(s))).otherwise(F.array_join(F.slice(held, at(s) + 1, at(e - 1) - at(s) + 1), ""))
        return lambda s, e: F.when(e > s, F.substring(whole(s, e), (s % CUT + 1).cast("int"), (e - s).cast("int"))).otherwise(F.lit(""))

    return let(blocks, lambda held: body(part(held)))


#: Put around matches to part a text at them; a text that holds this character is searched twice instead.
MARK = "\x01"


def _gaps_and_hits(text: Column, pattern: str) -> Column:
    """``struct<gap, hit>``: what lies before, between and after all matches, and the matches, by one search of the text."""

    def parted(t: Column) -> Column:
        marked = F.regexp_replace(t, F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
        # a split at one character needs no pattern
        pieces = let(marked, lambda m: F.when(F.contains(m, F.lit(MARK)), F.split(m, MARK, -1)).otherwise(F.array(m)))
        once = let(pieces, lambda p: F.struct(F.filter(p, lambda _, i: i % 2 == 0).alias("gap"), F.filter(p, lambda _, i: i % 2 == 1).alias("hit")))
        twice = F.struct(F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("hit"))
        return F.when(F.contains(t, F.lit(MARK)), twice).when(t.isNotNull(), once)

    return let(text, parted)


def match_spans(text: Column, pattern: str, beside: int = 0, least: int = 1, keep: Callable[[Column], Column] | None = None) -> Column:
    """All matches of a pattern as ``array<struct<start, end, text>>``; code points, end exclusive.

    SQL has no ``finditer``: a match starts after the gaps and matches before it.  The pattern
    must not match the empty string and must not depend on groups.  ``keep`` is a condition on
    a match's text.

    With ``beside`` each match also has the characters ``before`` and ``after`` it, so many at
    most.  They are put together from the ends of the gaps and matches next to it, never cut
    from the text, whose start may be far away.  No match is shorter than ``least``.
    """
    # so many neighbours hold all the characters that are asked for
    near = -(-beside // least)
    head = lambda s: F.substring(s, 1, beside)
    tail = lambda s: F.when(F.length(s) > beside, F.substring(s, -beside, beside)).otherwise(s)

    def spans(b: Column) -> Column:
        hits = b["hit"]
        gone = F.concat(F.array(F.lit(0)), F.transform(hits, F.length))
        steps = F.zip_with(F.slice(b["gap"], 1, F.size(hits)), F.slice(gone, 1, F.size(hits)), lambda g, m: F.length(g) + m)
        whole = F.zip_with(hits, prefix_sums(steps), lambda h, s: F.struct(s.alias("start"), (s + F.length(h)).alias("end"), h.alias("text")))
        if beside:
            whole = F.transform(whole, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), i.alias("i")))
        kept = F.filter(whole, lambda s: keep(s["text"])) if keep else whole
        if not beside:
            return kept
        # the end of each match with the gap before it, the beginning with the gap after it
        tails = F.zip_with(F.slice(b["gap"], 1, F.size(hits)), hits, lambda g, h: tail(F.concat(tail(g), tail(h))))
        heads = F.zip_with(hits, F.slice(b["gap"], 2, F.size(hits)), lambda h, g: head(F.concat(head(h), head(g))))

        def sides(x: Column) -> Column:
            def one(s: Column) -> Column:
                first = F.greatest(s["i"] - near, F.lit(0))
                before = tail(F.concat(F.array_join(F.slice(x["tails"], first + 1, s["i"] - first), ""), tail(F.get(b["gap"], s["i"]))))
                after = head(F.concat(head(F.get(b["gap"], s["i"] + 1)), F.array_join(F.slice(x["heads"], s["i"] + 2, F.lit(near)), "")))
                return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), before.alias("before"), after.alias("after"))

            return F.transform(x["kept"], one)

        some = let(F.struct(kept.alias("kept"), tails.alias("tails"), heads.alias("heads")), sides)
        return F.when(F.size(hits) > 0, some).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,text:string,before:string,after:string>>"))

    return let(_gaps_and_hits(text, pattern), spans)


def _at(counted: Column, k: Column) -> Column:
    """Value number ``k`` (from 1) of a multiset given as sorted ``array<struct<v, c>>``."""
    return let(prefix_sums(F.transform(counted, lambda x: x["c"])), lambda cum: F.get(counted, F.size(F.filter(cum, lambda x: x < k)))["v"])


def _count(counted: Column) -> Column:
    return F.aggregate(counted, F.lit(0).cast("long"), lambda acc, x: acc + x["c"])


def p90_exclusive(counted: Column) -> Column:
    """The ninth decile by the exclusive method for ten values or more, else the maximum, else 0.

    Takes distinct values with their counts, in order: what is held grows with those only.
    """

    def of(n: Column) -> Column:
        j = F.least(F.greatest(F.floor(9 * (n + 1) / F.lit(10.0)).cast("long"), F.lit(1)), n - 1)
        d = 9 * (n + 1) - 10 * j
        decile = let(j, lambda k: (_at(counted, k) * (10 - d) + _at(counted, k + 1) * d) / 10.0)
        return F.when(n >= 10, decile).when(n > 0, F.element_at(counted, -1)["v"].cast("double")).otherwise(F.lit(0.0))

    return let(_count(counted), of)


def latency_percentile(counted: Column, p: int) -> Column:
    """The value at ``n * p / 100``, cut, in a sorted list, to one digit; 0.0 for none."""
    at = lambda n: _at(counted, F.greatest(F.lit(1), F.floor(n * p / F.lit(100.0)).cast("long")))
    return F.coalesce(F.round(let(_count(counted), at), 1), F.lit(0.0))
