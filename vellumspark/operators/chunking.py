"""Chunks of documents in three tiers: by article, by greedy windows, or whole.

Windows are a fold over a text's paragraphs, so a document is chunked in its own row without
a shuffle.  One difference from a naive reading: windows of a stripped section are placed at
the stripped text's own offset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let, match_spans, prefix_sums, with_parts
from ..functions.text import slug, strip, strip_left, tokens_chunked, tokens_parsed
from ..profiles import TextProfile

SPAN = "array<struct<s:int,e:int>>"


def _span(s: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))


def tier(structure: Column, n_tokens: Column, profile: TextProfile) -> Column:
    """A: has articles; C: short; B: the rest.  ``n_tokens`` is the parser's estimate."""
    articles = F.exists(F.coalesce(structure, F.array().cast(structure_type())), lambda n: n["type"] == "artigo")
    return F.when(articles, "A").when(n_tokens <= profile.most_tokens, "C").otherwise("B")


def structure_type() -> str:
    from ..schemas import NODES

    return NODES


def paragraphs(text: Column, profile: TextProfile) -> Column:
    """Spans between paragraph breaks; one longer than the cap is cut every target length."""
    target, most = profile.target_tokens * profile.chars_per_token, profile.most_tokens * profile.chars_per_token

    def between(m: Column) -> Column:
        begin = F.concat(F.array(F.lit(0).cast("long")), F.transform(m, lambda x: x["end"]))
        end = F.concat(F.transform(m, lambda x: x["start"]), F.array(F.length(text).cast("long")))
        return F.filter(F.zip_with(begin, end, _span), lambda p: p["e"] > p["s"])

    cut = lambda p: F.transform(F.sequence(p["s"], p["e"] - 1, F.lit(target)), lambda i: _span(i, F.least(p["e"], i + target)))
    return F.flatten(F.transform(let(match_spans(text, profile.paragraph), between), lambda p: F.when(p["e"] - p["s"] <= most, F.array(p)).otherwise(cut(p))))


def windows(text: Column, profile: TextProfile) -> Column:
    """Paragraphs merged greedily up to the target length, with an overlap after each overflow."""
    target, overlap = profile.target_tokens * profile.chars_per_token, profile.overlap_tokens * profile.chars_per_token
    least = profile.least_chars
    none = F.array().cast(SPAN)
    start = F.struct(none.alias("w"), F.lit(None).cast("int").alias("s"), F.lit(0).alias("e"))

    def fold(acc: Column, p: Column) -> Column:
        closed = F.when(acc["e"] - acc["s"] >= least, F.concat(acc["w"], F.array(_span(acc["s"], acc["e"])))).otherwise(acc["w"])

        def moved(w: Column) -> Column:
            new = F.when(F.size(w) > 0, F.greatest(acc["s"], p["s"] - overlap)).otherwise(p["s"])
            return F.struct(w.alias("w"), new.cast("int").alias("s"), p["e"].alias("e"))

        first = F.struct(acc["w"].alias("w"), p["s"].alias("s"), p["e"].alias("e"))
        grown = F.struct(acc["w"].alias("w"), acc["s"].alias("s"), p["e"].alias("e"))
        return F.when(acc["s"].isNull(), first).when(p["e"] - acc["s"] <= target, grown).otherwise(let(closed, moved))

    def finish(acc: Column) -> Column:
        return F.when(acc["s"].isNotNull() & (acc["e"] - acc["s"] >= least), F.concat(acc["w"], F.array(_span(acc["s"], acc["e"])))).otherwise(acc["w"])

    merged = F.aggregate(paragraphs(text, profile), start, fold, finish)
    return let(merged, lambda w: F.when(F.size(w) > 0, w).otherwise(fixed_windows(text, target, least)))


def fixed_windows(text: Column, size: int, least: int) -> Column:
    """Slices of one length; a last one below ``least`` is dropped."""
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: _span(i, F.least(n, i + size)))
    return F.when(n > 0, F.filter(cut, lambda w: w["e"] - w["s"] >= least)).otherwise(F.array().cast(SPAN))


PIECE = "array<struct<suffix:string,type:string,label:string,parent:string,title:string,start:int,end:int,text:string,windowed:boolean>>"


def _sections(within: Callable[[Column, Column], Column], nodes: Column, profile: TextProfile) -> Column:
    """Tier A: preamble, articles (by paragraph where too long) and annexes, before the size cap; ``within`` takes parts of the text."""
    by_start = lambda kind: F.array_sort(F.filter(nodes, lambda n: n["type"] == kind), lambda a, b: a["start"] - b["start"])
    no = F.lit("")

    def piece(suffix, kind, label, parent, title, s, e) -> Column:
        def made(body: Column) -> Column:
            lead = F.length(body) - F.length(strip_left(body))
            return F.struct(suffix.alias("suffix"), F.lit(kind).alias("type"), label.alias("label"), parent.alias("parent"), title.alias("title"), s.cast("int").alias("start"), e.cast("int").alias("end"), strip(body).alias("text"), lead.cast("int").alias("lead"))

        return let(within(s, e), made)

    def article(a: Column, i: Column, paras: Column) -> Column:
        """``paras``: the paragraphs between this article and the next."""
        name = F.concat(slug(a["label"]), F.format_string("_%03d", i))
        one = piece(name, "artigo", a["label"], no, a["title"], a["start"], a["end"])

        def split(whole: Column, subs: Column) -> Column:
            windowed = F.struct(*[(no if k == "title" else whole[k]).alias(k) for k in ("suffix", "type", "label", "parent", "title", "start", "end", "text", "lead")])
            caput = piece(F.concat(name, F.lit("__caput")), "artigo", a["label"], no, F.lit("caput"), a["start"], F.get(subs, F.lit(0))["start"])
            each = lambda p, j: piece(F.concat(name, F.lit("__"), slug(p["label"]), F.format_string("_%03d", j)), "paragrafo", p["label"], a["label"], no, p["start"], p["end"])
            return F.when(F.size(subs) > 0, F.concat(F.array(caput), F.transform(subs, each))).otherwise(F.array(windowed))

        mine = F.filter(paras, lambda p: (p["parent"] == a["label"]) & (p["start"] >= a["start"]) & (p["end"] <= a["end"]))

        def kept(x: Column) -> Column:
            small = F.length(x["text"]) < profile.least_chars
            return F.when(small, F.filter(F.array(x), lambda _: F.lit(False))).when(tokens_chunked(x["text"]) <= profile.most_tokens, F.array(x)).otherwise(let(mine, lambda subs: split(x, subs)))

        return let(one, kept)

    def between(ps: Column, arts: Column) -> Column:
        """For each article the paragraphs from its start to the next article's, by running counts over both."""
        both = F.array_sort(F.concat(*[F.transform(x, lambda n: F.struct(n["start"].alias("start"), F.lit(k).alias("k"))) for k, x in ((0, arts), (1, ps))]))
        seen = prefix_sums(F.transform(both, lambda n: n["k"].cast("long")))
        # paragraphs before each article, and after the last one
        before = F.filter(F.zip_with(both, seen, lambda n, c: F.when(n["k"] == 0, c)), lambda c: c.isNotNull())
        upto = lambda b: F.concat(b, F.array(F.size(ps).cast("long")))
        part = lambda b, i: F.slice(ps, (F.get(b, i) + 1).cast("int"), (F.get(b, i + 1) - F.get(b, i)).cast("int"))
        return let(before, lambda b: let(upto(b), lambda u: F.transform(arts, lambda a, i: part(u, i))))

    def whole(arts: Column) -> Column:
        cut = F.get(arts, F.lit(0))["start"]
        preamble = piece(F.lit("preambulo"), "preambulo", F.lit("Preâmbulo"), no, no, F.lit(0), cut)
        first = F.filter(F.array(preamble), lambda x: F.length(x["text"]) >= profile.least_preamble)
        articles = let(by_start("paragrafo"), lambda ps: let(between(ps, arts), lambda own: F.flatten(F.transform(arts, lambda a, i: article(a, i, F.get(own, i))))))
        annexes = F.transform(by_start("anexo"), lambda x, i: piece(F.concat(slug(x["label"]), F.format_string("_%d", i)), "anexo", x["label"], no, x["title"], x["start"], x["end"]))
        return F.concat(first, F.filter(F.concat(articles, annexes), lambda x: F.length(x["text"]) >= profile.least_chars))

    return let(by_start("artigo"), whole)


def chunk_documents(docs: DataFrame, profile: TextProfile) -> DataFrame:
    """All chunks of parsed documents (``doc_id, text, structure, n_tokens_est`` and what else they have).

    Adds ``url`` (if there is a ``filename``), ``tier``, the section columns, ``char_start``, ``char_end``, ``n_chars``,
    ``n_tokens_est``, ``text`` and ``chunk_id`` to the documents' other columns.
    """
    whole = docs.withColumn("tier", tier(F.col("structure"), F.col("n_tokens_est"), profile))
    if "filename" in docs.columns:
        whole = whole.withColumn("url", F.concat(F.lit(profile.base_url), F.coalesce("filename", F.lit(""))))
    text, no = F.col("text"), F.lit("")
    # the whole text is a section as well: of windows (B) or of one chunk (C)
    plain = lambda suffix, kind: F.array(F.struct(F.lit(suffix).alias("suffix"), F.lit(kind).alias("type"), no.alias("label"), no.alias("parent"), no.alias("title"), F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text"), F.lit(0).alias("lead")))
    sections = F.when(F.col("tier") == "A", with_parts(text, lambda within: _sections(within, F.col("structure"), profile))).when(F.col("tier") == "B", plain("b", "prosa")).otherwise(plain("doc", "doc"))
    kept = [c for c in whole.columns if c not in ("text", "structure", "n_tokens_est")]
    parts = whole.select(*kept, F.explode(sections).alias("x"))
    capped = (F.col("tier") == "B") | ((F.col("tier") == "A") & (tokens_chunked(F.col("x.text")) > profile.most_tokens))
    one = F.array(F.struct(F.lit(0).alias("s"), F.length("x.text").alias("e"), F.col("x.text").alias("text")))
    texts = with_parts(F.col("x.text"), lambda within: F.transform(windows(F.col("x.text"), profile), lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), within(w["s"], w["e"]).alias("text"))))
    cut = parts.select(*kept, "x", capped.alias("capped"), F.posexplode(F.when(capped, texts).otherwise(one)).alias("k", "w"))
    body = strip(F.col("w.text"))
    at = F.col("x.start") + F.col("x.lead")
    title = F.when(F.col("capped") & (F.col("x.type") == "artigo") & (F.col("x.title") != "caput"), no).otherwise(F.col("x.title"))
    out = cut.select(
        *kept,
        F.concat_ws("__", F.col("doc_id").cast("string"), F.concat(F.col("x.suffix"), F.when(F.col("capped"), F.format_string("_%03d", F.col("k"))).otherwise(no))).alias("chunk_id"),
        F.col("x.type").alias("section_type"),
        F.col("x.label").alias("section_label"),
        F.col("x.parent").alias("section_parent"),
        title.alias("section_title"),
        F.when(F.col("capped"), at + F.col("w.s")).otherwise(F.col("x.start")).alias("char_start"),
        F.when(F.col("capped"), at + F.col("w.e")).otherwise(F.col("x.end")).alias("char_end"),
        body.alias("text"),
    )
    long = out.where((F.col("tier") == "C") | (F.length("text") >= profile.least_chars))
    return long.withColumns({"n_chars": F.length("text"), "n_tokens_est": tokens_chunked(F.col("text"))})


def with_estimate(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_tokens_est", tokens_parsed(F.col("text")))
