"""Line dedup by content-defined chunks.

A rolling hash runs over the hashes of two neighbouring lines, and a chunk ends wherever it is
lower than at the lines before and after.  That depends on four lines only, so a passage is
cut alike wherever it stands, and no two neighbours can both be ends: chunks have three lines
on average and two at least, but for a text's last one.  A line of over ``LONG_LINE`` words is
a passage of several lines that only lacks the breaks: it is a chunk of its own.

A passage of few lines may lie between the ends.  So beside the chunks each line that isn't
blank begins a run: the shortest row of lines from there, two or more, with over ``LONG_LINE``
words.  Runs are taken for repeated by the same steps as chunks.

A chunk of several lines, a long line or a run that occurs more than once in the corpus stays
where it first occurs (smallest id, a null before all, then text hash, then line) and is removed elsewhere.  An
occurrence that begins inside the first one stays too.  Each line that goes still stands at an
earlier place, so nothing is lost altogether.

First the hashes of all chunks and runs are counted; only those that occur twice are compared
by their bytes, and where hashes met by chance the bytes decide.  Sums are partial, so a
frequent passage is counted once per task.  All expressions run in the JVM.

Defined results: a null or empty text stays as it is; a text that loses all its lines
becomes empty, its row stays; rows with one id and one text count as one document and are
treated alike; ``n_chars``, if there, follows the text; texts and lines of any length are read
whole; other columns, whatever their names, are untouched; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.arrays import let, prefix_sums
from .common import materialize, table

MIN_LINES, LONG_LINE = 2, 50


def word_count(line: Column) -> Column:
    """Words of a line, told by its blanks; 0 for a blank line."""
    blanks = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(blanks < F.octet_length(line), blanks + 1).otherwise(0)


def chunk_ends(lines: Column, words: Column) -> Column:
    """For each chunk the number of lines up to its end."""
    hashes = F.transform(lines, lambda x: F.xxhash64(x))

    def roll(h: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("long")), F.slice(h, F.lit(1), F.size(h) - 1))
        return F.zip_with(before, h, lambda a, b: F.shiftleft(a, 1).bitwiseXOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(b))

    def ends(r: Column) -> Column:
        low = lambda x, i: (x < F.get(r, i - 1)) & (x <= F.get(r, i + 1))
        alone = lambda i: F.coalesce(F.get(words, i) > LONG_LINE, F.lit(False))
        end = lambda x, i: low(x, i) | alone(i) | alone(i + 1) | (i == F.size(r) - 1)
        return F.filter(F.transform(r, lambda x, i: F.when(end(x, i), i + 1)), lambda e: e.isNotNull())

    return let(let(hashes, roll), ends)


def _part(lines: Column, a: Column, b: Column) -> Column:
    return F.array_join(F.slice(lines, a + 1, b - a), "\n")


def _chunks(lines: Column, words: Column) -> Column:
    """``array<struct<a, b>>``: first line and end of each chunk that counts."""

    def parts(e: Column) -> Column:
        begin = F.concat(F.array(F.lit(0)), F.slice(e, F.lit(1), F.size(e) - 1))
        return F.filter(F.zip_with(begin, e, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda c: (c["b"] - c["a"] >= MIN_LINES) | (F.get(words, c["a"]) > LONG_LINE))

    return let(chunk_ends(lines, words), parts)


def _runs(words: Column) -> Column:
    """``array<struct<a, b>>``: the shortest run of several lines with over ``LONG_LINE`` words from each line on."""

    def of(x: Column) -> Column:
        at, total = x["at"], x["total"]

        def run(i: Column, k: Column) -> Column:
            # lines from k on with which the run is still too short; each has a word, so LONG_LINE are enough
            most = F.get(total, k) - F.get(words, i) + LONG_LINE
            short = F.size(F.filter(F.slice(total, k + 1, LONG_LINE), lambda t: t <= most))
            return F.when(short > 0, F.struct(i.alias("a"), (F.get(at, k + short) + 1).alias("b")))

        return F.filter(F.transform(at, run), lambda r: r["b"].isNotNull())

    worded = F.struct(F.filter(F.transform(words, lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull()).alias("at"), prefix_sums(F.filter(words, lambda n: n > 0)).alias("total"))
    # a text of so few words has none
    enough = F.aggregate(words, F.lit(0), lambda s, n: s + n) > LONG_LINE
    return F.when(enough, let(worded, of)).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def occurrences(text: Column) -> Column:
    """``array<struct<a, b, run, h>>``: lines ``a`` to ``b``, exclusive, of each chunk and each run, and their hash."""

    def both(x: Column) -> Column:
        lines, words = x["lines"], x["words"]
        named = lambda parts, run: F.transform(parts, lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), F.lit(run).alias("run"), F.xxhash64(_part(lines, c["a"], c["b"])).alias("h")))
        return F.concat(named(_chunks(lines, words), False), named(_runs(words), True))

    return let(F.split(text, "\n", -1), lambda lines: let(F.struct(lines.alias("lines"), F.transform(lines, word_count).alias("words")), both))


#: A second hash of the bytes: with the first it names a group of equal bytes.
def _second(text: Column) -> Column:
    return F.xxhash64(F.lit(1), text)


def _flagged(docs: DataFrame) -> DataFrame:
    """``docs``, the hash of each text and ``__vs_seen``: its chunks and runs whose hash occurs twice."""
    each = docs.where("text is not null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.explode(occurrences(F.col("text"))).alias("o"))
    found = materialize(each.select("id", "th", "o.*"), "line-occurrences")
    twice = materialize(found.groupBy("run", "h").count().where("count > 1").select("run", "h"), "line-twice")
    # merged at every size: the plan, and what it moves, does not change as the corpus grows
    seen = found.join(twice.hint("merge"), ["run", "h"], "left_semi").groupBy("id", "th").agg(F.collect_set(F.struct("a", "b", "run", "h")).alias("__vs_seen"))
    seen = seen.withColumnsRenamed({"id": "__vs_id", "th": "__vs_of"})
    hashed = docs.withColumn("__vs_th", F.xxhash64("text"))
    on = hashed["doc_id"].eqNullSafe(F.col("__vs_id")) & (hashed["__vs_th"] == F.col("__vs_of"))
    return materialize(hashed.join(seen.hint("merge"), on, "left").drop("__vs_id", "__vs_of"), "line-texts")


def _gone(flagged: DataFrame) -> DataFrame:
    """``id, th, lines``: the lines of each text that occurred before."""
    lines = F.split("text", "\n", -1)
    parts = let(lines, lambda x: F.transform(F.col("__vs_seen"), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["run"].alias("run"), s["h"].alias("h"), _part(x, s["a"], s["b"]).alias("text"))))
    each = flagged.where("__vs_seen is not null").select(F.col("doc_id").alias("id"), F.col("__vs_th").alias("th"), F.explode(parts).alias("o")).select("id", "th", "o.*")
    place = F.struct("id", "th", "a", "b")
    # grouped by the bytes themselves; their hashes follow from them
    same = each.groupBy("run", "text").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("h").alias("h")).where("first <> last")
    same = materialize(same.select("run", "h", _second(F.col("text")).alias("h2"), "first"), "line-first")
    own = each.select("id", "th", "a", "b", "run", "h", _second(F.col("text")).alias("h2"))
    later = own.join(same.hint("merge"), ["run", "h", "h2"]).where(~(F.struct("id", "th").eqNullSafe(F.struct("first.id", "first.th")) & (F.col("a") < F.col("first.b"))))
    lost = F.array_distinct(F.flatten(F.collect_list(F.sequence("a", F.col("b") - 1))))
    return materialize(later.select("id", "th", "a", "b").distinct().groupBy("id", "th").agg(lost.alias("lines")), "line-gone")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated chunks and runs; same columns and rows."""
    flagged = _flagged(docs)
    gone = _gone(flagged).withColumnsRenamed({"id": "__vs_id", "th": "__vs_of", "lines": "__vs_gone"})
    on = flagged["doc_id"].eqNullSafe(F.col("__vs_id")) & (flagged["__vs_th"] == F.col("__vs_of"))
    some = flagged.where("__vs_seen is not null").join(gone.hint("merge"), on, "left")

    def rebuilt(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__vs_gone"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    changed = F.col("__vs_gone").isNotNull()
    out = {"text": F.when(changed, let(F.split("text", "\n", -1), rebuilt)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length(out["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    some = some.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])
    return flagged.where("__vs_seen is null").select(*[F.col(f"`{c}`") for c in docs.columns]).union(some)


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without repeated chunks and runs, and how many characters are left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs.withColumn("n_chars", F.length("text"))).select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"))
