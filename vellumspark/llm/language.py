"""Language identification by words first, backing off to shorter and shorter n-grams.

A known word scores its log frequency in each language.  An unseen word scores the mean log
frequency of its character 5-grams that are known, or of its 4-grams if none is, and so on
down to single letters.

Word counts cover all training documents: each task counts its own, and the sums meet by
language and word.  The n-grams are counted over all of these words, weighted by their counts.
The model holds the ``MODEL_WORDS`` most frequent words of each language and the ``MODEL_GRAMS``
most frequent n-grams of each length in each language, with their counts in all languages; so
what is broadcast grows with the number of languages and not with the corpus, and no language
is lost.  The cut is exact: it is found from histograms of the counts, and only the entries of
the last step, a thousandth of the equally frequent ones, are ranked.

Defined results: words are runs of letters (Unicode category L) in lower case; ``und`` with
score 0 for a null text, a text without a letter, or if nothing was learned; ties go to the
language that sorts first; equally frequent words are taken by a part of their hash and then in
order; rows without an id are neither learned from nor held out; repeated rows count and are
predicted each; texts and words of any length are read whole; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import materialize, small_batches, table

#: Words of a language, and n-grams of each length in it, that the model holds.
MODEL_WORDS, MODEL_GRAMS = 50_000, 15_000
ORDERS = (5, 4, 3, 2, 1)
#: Equally frequent entries are cut by so many parts of their hash.
PARTS = 1024
#: Distinct words that a task counts before it passes the sums on.
HELD_WORDS = 400_000
#: The score is the posterior as if a text had at most so many words; longer ones are all alike.
SCORED_WORDS = 20
MIN_SCORE = 0.5
UNKNOWN = "und"


def _marks() -> str:
    """Characters that are neither letters nor decimal digits, but count as part of words in patterns."""
    found = [c for c in range(0x110000) if (x := chr(c)).isalnum() and not x.isalpha() and not x.isdecimal()]
    ends = [0, *(i for i in range(1, len(found)) if found[i] != found[i - 1] + 1), len(found)]
    return "".join(f"{chr(found[a])}-{chr(found[b - 1])}" for a, b in zip(ends, ends[1:]))


#: A run of letters; the short pattern is as good where none of the marks stands.
MARK, PLAIN = re.compile(f"[{_marks()}]"), re.compile(r"[^\W\d_]+")
WORD = re.compile(rf"[^\W\d_{_marks()}]+")


def words_of(text: str) -> list[str]:
    """The lower-cased runs of letters of a text."""
    low = text.lower()
    return (PLAIN if low.isascii() or not MARK.search(low) else WORD).findall(low)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, Counter] = defaultdict(Counter)

    def drain() -> Iterator[pd.DataFrame]:
        for lang, c in counts.items():
            words = list(c)
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                yield pd.DataFrame({"lang": lang, "word": some, "n": [c[w] for w in some]})
        counts.clear()

    for pdf in batches:
        for text, lang in zip(pdf["text"], pdf["lang"]):
            counts[lang].update(words_of(text))
        if sum(map(len, counts.values())) > HELD_WORDS:
            yield from drain()
    yield from drain()


def word_counts(labelled: DataFrame) -> DataFrame:
    """``lang, word, n`` over all rows of ``labelled`` (``text``, ``lang``)."""
    small_batches(labelled.sparkSession)
    known = labelled.select("text", "lang").where("text is not null and lang is not null")
    return known.mapInPandas(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def grams(word: str, order: int) -> list[str]:
    padded = f" {word} " if order > 1 else word
    return [padded[i : i + order] for i in range(max(1, len(padded) - order + 1))]


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[tuple[str, int], Counter] = defaultdict(Counter)

    def drain() -> Iterator[pd.DataFrame]:
        for (lang, order), of in held.items():
            yield pd.DataFrame({"lang": lang, "order": order, "gram": list(of), "n": list(of.values())})
        held.clear()

    for pdf in batches:
        for lang, rows in pdf.groupby("lang"):
            once = rows.loc[rows["n"] == 1, "word"].tolist()
            often = [(w, n) for w, n in zip(rows["word"], rows["n"].tolist()) if n > 1]
            for order in ORDERS:
                of = held[lang, order]
                of.update([g for w in once for g in grams(w, order)])
                for word, n in often:
                    for g in grams(word, order):
                        of[g] += n
        if sum(map(len, held.values())) > HELD_WORDS:
            yield from drain()
    yield from drain()


def gram_counts(words: DataFrame) -> DataFrame:
    """``lang, order, gram, n`` over all of ``words`` (``lang, word, n``)."""
    return words.mapInPandas(_count_grams, "lang string, order int, gram string, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, by: list[str], key: str, room: int) -> DataFrame:
    """The ``room`` entries of each group with the largest ``n``; ties by part of the hash, then by ``key``.

    Two histograms tell where to cut; only the entries of one count and one part are ranked.
    """
    spark = counts.sparkSession
    step, part = F.floor(F.log2("n") * 8).cast("int"), F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
    kinds = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in by)

    def cut(rows: list, of: int) -> dict[tuple, tuple]:
        """For each group the last step that is needed, and how many entries come before it."""
        groups: dict[tuple, list] = defaultdict(list)
        for r in rows:
            groups[tuple(r)[: len(by)]].append(tuple(r)[len(by) :])
        out = {}
        for g, x in groups.items():
            held = 0
            for at in sorted(x, key=lambda y: [-y[0], *y[1:-1]]):  # largest count first, then smallest part
                out[g] = (at[:of], held)
                held += at[of]
                if held >= room - before.get(g, 0):
                    break
        return out

    before: dict[tuple, int] = {}
    first = cut(counts.groupBy(*by, step.alias("step")).count().collect(), 1)  # a few hundred rows a group
    if not first:
        return counts.limit(0)
    before = {g: held for g, (_, held) in first.items()}
    low = F.broadcast(spark.createDataFrame([(*g, at[0]) for g, (at, _) in first.items()], f"{kinds}, __vs_step int"))
    last = counts.join(low, by).where(step == F.col("__vs_step"))
    second = cut(last.groupBy(*by, "n", part.alias("part")).count().collect(), 2)  # at most PARTS rows a count of the step
    edge = [(*g, first[g][0][0], n, p, room - before[g] - held) for g, ((n, p), held) in second.items()]
    edges = F.broadcast(spark.createDataFrame(edge, f"{kinds}, __vs_step int, __vs_n long, __vs_part int, __vs_left long"))
    near = counts.join(edges, by).withColumns({"__vs_s": step, "__vs_p": part})
    whole = near.where("__vs_s > __vs_step or __vs_s = __vs_step and (n > __vs_n or n = __vs_n and __vs_p < __vs_part)")
    ranked = near.where("n = __vs_n and __vs_p = __vs_part").withColumn("__vs_rank", F.row_number().over(Window.partitionBy(*by).orderBy(key)))
    return whole.select(*counts.columns).union(ranked.where("__vs_rank <= __vs_left").select(*counts.columns))


@dataclass
class LanguageModel:
    """Log frequencies: a row for each known word or n-gram, a column for each language."""

    langs: list[str]
    words: dict[str, int]
    gram_rows: list[dict[str, int]]
    table: np.ndarray

    @staticmethod
    def of(langs: list[str], held: list[tuple[list[str], np.ndarray]]) -> "LanguageModel":
        """From the words and from the n-grams of each length, with their counts in each language."""
        names, parts, at = [], [], 0
        for keys, count in held:
            names.append({k: at + i for i, k in enumerate(keys)})
            at += len(keys)
            parts.append(np.log((count + 0.5) / (count.sum(axis=0) + 0.5 * len(keys))) if keys else count)
        return LanguageModel(langs, names[0], names[1:], np.concatenate(parts))

    def evidence(self, text: str) -> tuple[np.ndarray | None, int]:
        """Sum of the log frequencies of a text's words in each language, and their number."""
        words = words_of(text)
        if not words or not self.langs:
            return None, 0
        known, rows, weights = self.words, [], []
        found = [known.get(w, -1) for w in words]
        for w in [w for w, f in zip(words, found) if f < 0]:
            for table_of, order in zip(self.gram_rows, ORDERS):
                if some := [r for r in map(table_of.get, grams(w, order)) if r is not None]:
                    rows += some
                    weights += [1 / len(some)] * len(some)
                    break
        seen = np.array(found)
        total = self.table[seen[seen >= 0]].sum(axis=0)
        if rows:
            total = total + np.array(weights) @ self.table[rows]
        return total, len(words)

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n = self.evidence(text) if text else (None, 0)
        if total is None:
            return UNKNOWN, 0.0
        total = total * min(1, SCORED_WORDS / n)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def _held(counts: DataFrame, by: list[str], key: str, room: int, langs: list[str]) -> dict[int, tuple[list[str], np.ndarray]]:
    """What is most frequent in one of the languages, by length, with its counts in all; the driver receives this only."""
    rest = [c for c in by if c != "lang"]
    kept = most_frequent(counts, by, key, room).select(*rest, key).distinct()
    of = counts.join(kept.hint("merge"), [*rest, key]).groupBy(*rest, key)
    rows = of.agg(*[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)]).toArrow()
    order = rows.column("order").to_numpy() if rest else np.zeros(len(rows), int)
    keys, count = rows.column(key).to_pylist(), np.stack([rows.column(f"n{i}").to_numpy() for i in range(len(langs))], axis=1).astype(float) if langs else np.zeros((0, 0))
    return {int(o): ([keys[i] for i in np.flatnonzero(order == o)], count[order == o]) for o in (ORDERS if rest else [0])}


def fit(labelled: DataFrame) -> LanguageModel:
    """Learn from all rows of ``labelled``."""
    words = materialize(word_counts(labelled), "lang-words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    if not langs:
        return LanguageModel([], {}, [{} for _ in ORDERS], np.zeros((0, 0)))
    parts = _held(materialize(gram_counts(words), "lang-grams"), ["lang", "order"], "gram", MODEL_GRAMS, langs)
    return LanguageModel.of(langs, [_held(words, ["lang"], "word", MODEL_WORDS, langs)[0], *(parts[order] for order in ORDERS)])


def predictions(docs: DataFrame, model: LanguageModel) -> Column:
    """A column ``struct<lang, score>`` for ``docs["text"]``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in text], columns=["lang", "score"])

    return F.pandas_udf(run, "lang string, score double", F.PandasUDFType.SCALAR)(docs["text"])


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and predict all rows."""
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    said = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictions(docs, model).alias("said"))
    return said.select("doc_id", "held_out", F.col("said.lang").alias("lang_pred"), F.col("said.score").alias("score"))


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Drop the documents without a language: no letters, or no language with ``min_score``."""
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    said = docs.withColumn("__vs_said", predictions(docs, model))
    return said.where((F.col("__vs_said.lang") != UNKNOWN) & (F.col("__vs_said.score") >= min_score)).select(*docs.columns)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
