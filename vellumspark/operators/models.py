"""Model adapters: embedder, reranker, generator and judge, with plain stand-ins.

A model is anything with the method named here; it runs in Arrow batches on executors.  The
stand-ins are column expressions, so results do not depend on any model file.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, MapType, StructField, StructType

from ..functions.text import json_answer, word_tokens
from ..profiles import NO_ANSWER
from ..sources.scratch import ship_package


class Embedder(Protocol):
    def encode(self, texts: list[str], return_dense: bool = True, return_sparse: bool = True) -> dict: ...


class Reranker(Protocol):
    def compute_score(self, pairs: list[tuple[str, str]], normalize: bool = True) -> list[float] | float: ...


class Generator(Protocol):
    """Answers a prompt under fixed instructions; may tell its use (``input_tokens``, ``output_tokens``, ``cache_read_tokens``)."""

    def complete(self, system: str, prompt: str, max_tokens: int) -> str | tuple[str, dict[str, int]]: ...


class Named:
    """Loads a model where it runs: ``package.module:name`` is what makes one."""

    def __init__(self, name: str):
        self.module, _, self.name = name.partition(":")
        if not self.name:
            raise ValueError(f"not module:name: {name!r}")

    def __call__(self):
        return getattr(importlib.import_module(self.module), self.name)()


def embed(rows: DataFrame, text: str, load: Callable[[], Embedder], batch: int = 32) -> DataFrame:
    """Adds ``dense`` and ``sparse`` from one pass of the model; ``load`` runs once in each task."""
    schema = StructType([*rows.schema.fields, StructField("dense", ArrayType(FloatType())), StructField("sparse", MapType(IntegerType(), FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            dense, sparse = [], []
            for at in range(0, len(pdf), batch):
                out = model.encode(pdf[text].iloc[at : at + batch].fillna("").tolist(), return_dense=True, return_sparse=True)
                dense += [list(map(float, v)) for v in out["dense_vecs"]]
                sparse += [{int(k): float(w) for k, w in x.items()} for x in out["lexical_weights"]]
            yield pdf.assign(dense=dense, sparse=sparse)

    ship_package(rows.sparkSession)
    return rows.mapInPandas(run, schema)


def rerank_scores(query: Column, text: Column, load: Callable[[], Reranker], batch: int = 16) -> Column:
    """Normalised scores of pairs; a single pair's bare number is accepted."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in parts:
            out: list[float] = []
            for at in range(0, len(q), batch):
                got = model.compute_score(list(zip(q[at : at + batch], t[at : at + batch])), normalize=True)
                out += [got] if isinstance(got, (int, float)) else list(got)
            yield pd.Series(out, dtype=float)

    ship_package(SparkSession.active())
    return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(query, text)


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Stand-in: counts of hashed words."""
    at = F.transform(word_tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(at, lambda a: a == i)).cast("float"))


def overlap_logit(query: Column, text: Column) -> Column:
    """Stand-in: the share of the query's words that the text has, from -4 to 4."""
    words = F.array_distinct(word_tokens(query))
    shared = F.size(F.array_intersect(words, word_tokens(text)))
    return F.when(F.size(words) > 0, 8.0 * shared / F.size(words) - 4.0).otherwise(F.lit(-4.0))


def extract_answer(context: Column, n_chunks: Column, chars: int = 160) -> Column:
    """Stand-in: the beginning of the first numbered text, cited; the fixed answer without any."""
    body = F.regexp_extract(context, r"(?s)─{60}\n(.*?)(?=\n\n\[\d+\] |\z)", 1)
    number = F.regexp_extract(context, r"^\[(\d+)\]", 1)
    return F.when(n_chunks > 0, F.concat(F.substring(F.replace(body, F.lit("\n"), F.lit(" ")), 1, chars), F.lit(" ["), number, F.lit("]"))).otherwise(F.lit(NO_ANSWER))


def judge_overlap(answer: Column, contexts: Column) -> Column:
    """Stand-in judge: 1 if half of the answer's words stand in the contexts, else 0; -1 without an answer."""
    words = F.array_distinct(word_tokens(answer))
    share = F.size(F.array_intersect(words, word_tokens(contexts))) / F.size(words)
    return F.when(F.size(words) > 0, (share >= 0.5).cast("int")).otherwise(F.lit(-1))


MAX_TOKENS, JUDGE_TOKENS, JUDGE_CONTEXTS, JUDGE_CHARS, TRIES = 1024, 64, 5, 3000, 3
SYSTEM = "Responda somente com base nos trechos numerados e cite cada afirmação com o número do trecho entre colchetes, como [1]. Se os trechos não bastarem, diga: " + NO_ANSWER
JUDGE_SYSTEM = "Avalie a resposta. Devolva somente JSON, sem mais texto."
ANSWERED = "answer string, input_tokens int, output_tokens int, cache_read_tokens int, latency_ms int"


def question_prompt(context: Column, question: Column) -> Column:
    """The numbered texts, a rule and the question."""
    return F.concat(F.lit("Trechos:\n\n"), context, F.lit("\n\n" + "═" * 60 + "\n\nPergunta: "), question)


def judge_prompt(question: Column, contexts: Column, answer: Column) -> Column:
    """The first contexts, cut, with the answer and the two questions to the judge."""
    held = F.substring(F.array_join(F.slice(contexts, 1, JUDGE_CONTEXTS), "\n---\n"), 1, JUDGE_CHARS)
    asked = '\n\nfaithfulness: 1 se a resposta usa apenas os contextos, senão 0.\nanswer_relevance: 1 se a resposta responde à pergunta, senão 0.\nJSON: {"faithfulness": 0 ou 1, "answer_relevance": 0 ou 1}'
    return F.concat(F.lit("Pergunta: "), question, F.lit("\n\nContextos:\n"), held, F.lit("\n\nResposta:\n"), answer, F.lit(asked))


def _call(model: Generator, system: str, prompt: str, tokens: int, tries: int) -> tuple[str | None, dict[str, int], int]:
    """Answer, use and milliseconds; no answer if every try fails."""
    began = time.monotonic()
    for _ in range(tries):
        try:
            got = model.complete(system, prompt, tokens)
        except Exception:  # a model's failure is retried, then an outcome
            continue
        text, use = got if isinstance(got, tuple) else (got, {})
        return text.strip(), use, round(1000 * (time.monotonic() - began))
    return None, {}, round(1000 * (time.monotonic() - began))


def generate(rows: DataFrame, load: Callable[[], Generator], system: str = SYSTEM, max_tokens: int = MAX_TOKENS, tries: int = 1) -> DataFrame:
    """``rows`` with the model's answer to ``prompt``, its use of tokens and time; the fixed answer where the prompt is null.

    ``load`` runs once in each task.  An answer that fails ``tries`` times is null.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), ANSWERED])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            got = [_call(model, system, p, max_tokens, tries) if p is not None else (NO_ANSWER, {}, 0) for p in pdf["prompt"]]
            use = {k: [int(u.get(k, 0)) for _, u, _ in got] for k in ("input_tokens", "output_tokens", "cache_read_tokens")}
            yield pdf.assign(answer=[a for a, _, _ in got], **use, latency_ms=[ms for _, _, ms in got])

    ship_package(rows.sparkSession)
    return rows.mapInPandas(run, schema)


def judge(rows: DataFrame, load: Callable[[], Generator]) -> DataFrame:
    """``rows`` (``question, contexts, answer``) with ``faithfulness`` and ``relevance``: 1, 0, or -1 where the judge fails."""
    asked = generate(rows.withColumnRenamed("answer", "__answer").withColumn("prompt", judge_prompt(F.col("question"), F.col("contexts"), F.col("__answer"))), load, JUDGE_SYSTEM, JUDGE_TOKENS)
    said = json_answer(F.coalesce("answer", F.lit("")), "faithfulness string, answer_relevance string")
    yes = lambda c: F.when(said.isNull(), -1).otherwise(F.coalesce(~c.isin("0", "false", "", "null", "0.0"), F.lit(False)).cast("int"))
    judged = asked.withColumns({"faithfulness": yes(said["faithfulness"]), "relevance": yes(said["answer_relevance"])})
    return judged.select(*[F.col("__answer").alias(c) if c == "answer" else c for c in rows.columns], "faithfulness", "relevance")


class Extractive:
    """Stand-in generator: the beginning of the first numbered text, cited."""

    def complete(self, system: str, prompt: str, max_tokens: int) -> tuple[str, dict[str, int]]:
        import re

        found = re.search(r"\[(\d+)\] [^\n]*\nURL: [^\n]*\n─{60}\n(.*?)(?=\n\n\[\d+\] |\n\n═{60}|\Z)", prompt, re.S)
        answer = f"{found[2][:160]} [{found[1]}]".replace("\n", " ") if found else NO_ANSWER
        return answer, {"input_tokens": len(prompt) // 4, "output_tokens": min(max_tokens, len(answer) // 4)}
