"""Question sets: prompts from sampled chunks, a generator's answers, records and targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import json_answer, label_line
from . import models, sampling

ANSWER = "pergunta string, resposta_esperada string"
TITLE_CHARS, TEXT_CHARS = 80, 2000

#: What each kind of question asks for; templates are the caller's to replace.
TASKS = {
    "factual": "Escreva uma pergunta objetiva que este trecho responde por completo, e a resposta.",
    "conceptual": "Escreva uma pergunta sobre um conceito que este trecho explica, e a resposta.",
    "comparative": "Escreva uma pergunta que compara os dois trechos, e a resposta.",
    "multi_hop": "Escreva uma pergunta que só os dois trechos juntos respondem, e a resposta.",
    "negative": "Escreva uma pergunta próxima deste trecho que ele não responde; a resposta é que não consta.",
}
FORM = 'Responda em JSON: {"pergunta": "...", "resposta_esperada": "..."}'


def described(chunk: Column, label: Callable[[Column, Column, Column, Column], Column] = label_line) -> Column:
    """Metadata line (title cut) and text (cut) of a chunk struct; ``label`` puts kind, year, title and section together."""
    section = F.coalesce(F.nullif(chunk["section_label"], F.lit("")), chunk["section_type"])
    return F.concat(label(chunk["tipo_ato"], chunk["year"], F.substring(chunk["title"], 1, TITLE_CHARS), section), F.lit("\n"), F.substring(chunk["text"], 1, TEXT_CHARS))


def prompt(kind: str, *chunks: Column, tasks: dict[str, str] = TASKS) -> Column:
    return F.concat_ws("\n\n", F.lit(tasks[kind]), *[described(c) for c in chunks], F.lit(FORM))


def sampled(chunks: DataFrame, target: dict[str, int] | None = None, oversample: float = 2, seed: int = sampling.SEED) -> DataFrame:
    """``tipo_query, chunks`` (an array of chunk structs), ``oversample`` times the target of each kind."""
    target = sampling.TARGET if target is None else target
    good = sampling.good_chunks(chunks)
    whole = F.struct(*chunks.columns)
    parts = []
    for shift, kind in enumerate(("factual", "conceptual")):
        one = sampling.round_robin(good, ["tipo_ato", "year"], "chunk_id", round(target[kind] * oversample), seed + shift)
        parts.append(one.select(F.lit(kind).alias("tipo_query"), F.array(whole).alias("chunks")))
    by_id = chunks.select(F.col("chunk_id").alias("id"), whole.alias("c"))
    for kind, same in (("comparative", True), ("multi_hop", False)):
        pairs = sampling.pairs(good, "chunk_id", "doc_id", "tipo_ato", "year", round(target[kind] * oversample), same, seed)
        both = pairs.select(F.col("a.chunk_id").alias("ia"), F.col("b.chunk_id").alias("ib"))
        found = both.join(by_id.alias("x"), F.col("x.id") == F.col("ia")).join(by_id.alias("y"), F.col("y.id") == F.col("ib"))
        parts.append(found.select(F.lit(kind).alias("tipo_query"), F.array(F.col("x.c"), F.col("y.c")).alias("chunks")))
    none = sampling.negatives(chunks, "chunk_id", round(target["negative"] * oversample), seed)
    parts.append(none.select(F.lit("negative").alias("tipo_query"), F.array(whole).alias("chunks")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def golden_set(samples: DataFrame, ask: Callable[[Column], Column], target: dict[str, int] | None = None, tasks: dict[str, str] = TASKS) -> DataFrame:
    """Questions from samples: ``ask`` maps a prompt column to the generator's raw answers."""
    return _records(samples.withColumn("__raw", ask(prompts(tasks))), target)


def asked(samples: DataFrame, load: Callable[[], models.Generator], target: dict[str, int] | None = None, tasks: dict[str, str] = TASKS, tries: int = models.TRIES) -> DataFrame:
    """Questions from samples by a model; an answer that isn't JSON counts as a failed try."""

    class Strict:
        def __init__(self):
            self.model = load()

        def complete(self, system: str, prompt: str, max_tokens: int):
            got = self.model.complete(system, prompt, max_tokens)
            text = got[0] if isinstance(got, tuple) else got
            if "{" not in text or "}" not in text:
                raise ValueError("no JSON")
            return got

    said = models.generate(samples.withColumn("prompt", prompts(tasks)), Strict, FORM, models.MAX_TOKENS, tries)
    return _records(said.withColumnRenamed("answer", "__raw"), target)


class Quoting:
    """Stand-in: asks for what the first text says, and answers with its beginning."""

    def complete(self, system: str, prompt: str, max_tokens: int) -> str:
        import json

        text = prompt.split("\n\n")[1]
        label, _, body = text.partition("\n")
        return json.dumps({"pergunta": f"O que diz {label}?", "resposta_esperada": body[:200]}, ensure_ascii=False)


def prompts(tasks: dict[str, str] = TASKS) -> Column:
    """The prompt of each sample (``tipo_query, chunks``)."""
    one, two = F.get("chunks", F.lit(0)), F.get("chunks", F.lit(1))
    return F.coalesce(*[F.when(F.col("tipo_query") == k, F.when(F.size("chunks") > 1, prompt(k, one, two, tasks=tasks)).otherwise(prompt(k, one, tasks=tasks))) for k in tasks])


def _records(answered: DataFrame, target: dict[str, int] | None) -> DataFrame:
    """Records of the answers that hold JSON.

    Ids are given before the target trims each kind, so they may have gaps.  Factual and
    conceptual questions keep type and year as filters, comparative ones the type; negative ones
    have no relevant chunks.
    """
    ids = F.transform("chunks", lambda c: c["chunk_id"])
    answered = answered.select("tipo_query", "chunks", json_answer(F.coalesce("__raw", F.lit("")), ANSWER).alias("answer")).where("answer is not null")
    # a bounded set: as many rows as the targets ask for, numbered in one order
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tipo_query", sampling.shuffled(F.array_join(ids, "|"))))
    first, kind = F.get("chunks", F.lit(0)), F.col("tipo_query")
    rows = answered.select(
        number.alias("ord"),
        "answer.pergunta",
        kind,
        "answer.resposta_esperada",
        F.when(kind == "negative", F.array().cast("array<string>")).otherwise(ids).alias("docs_relevantes"),
        F.when(kind.isin("factual", "conceptual", "comparative"), first["tipo_ato"]).alias("tipo_ato_filtro"),
        F.when(kind.isin("factual", "conceptual"), first["year"]).alias("year_filtro"),
        F.transform("chunks", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text"))).alias("_chunk_text_ref"),
    )
    return sampling.trim(rows, target).select(sampling.question_id(F.col("ord")).alias("id"), "*").drop("ord")
