from pyspark.sql import functions as F

from vellumspark.operators import golden, sampling


def test_question_set(spark):
    rows = []
    for i in range(400):
        kind, tier = ("ren", "dsp", "prt", "xxx")[i % 4], "C" if i % 3 else "B"
        rows.append((f"c{i:03d}", f"d{i // 2}", kind, 2000 + i % 5, tier, "doc", "", f"title {i}", f"text {i} " + "word " * 80))
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, tipo_ato string, year int, tier string, section_type string, section_label string, title string, text string")
    target = {"factual": 6, "conceptual": 4, "comparative": 3, "multi_hop": 3, "negative": 2}
    samples = golden.sampled(chunks, target)
    sizes = {r.tipo_query: r["count"] for r in samples.groupBy("tipo_query").count().collect()}
    assert sizes == {k: 2 * n for k, n in target.items()}

    def ask(p):
        said = F.to_json(F.struct(F.md5(p).alias("pergunta"), F.substring(p, 1, 20).alias("resposta_esperada")))
        return F.when(F.contains(p, F.lit("objetiva")), F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(said)

    got = golden.golden_set(samples, ask, target).collect()
    count = {}
    for r in got:
        count[r.tipo_query] = count.get(r.tipo_query, 0) + 1
        assert r.id.startswith("gs_") and len(r.docs_relevantes) == {"negative": 0, "comparative": 2, "multi_hop": 2}.get(r.tipo_query, 1)
        assert (r.year_filtro is None) == (r.tipo_query not in ("factual", "conceptual")) and (r.tipo_ato_filtro is None) == (r.tipo_query in ("multi_hop", "negative"))
    assert count == target and len({r.id for r in got}) == len(got)
    assert "xxx" not in {r.tipo_ato_filtro for r in got}
    clean = sampling.public_columns(golden.golden_set(samples, ask, target))
    assert "_chunk_text_ref" not in clean.columns
    assert golden.golden_set(samples, lambda p: F.lit("no answer"), target).count() == 0
