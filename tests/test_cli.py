"""The command line from pages to an answer and its evaluation."""

import argparse
import json

import pytest

from vellumspark import cli
from vellumspark.operators import models
from vellumspark.schemas import PAGE
from vellumspark.sources.writers import read_points


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Stored pages, documents, chunks and index of two acts and a plain text."""
    root = tmp_path_factory.mktemp("cli")
    at = lambda name: f"file://{root}/{name}"
    body = "palavra comum de enchimento " * 6
    pages = [
        ("2020/ren20201001", 1, f"PORTARIA Nº 77\n\nDispõe sobre tarifas.\n\nProcesso nº: 48500.001234/2020-12\nArt. 1º tarifa social {body}"),
        ("2020/ren20201001", 2, f"Art. 2º bandeira amarela {body}"),
        ("2021/dsp2021555", 1, f"texto sobre geradores {body}"),
    ]
    spark.createDataFrame(pages, "doc_id string, page int, text string").write.parquet(at("pages"))
    cli.main(["parse", "--pages", at("pages"), "--out", at("docs"), "--agency", "AGX", "--base-url", "https://x/"])
    cli.main(["chunk", "--docs", at("docs"), "--out", at("chunks"), "--agency", "AGX", "--base-url", "https://x/", "--summary-out", at("summary")])
    cli.main(["index", "--chunks", at("chunks"), "--out", at("index")])
    return at, root


def said(capsys, *argv):
    capsys.readouterr()
    cli.main(list(argv))
    return capsys.readouterr().out


def test_parsed_documents_are_whole(spark, made):
    at, _ = made
    got = {r.doc_id: r for r in spark.read.parquet(at("docs")).collect()}
    r = got["2020/ren20201001"]
    assert (r.tipo_ato, r.year, r.filename, r.title, r.ementa, r.processo, r.n_pages) == ("ren", 2020, "ren20201001.pdf", "PORTARIA Nº 77", "Dispõe sobre tarifas.", "48500.001234/2020-12", 2)
    assert r.n_chars == len(r.text) and [n.label for n in r.structure] == ["Art. 1º", "Art. 2º"] and r.tables == [] and r.pdf_creator == ""
    chunk = spark.read.parquet(at("chunks")).where("chunk_id like '%art2%'").head()
    assert (chunk.tipo_ato, chunk.year, chunk.title, chunk.url) == ("ren", 2020, "PORTARIA Nº 77", "https://x/ren20201001.pdf")
    assert json.loads(spark.read.text(at("summary")).head()[0]) == {"n_chunks": 3, "tiers": {"A": 2, "C": 1}}


def test_resume_limit_and_stems(spark, made, capsys):
    at, _ = made
    out = at("again")
    assert json.loads(said(capsys, "parse", "--pages", at("pages"), "--out", out, "--limit", "1"))["n_docs"] == 1
    assert json.loads(said(capsys, "parse", "--pages", at("pages"), "--out", out, "--resume"))["n_docs"] == 1
    assert json.loads(said(capsys, "parse", "--pages", at("pages"), "--out", out, "--resume"))["n_docs"] == 0
    assert spark.read.parquet(out).count() == 2
    assert json.loads(said(capsys, "parse", "--pages", at("pages"), "--out", at("some"), "--stems", "dsp2021555,none"))["n_docs"] == 1


def test_retrieve_with_filters_and_generate(made, capsys):
    at, _ = made
    common = ["--chunks", at("chunks"), "--index", at("index")]
    first = json.loads(said(capsys, "retrieve", "--query", "bandeira amarela", "--json", "--top-k", "2", *common).splitlines()[0])
    assert first["id"] == "2020/ren20201001__art2_001" and first["rank"] == 1
    assert "dsp2021555__doc" in said(capsys, "retrieve", "--query", "bandeira amarela", "--tier", "C", "--no-rerank", *common)
    ids = [json.loads(x)["id"] for x in said(capsys, "retrieve", "--query", "enchimento", "--tipo-ato", "REN", "--year", "2020", "--json", *common).splitlines()]
    assert ids and all(i.startswith("2020/ren") for i in ids)
    assert said(capsys, "retrieve", "--query", "enchimento", "--year", "1999", "--json", *common) == ""
    got = json.loads(said(capsys, "generate", "--query", "tarifa social", "--json", *common))
    assert got["citations"][0]["chunk_id"] == "2020/ren20201001__art1_000" and got["citations"][0]["url"] == "https://x/ren20201001.pdf" and not got["not_found"]
    shown = said(capsys, "generate", "--query", "tarifa social", *common)
    assert "Fontes:" in shown and "https://x/ren20201001.pdf" in shown
    assert json.loads(said(capsys, "generate", "--query", "tarifa", "--year", "1999", "--json", *common))["not_found"]
    out = said(capsys, "smoke", "--queries", "tarifa social|geradores", "--chunks", at("chunks"))
    assert json.loads(out.splitlines()[0]) == {"points_count": 3} and len(out.splitlines()) == 7


def test_evaluation_writes_results(spark, made, capsys):
    at, root = made
    rows = [
        {"id": "q1", "tipo_query": "factual", "pergunta": "geradores", "docs_relevantes": ["2021/dsp2021555__doc"], "tipo_ato_filtro": "DSP", "year_filtro": 2021},
        {"id": "q2", "tipo_query": "negative", "pergunta": "nada", "docs_relevantes": [], "tipo_ato_filtro": None, "year_filtro": 1999},
        {"id": "q3", "tipo_query": "conceptual", "pergunta": "bandeira amarela", "docs_relevantes": ["2020/ren20201001__art2_001"], "tipo_ato_filtro": "ren"},
    ]
    (root / "golden.jsonl").write_text("\n".join(map(json.dumps, rows)))
    out = json.loads(said(capsys, "evaluate", "--golden", at("golden.jsonl"), "--chunks", at("chunks"), "--index", at("index"), "--with-generation", "--out", at("eval")))
    assert out["all"]["hit_5"] == 1.0 and out["all"]["n"] == 2 and out["n_generated"] == 3 and out["not_found_rate_negative"] == 1.0
    assert out["n_llm_eval"] == 2 and out["faithfulness"] == 1.0 and out["p50_latency_ms"] >= 0 and set(out["by_type"]) == {"factual", "conceptual"}
    per = {r.qid: r for r in spark.read.json(at("eval/results")).collect()}
    assert per["q1"].retrieved_ids == ["2021/dsp2021555__doc"] and per["q2"].not_found and per["q3"].n_cited == 1
    assert json.loads(spark.read.json(at("eval/summary")).head().summary) == out


def test_models_are_called_and_retried(spark):
    class Flaky:
        def __init__(self):
            self.calls = 0

        def complete(self, system, prompt, max_tokens):
            self.calls += 1
            if "judge" in prompt:
                return '```json\n{"faithfulness": 1, "answer_relevance": 0}\n```' if self.calls % 2 else "no verdict"
            if self.calls < 3:
                raise OSError("busy")
            return f" {prompt}! ", {"input_tokens": 7, "output_tokens": max_tokens}

    rows = spark.createDataFrame([(1, "ask"), (2, None)], "qid int, prompt string").coalesce(1)
    got = {r.qid: r for r in models.generate(rows, Flaky, tries=3).collect()}
    assert got[1].answer == "ask!" and got[1].output_tokens == 1024 and got[2].answer == models.NO_ANSWER
    assert models.generate(rows.where("qid = 1"), Flaky, tries=2).head().answer is None
    asked = spark.createDataFrame([(i, "judge", ["c"] * 9, f"a{i}") for i in range(2)], "qid int, question string, contexts array<string>, answer string").coalesce(1)
    assert [(r.answer, r.faithfulness, r.relevance) for r in models.judge(asked, Flaky).orderBy("qid").collect()] == [("a0", 1, 0), ("a1", -1, -1)]


def test_upsert_and_snapshot(spark, made, capsys):
    at, _ = made
    assert json.loads(said(capsys, "upsert", "--chunks", at("chunks"), "--out", at("points"))) == {"points_count": 3, "status": "green"}
    assert json.loads(said(capsys, "upsert", "--chunks", at("chunks"), "--out", at("points"))) == {"points_count": 3, "status": "green"}
    n = json.loads(said(capsys, "snapshot", "--source", at("points"), "--target", at("kept")))["files"]
    assert n > 0 and json.loads(said(capsys, "snapshot", "--source", at("points"), "--target", at("kept")))["files"] == 0
    assert json.loads(said(capsys, "restore", "--source", at("kept"), "--target", at("back")))["files"] == n
    assert sorted(read_points(spark, at("back")).collect()) == sorted(read_points(spark, at("points")).collect())


class Letters:
    """Embedder and reranker by letters."""

    def encode(self, texts, return_dense=True, return_sparse=True):
        counts = [[float(t.lower().count(c)) for c in "abcdeg"] for t in texts]
        return {"dense_vecs": counts, "lexical_weights": [{k: v for k, v in enumerate(x) if v} for x in counts]}

    def compute_score(self, pairs, normalize=True):
        return [1 / (1 + abs(len(q) - len(t) % 50)) for q, t in pairs]


def test_models_by_name(spark, made, capsys):
    """Vectors of a model are stored by ``index``, questions are embedded by it, and its reranker's scores are shown."""
    at, _ = made
    name = f"{__name__}:Letters"
    out = json.loads(said(capsys, "index", "--chunks", at("chunks"), "--out", at("index2"), "--vectors-out", at("vectors"), "--embedder", name))
    assert (out["n_chunks"], out["points_count"], out["status"]) == (3, 3, "green")
    stored = {r.chunk_id: r for r in read_points(spark, at("vectors")).collect()}
    chunks = {r.chunk_id: r.text for r in spark.read.parquet(at("chunks")).collect()}
    for i, text in chunks.items():
        want = Letters().encode([text])
        assert stored[i].dense == want["dense_vecs"][0] and stored[i].sparse == want["lexical_weights"][0]
    common = ["--query", "bandeira amarela", "--chunks", at("chunks"), "--index", at("index2"), "--vectors", at("vectors")]
    hits = [json.loads(x) for x in said(capsys, "retrieve", *common, "--embedder", name, "--reranker", name, "--json").splitlines()]
    want = sorted(((round(Letters().compute_score([("bandeira amarela", t)])[0], 6), i) for i, t in chunks.items()), key=lambda x: -x[0])
    assert [h["score"] for h in hits] == [s for s, _ in want] and {h["id"] for h in hits} == set(chunks)
    with pytest.raises(ValueError, match="6 values"):
        cli.main(["retrieve", *common])
    assert "points_count" in said(capsys, "smoke", "--queries", "tarifa|geradores", "--chunks", at("chunks"), "--vectors", at("vectors"), "--embedder", name)


def test_snapshots_copy_what_differs_and_tell_damage(spark, tmp_path):
    from vellumspark.sources import files

    source, kept = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    spark.range(100).repartition(5).write.parquet(source)
    n = files.snapshot(spark, source, kept)
    assert n >= 6 and files.snapshot(spark, source, kept) == 0
    spark.range(100, 110).coalesce(1).write.mode("append").parquet(source)
    assert 1 <= files.snapshot(spark, source, kept) <= 3
    gone = next(f for f in (tmp_path / "a").glob("*.parquet"))
    gone.unlink()
    files.snapshot(spark, source, kept)
    assert not (tmp_path / "b" / gone.name).exists()
    files.restore(spark, kept, f"file://{tmp_path}/c")
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/c").collect()) == sorted(r.id for r in spark.read.parquet(source).collect())
    bad = next(f for f in (tmp_path / "b").glob("*.parquet"))
    bad.write_bytes(bad.read_bytes()[:-9] + b"damaged!!")
    with pytest.raises(ValueError, match=bad.name):
        files.restore(spark, kept, f"file://{tmp_path}/d")
    assert not (tmp_path / "d" / bad.name).exists()


def test_golden_questions(spark, tmp_path, capsys):
    rows = [(f"c{i:03d}", f"d{i // 2}", ("ren", "dsp", "prt")[i % 3], 2000 + i % 5, "C", "doc", "", f"title {i}", f"text {i} " + "word " * 80) for i in range(90)]
    at = lambda name: f"file://{tmp_path}/{name}"
    spark.createDataFrame(rows, "chunk_id string, doc_id string, tipo_ato string, year int, tier string, section_type string, section_label string, title string, text string").write.parquet(at("chunks"))
    out = json.loads(said(capsys, "golden", "--chunks", at("chunks"), "--out", at("golden"), "--raw-out", at("raw"), "--limit", "2", "--oversample", "1.5"))
    assert out == {"n": 10, "by_type": {k: 2 for k in ("comparative", "conceptual", "factual", "multi_hop", "negative")}}
    public = spark.read.json(at("golden"))
    assert "_chunk_text_ref" not in public.columns and "_chunk_text_ref" in spark.read.json(at("raw")).columns
    assert all(r.pergunta.startswith("O que diz") and r.resposta_esperada.startswith("text") for r in public.collect())


def test_download_tasks_and_outcomes(spark, tmp_path, capsys):
    pdf = lambda url, name, kind="Texto": {"url": url, "arquivo": name, "tipo": kind}
    one = {"2020-01-01": {"registros": [{"titulo": "REN 1", "pdfs": [pdf("http://x/a.pdf", "a.pdf"), pdf("https://x/b.html", "b"), pdf("https://x/gone.pdf", "g.pdf"), pdf("https://x/fake.pdf", "f.pdf"), pdf("https://x/busy.pdf", "busy.pdf")]}]}}
    (tmp_path / "a_2020_metadados.json").write_text(json.dumps(one))
    at = lambda name: f"file://{tmp_path}/{name}"
    assert json.loads(said(capsys, "download", "--metadata", at("*_metadados.json"), "--out", at("out"), "--max-downloads", "3")) == {"n_tasks": 3, "n_skipped": 1}

    def get(url):
        if "gone" in url:
            return 404, b""
        if "busy" in url:
            raise TimeoutError
        return 200, b"<html>" if "fake" in url else b"%PDF-1.4 " + url.encode()

    capsys.readouterr()
    cli.download(spark, argparse.Namespace(metadata=at("*_metadados.json"), out=at("out"), only_year=None, only_kind=None, sample=None, max_downloads=None), get)
    out = json.loads(capsys.readouterr().out)
    assert (out["n_ok"], out["n_failed"], out["n_skipped"]) == (1, 3, 1)
    assert (tmp_path / "out/files/2020/a.pdf").read_bytes() == b"%PDF-1.4 https://x/a.pdf"
    failed = {r.url: (r.error, r.attempts) for r in spark.read.json(at("out/failures")).collect()}
    assert failed == {"https://x/gone.pdf": ("http_404", 1), "https://x/fake.pdf": ("not_pdf", 1), "https://x/busy.pdf": ("TimeoutError", 3)}


def test_analysis_report(spark, tmp_path, capsys):
    block = lambda x, text, kind=0: (float(x), 1.0, x + 2.0, 3.0, text, kind)
    wide = [block(1, "a"), block(2, "b"), block(80, "c"), block(90, "d")]
    pages = [("2020/ren20201", 1, 100.0, wide, []), ("2020/ren20201", 2, 100.0, [block(1, "x" * 300)], []), ("2020/ren20202", 1, 100.0, [block(1, "s"), block(1, "", 1)], []), ("2021/dsp20213", 1, 100.0, [block(1, "y" * 200)], [])]
    at = lambda name: f"file://{tmp_path}/{name}"
    spark.createDataFrame(pages, PAGE).write.parquet(at("pages"))
    out = json.loads(said(capsys, "analyze", "--pages", at("pages"), "--report", at("report")))
    assert (out["n"], out["n_ok"], out["n_ocr_suspect"], out["n_multi_col"], out["n_error"]) == (3, 3, 1, 1, 0)
    assert list(out["tipos_ato"]) == ["ren", "dsp"] and out["tipos_ato"]["ren"]["pages_max"] == 2
    assert [s["file"] for s in out["tipos_ato"]["ren"]["samples"]] == ["ren20201.pdf", "ren20202.pdf"]
    assert json.loads(spark.read.text(at("report/summary")).head()[0]) == out and spark.read.json(at("report/per_pdf")).count() == 3
