"""Sources, sinks, resumption and streaming on files made here."""

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from vellumspark.operators import corpus
from vellumspark.sources import readers, writers
from vellumspark.streaming.resume import ingest


def test_metadata_files(spark, tmp_path):
    pdf = lambda url, name="f.pdf", kind="Texto": {"url": url, "arquivo": name, "tipo": kind}
    one = {"2020-01-01": {"registros": [{"titulo": " REN 1 ", "pdfs": [pdf("http://x/a.pdf "), pdf("https://x/b.html"), pdf("")]}, {"titulo": None, "pdfs": None}]}, "bad": "no object", "2020-02-01": {"registros": [{"titulo": "PRT 2", "pdfs": [pdf("https://x/c.pdf", kind="Voto")]}]}}
    two = {"2021-01-01": {"registros": [{"titulo": "REN 3", "pdfs": [pdf("https://x/a.pdf", "other.pdf")]}]}}
    (tmp_path / "a_2020_metadados.json").write_text(json.dumps(one))
    (tmp_path / "b_2021_metadados.json").write_text(json.dumps(two))
    (tmp_path / "c_metadados.json").write_text(json.dumps(two))
    rows = readers.read_metadata(spark, f"file://{tmp_path}/*_metadados.json")
    assert [(r.ano, r.titulo, r.url) for r in rows.orderBy("ord").collect()] == [(2020, "REN 1", "http://x/a.pdf"), (2020, "REN 1", "https://x/b.html"), (2020, "PRT 2", "https://x/c.pdf"), (2021, "REN 3", "https://x/a.pdf")]
    tasks = {r.url: r for r in corpus.download_tasks(rows).collect()}
    assert set(tasks) == {"https://x/a.pdf", "https://x/c.pdf"}
    assert tasks["https://x/a.pdf"].ano_destino == 2020 and [f.titulo for f in tasks["https://x/a.pdf"].fontes] == ["REN 1", "REN 3"]
    assert tuple(corpus.skipped_urls(rows).head()) == (1, 4)
    assert corpus.download_tasks(rows, "Voto").count() == 1
    assert readers.read_metadata(spark, f"file://{tmp_path}/*_metadados.json", 2021).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_metadata(spark, f"file://{tmp_path}/none*.json")


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2\n{"a": 3}\n')
    rows, bad = readers.read_json_lines(spark, f"file://{path}", "a int", strict=False)
    assert sorted(r.a for r in rows.collect()) == [1, 3] and bad.count() == 1
    with pytest.raises(Exception):
        readers.read_json_lines(spark, f"file://{path}", "a int")[0].collect()
    path.write_text('{"a": 1}\n\n{"a": 3}\n')
    assert sorted(r.a for r in readers.read_json_lines(spark, f"file://{path}", "a int")[0].collect()) == [1, 3]


def test_page_files_and_extractor(spark, tmp_path):
    (tmp_path / "2021").mkdir()
    content = b"%PDF-1.4 " + b"x" * 20
    (tmp_path / "2021" / "ren20201.pdf").write_bytes(content)
    (tmp_path / "2021" / "voto.pdf").write_bytes(b"broken")
    (tmp_path / "2021" / "n.txt").write_bytes(b"")
    files = readers.read_page_files(spark, f"file://{tmp_path}")
    got = {r.doc_id: r for r in files.drop("content").collect()}
    assert set(got) == {"2021/ren20201", "2021/voto"}
    r = got["2021/ren20201"]
    assert (r.tipo_ato, r.year, r.size_bytes, r.sha256, r.is_pdf) == ("ren", 2020, 29, hashlib.sha256(content).hexdigest(), True)
    assert (got["2021/voto"].tipo_ato, got["2021/voto"].year, got["2021/voto"].is_pdf) == ("outros", 2021, False)

    def extract(raw):
        if not raw.startswith(b"%PDF-"):
            raise ValueError("no PDF")
        return [{"width": 100.0, "blocks": [{"x0": 0.0, "y0": 1.0, "x1": 2.0, "y1": 3.0, "text": raw[5:8].decode(), "type": 0}], "tables": [[["a", "b"]]]} for _ in range(4)]

    pages = readers.extract_pages(files, extract)
    assert pages.count() == 4 and readers.first_pages(pages).count() == 3 and pages.head().blocks[0].text == "1.4"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z")], "chunk_id string, version int, text string")
    once = writers.write_points(rows, f"file://{tmp_path}/points")
    assert {r.chunk_id: r.text for r in once.collect()} == {"a": "z", "b": "y"}
    first = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    more = spark.createDataFrame([("d2",), ("d3",)], "doc_id string")
    assert [writers.append_new(x, f"file://{tmp_path}/parsed", "doc_id") for x in (first, more, more)] == [2, 1, 0]
    outcome = spark.createDataFrame([("u", 200, "s"), ("v", 404, None), ("w", None, None)], "url string, http_status int, sha256 string")
    writers.write_outcomes(outcome, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/manifest").count() == 1 and spark.read.json(f"file://{tmp_path}/out/failures").count() == 2
    one = writers.run_summary(outcome, {"ok": F.col("http_status") == 200}, time.time() - 5).head()
    assert one.ok == 1 and 4.9 < one.duration_s < 60
    writers.write_evaluation(rows, rows.limit(1), f"file://{tmp_path}/eval")
    assert spark.read.json(f"file://{tmp_path}/eval/results").count() == 3
    hit = writers.rendered_hits(spark.createDataFrame([(1, 7, 0.5, "a\nb" + "x" * 300)], "rank int, id int, score double, text string")).head()
    assert hit.line.startswith(" 1. [0.5000] 7 | a bx") and len(json.loads(hit.json)["text"]) == 200


def test_completed_downloads(spark):
    t = lambda s: f"2024-01-01 00:00:{s:02d}"
    manifest = spark.createDataFrame([("u", "f1", t(1)), ("u", "gone", t(2)), ("v", "f2", t(1)), ("w", "f3", t(1))], "url string, local_path string, downloaded_at string")
    files = spark.createDataFrame([("f1", 5), ("f2", 5), ("f3", 0)], "path string, size int")
    assert [r.url for r in corpus.completed(manifest, files).collect()] == ["v"]


def test_streaming_reads_each_file_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.range(5).write.parquet(f"{root}/in/a")
    run = lambda: ingest(spark, f"{root}/in/*", "id long", f"{root}/out", f"{root}/check", lambda d: d.where("id <> 2"))
    assert [run(), run()] == [4, 4]
    spark.range(10, 12).write.parquet(f"{root}/in/b")
    assert run() == 6


def test_settings(tmp_path, monkeypatch):
    import os

    from vellumspark.sources.config import load_settings

    monkeypatch.setenv("VS_SET", "kept")
    monkeypatch.setenv("VS_EMPTY", "")
    monkeypatch.delenv("VS_NEW", raising=False)
    (tmp_path / ".env").write_text("# VS_NO=1\nVS_SET=x\nVS_EMPTY = 'full'\nVS_NEW=\"a=b\"\nbroken\n")
    assert load_settings(tmp_path / ".env") == {"VS_EMPTY": "full", "VS_NEW": "a=b"}
    assert os.environ["VS_SET"] == "kept" and load_settings(tmp_path / "none") == {}
    monkeypatch.delenv("VS_NEW")


def test_samples_and_errors(spark):
    rows = spark.createDataFrame([("ren", "b", None), ("ren", "a", "e1"), ("dsp", "z", "e2"), ("dsp", "y", None), ("xxx", "q", "e3")], "kind string, path string, error string")
    got = corpus.samples_of(rows, {"ren": "b", "dsp": "none"}, "kind", "path").collect()
    assert sorted((r.kind, r.path) for r in got) == [("dsp", "y"), ("ren", "b")]
    assert [r.error for r in corpus.first_errors(rows, "error", "path", 2).collect()] == ["e1", "e3"]


def test_pages_with_tables(spark):
    from vellumspark.operators.cleaning import page_with_tables
    from vellumspark.schemas import PAGE

    block = (0.0, 1.0, 2.0, 3.0, "body", 0)
    pages = [("d", 2, 100.0, [block], [[["1", "2"], ["3", "4"]], [["h", None], ["x", "y"]]]), ("e", 1, 100.0, [block], [])]
    got = {r.doc_id: r for r in page_with_tables(spark.createDataFrame(pages, PAGE)).collect()}
    assert got["d"].text == "body\n\n[[TABELA:p2t2]]\n" and got["e"].text == "body"
    assert [tuple(t) for t in got["d"].tables] == [("p2t2", 2, "| h |  |\n| --- | --- |\n| x | y |", 2, 2)]


def test_upsert_writes_what_a_batch_brings(spark, tmp_path, monkeypatch):
    from vellumspark.sources import segments

    path = f"file://{tmp_path}/points"
    row = lambda i, text: (f"c{i}", f"d{i // 10}", "rens"[i % 4], 2000 + i % 5, text, [float(i)] * 64, {i: 1.0})
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id string, doc_id string, tipo_ato string, year int, text string, dense array<float>, sparse map<int,float>").coalesce(2)
    body = lambda n: "".join(hashlib.sha256(f"{n}/{k}".encode()).hexdigest() for k in range(20))
    live = {i: row(i, body(i)) for i in range(3000)}
    writers.write_points(frame(list(live.values())), path)
    size = lambda: sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    before = size()
    batch = {i: row(i, "new " + body(i)) for i in range(0, 3000, 101)}
    live |= batch
    got = writers.write_points(frame(list(batch.values())), path)
    assert size() - before < 0.02 * before
    assert sorted(map(str, got.select(*frame([]).columns).collect())) == sorted(map(str, frame(list(live.values())).collect()))
    assert writers.collection_stats(got).head().status == "green"
    # a repeated id: the largest row, or the largest version
    twice = writers.write_points(frame([row(1, "b"), row(1, "a"), row(9999, "x"), row(9999, "x")]), path)
    assert twice.where("chunk_id = 'c1'").head().text == "b" and twice.count() == 3001
    fewer = writers.delete_points(twice.where("doc_id = 'd0'").select("id"), path)
    assert fewer.count() == 2991 and fewer.where("doc_id = 'd0'").isEmpty()
    monkeypatch.setattr(segments, "FAN", 2)
    writers.write_points(frame([row(5, "back")]), path)
    merged = writers.write_points(frame([row(6, "back")]), path)
    assert merged.count() == 2993 and sorted(r.text for r in merged.where("doc_id = 'd0'").collect()) == ["back", "back"]
    assert len(segments.Segments(spark, path).state["segments"]) < 5


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    """Row groups without a point's id are left out by their Bloom filters."""
    import pyarrow.parquet as pq

    path = f"file://{tmp_path}/points"
    rows = spark.range(40_000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("d"), F.col("id") % 997).alias("doc_id"), F.lit("ren").alias("tipo_ato"), F.md5(F.col("id").cast("string")).alias("text")).coalesce(1)
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(256 << 10))
    try:
        points = writers.write_points(rows, path)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    file = next(f for f in tmp_path.rglob("*.parquet") if "/rows/" in str(f))
    groups = pq.ParquetFile(file).metadata.num_row_groups
    assert groups > 4
    for column, value in (("id", points.where("chunk_id = 'c17'").head().id), ("doc_id", "d33")):
        found = points.where(F.col(column) == value)
        n = found.count()
        scan = found.select("text")
        scan.collect()
        node = scan._jdf.queryExecution().executedPlan()
        while node.children().size():
            node = node.children().apply(0)
        read = node.metrics().get("numOutputRows").get().value()
        assert n >= 1 and read <= 2 * 40_000 / groups, (column, read)


def test_hosts_are_asked_by_few_at_once_and_not_before_their_time(spark, tmp_path):
    from vellumspark.sources import files

    log = tmp_path / "asked"
    log.mkdir()

    def get(url):
        host, k = url.split("/")[2:4]
        began = time.time()
        time.sleep(0.03)
        (log / f"{host}-{k}-{began:.6f}").write_text(f"{host} {began} {time.time()}")
        if k == "3" and len(list(log.glob(f"{host}-3-*"))) == 1:
            return 429, b"", {"Retry-After": "1"}
        return 200, b"%PDF- " + url.encode()

    tasks = spark.createDataFrame([(f"https://{h}/{k}", f"{h}/{k}.pdf") for h in ("a.org", "b.org", "A.org") for k in range(12)], "url string, local_path string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = files.fetch(tasks, f"file://{tmp_path}/files", get, per_host=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 36 and all(r.http_status == 200 and r.sha256 for r in rows) and sorted({r.attempts for r in rows}) == [1, 2]
    asked = [(h.lower(), float(a), float(b)) for h, a, b in (f.read_text().split() for f in log.iterdir())]
    for host in ("a.org", "b.org"):
        own = [(a, b) for h, a, b in asked if h == host]
        assert max(sum(a <= at < b for a, b in own) for at, _ in own) <= 3
    refused = [float(f.read_text().split()[2]) for f in sorted(log.glob("b.org-3-*"))][0]
    # those that were under way may end; none begins before the time
    assert not [a for h, a, _ in asked if h == "b.org" and refused + 0.05 < a < refused + 0.95]


def test_retry_after_values():
    from vellumspark.sources.files import seconds_to_wait

    assert [seconds_to_wait(x, 0.0) for x in (None, "", "x", "7", "-3", "Thu, 01 Jan 1970 00:01:00 GMT")] == [None, None, None, 7.0, 0.0, 60.0]
