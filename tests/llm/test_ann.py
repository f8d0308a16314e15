import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import ann


def brute(rows, queries, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    hit = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hit / sum(map(len, want.values()))


def test_whole_table_against_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got, want = found(ann.op6_nearest(spark, "/root/testdata/sf0.1").collect()), brute(rows, [i for i, _ in rows if i % 100 == 0])
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values())
    assert recall(got, want) >= 0.9
    exact = {(q, i): d for q, w in brute(rows, list(got), len(rows)).items() for i, d in w}
    assert all(abs(d - exact[q, i]) < 1e-12 for q, g in got.items() for i, d in g)
    assert all([(d, i) for i, d in g] == sorted((d, i) for i, d in g) for g in got.values())


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 700)] + [(i, (np.array(rows[3][1]) + 1e-3).tolist()) for i in range(700, 720)]
    odd = [(900, None), (1000, [0.0] * 6), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1200, [math.nan] * 6), (1300, [math.inf] * 6), (1400, [1.0, 2.0]), (1500, []), (None, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, score int")
    got = found(ann.search(frame, F.col("vec_id") % 100 == 0).collect())
    want = brute(rows, [i for i, _ in rows if i % 100 == 0])
    assert set(got) == set(want) and recall(got, want) >= 0.9
    assert [i for i, _ in got[300]] == [7, *range(301, 310)] and [i for i, _ in got[400]] == [7, *range(300, 309)]


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_rows(spark, n):
    frame = spark.createDataFrame([(i * 100, [float(i), 1.0]) for i in range(n)], "vec_id long, embedding array<float>")
    got = found(ann.search(frame, F.col("vec_id") % 100 == 0).collect())
    assert {q: len(g) for q, g in got.items()} == ({i * 100: n - 1 for i in range(n)} if n > 1 else {})


def test_crowded_cells_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * (0.1 if i % 3 else 3)).tolist()) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.search(frame, F.col("vec_id") % 100 == 0).collect())
    assert recall(got, brute(rows, range(0, 900, 100))) >= 0.9


def test_many_queries_of_a_cell_are_dealt_and_exact_search_finds_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    monkeypatch.setattr(ann, "QUERY_BYTES", 2000)
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=8) * (0.1 if i % 3 else 3)).tolist()) for i in range(900)] + [(i, [1.0] * 8) for i in range(900, 960)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, range(0, 960, 5))
    assert recall(found(ann.search(frame, F.col("vec_id") % 5 == 0).collect()), want) >= 0.9
    got = found(ann.search(frame, F.col("vec_id") % 5 == 0, exact=True).collect())
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_bundles_hold_neighbouring_cells_up_to_their_size(monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 10)
    bundle, parts = ann.bundles(np.array([4, 6, 1, 0, 35, 9, 2, 0]))
    assert bundle.tolist() == [0, 0, 1, 1, 2, 3, 4, 4] and parts.tolist() == [1, 1, 4, 1, 1]
    assert [x.tolist() for x in ann.bundles(np.array([0]))] == [[0], [1]]


def test_recall_and_rows_that_leave_the_scan_at_fifty_thousand(spark, tmp_path, monkeypatch):
    left, plain = [], ann._top

    def top(rows, key, order, n):
        if key == "query" and order[-1] == "entry":
            left.append(rows.count())
        return plain(rows, key, order, n)

    monkeypatch.setattr(ann, "_top", top)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}), tmp_path / "embeddings.parquet")
    frame = spark.read.parquet(str(tmp_path)).repartition(8)
    got = found(ann.search(frame, F.col("vec_id") % 100 == 0).collect())
    want = {}
    for q in range(0, 50_000, 100):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        d[q] = np.inf
        want[q] = [(int(i), 0.0) for i in np.argsort(d)[:10]]
    assert recall(got, want) >= 0.9, recall(got, want)
    assert len(left) == 2 and sum(left) / len(want) < len(x) / 20, (left, recall(got, want))
    print("recall", recall(got, want), "rows that leave the scan for a query", sum(left) / len(want))


def test_queries_among_near_copies_far_from_zero(spark):
    rng = np.random.default_rng(1)
    x, query = rng.normal(size=(4000, 32)), np.arange(4000) % 100 == 0
    close = query | (rng.random(4000) < 0.1)
    x[close] = x[0] * 3 + 1e-3 * rng.normal(size=(close.sum(), 32))
    rows = list(enumerate(x.tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    value = recall(found(ann.search(frame, F.col("vec_id") % 100 == 0).collect()), brute(rows, range(0, 4000, 100)))
    assert value >= 0.95, value


def test_words_weigh_the_parallel_error_more():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = ann.Codebook(x, 4)
    cell = ann.nearest(x, book.centre)
    left, unit, _ = book._split(x, cell)
    at = np.arange(book.pieces)

    def parallel(code):
        return float((((left - book.word[at, code]) * unit).sum(axis=(1, 2)) ** 2).mean())

    aware = book._choose(left, unit)
    plain = ((left[:, :, None] - book.word) ** 2).sum(axis=3).argmin(axis=2)
    assert book.eta > 1.5 or book.eta == 1.0
    book.eta = 8.0
    assert parallel(book._choose(left, unit)) < parallel(plain)
    assert aware.shape == (2000, book.pieces)


def test_depth_is_measured_over_the_whole_index(spark, monkeypatch):
    monkeypatch.setattr(ann, "RERANK", 10)  # too few for vectors without clusters
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64))
    rows = list(enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.search(frame, F.col("vec_id") % 100 == 0).collect())
    value = recall(got, brute(rows, range(0, 6000, 100)))
    assert value >= 0.9, value
