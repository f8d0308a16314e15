"""Vector search in cells against the plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.operators import cells, dense

N, DIM = 12_000, 24


@pytest.fixture(scope="module")
def vectors(spark):
    """Vectors around many middles, some equal, some without a direction."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(60, DIM))
    x = middles[rng.integers(0, 60, N)] + 0.6 * rng.normal(size=(N, DIM))
    x[5000:5400] = x[0]
    rows = [(i, v.tolist(), "rens"[i % 4] if i % 100 else "rare", 2000 + i % 10) for i, v in enumerate(x)]
    rows += [(N, [0.0] * DIM, "r", 2000), (N + 1, None, "r", 2000), (N + 2, [float("nan")] * DIM, "r", 2000), (N + 3, [None] * DIM, "r", 2000)]
    path = spark.createDataFrame(rows, "id long, v array<double>, tipo string, year int")
    return path.repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return cells.store_cells(vectors, f"file://{tmp_path_factory.mktemp('cells')}/index", ["tipo", "year"])


@pytest.mark.parametrize("keep, share", [(None, 1.0), ("year = 2003", 0.1), ("tipo = 'rare'", 0.01), ("tipo = 'none'", 0)])
def test_recall_under_filters(spark, vectors, index, keep, share, capsys):
    keep = F.expr(keep) if keep else None
    asked = vectors.where("id % 150 = 7").select(F.col("id").alias("qid"), "v")
    plain = vectors.where("id < %d" % N)
    want = {(r.qid, r.id): r.score for r in dense.search(plain, asked, 10, keep).collect()}
    got = {(r.qid, r.id): r.score for r in cells.search(index, asked, 10, keep).collect()}
    compared = cells.chosen(index, asked, keep).agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0] / asked.count()
    with capsys.disabled():
        print(f" share {share}: {compared:.0f} of {share * N:.0f} rows compared a question, recall {len(set(got) & set(want)) / max(1, len(want)):.3f}")
    assert len(set(got) & set(want)) >= 0.9 * len(want) and len(got) == len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in set(got) & set(want))
    assert compared <= share * N and (share < 1 or compared < 0.5 * N)
    if share and share <= 0.01:
        assert set(got) == set(want)


def test_parts_and_groups_change_nothing(spark, vectors, tmp_path, monkeypatch):
    some = vectors.where("id < 6000")
    asked = some.where("id % 40 = 0").select(F.col("id").alias("qid"), "v")
    monkeypatch.setattr(cells, "PART_ROWS", 50)
    monkeypatch.setattr(cells, "GROUP", 7)
    index = cells.store_cells(some, f"file://{tmp_path}/index", [], enough=10**9)
    want = sorted((r.qid, r["rank"], r.id) for r in dense.search(some, asked, 5).collect())
    assert sorted((r.qid, r["rank"], r.id) for r in cells.search(index, asked, 5).collect()) == want


def test_few_and_no_vectors(spark, vectors, tmp_path):
    one = vectors.where("id = 3")
    index = cells.store_cells(one, f"file://{tmp_path}/one", ["tipo"])
    asked = vectors.where("id in (4, %d)" % N).select(F.col("id").alias("qid"), "v")
    assert [(r.qid, r.id, r["rank"]) for r in cells.search(index, asked, 5).collect()] == [(4, 3, 1)]
    assert cells.search(index, asked.limit(0), 5).collect() == []
    with pytest.raises(ValueError):
        cells.store_cells(vectors.where("id < 0"), f"file://{tmp_path}/none", ["tipo"])
