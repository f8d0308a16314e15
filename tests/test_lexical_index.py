"""Block bounds and segments of the lexical index against full sums and rebuilt indexes."""

import random

import pytest
from pyspark.sql import functions as F

from vellumspark.operators import lexical
from vellumspark.sources import segments


def texts(n, seed=3, words=300):
    """Words of very different frequency, in texts of very different length; neighbours share a topic."""
    rng = random.Random(seed)
    names = [f"w{k}" for k in range(words)]
    weight = [1 / (k + 1) for k in range(words)]
    rows = []
    for i in range(n):
        topic = names[50 + (i // 40 * 7) % 240 :][:8]
        rows.append((i, " ".join(rng.choices(names, weight, k=rng.choice([0, 3, 20, 200])) + rng.choices(topic, k=rng.randrange(4)))))
    return rows


def near(got, want):
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def tops(found):
    return {(r.qid, r["rank"], r.id): r.score for r in found.collect()}


@pytest.fixture(autouse=True)
def bounded(monkeypatch):
    monkeypatch.setattr(lexical, "WORTH", -1)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(1500), "id int, text string").repartition(3).select("id", "text", (F.col("id") % 100).alias("part"))


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(0, "w0 w1 w2 w70"), (1, "w0 w1 w3 w5 w8 w13 w21 w34 w55 w89 w144"), (2, "w250 w250 w251"), (3, "unknown"), (4, ""), (5, "w0"), (6, None), (7, "W0 w1 " * 30 + "w199")]
    return spark.createDataFrame(rows, "q int, text string")


@pytest.mark.parametrize("k", [1, 10, 200])
def test_bounded_search_equals_full_sums(spark, tmp_path, docs, asked, k):
    index = lexical.store_index(docs, "id", f"file://{tmp_path}/index")
    near(tops(lexical.search(index, asked, "q", k)), tops(lexical.ranked(lexical.scores(index, asked, "q"), k)))
    for keep in (F.col("part") < 1, F.col("part") < 10, F.lit(False)):
        kept = docs.where(keep).select("id")
        want = lexical.ranked(lexical.scores(index, asked, "q").join(kept, "id", "left_semi"), k)
        near(tops(lexical.search(index, asked, "q", k, docs, keep)), tops(want))


@pytest.mark.parametrize("repeats", [False, True])
def test_sums_of_blocks_equal_full_sums_and_pass_on_k(spark, tmp_path, docs, asked, monkeypatch, repeats):
    """No row for each posting leaves a task: ``k`` for each question and task at most."""
    path, left, plain = f"file://{tmp_path}/index", [], lexical.ranked
    rows = docs.union(docs.where("id % 5 = 0").withColumn("text", F.concat(F.lit("w0 w1 "), "text"))) if repeats else docs
    lexical.store_index(rows, "id", path)
    lexical.delete(docs.where("id % 7 = 3"), "id", path)
    index = lexical.LexicalIndex.load(spark, path)
    want = {k: tops(plain(lexical.scores(index, asked, "q").join(k, "id", "left_semi") if k else lexical.scores(index, asked, "q"), 9)) for k in (None, docs.where("part < 10").select("id"))}
    monkeypatch.setattr(lexical, "WORTH", 10**9)
    monkeypatch.setattr(lexical, "SCORES", 700)
    monkeypatch.setattr(lexical, "ASKED_BYTES", 1000)
    monkeypatch.setattr(lexical, "ranked", lambda found, k: left.append(found.count()) or plain(found, k))
    for kept, found in want.items():
        near(tops(lexical.search(index, asked, "q", 9, kept, None if kept is None else F.lit(True))), found)
    assert max(left) <= 9 * 8 * 4  # questions, tasks


def test_bounds_hold_and_leave_postings_out(spark, tmp_path, docs, asked):
    index = lexical.store_index(docs, "id", f"file://{tmp_path}/index")
    terms = lexical._asked(index, asked, "q", "text")
    bound = lexical.bounds(index, terms).groupBy("qid", "block").agg(F.sum("most").alias("most"))
    best = lexical.scores(index, asked, "q").join(index.lengths.select("id", "block"), "id").groupBy("qid", "block").agg(F.max("score").alias("best"))
    assert best.join(bound, ["qid", "block"], "left").where("most is null or most < best - 1e-9").count() == 0
    # with one term a bound is what the block's best document scores
    assert best.where("qid = 5").join(bound, ["qid", "block"]).where("abs(most - best) > 1e-9").count() == 0
    read = lexical.wanted_lists(index, terms, 5).where("qid = 0 and essential").agg(F.sum("n")).head()[0]
    assert read < 0.2 * lexical.bounds(index, terms).where("qid = 0").agg(F.sum("n")).head()[0]


def test_impacts_are_what_no_other_pair_beats(spark):
    pairs = [(3, 10, 1), (3, 8, 2), (1, 8, 3), (1, 2, 4), (5, 40, 5), (5, 40, 6), (2, 8, 7)]
    row = spark.createDataFrame([(pairs,), ([],)], "p array<struct<tf:int,dl:int,id:int>>").select(lexical._impacts(F.col("p")).alias("i")).collect()
    assert [[tuple(x) for x in r.i] for r in row] == [[(5, 40), (3, 8), (1, 2)], []]


def test_segments_equal_an_index_that_is_built_anew(spark, tmp_path, asked, monkeypatch):
    """Appends that replace documents, deletes and merges: statistics and scores are those of the documents that live."""
    monkeypatch.setattr(segments, "FAN", 3)
    path, live = f"file://{tmp_path}/index", {}
    frame = lambda rows: spark.createDataFrame(rows, "id int, text string")

    def same():
        index = lexical.LexicalIndex.load(spark, path)
        anew = lexical.build_index(frame(list(live.items())), "id")
        near({r.term: (r.idf) for r in index.terms.collect()}, {r.term: (r.idf) for r in anew.terms.collect()})
        assert {r.term: r.df for r in index.terms.collect()} == {r.term: r.df for r in anew.terms.collect()}
        near(dict(enumerate(index.corpus.head())), dict(enumerate(anew.corpus.head())))
        near(tops(lexical.search(index, asked, "q", 20)), tops(lexical.ranked(lexical.scores(anew, asked, "q"), 20)))
        assert sorted(r.id for r in index.lengths.collect()) == sorted(live)
        assert {tuple(r) for r in index.postings.collect()} == {tuple(r) for r in anew.postings.collect()}

    whole = texts(260)
    for at, step in enumerate([whole[:150], whole[150:220], [(5, "new words w0 w1"), *whole[220:]]]):
        live |= dict(step)
        lexical.append(frame(step), "id", path)
    same()
    gone = [5, 7, 160, 161, 162, 250, 9999]
    live = {k: v for k, v in live.items() if k not in gone}
    lexical.delete(frame([(i, "") for i in gone]), "id", path)
    same()
    for step in ([(7, "w0 back"), (8, "w9 w9")], [(300, "w1 w250"), (302, "w2")], [(301, "w250"), (8, None)]):
        live |= dict(step)
        lexical.append(frame(step), "id", path)
    same()
    table = segments.Segments(spark, path)
    sizes = [s["rows"] for s in table.state["segments"]]
    assert sorted(sizes) == [5, 41, 70, 150] and not table.like() and len(segments.versions(spark, f"{path}/state")) == segments.KEPT_STATES
    lexical.delete(frame([(i, "") for i in live]), "id", path)
    assert lexical.LexicalIndex.load(spark, path).lengths.count() == 0


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    rows = texts(2000)
    path = f"file://{tmp_path}/index"
    lexical.append(spark.createDataFrame(rows, "id int, text string"), "id", path)
    first = {f for f in tmp_path.rglob("*.parquet")}
    lexical.append(spark.createDataFrame(rows[100:120], "id int, text string"), "id", path)
    size = lambda files: sum(f.stat().st_size for f in files if "/lists/" in str(f))
    later = {f for f in tmp_path.rglob("*.parquet")}
    assert first - later == set() or all("/t0" in str(f) for f in first - later)
    assert size(later - first) < 0.1 * size(first)


def test_new_files_are_appended_and_changed_ones_build_anew(spark, tmp_path, monkeypatch):
    path, root = f"file://{tmp_path}/docs", f"file://{tmp_path}/index"
    built, plain = [], lexical._lists
    monkeypatch.setattr(lexical, "_lists", lambda docs, *a: built.append(docs.count()) or plain(docs, *a))
    frame = lambda rows: spark.createDataFrame(rows, "id int, text string").coalesce(1)
    frame([(1, "a b"), (2, "b")]).write.parquet(path)
    frame([(3, "c")]).write.mode("append").parquet(path)
    read = lambda: lexical.stored_index(spark.read.parquet(path), "id", root)
    assert read().lengths.count() == 3 and read().lengths.count() == 3 and built == [3]
    frame([(4, "c d")]).write.mode("append").parquet(path)
    assert sorted((r.term, r.df) for r in read().terms.collect()) == [("a", 1), ("b", 2), ("c", 2), ("d", 1)] and built == [3, 1]
    next(f for f in (tmp_path / "docs").glob("*.parquet")).unlink()
    assert read().lengths.count() < 4 and len(built) == 3
