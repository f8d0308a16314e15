import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import divergence

COLUMNS = "doc_id long, text string, lang string, source string"


def brute(rows, least):
    """All groups and pairs from whole vectors."""
    terms, groups, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [w.translate(lower) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang, source].update(found)
        terms[lang].update(found)
        seen[lang].update(set(found))
    out = set()
    for lang in terms:
        kept = [t for t in terms[lang] if seen[lang][t] >= least]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = shares(terms[lang]), {s: shares(c) for (x, s), c in groups.items() if x == lang}
        for s in p:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)}
            over = sorted((q[t] - p[s][t], t.encode()) for t in kept if groups[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(over[:50])}
    return out


def table(seed, n, sources):
    rng = random.Random(seed)
    words = [w for w in "the The and of, été Été naïve 漢字 a1b x_y straße STRASSE émile ZZ".split()] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)]
    rows = []
    for k in range(n):
        source = rng.choice([None, "", *[f"s{j}" for j in range(sources)]]) if k % 3 else "s0"
        rows.append((k, " ".join(rng.choices(words, k=rng.randrange(40))) if k % 17 else None, rng.choice(["en", "de", None]), source))
    return rows + [(n, "zz alone", "xx", "only"), (n + 1, "", "yy", "left"), (n + 2, "rare words", "yy", "right"), (n + 3, None, "yy", None), rows[1], rows[1]]


@pytest.mark.parametrize("cells, entries, sources", [(16, 1 << 18, 3), (4, 16, 9), (5, 64, 13), (3, 7, 2)])
def test_equals_brute_force_whatever_the_cells(spark, monkeypatch, cells, entries, sources):
    for name, value in (("LEAST_DOCS", 6), ("CELLS", cells), ("ENTRIES", entries)):
        monkeypatch.setattr(divergence, name, value)
    rows = table(cells, 160, sources)
    got = [tuple(r) for r in divergence.audit(spark.createDataFrame(rows, COLUMNS)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 6)


def test_every_two_cells_meet_once(spark):
    turns = [(n, c, t) for n in range(1, 19) for c in range(n) for t in range(19)]
    rows = spark.createDataFrame(turns, "n long, c long, t int")
    met = defaultdict(list)
    for t in range(19):
        for r in rows.where(F.col("t") == t).select("n", "c", divergence.partner(F.col("c"), F.col("n"), t).alias("o")).where("o is not null").collect():
            met[r.n].append((t, r.c, r.o))
    for n in range(2, 19):
        assert {(t, b, a) for t, a, b in met[n]} == set(met[n])
        assert sorted((a, b) for _, a, b in met[n]) == [(a, b) for a in range(n) for b in range(n) if a != b]
        assert len({(t, a) for t, a, _ in met[n]}) == len(met[n])


def test_shares_are_exact_beyond_64_bits(spark):
    rows = [(10**12 + 7, 3 * 10**12 + 11, 10**6), (0, 0, 3), (9_300_000_000, 9_300_000_000, 1), (1, 10, 0)]
    got = spark.createDataFrame(rows, "n long, own long, terms long").select("*", divergence.share("n", "own", "terms").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) if v else 0 for n, t, v in rows]


def test_packed_vectors_come_back():
    seats = [(3, 7, np.array([0, 4, 5]), np.array([10, 1_000_000_001, 12])), (4, 1, np.array([], int), np.array([], int))]
    seat, p = divergence._unpacked(divergence._packed(6, seats))
    assert seat.tolist() == [3, 4] and p.tolist() == [[10, 7, 7, 7, 1_000_000_001, 12], [1] * 6]
    assert divergence._unpacked(divergence._packed(0, seats[1:]))[1].shape == (1, 0)


def test_counting_hands_on_early_and_cuts_long_texts_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "PART", 10)
    text = ("Grün-ROT " * 50 + "x" * 95).encode()
    batch = pa.record_batch([pa.array(["l"] * 2), pa.array(["s"] * 2), pa.array([text, b""])], names=["lang", "source", "text"])
    total = Counter()
    for b in divergence._count(iter([batch, batch])):
        for r in b.to_pylist():
            total[r["term"].decode(), "n"] += r["n"]
            total[r["term"].decode(), "docs"] += r["docs"]
    assert total == {("grün", "n"): 100, ("grün", "docs"): 2, ("rot", "n"): 100, ("rot", "docs"): 2, ("x" * 95, "n"): 2, ("x" * 95, "docs"): 2, ("", "n"): 0, ("", "docs"): 4}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert divergence.audit(empty).collect() == [] and divergence.audit(empty).columns == ["lang", "source", "part", "item", "value", "rank"]
    # names of its own tables as extra columns
    odd = spark.createDataFrame([(1, "a", None, None, 1, "x", 2), (1, "a", None, "b", 1, "x", 2)], COLUMNS + ", seat int, term string, block int")
    assert sorted(tuple(r) for r in divergence.audit(odd).collect()) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    got = [tuple(r) for r in divergence.op11_systolic(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == brute([tuple(r) for r in docs.collect()], divergence.LEAST_DOCS)
