import random

import xxhash
from pyspark.sql import functions as F

from vellumspark.llm import lines

M = (1 << 64) - 1


def h(s):
    return xxhash.xxh64_intdigest(s.encode(), 42)


def long(line):
    return bool(line.strip(" ")) and line.count(" ") >= lines.LONG_LINE


def chunks(all_lines):
    """First line and end of each chunk that counts."""
    hs = [0, *map(h, all_lines)]
    roll = [((a << 1) & M) ^ (a >> 63) ^ b for a, b in zip(hs, hs[1:])]
    roll = [r - (1 << 64) if r >> 63 else r for r in roll]
    out, begin = [], 0
    for i in range(len(roll)):
        alone = long(all_lines[i]) or i + 1 < len(roll) and long(all_lines[i + 1])
        if alone or i == len(roll) - 1 or i and roll[i] < roll[i - 1] and roll[i] <= roll[i + 1]:
            if i + 1 - begin >= 2 or long(all_lines[begin]):
                out.append((begin, i + 1))
            begin = i + 1
    return out


def runs(all_lines):
    """The shortest run of several lines with over fifty words from each line that isn't blank."""
    out = []
    for a, line in enumerate(all_lines):
        if not line.strip(" "):
            continue
        n = 0
        for b in range(a, len(all_lines)):
            if all_lines[b].strip(" "):
                n += all_lines[b].count(" ") + 1
                if n > lines.LONG_LINE:
                    if b > a:
                        out.append((a, b + 1))
                    break
    return out


def brute(rows):
    """rows: (doc_id, text) with distinct ids."""
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[i] = None
            continue
        all_lines, gone = t.split("\n"), set()
        for kind, parts in enumerate((chunks(all_lines), runs(all_lines))):
            for a, b in parts:
                key = kind, "\n".join(all_lines[a:b])
                j, end = first.setdefault(key, (i, b))
                if j != i or a >= end:
                    gone |= set(range(a, b))
        out[i] = "\n".join(x for k, x in enumerate(all_lines) if k not in gone)
    return out


def test_equal_to_brute_force(spark):
    rng = random.Random(5)
    passage = [f"passage line {i}" for i in range(9)]
    rows = [(i, "\n".join([f"own {i} {rng.random()}" for _ in range(rng.randrange(6))] + passage + [f"end {i}"])) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "one"), (104, "x\n" * 3000), (105, "x\n" * 3000), (106, "\n".join(passage + passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == brute(rows)
    assert sum(map(len, filter(None, got.values()))) < 0.7 * sum(len(t or "") for _, t in rows)


def test_long_lines_are_passages_of_their_own(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own {i}\n{passage}\nlast {i}") for i in range(5)] + [(9, passage[:100] + f"\nshort\n{passage} more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == {0: rows[0][1], 9: rows[5][1]} | {i: f"own {i}\nlast {i}" for i in range(1, 5)}


def test_short_passages_in_other_surroundings_go(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], []
    for k in range(2, 7):  # passages of 2 to 6 lines with 60 words
        for _ in range(6):
            planted.append([line(60 // k) for _ in range(k)])
    for passage in planted:
        for _ in range(3):
            rows.append((len(rows), "\n".join([line(8) for _ in range(rng.randrange(1, 9))] + passage + [line(8) for _ in range(rng.randrange(1, 9))])))
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    for k, passage in enumerate(planted):
        text = "\n".join(passage)
        assert [text in got[3 * k + j] for j in range(3)] == [True, False, False]
        for j in range(3):  # all own lines stay
            assert all(x in got[3 * k + j] for x in rows[3 * k + j][1].split("\n") if x not in passage)


def test_bytes_decide_where_hashes_meet(spark, monkeypatch):
    plain = lines.occurrences
    monkeypatch.setattr(lines, "occurrences", lambda t: F.transform(plain(t), lambda o: o.withField("h", F.lit(7).cast("long"))))
    passage = [f"passage {i} line" for i in range(9)]
    rows = [(i, "\n".join([f"own {i} a", f"own {i} b"] + passage + [f"end {i}"])) for i in range(5)] + [(9, "other\ntext")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_long_texts_and_repeated_lines(spark):
    rows = [(1, "x\n" * 20_000), (2, "\n".join(f"line {i % 700} of it" for i in range(20_000))), (3, "y " * 200_000), (4, "y " * 200_000), (5, "\n" * 5000)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and got[4] == ""


def test_whole_table_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r.text for r in lines.op9_line_chunks(spark, sf).collect()}
    assert got == brute(rows)


def test_columns_null_ids_repeats_and_empty(spark):
    text = "\n".join(f"line {i}" for i in range(12))
    rows = [(None, text, "a", 1, 2, 3), (None, text, "a", 1, 2, 3), (7, text, "b", 1, 2, 3), (None, None, "c", 0, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, pos int, first int, n_chars long")
    got = lines.dedup_lines(docs)
    assert got.columns == docs.columns
    texts = sorted((r.h, r.text) for r in got.collect() if r.text is not None)
    assert [t for k, t in texts if k == "a"] == [text, text] and len(texts[2][1]) < len(text)
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.h == "b")
    clashing = docs.withColumns({"a": F.lit(1), "b": F.lit("x"), "run": F.lit(2), "id": F.lit(3), "th": F.lit(4), "lines": F.lit(5)})
    assert lines.dedup_lines(clashing).columns == clashing.columns and lines.dedup_lines(clashing).count() == 4
    assert lines.dedup_lines(docs.limit(0)).collect() == []
