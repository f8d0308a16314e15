"""Queries against their SQL on tables with nulls, empty texts and repeated rows."""

from collections import Counter

import duckdb

from vellumspark.plans.queries import ORACLES, QUERIES


def differ(spark, folder, name, table, rows, schema):
    """Rows that only the query gives, and rows that only its SQL gives."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = con.sql(ORACLES[name])
    want = Counter(found.fetchall())
    got = Counter(tuple(r) for r in QUERIES[name](spark, str(folder)).select(*found.columns).collect())
    assert sum(want.values()) == len(rows)
    return got - want, want - got


def test_prompt_texts(spark, tmp_path):
    long = "é😀" * 1200
    pairs = [("src1", "a text"), ("src1", ""), ("", "a text"), ("", ""), (None, "a text"), ("src1", None), (None, None), ("src1", " \n"), ("straße ŉ ﬁ ᾀ é 😀", long), ("ação", "x\r\ny z")]
    rows = [(i * len(pairs) + k, s, t) for i in range(-3, 4) for k, (s, t) in enumerate(pairs)] + [(None, "src1", "a text"), (5, "src1", "a text"), (5, "src1", "a text")]
    assert differ(spark, tmp_path, "prompt_texts", "documents", rows, "doc_id long, source string, text string") == (Counter(), Counter())


def test_strip_page_heads(spark, tmp_path):
    same = "one line of each turn"
    pages = [
        [(0, None), (1, "b"), (2, None), (3, "")],  # three heads, one text or two
        [(0, None), (1, "")],
        [(k, same) for k in range(4)],
        [(k, f"a\n {same} \nb{k}") for k in range(3)],
        [(k, f"a\r\nb\rc d\fe\x85f{k}\n") for k in range(3)],
        [(k, f"a\r\nb{k}") for k in range(2)],
        [(0, "p"), (0, "q"), (0, "r")],  # rows of one turn
        [(1, "p")] * 3,
        [(None, "p"), (None, "q"), (0, "r")],
        [(None, "p")],
        [(k, f"Boletim {k} de hoje") for k in (1, 1, 1, 2)],  # heads within the text
        [(k, "Boletim 2 de hoje\nx") for k in range(3)],
        [(k, "turno 10\nturno 11") for k in range(9, 14)],
        [(k, f"n{k}") for k in range(300)],
    ]
    rows = [(i - 3, t, x) for i, p in enumerate(pages) for t, x in p]
    unknown = [(None, k, f"none {k}") for k in range(3)]
    schema = "conv_id long, turn long, text string"
    for n in (0, 2, 3):
        assert differ(spark, tmp_path / str(n), "strip_page_heads", "conversations", rows + unknown[:n], schema) == (Counter(), Counter())


def test_repeated_lines_of_a_head(spark):
    from vellumspark.operators import cleaning

    texts = {1: ["first line\r\nsecond line\nbody\r\nsecond line\n"] * 3, 2: ["first line\n"] * 2, 3: [" first line", "first line\x85", "first line\n\nfirst line", None]}
    pages = spark.createDataFrame([(d, 0, t) for d, ts in texts.items() for t in ts], "d long, p int, t string")
    found = lambda **a: {(r.d, r.line, r.pages) for r in cleaning.repeated_lines(pages, "d", text="t", **a).collect()}
    assert found(page="p") == set()
    assert found(page=None, head=1) == {(1, "first line", 3), (3, "first line", 3)}
    assert found(page=None, head=2) == found(page=None) == {(1, "first line", 3), (1, "second line", 3), (3, "first line", 3)}
    left = lambda head: Counter((r.d, r.t) for r in cleaning.drop_repeated(pages, cleaning.repeated_lines(pages, "d", None, "t", head=head), "d", "t", head).collect())
    rest = Counter({(2, "first line\n"): 2, (3, None): 1})
    assert left(1) == rest + Counter({(1, "second line\nbody\r\nsecond line\n"): 3, (3, ""): 2, (3, "\nfirst line"): 1})
    assert left(2) == rest + Counter({(1, "body\r\nsecond line\n"): 3, (3, ""): 2, (3, "\nfirst line"): 1})
    assert left(None) == rest + Counter({(1, "body\n"): 3, (3, ""): 3})


def test_labels_of_a_chunk(spark):
    """Left to itself the label has no empty parts; as fields all keep their place."""
    from pyspark.sql import functions as F

    from vellumspark.functions import text as T
    from vellumspark.operators import golden

    rows = [("prt", 2001, "t" * 90, "Art. 1º", "x"), ("", 0, "", "", "x"), (None, None, None, "", "x")]
    chunks = spark.createDataFrame([(i, *r[:4], "doc", r[4]) for i, r in enumerate(rows)], "i int, tipo_ato string, year int, title string, section_label string, section_type string, text string").select("i", F.struct("*").alias("c"))
    got = chunks.select("i", golden.described(F.col("c")).alias("a"), golden.described(F.col("c"), T.label_fields).alias("b")).orderBy("i").collect()
    assert [r.a for r in got] == [f"PRT | 2001 | {'t' * 80} | Art. 1º\nx", "doc\nx", "doc\nx"]
    assert [r.b for r in got] == [f"PRT | 2001 | {'t' * 80} | Art. 1º\nx", " |  | doc\nx", None]
