import io
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from vellumspark.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


ENCODER = tf.WordEncoder(PATH, cached=30)


class Keep(io.BytesIO):
    def close(self):
        pass


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert np.array_equal(tf.from_planes(tf.to_planes(ids, kind), n, kind), ids)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_round_trip_and_ranges(kind, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_IDS", 64)
    rng, out = np.random.default_rng(1), Keep()
    docs = [(i, rng.integers(0, 50_000, int(n), dtype=np.uint32)) for i, n in enumerate([0, 1, 63, 64, 65, 500, 3, 0, 128])]
    w = tf.PlaneWriter(out, kind)
    for d in docs:
        w.add(*d)
    w.close()
    r = tf.PlaneReader(io.BytesIO(out.getvalue()))
    got = list(r.documents())
    assert [(d, s) for d, s, _ in got] == [(i, sum(len(x) for _, x in docs[:i])) for i in range(len(docs))]
    assert all(np.array_equal(a, b) for (_, _, a), (_, b) in zip(got, docs))
    whole = np.concatenate([x for _, x in docs])
    for a, b in ((0, 0), (0, 1), (60, 70), (100, 700), (0, len(whole))):
        assert np.array_equal(r.ids(a, b), whole[a:b])
    with pytest.raises(ValueError):
        tf.PlaneReader(io.BytesIO(out.getvalue()[:-1]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aB's1 \n\t\r\x1c\x85 é́Σς中 <|>endofstartx."))), min_size=1, max_size=4))
def test_words_encode_like_whole_texts(texts):
    texts = [*texts, "".join(texts) + "<|endoftext|>" + texts[0], "don't  I'LL\n\n<|startoftext|>"]
    whole = Tokenizer.from_file(PATH)
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(ENCODER.encode(texts)) == want


def test_long_texts_are_cut(monkeypatch):
    from vellumspark.llm import ragged

    texts = ["Some words, more. " * 40, "x" * 300, "Ünd ärgerlich it's 12.5\n" * 30, "", None]
    want = [np.array(Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(ragged.grouped(texts, tf.last_gap, ENCODER._group, 100)) == want


def want(rows):
    whole, at, out = Tokenizer.from_file(PATH), 0, {}
    for i, t in sorted(rows):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        out[i] = (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    return out


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tf.op3_token_planes(spark, sf).collect()}
    assert got == want(rows)


def test_nulls_repeats_and_empty(spark, tmp_path):
    schema = "doc_id long, text string, ids string"
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "a b", "x"), (3, None, "x"), (3, None, "x"), (None, "c", None), (5, "", "y"), (6, "word " * 30_000, "z")], schema)
    got = sorted(tf.read_token_files(tf.write_token_files(docs, str(tmp_path), PATH, "bit")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 3, 3, 5, 6, big] and [r.n_tokens for r in got] == [2, 1, 1, 1, 30_001, 3]
    assert tf.read_token_files(tf.write_token_files(docs.limit(0), str(tmp_path), PATH)).count() == 0
