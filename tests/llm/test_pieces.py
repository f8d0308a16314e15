import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from vellumspark.llm import pieces, ragged

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = pieces.PieceModel.load(PATH)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("   aabtheéß1\n\t▁ﬁ①😀.,'\0") for _ in range(rng.randrange(60))) for _ in range(n)]


LONG = ["", "a" * 5000, "the" * 3000, " " * 333 + "x", "ab" * 4000 + "é" * 500, "word. " * 3000, "\n" * 200]


def test_ids_equal_the_library():
    texts = random_texts(1500) + LONG
    assert [ids(x) for x in MODEL.encode(texts)] == SP.encode(texts)


def test_streaming_commits_early_and_gives_the_same_ids():
    rng = random.Random(4)
    text = "▁" + "".join(rng.choice("abcdeth ,é") for _ in range(20_000)).replace(" ", "▁")
    parts = list(MODEL.stream(text[i : i + 7] for i in range(0, len(text), 7)))
    assert len(parts) > 200 and max(map(len, parts)) < 200
    assert [i for p in parts for i in p] == SP.encode(text[1:])


def test_window_stays_small_and_all_paths_pass_its_beginning():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdethinngs▁,é") for _ in range(6000))
    window, widest, done = pieces.Lattice(MODEL), 0, 0
    for c in text:
        window.extend(c)
        widest = max(widest, len(window.text))
        if met := window.met():
            for j in window.alive[-1]:  # walk each survivor's path
                while j > met:
                    j = window.start[j]
                assert j == met
            window.commit(met)
            done += met
    assert widest <= 4 * MODEL.longest and done > len(text) - widest


def test_every_id_leaves_by_a_commit_after_a_meeting(monkeypatch):
    """Over all texts of sf0.01, long words and odd ones: what ``commit`` gave, after ``met``, makes up all ids."""
    import pyarrow.parquet as pq

    model = pieces.PieceModel.load.__wrapped__(PATH)
    plain = {name: getattr(pieces.Lattice, name) for name in ("met", "commit", "ids")}
    last, widest, inside, given, parts = {}, [0], [0], [0], {}

    def met(self):
        at = plain["met"](self)
        for j in self.alive[-1]:
            while j > at:
                j = self.start[j]
            assert j == at
        widest[0] = max(widest[0], len(self.text))
        last[id(self)] = [at]
        while at:  # every path goes on along this one
            at = self.start[at]
            last[id(self)].append(at)
        return last[id(self)][0]

    def commit(self, at):
        assert at in last.pop(id(self))
        inside[0] += 1
        out = plain["commit"](self, at)
        inside[0] -= 1
        given[0] += len(out)
        return out

    def ids_of(self, at):
        assert inside[0] == 1
        return plain["ids"](self, at)

    def stream(self, some, after="", plain=pieces.PieceModel.stream):
        some, before = list(some), given[0]
        out = list(plain(self, some, after))
        assert sum(map(len, out)) == given[0] - before
        parts["".join(some)] = b"".join(x.tobytes() for x in out)
        return iter(out)

    for name, f in (("met", met), ("commit", commit), ("ids", ids_of)):
        monkeypatch.setattr(pieces.Lattice, name, f)
    monkeypatch.setattr(pieces.PieceModel, "stream", stream)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist() + LONG + random_texts(300, 9)
    got = list(model.encode(texts))
    assert [ids(x) for x in got] == SP.encode([t or "" for t in texts])
    for text, raw in zip(texts, got):
        marked = "▁" + text.replace(" ", "▁") if text else ""
        whole = [marked] if "\0" in marked else [w for w in model._words(marked).split("\0") if w]
        assert b"".join(parts[w] for w in whole) == raw
    assert widest[0] <= 4 * model.longest


def test_long_texts_are_cut_between_words():
    texts = ["some words   more, words.\n" * 50, "x" * 500, *random_texts(50, 2)]
    marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
    cut = lambda t: max((i for i in range(1, len(t)) if t[i] == "▁" != t[i - 1]), default=0)
    assert [ids(x) for x in ragged.grouped(marked, cut, MODEL._group, 100)] == SP.encode(texts)


def test_decoding():
    texts = random_texts(1500, 3) + LONG
    assert [MODEL.decode(x) for x in MODEL.encode(texts)] == [t.replace("▁", " ") for t in texts]
    assert MODEL.decode(np.array([259, 3 + 0xC3], "<u4").tobytes()) == " �"


@pytest.mark.parametrize("seed", range(5))
def test_unigram_finds_the_best_sum(seed):
    rng = random.Random(seed)
    vocab = {p: -rng.random() * len(p) - 0.1 for p in {"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 5))) for _ in range(25)} | {"a", "b"}}
    listed = [(f"<{b}>", None) for b in range(256)] + sorted(vocab.items())
    model = pieces.PieceModel(listed, 0, "unigram")
    for _ in range(20):
        text = "".join(rng.choice("aab c") for _ in range(rng.randrange(1, 40)))
        marked = "▁" + text.replace(" ", "▁")
        best = [0.0]
        for i in range(1, len(marked) + 1):
            best.append(max([best[i - 1] + model.unknown] + [best[j] + vocab[marked[j:i]] for j in range(i) if marked[j:i] in vocab]))
        found = ids(next(model.encode([text])))
        score, raw = 0.0, 0
        for i in found:
            raw, score = (raw + 1, score) if i < 256 else (raw, score + listed[i][1])
        unknown = sum(len(c.encode()) for c in marked) - sum(len(listed[i][0].encode()) for i in found if i >= 256)
        assert raw == unknown and model.decode(np.array(found, "<u4").tobytes()) == text
        score += model.unknown * (len(marked) - sum(len(listed[i][0]) for i in found if i >= 256))
        assert abs(score - best[-1]) < 1e-6


def test_whole_table_nulls_repeats_and_empty(spark, sf):
    import zlib

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: SP.encode(r.text) for r in docs.collect()}
    got = pieces.op4_pieces(spark, sf).collect()
    assert {r.doc_id: (r.n_ids, r.ids_crc32, r.round_trip) for r in got} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True) for i, x in want.items()}
    rows = [(1, None, 5), (None, "", 6), (2, "a▁b", 7), (2, "a▁b", 7)]
    some = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    assert sorted(r.n_ids for r in pieces.piece_digest(some, PATH).collect()) == [0, 0, 2, 2]
    assert all(r.round_trip for r in pieces.piece_digest(some, PATH).collect())
    assert pieces.piece_digest(some.limit(0), PATH).count() == 0
