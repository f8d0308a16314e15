"""SentencePiece encoding by a streaming Viterbi, and decoding.

The lattice has a node for each character boundary.  A node keeps one backpointer: the piece
that ends there on the best path.  A boundary survives as long as what follows it is the
beginning of some piece; paths that go on can only go on from survivors.  So wherever the
backpointer paths of all survivors meet in one boundary, the ids before it are committed and
their characters forgotten.  The window is what lies between the last meeting and the end: a
few piece lengths, however long the text.

What "best" means depends on the model's kind:

* ``unigram``: the largest sum of piece scores, as usual for Viterbi;
* ``bpe``: the scores of such a model are merge ranks, whose largest sum is *not* what merging
  yields.  A row of pieces is the merge result exactly if each two neighbours stay apart when
  merged on their own, and each prefix has exactly one such row.  So a piece may follow the
  piece on the node's path only if that pair stays apart; pairs are remembered.

So ids equal the sentencepiece library's for a BPE model, which the tests check.

All ids come from commits of what has met; at the text's end only the end itself survives.  One
kind of meeting is sure to come: between two characters that stand side by side in no piece
(before a blank, around a newline) nothing survives but the boundary itself.  What lies between two
such places, a word, is therefore committed alike wherever it stands.  So a worker streams each word
once, with a character behind it that lets the paths meet at its end, and remembers its commits
in a bounded table by the window's content.

Defined results: null and empty texts have no ids; characters without a piece become their
UTF-8 bytes; U+2581 reads as a blank, as in the library, so it does not survive a round trip;
bytes that form no character decode to U+FFFD; texts of any length, without any blank too, are
encoded whole; repeated rows give repeated results; columns besides id and text are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StringType

from .common import small_batches, table
from .ragged import gather, grouped, rows_of

BLANK = "▁"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZàáâäçèéêëíîïñóôöùúûüß"
#: Words and pairs that a worker remembers; when there are more it forgets them and starts again.
CACHED_WORDS, CACHED_PAIRS = 900_000, 1_000_000
#: Longer words are not remembered.
LONGEST_WORD = 48


class Lattice:
    """The window: its characters and, for each boundary, piece, start of that piece, score and survivors."""

    def __init__(self, model: "PieceModel"):
        self.model, self.text = model, ""
        # node 0 carries the piece before the window
        self.piece, self.start, self.best, self.alive = [-1], [-1], [0.0], [[0]]

    def extend(self, more: str) -> None:
        """Add a node for each character."""
        model, piece, start, best, alive = self.model, self.piece, self.start, self.best, self.alive
        step, pairs, apart, score, merging = model.step.get, model.pairs.get, model.apart, model.score, model.kind == "bpe"
        i, text = len(self.text), self.text + more
        self.text = text
        for i in range(i + 1, len(text) + 1):
            found, at, here = -1, i - 1, [i]
            top = best[at] + model.unknown
            for j in alive[-1]:  # the shortest piece first
                code = step(text[j:i])
                if code is None:
                    continue
                if code & 1:
                    here.append(j)
                if code > 1:
                    t = (code >> 1) - 1
                    if not merging:
                        if best[j] + score[t] > top:
                            found, at, top = t, j, best[j] + score[t]
                    elif found < 0:  # exactly one piece fits
                        p = piece[j]
                        if p < 0 or (pairs(p << 20 | t) or pairs(p << 20 | t) is None and apart(p, t)):
                            found, at = t, j
            piece.append(found)
            start.append(at)
            best.append(top)
            alive.append(here)

    def end(self) -> None:
        """Nothing follows: no boundary survives but the last."""
        self.alive[-1] = [len(self.text)]

    def met(self) -> int:
        """The last boundary that the paths of all survivors have in common."""
        heads = set(self.alive[-1])
        while len(heads) > 1:
            last = max(heads)
            heads.remove(last)
            heads.add(self.start[last])
        return heads.pop()

    def ids(self, at: int) -> array:
        """The ids of the path to boundary ``at``."""
        out, piece, start, text, raw = array("I"), self.piece, self.start, self.text, self.model.bytes_at
        while at:
            before = start[at]
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out.extend(raw + c for c in reversed(text[before:at].encode("utf-8", "surrogatepass")))
            at = before
        out.reverse()
        return out

    def commit(self, at: int) -> array:
        """The ids before boundary ``at``, where all paths meet; the window begins there from now on."""
        out = self.ids(at)
        self.text, self.piece, self.best = self.text[at:], self.piece[at:], self.best[at:]
        self.start = [-1, *(j - at for j in self.start[at + 1 :])]
        # lists before the end are no longer read
        self.alive = [[]] * len(self.text) + [[j - at for j in self.alive[-1]]]
        return out


class PieceModel:
    """A vocabulary: pieces with scores, and byte pieces for all that has none."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_at: int, kind: str):
        """``pieces`` by id; those with a None score are not matched in texts; byte b has id ``bytes_at`` + b."""
        self.kind, self.bytes_at = kind, bytes_at
        self.names = [p for p, _ in pieces]
        self.score = [s for _, s in pieces]
        self.id = {p: i for i, (p, s) in enumerate(pieces) if s is not None}
        self.longest = max(map(len, self.id))
        # what pieces begin with: 1 if longer ones do, and twice the next id if it is a piece itself
        begun = {p[:k] for p in self.id for k in range(1, len(p))}
        self.step = {p: (self.id.get(p, -1) + 1) << 1 | (p in begun) for p in begun | set(self.id)}
        self.unknown = min(s for _, s in pieces if s is not None) - 10
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        # a word ends where no piece can reach over: before a blank, around a newline, and
        # between a letter and a mark that never stand side by side in a piece
        beside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.parted = not any(x[1] == BLANK != x[0] or "\n" in x for x in beside)
        marks = "".join(m for m in ".,!?:;" if not any(x[1] == m and x[0] in LETTERS for x in beside))
        self.before_mark = re.compile(f"(?<=[{LETTERS}])(?=[{marks}])") if marks else None
        raw = [p.encode() for p in self.names]
        for b in range(256):
            raw[bytes_at + b] = bytes([b])
        self.spelled = np.frombuffer(b"".join(raw), np.uint8)
        self.spelled_len = np.fromiter(map(len, raw), np.int64, len(raw))
        self.spelled_at = np.cumsum(self.spelled_len) - self.spelled_len

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> "PieceModel":
        """The BPE vocabulary of a model file; only read by the library, not encoded with it."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        hidden = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        pieces = [(sp.id_to_piece(i), None if hidden(i) else sp.get_score(i)) for i in range(sp.get_piece_size())]
        return PieceModel(pieces, sp.piece_to_id("<0x00>"), "bpe")

    # -- encoding ---------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The merge result of a short text: best score first, leftmost among equals."""
        parts, score, ids = list(text), self.score, self.id
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay as they are when merged on their own."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            x, y = self.names[a], self.names[b]
            known = self.pairs[key] = self.merged(x + y) == [x, y]
        return known

    def stream(self, parts: Iterable[str], after: str = "") -> Iterator[array]:
        """Ids of the characters of ``parts``, as they are committed.

        ``after`` follows them in the text and is not encoded itself; without it the text ends.
        """
        window = Lattice(self)
        for part in parts:
            for i in range(0, len(part), self.longest):
                if window.text and (met := window.met()):
                    yield window.commit(met)
                window.extend(part[i : i + self.longest])
        size = len(window.text)
        if after:
            window.extend(after)
        else:
            window.end()
        met = window.met()
        while met > size:  # all pass the boundaries on the way to a meeting, too
            met = window.start[met]
        if met != size:
            raise ValueError(f"paths do not meet before {after!r}")
        if met:
            yield window.commit(met)

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """Commits of distinct words, each streamed on its own.

        A blank parts a word from what follows, as newlines and marks do; a word that ends with a blank
        stands before one of these.
        """
        return {word: b"".join(some.tobytes() for some in self.stream([word], "\n" if word[-1:] == BLANK else BLANK)) for word in words}

    def _rows(self, words: list[str]) -> list[bytes]:
        get = self.words.get
        found = [get(w) for w in words]
        new = [w for w, f in zip(words, found) if f is None]
        if new:
            if len(self.words) + len(new) > CACHED_WORDS:
                self.words.clear()
            fresh = self._fresh(new)
            found = [fresh[w] if f is None else f for w, f in zip(words, found)]
            self.words.update((w, b) for w, b in fresh.items() if len(w) <= LONGEST_WORD)
        return found

    def _words(self, marked: str) -> str:
        """The text with a NUL between words."""
        runs = BLANK + BLANK in marked
        out = re.sub(f"(?<!{BLANK}){BLANK}", "\0" + BLANK, marked) if runs else marked.replace(BLANK, "\0" + BLANK)
        if "\n" in out:
            out = out.replace("\n", "\0\n\0")
        return self.before_mark.sub("\0", out) if self.before_mark else out

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, "<u4")] * len(texts)
        plain = [k for k, t in enumerate(texts) if t and self.parted and "\0" not in t]
        if plain:
            for k, ids in zip(plain, rows_of([self._words(texts[k]) for k in plain], "\0", self._rows, "<u4")):
                out[k] = ids
        for k in set(range(len(texts))) - set(plain):
            out[k] = np.frombuffer(b"".join(some.tobytes() for some in self.stream([texts[k]])), "<u4")
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""

        def cut(text: str) -> int:
            found = max((m.start() for m in re.finditer(f"(?<!{BLANK}){BLANK}", text)), default=0) if self.parted else 0
            return found

        return grouped([BLANK + t.replace(" ", BLANK) if t else "" for t in texts], cut, self._group)

    # -- decoding ---------------------------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        """The text of the ids; the first blank was added by encoding."""
        i = np.frombuffer(ids, "<u4")
        spelled, _ = gather(self.spelled, self.spelled_at[i], self.spelled_len[i])
        return spelled.tobytes().decode("utf-8", "replace").replace(BLANK, " ")[1:]


def encoded(text: Column, path: str) -> Column:
    """Ids of each text as bytes (little-endian unsigned 32-bit)."""

    def run(some: pd.Series) -> pd.Series:
        model = PieceModel.load(path)
        return pd.Series(list(model.encode(some.tolist())), dtype=object)

    return F.pandas_udf(run, BinaryType(), F.PandasUDFType.SCALAR)(text)


def decoded(ids: Column, path: str) -> Column:
    def run(some: pd.Series) -> pd.Series:
        model = PieceModel.load(path)
        return pd.Series([model.decode(b) for b in some], dtype=object)

    return F.pandas_udf(run, StringType(), F.PandasUDFType.SCALAR)(ids)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Id, text, ids and decoded text of each document; the ids cross to the JVM once."""
    small_batches(docs.sparkSession)

    def run(some: pd.Series) -> pd.DataFrame:
        model = PieceModel.load(path)
        ids = list(model.encode(some.tolist()))
        return pd.DataFrame({"ids": ids, "decoded": [model.decode(x) for x in ids]})

    both = F.pandas_udf(run, "ids binary, decoded string", F.PandasUDFType.SCALAR)(docs["text"])
    whole = docs.select("doc_id", "text", both.alias("__vs_both"))
    return whole.select("doc_id", "text", "__vs_both.ids", "__vs_both.decoded")


def piece_digest(docs: DataFrame, path: str) -> DataFrame:
    """Number and checksum of each document's ids, and whether they decode to its text again."""
    whole = encode_documents(docs, path)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(BLANK), F.lit(" "))
    return whole.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), same.alias("round_trip"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
