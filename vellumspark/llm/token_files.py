"""Token-id files with bit- or byte-plane shuffling.

A file holds the ids of consecutive documents in blocks of ``BLOCK_IDS`` ids.  Each block is
transposed into planes, either the four bytes or the 32 bits of every id, and each plane is
compressed with zstandard; planes that are all zero take no space.  The footer holds the
documents (id, number of ids) and the chunk index, so any range of ids is read by decoding
only its blocks.

Layout: ``MAGIC``, the planes of block 0, 1, ..., a zstandard-compressed JSON footer, its
length as 8 little-endian bytes, ``MAGIC``.

Writing: documents are ranged by id, each task writes one file under a name of its own and
moves it into place when complete, and the table of files is written last.  A task that is
repeated leaves an unused file behind at worst.

Defined results: a null text is encoded as the empty one, so it has the end id alone; rows are
ordered by id (nulls first), rows that share an id by a hash of their text; an empty table
gives no files and an empty result; texts of any length are encoded whole, and columns besides id
and text, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh_dir, materialize, small_batches, table
from .ragged import grouped, rows_of

MAGIC = b"VSPLANE1"
BLOCK_IDS = 1 << 16
END_ID = 2
#: Words whose ids a worker remembers; when there are more it forgets all and starts again.
CACHED_WORDS = 900_000


def open_uri(uri: str, mode: str):
    """A file object for a path in any store that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))
    if mode == "rb":
        return store.open_input_file(path)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def move_uri(src: str, dst: str) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(src) if "://" in src else (fs.LocalFileSystem(), os.path.abspath(src))
    store.move(path, path[: len(path) - len(os.path.basename(src))] + os.path.basename(dst))


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of a block, lowest byte or bit first, compressed; b"" for a plane of zeros."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    pack = zstandard.ZstdCompressor(level=1)
    rows = raw.T if kind == "byte" else np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [pack.compress(np.ascontiguousarray(r).tobytes()) if r.any() else b"" for r in rows]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    width = n if kind == "byte" else (n + 7) // 8
    rows = np.stack([np.frombuffer(unpack.decompress(p), np.uint8) if p else np.zeros(width, np.uint8) for p in planes])
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


class PlaneWriter:
    """Writes one file; holds one block of ids at a time."""

    def __init__(self, out, kind: str = "byte"):
        self.out, self.kind, self.at, self.held, self.n_held = out, kind, len(MAGIC), [], 0
        self.docs: list[tuple] = []
        self.index: list[tuple[int, int, list[int]]] = []
        self.total = 0
        out.write(MAGIC)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            whole = np.concatenate(self.held)
            full = len(whole) - len(whole) % BLOCK_IDS
            for i in range(0, full, BLOCK_IDS):
                self._block(whole[i : i + BLOCK_IDS])
            self.held, self.n_held = [whole[full:]], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        planes = to_planes(ids, self.kind)
        self.index.append((self.at, len(ids), [len(p) for p in planes]))
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        footer = zstandard.compress(json.dumps({"kind": self.kind, "docs": self.docs, "index": self.index}).encode())
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()


class PlaneReader:
    """Reads documents in order or any range of ids."""

    def __init__(self, source):
        self.source, tail = source, len(MAGIC) + 8
        end = source.seek(0, 2)
        source.seek(end - tail)
        last = source.read(tail)
        if last[8:] != MAGIC:
            raise ValueError("not a token-plane file, or cut short")
        length = struct.unpack("<Q", last[:8])[0]
        source.seek(end - tail - length)
        footer = json.loads(zstandard.decompress(source.read(length)))
        self.kind, self.docs, self.index = footer["kind"], footer["docs"], footer["index"]

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.index[k]
        self.source.seek(at)
        raw, cuts = self.source.read(sum(sizes)), [0, *itertools.accumulate(sizes)]
        return from_planes([raw[a:b] for a, b in zip(cuts, cuts[1:])], n, self.kind)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only their blocks are read."""
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK_IDS, (stop - 1) // BLOCK_IDS
        found = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return found[start - first * BLOCK_IDS : stop - first * BLOCK_IDS]

    def documents(self) -> Iterator[tuple[object, int, np.ndarray]]:
        """Document id, first place in the file and ids, one block in memory at a time."""
        held, k, start = np.empty(0, np.uint32), 0, 0
        for doc_id, n in self.docs:
            parts = [held]
            have = len(held)
            while have < n:
                parts.append(self.block(k))
                have, k = have + len(parts[-1]), k + 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, start, held[:n]
            held, start = held[n:], start + n


# Letters and marks that split and lower-case alike in every library.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"""!"#$%&()*+,\-./:;=>?@\[\]^_`{|}~"""
PLAIN, MARKED, SIMPLE = re.compile(f"[{LETTERS}{MARKS} \n]*"), re.compile(f"[{MARKS}]+"), re.compile(f"[{LETTERS}]+|[{MARKS}]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(rest)) for b in range(256)]


def last_gap(text: str) -> int:
    """The last place before a space or newline; 0 if there is none."""
    return max(0, text.rfind(" "), text.rfind("\n"))


class WordEncoder:
    """Encodes by a tokenizer that never joins across a space or newline, remembering each word.

    The vocabulary drops white space before it splits, so a text's ids are its words' ids in a
    row; words are what spaces and newlines part, other white space is left to the library.  A
    plain text is lower-cased at once and its runs of marks parted from the letters; such words
    go to the library many at a time and past its normalizer, and come back apart at the pieces
    that end a word.  All other texts' words go through the whole tokenizer.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.whole, self.split, self.cached = Tokenizer.from_file(path), Tokenizer.from_file(path), cached
        self.split.normalizer = normalizers.Sequence([])
        self.split.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        names = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for p, i in names.items() if p.endswith("</w>")]] = True
        self.letters = dict(enumerate(_byte_letters())) | {32: " "}
        self.known: dict[str, bytes] = {}

    def _plain(self, words: list[str]) -> None:
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            line = " ".join(some).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.split.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            raw, cuts = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            self.known.update(zip(some, (raw[a:b] for a, b in zip([0, *cuts], cuts))))

    def _other(self, words: list[str]) -> None:
        for w, e in zip(words, self.whole.encode_batch_fast(words, add_special_tokens=False)):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _rows(self, words: list[str]) -> list[bytes]:
        get = self.known.get
        found = [get(w) for w in words]
        new = [w for w, f in zip(words, found) if f is None]
        if new:
            if len(self.known) + len(new) > self.cached:
                self.known.clear()
                new = words
            # a word that was changed above holds no other characters, so both ways give its ids
            plain = [bool(SIMPLE.fullmatch(w)) and w == w.lower() for w in new]
            self._plain([w for w, p in zip(new, plain) if p])
            self._other([w for w, p in zip(new, plain) if not p])
            found = [self.known[w] for w in words]
        return found

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        ready = [MARKED.sub(r" \g<0> ", t.lower()) if PLAIN.fullmatch(t) else t for t in texts]
        return rows_of([t.replace("\n", " ") for t in ready], " ", self._rows, "<u4")

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return grouped(texts, last_gap, self._group, 3_000_000)


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One a worker process, so that its tasks share the words."""
    return WordEncoder(path)


def _write(root: str, vocabulary: str, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, writer = encoder(vocabulary), None
        name = f"{root}/.writing-{uuid.uuid4().hex}"
        end = struct.pack("<I", END_ID)
        for pdf in batches:
            for doc_id, ids in zip(pdf["doc_id"].tolist(), words.encode(pdf["text"].tolist())):
                if writer is None:
                    writer, first = PlaneWriter(open_uri(name, "wb"), kind), doc_id
                writer.add(None if doc_id is None else int(doc_id), np.frombuffer(ids + end, "<u4"))
        if writer is None:
            return
        writer.close()
        final = f"{root}/ids-{uuid.uuid4().hex}.planes"
        move_uri(name, final)
        from pyspark import TaskContext

        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "path": [final], "docs": [len(writer.docs)], "ids": [writer.total]})

    return run


def write_token_files(docs: DataFrame, root: str, vocabulary: str, kind: str = "byte") -> DataFrame:
    """Write all documents in ascending order of id; the table of files, in that order."""
    small_batches(docs.sparkSession, 1000)
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranged = ranged.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make floats of ids beside a null
    return materialize(ranged.mapInPandas(_write(root, vocabulary, kind), "part int, path string, docs long, ids long"), "token-files")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, base in zip(pdf["path"], pdf["base"]):
            with open_uri(path, "rb") as source:
                found = ((d, base + at, len(ids), zlib.crc32(ids.tobytes())) for d, at, ids in PlaneReader(source).documents())
                while some := list(itertools.islice(found, 10_000)):
                    ids, *rest = zip(*some)
                    yield pd.DataFrame({"doc_id": pd.array(ids, "Int64")} | dict(zip(("start", "n_tokens", "ids_crc32"), rest)))


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of the files: its place among all ids, number of ids and their checksum."""
    spark, base, rows = files.sparkSession, 0, []
    for part, path, n in files.select("part", "path", "ids").orderBy("part").collect():  # one row per file
        rows.append((path, base))
        base += n
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    listed = spark.createDataFrame(rows, "path string, base long").repartition(len(rows))
    return listed.mapInPandas(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_dir(spark, "token-planes")
    files = write_token_files(table(spark, sf_dir, "documents"), root, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(files)
