"""Words of many texts looked up at once: rows of different length in one flat array."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of the texts that are looked up together; a longer text is cut and goes in parts.
GROUP_CHARS = 1_000_000


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pool[start:start + length]`` of every row, one after another, and where each row ends."""
    end = np.cumsum(length)
    if not len(end) or not end[-1]:
        return pool[:0], end
    return pool[np.repeat(start - (end - length), length) + np.arange(end[-1])], end


def rows_of(texts: list[str], separator: str, rows: Callable[[list[str]], list[bytes]], kind: str) -> list[np.ndarray]:
    """For each text the rows of its parts in a row; ``rows`` gives those of distinct parts."""
    split = pc.split_pattern(pa.array(texts, pa.large_string()), separator)
    coded = split.values.dictionary_encode()
    held = rows(coded.dictionary.to_pylist())
    length = np.fromiter(map(len, held), np.int64, len(held)) // np.dtype(kind).itemsize
    pool, at = np.frombuffer(b"".join(held), kind), coded.indices.to_numpy()
    out, end = gather(pool, (np.cumsum(length) - length)[at], length[at])
    bounds = np.concatenate([[0], end])[split.offsets.to_numpy()]
    return [out[a:b] for a, b in zip(bounds, bounds[1:])]


def grouped(texts: list[str | None], cut: Callable[[str], int], run: Callable[[list[str]], list[np.ndarray]], chars: int = GROUP_CHARS) -> Iterator[bytes]:
    """``run`` over groups of texts of bounded size; ``cut`` gives the last place where a long text may be parted, or 0."""
    parts: list[str] = []
    last: list[int] = []
    held = 0

    def drain() -> Iterator[bytes]:
        nonlocal parts, last, held
        done, at = run(parts), 0
        for end in last:
            yield b"".join(x.tobytes() for x in done[at:end])
            at = end
        parts, last, held = [], [], 0

    for text in texts:
        text, long_part = text or "", []
        while len(text) > chars and (at := cut(text[:chars])):
            long_part += [x.tobytes() for x in run([text[:at]])]
            text = text[at:]
        if long_part:
            yield from drain()
            yield b"".join([*long_part, *(x.tobytes() for x in run([text]))])
            continue
        parts.append(text)
        last.append(len(parts))
        held += len(text)
        if held > chars:
            yield from drain()
    yield from drain()
