"""Words of many texts at once: byte classes mark where they begin and end, Arrow holds them without a Python string each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: bytes of a term: digits, letters, and all of every character beyond ASCII
TERM = np.zeros(256, bool)
TERM[ord("0") : ord("9") + 1] = TERM[ord("A") : ord("Z") + 1] = TERM[ord("a") : ord("z") + 1] = TERM[0x80:] = True


def text_groups(texts: pa.Array, most: int = 1 << 22) -> Iterator[pa.Array]:
    """Slices of about ``most`` bytes, so that the memory of a batch does not grow with it; a longer text is a slice of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, side="right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def joined(texts: pa.Array, mark: int = 0x0A) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with A-Z lower-cased and ``mark`` behind each, and the place of each mark; null is empty."""
    parts = [(t or "").encode() for t in texts.to_pylist()]
    raw = LOWER[np.frombuffer(bytes([mark]).join([*parts, b""]), np.uint8)]
    return raw, np.cumsum([len(x) + 1 for x in parts]) - 1


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs where ``inside`` holds."""
    steps = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def as_strings(raw: np.ndarray, inside: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words raw[begin:end], which are exactly the bytes ``inside``, as an Arrow array."""
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[inside])))


def run_sums(codes: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order and the exact sum of the 64-bit values (or the number) of each."""
    if values is None:
        return np.unique(codes, return_counts=True)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(values[order], first) if len(first) else np.zeros(0, np.int64)
