"""Vectorised word splitting and hashing over Arrow string columns.

Texts are handled as UTF-8 bytes.  A batch is cut into slices of whole texts of about
``SLICE_BYTES`` bytes so that the temporary arrays stay small however large a batch is; one text
larger than that makes a slice of its own.  Null texts count as empty.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

#: Byte classes: words without ASCII white space, words of letters and bytes beyond ASCII and digits.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
ALNUM_WORDS[0x80:] = True
LINES = np.ones(256, bool)
LINES[0x0A] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = (h ^ (h >> U(30))) * _B
    h = (h ^ (h >> U(27))) * _C
    return h ^ (h >> U(31))


@dataclass
class Texts:
    """Rows ``first`` to ``first + len(lo)`` of a batch: bytes of text ``i`` are ``data[lo[i]:hi[i]]``.

    ``data`` has eight spare zero bytes at its end."""

    first: int
    data: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def __len__(self) -> int:
        return len(self.lo)


def slices(column: pa.Array, limit: int = SLICE_BYTES, lower: bool = False) -> Iterator[Texts]:
    """The texts of a string column, slice by slice, in order."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        part = data[offsets[at] : offsets[to]]
        part = np.concatenate([LOWER[part] if lower else part, np.zeros(8, np.uint8)])
        ends = offsets[at : to + 1] - offsets[at]
        yield Texts(at, part, ends[:-1], ends[1:])
        at = to


@dataclass
class Spans:
    """Words (or lines) of a slice: byte ranges, index of the text in the slice, 64-bit hashes."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def cut(texts: Texts, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of the class ``inside`` within each text: start, end, text."""
    data, full = texts.data[:-8], texts.hi > texts.lo
    w = inside[data]
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    s[texts.lo[full]] = w[texts.lo[full]]
    e[texts.hi[full] - 1] = w[texts.hi[full] - 1]
    start, end = np.flatnonzero(s), np.flatnonzero(e) + 1
    return start, end, np.searchsorted(texts.lo, start, "right") - 1


#: So few long ranges left are hashed one by one, which for them is faster than a round of array operations for each eight bytes.
FEW = 4


def _carried_on(h: int, rest: bytes) -> int:
    """The hash of a range from what it was so far and the bytes that are left: the same steps as hashes()."""
    a, b, c, full = int(_A), int(_B), int(_C), (1 << 64) - 1
    for (v,) in struct.iter_unpack("<Q", rest + bytes(-len(rest) % 8)):
        h = (h ^ v) * a & full
        h = (h ^ h >> 30) * b & full
        h = (h ^ h >> 27) * c & full
        h ^= h >> 31
    return h


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, eight bytes at a step; equal ranges have equal hashes."""
    eight = np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))
    size = end - start
    h = mix(size.astype(U) * _A + _C)
    todo, k = np.arange(len(start)), 0
    while len(todo):
        left = size[todo] - 8 * k
        todo, left = todo[left > 0], left[left > 0]
        if len(todo) <= FEW:
            for i in todo.tolist():
                h[i] = _carried_on(int(h[i]), data[start[i] + 8 * k : end[i]].tobytes())
            break
        v = eight[start[todo] + 8 * k]
        short = left < 8
        v[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
        h[todo] = mix((h[todo] ^ v) * _A)
        k += 1
    return h


def words(texts: Texts, inside: np.ndarray) -> Spans:
    start, end, doc = cut(texts, inside)
    return Spans(start, end, doc, hashes(texts.data, start, end))


def grams(hash_: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbouring words, wherever texts end."""
    if len(hash_) < n:
        return np.zeros(0, U)
    size = len(hash_) - n + 1
    acc = hash_[:size].copy()
    for j in range(1, n):
        acc = acc * _A + hash_[j : j + size]
    return mix(acc)


def per_text(texts: Texts, flags: np.ndarray) -> np.ndarray:
    """How many bytes of each text have a flag."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[texts.hi] - total[texts.lo]


def salted(hash_: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one text."""
    return mix(hash_ ^ mix((doc.astype(U) + U(1)) * _A))
