"""Words of whole columns of texts, cut with array operations instead of Python strings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_WORD, _BLANK, _END = 0, 1, 2


def byte_kinds(blank: bytes, end: bytes = b"") -> np.ndarray:
    """A table that tells bytes of words from those between words and those that end a piece."""
    kind = np.full(256, _WORD, np.uint8)
    kind[list(blank)] = _BLANK
    kind[list(end)] = _END
    return kind


_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


@dataclass
class Words:
    """The words of a column in order, each with its row and with the piece of text it is in."""

    words: pa.BinaryArray
    row: np.ndarray
    piece: np.ndarray

    def coded(self) -> tuple[np.ndarray, pa.BinaryArray]:
        """(number of each word, the distinct words)."""
        coded = self.words.dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def cut_words(column: pa.Array, kind: np.ndarray, lower: bool) -> Words:
    """Cut the UTF-8 texts of ``column`` (no nulls) by a table of ``byte_kinds``.

    ``lower`` puts A-Z in lower case. A word never crosses rows.
    """
    column = column.cast(pa.large_binary())
    _, places, content = column.buffers()
    edges = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(content, np.uint8)[edges[0] : edges[-1]] if content is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    kinds = kind[data]
    inside = kinds == _WORD
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = edges[:-1][edges[:-1] < len(data)]
    first[heads] = inside[heads]
    begin = np.flatnonzero(first)
    packed = data[inside]
    if lower:
        packed = _LOWER[packed]
    offsets = np.empty(len(begin) + 1, np.int32)
    offsets[:-1] = (np.cumsum(inside, dtype=np.int32) - 1)[begin]
    offsets[-1] = len(packed)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    row = np.repeat(np.arange(len(column)), np.diff(np.searchsorted(begin, edges)))
    piece = row if not (kind == _END).any() else np.cumsum(kinds == _END, dtype=np.int32)[begin] + row
    return Words(words, row, piece)


def hashes(words: pa.BinaryArray) -> np.ndarray:
    """A 64-bit hash of every word; equal words have equal hashes in all tasks."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, places, content = words.buffers()
    edges = np.frombuffer(places, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    if edges[0] == edges[-1]:
        return np.zeros(len(words), np.uint64)
    data = np.frombuffer(content, np.uint8)[edges[0] : edges[-1]].astype(np.uint64) + np.uint64(1)
    edges = edges - edges[0]
    size = np.diff(edges)
    power = np.cumprod(np.full(int(size.max()), 0x5851F42D4C957F2D, np.uint64))
    place = np.arange(len(data)) - np.repeat(edges[:-1], size)
    out = np.zeros(len(words), np.uint64)
    full = np.flatnonzero(size)
    out[full] = np.add.reduceat(data * power[place], edges[:-1][full])
    return out


def mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash ``h`` of a phrase carried on over one more word."""
    h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))
