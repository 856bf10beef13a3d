"""Words of a column of texts as arrays: where they stand and what they hash to. NumPy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of polynomial hashes modulo 2**64, and of the mixing step.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C55, 0xD1342543DE82EF95
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text taken at once; one longer text is taken alone.
CHUNK = 1_000_000

SPACES = np.ones(256, np.uint8)
SPACES[[32, 9, 10, 11, 12, 13]] = 0
#: Byte → number to hash, 0 only for what separates words: a NUL is a byte of a word like any other.
PLAIN = np.where(SPACES == 0, 0, np.arange(256) + 1).astype(np.uint16)
LOWER = PLAIN.copy()
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class Powers:
    """base**0 .. base**n and those of its inverse, modulo 2**64; grown when needed."""

    def __init__(self, base: int):
        self.base, self.n = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= self.n:
            self.n = n + 1 + n // 4
            ups = []
            for b in (self.base, pow(self.base, -1, 1 << 64)):
                a = np.full(self.n, b, np.uint64)
                a[0] = 1
                ups.append(np.cumprod(a, dtype=np.uint64))
            self.up, self.down = ups
        return self.up, self.down


_bytes, _words = Powers(BYTE_BASE), Powers(WORD_BASE)


def window_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial hash of values[s:e] for each s, e; equal stretches have equal hashes wherever they stand."""
    up, down = powers.upto(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


class Words:
    """Of some texts: doc (text of each word), start, end (bytes), code (64-bit hash), count and first (by text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = PLAIN):
        n, base = len(offsets) - 1, offsets[0]
        data, offsets = data[base : offsets[-1]], offsets - base
        self.data, self.n = table[data], n
        word = self.data != 0
        start = word.copy()
        start[1:] &= ~word[:-1]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        start[edge] = word[edge]  # a text's first byte starts a word even if the text before ends in one
        end = word.copy()
        end[:-1] &= ~word[1:] | start[1:]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=n)[:n]
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        raw = window_sums(self.data.astype(np.uint64), self.start, self.end, _bytes)
        self.code = mixed(raw + (self.end - self.start).astype(np.uint64))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word's index, hash) of every k consecutive words of one text."""
        at = np.arange(max(0, len(self.code) - k + 1))
        at = at[self.doc[at] == self.doc[at + k - 1]]
        return at, mixed(window_sums(self.code, at, at + k, _words) + np.uint64(k))

    def whole(self, docs: np.ndarray) -> np.ndarray:
        """Hash of each of these texts' whole word sequence."""
        s, e = self.first[docs], self.first[docs + 1]
        return mixed(window_sums(self.code, s, e, _words) + (e - s).astype(np.uint64))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) for stretches of a text column of about CHUNK bytes; a null is empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield at, to, data, offsets[at : to + 1]
        at = to


def batches(column: pa.Array, table: np.ndarray = PLAIN) -> Iterator[tuple[int, Words]]:
    """(first row, Words) for stretches of a text column."""
    for at, _, data, offsets in chunks(column):
        yield at, Words(data, offsets, table)


def text_groups(column: pa.Array, size: int = 3_000_000):
    """(from, texts) of stretches of a text column of about `size` bytes; a null is empty. One stretch at a time is in Python."""
    if len(column):
        length = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
        mark = np.cumsum(length) // size
        for at in np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]]):
            to = int(np.searchsorted(mark, mark[at], side="right"))
            yield int(at), [t or "" for t in column.slice(int(at), to - int(at)).to_pylist()]
