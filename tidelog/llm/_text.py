"""Vectorised text kernels over Arrow buffers, shared by the corpus operators.

A *word* is a maximal run of bytes other than the six ASCII white-space characters, so cutting never splits a
UTF-8 character. Null text has no words. All hashes are 64-bit; two different strings share one with probability 2**-64.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
_BYTE = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the hash base ("up") or of its inverse ("down") modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        base = U(_BASE if which == "up" else _INV)
        have = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        have[0] = 1
        _powers[which] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words; changes ``x`` in place and returns it."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is as long as an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows of about ``most`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        lengths = np.diff(buffers(batch.column(text))[1])
        ends = np.cumsum(lengths)
        at = 0
        while at < len(lengths):
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            yield batch.slice(at, max(upto, at + 1) - at)
            at = max(upto, at + 1)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of every word, and each text's range of words as offsets."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(SPACE[data], out=inside[1:-1])
    core = inside[1:-1]
    opens = core & ~inside[:-2]
    closes = core & ~inside[2:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edge] = core[edge]
    closes[edge - 1] = core[edge - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each range; depends on the bytes alone."""
    return range_hasher(data)(starts, ends)


def range_hasher(data: np.ndarray):
    """The function of (starts, ends) that range_hash applies, with its prefix sums computed once."""
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power("up", len(data)), out=prefix[1:])

    def of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = prefix[ends] - prefix[starts]
        out *= _power("down", len(data) + 1)[starts]
        return mix(out + (ends - starts).astype(np.uint64) * U(0xD1B54A32D192ED03))

    return of


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and each text's range of words as offsets."""
    starts, ends, per_text = word_bounds(data, offsets)
    return range_hash(data, starts, ends), per_text


def _gram_step(state: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    state = (state + term) * U(0xD6E8FEB86659FD93 + 2 * k)
    state ^= state >> U(29)
    return state


def gram_hashes(words: np.ndarray, per_text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-gram of words within each text, and offsets. A text of 1 to n-1 words is one gram of all its words."""
    counts = np.diff(per_text)
    grams = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    offsets = np.concatenate([[0], np.cumsum(grams)])
    here = np.arange(len(words)) + n <= np.repeat(per_text[1:], counts)
    every = np.zeros(len(words), np.uint64)
    fit = max(len(words) - n + 1, 0)
    state = every[:fit]
    for k in range(n if fit else 0):
        state = _gram_step(state, words[k : k + fit], k)
    every[:fit] = state
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first, size, state = per_text[short], counts[short], np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            more = size > k
            state[more] = _gram_step(state[more], words[first[more] + k], k)
        every[first], here[first] = state, True
    return mix(every[here]), offsets


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each range, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


class Memo:
    """Codes of strings that recur: each new string is encoded once, and its ids stay in flat arrays until too many are kept."""

    def __init__(self, encode_many, most: int = 400_000, finish=None):
        self.encode_many, self.most, self.finish = encode_many, most, finish
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def __call__(self, strings: list[str]) -> np.ndarray:
        """Index of each string; its ids are ids[ends[i]:ends[i + 1]]."""
        if len(self.place) > self.most:
            self._clear()
        at = np.fromiter(map(self.place.get, strings, itertools.repeat(-1)), np.int64, len(strings))
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = [strings[i] for i in fresh]
            coded = self.encode_many(new)
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter(itertools.chain.from_iterable(coded), np.int64, int(sizes.sum()))
            if self.finish:
                flat = self.finish(flat, new, np.cumsum(sizes))
            at[fresh] = np.arange(len(new)) + len(self.place)
            self.place.update(zip(new, at[fresh].tolist()))
            self.ids = np.concatenate([self.ids, flat])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return at
