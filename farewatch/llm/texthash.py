"""Word and window hashes of whole text batches in numpy.

Texts are handled as UTF-8 bytes.  A word is a run of bytes that are not ASCII
white space.  The hash of a word is a sum of random byte values times powers of
an odd number (mod 2^64), read off running sums, then mixed; windows are
hashed likewise from their words.  Two independent seeds give 128-bit keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Bytes hashed at once; a longer text is cut at white space, never inside a word.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Seed:
    table: np.ndarray
    base: int
    inverse: int
    step: int

    @classmethod
    def make(cls, number: int, fold_case: bool) -> Seed:
        rng = np.random.default_rng(number)
        table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold_case:
            table[ord("A"):ord("Z") + 1] = table[ord("a"):ord("z") + 1]
        base, step = (int(x) * 8 + 5 for x in rng.integers(1, 2**60, 2))
        return cls(table, base, pow(base, -1, 2**64), step)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits (a fixed bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(data: np.ndarray, text_starts: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words start and end; words never cross a text's start."""
    solid = ~space[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[text_starts] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | fresh[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | fresh[1:])) + 1
    return starts, ends


class Hasher:
    """Word hashes under one or two seeds; ``fold_case`` treats A-Z as a-z.

    ``space`` marks the bytes that separate words (ASCII white space by default).
    """

    def __init__(self, seeds: int = 1, fold_case: bool = False, space: np.ndarray = _SPACE):
        self.space = space
        self.seeds = [Seed.make(1009 + i, fold_case) for i in range(seeds)]
        self._pow: list[tuple[np.ndarray, np.ndarray]] = []

    def __getstate__(self):
        return {"space": self.space, "seeds": self.seeds, "_pow": []}

    def _tables(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if not self._pow or len(self._pow[0][0]) < n:
            size = max(n, min(SLICE_BYTES, 1 << 16), 2 * len(self._pow[0][0]) if self._pow else 0)
            self._pow = [(_powers(s.base, size), _powers(s.inverse, size)) for s in self.seeds]
        return self._pow

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """One array of word hashes per seed."""
        out = []
        for seed, (power, inverse) in zip(self.seeds, self._tables(len(data) + 1), strict=True):
            total = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(seed.table[data] * power[:len(data)], out=total[1:])
            out.append(mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
        return out

    def windows(self, words: list[np.ndarray], length: int) -> list[np.ndarray]:
        """Hashes of all runs of ``length`` words (of the flat word arrays), per seed."""
        out = []
        for seed, hashes in zip(self.seeds, words, strict=True):
            n = max(0, len(hashes) - length + 1)
            acc, factor = np.zeros(n, dtype=np.uint64), 1
            for i in range(length):
                acc += hashes[i:i + n] * np.uint64(factor)
                factor = factor * seed.step % 2**64
            out.append(mix(acc))
        return out


@dataclass
class TextBlock:
    """Words of consecutive texts: ``first[i]:first[i + 1]`` are the words of text ``rows[i]``."""

    rows: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: list[np.ndarray]

    def window_texts(self, length: int) -> np.ndarray:
        """For each run of ``length`` words of the block: its text's number, or -1 if it crosses texts."""
        n = max(0, len(self.starts) - length + 1)
        owner = np.repeat(np.arange(len(self.rows)), np.diff(self.first))
        return np.where(owner[:n] == owner[length - 1:length - 1 + n], owner[:n], -1) if n else np.zeros(0, dtype=np.int64)


def _cut(data: np.ndarray, space_bytes: np.ndarray) -> list[slice]:
    """Slices of a long text of about SLICE_BYTES, cut between words."""
    out, at = [], 0
    while len(data) - at > SLICE_BYTES:
        space = np.flatnonzero(space_bytes[data[at:at + SLICE_BYTES]])
        end = at + (int(space[-1]) + 1 if len(space) else SLICE_BYTES)
        if not len(space):  # one enormous word: take it whole
            later = np.flatnonzero(space_bytes[data[end:]])
            end = end + int(later[0]) if len(later) else len(data)
        out.append(slice(at, end))
        at = end
    out.append(slice(at, len(data)))
    return out


def text_blocks(column, hasher: Hasher) -> Iterator[TextBlock]:
    """Blocks of a string column (pyarrow array); null texts have no words.

    Every text lies in one block; a block is about SLICE_BYTES long unless one
    text is longer.
    """
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    raw = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        data = raw[offsets[at]:offsets[to]]
        texts = (offsets[at:to + 1] - offsets[at]).astype(np.int64)
        if to == at + 1 and len(data) > SLICE_BYTES:
            parts = []
            for piece in _cut(data, hasher.space):
                s, e = word_bounds(data[piece], np.zeros(1, dtype=np.int64), hasher.space)
                parts.append((s + piece.start, e + piece.start, hasher.words(data[piece], s, e)))
            starts, ends = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            hashes = [np.concatenate([p[2][i] for p in parts]) for i in range(len(hasher.seeds))]
        else:
            starts, ends = word_bounds(data, texts[:-1], hasher.space)
            hashes = hasher.words(data, starts, ends)
        yield TextBlock(np.arange(at, to), data, starts, ends, np.searchsorted(starts, texts), hashes)
        at = to
