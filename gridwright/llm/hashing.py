"""Words and byte strings of many cells hashed at once with numpy, for use inside tasks.

Hashes are polynomials over a table of 64-bit byte values, modulo 2^64, from
one running sum over the bytes: the hash of any span is a difference of two
sums, shifted back to position 0. Equal spans have equal hashes wherever they
stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer cell makes a chunk of its own.
CHUNK_BYTES = 2 << 20

# Constants of a public 64-bit mixing function (splitmix64).
GAMMA, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits, one to one."""
    x = x + GAMMA
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


BASE = int(mix(np.array([7], np.uint64))[0]) | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = mix(np.arange(1000, 1256, dtype=np.uint64))
#: A-Z count as a-z.
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to at least ``n``, modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, CHUNK_BYTES + 1), np.uint64(base), np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have


@dataclass
class Chunk:
    """Some cells of a batch: rows ``first`` to ``last``, their UTF-8 bytes and offsets."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """A string column as byte chunks of whole cells; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Chunk(first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


class Spans:
    """Hashes of spans of a byte array."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES):
        terms = values[data]
        terms *= powers(BASE, len(data))[:len(data)]
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(terms, out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * powers(BASE_INVERSE, len(self.sums))[starts]

    def hash_all(self, size: int) -> np.ndarray:
        """Hash of the ``size`` bytes from every position that has them."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * powers(BASE_INVERSE, len(self.sums))[:n]


def word_bounds(chunk: Chunk, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a chunk, and how many of them come before each cell."""
    inside = np.zeros(len(chunk.data) + 2, bool)
    inside[1:-1] = is_word[chunk.data]
    here = inside[1:-1]
    before, after = inside[:-2].copy(), inside[2:].copy()
    cuts = chunk.offsets[1:-1]
    before[cuts[cuts < len(before)]] = False
    after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(starts, chunk.offsets)


def byte_class(separators) -> np.ndarray:
    """Which bytes are word bytes: all but the separators."""
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    return is_word


#: White space as the text queries know it, and everything ASCII that is no digit or letter.
SPACES = (0x20, *range(0x09, 0x0E))
NOT_SPACE = byte_class(SPACES)
ALPHANUMERIC = byte_class([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hash of ``size`` consecutive word hashes, from every word that has them."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out ^ hashes[i:n + i])
    return out


def segment_of(counts_before: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` items, the segment it is in, from the items before each segment."""
    return np.repeat(np.arange(len(counts_before) - 1), np.diff(counts_before))[:n]
