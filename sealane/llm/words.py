"""Words, lines and rolling hashes of whole Arrow columns of text, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken together up to so many bytes; a longer text is taken alone and whole.  A task holds
#: about a hundred bytes for each.
CHUNK = 1 << 18

U = np.uint64
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)


def _inverse(odd: np.uint64) -> np.uint64:
    return U(pow(int(odd), -1, 1 << 64))


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, _inverse(base)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                table = np.full(max(n, CHUNK + 8), base, U)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))
        return self.up[:n], self.down[:n]


_bytes, _words = Powers(_BASE), Powers(_STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Chunk(NamedTuple):
    first: int  # row of the first text in the batch
    data: np.ndarray  # the texts' UTF-8 bytes
    bounds: np.ndarray  # n + 1 offsets into data


def chunks(column: pa.Array) -> Iterator[Chunk]:
    """The texts of a column in chunks; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + CHUNK, "right")) - 1)
        yield Chunk(a, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        a = b


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    start: np.ndarray  # byte offsets in the chunk
    end: np.ndarray
    doc: np.ndarray  # which text of the chunk
    of: np.ndarray  # n + 1 offsets: the words of each text
    hash: np.ndarray


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def prefix(data: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`span_hash` gets the hash of any byte range."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data + U(1)) * _bytes.get(len(data))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    down = _bytes.get(len(sums))[1]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * _STEP)


def words(chunk: Chunk, data: np.ndarray | None = None, sums: np.ndarray | None = None, between: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes other than ASCII white space (or those marked in ``between``), within each text."""
    data = chunk.data if data is None else data
    n = len(data)
    space = np.ones(n + 2, bool)
    space[1:-1] = between[data]
    edge = np.zeros(n + 1, bool)
    edge[chunk.bounds] = True
    word = ~space[1:-1]
    start = np.flatnonzero(word & (space[:-2] | edge[:-1]))
    end = np.flatnonzero(word & (space[2:] | edge[1:])) + 1
    of = np.searchsorted(start, chunk.bounds)
    doc = np.repeat(np.arange(len(chunk.bounds) - 1), np.diff(of))
    return Words(start, end, doc, of, span_hash(prefix(data) if sums is None else sums, start, end))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of n words within one text."""
    at = np.arange(max(0, len(w.hash) - n + 1))
    at = at[w.doc[at] == w.doc[at + n - 1]] if len(at) else at
    up, down = _words.get(len(w.hash) + 1)
    sums = np.zeros(len(w.hash) + 1, U)
    np.cumsum(w.hash * up[:-1], out=sums[1:])
    return at, mix((sums[at + n] - sums[at]) * down[at] + U(n))


_others = Powers(U(0xA24BAED4963EE407))


class Spans:
    """128-bit hashes of runs of words of a chunk, from running sums."""

    def __init__(self, w: Words) -> None:
        self.sums = []
        for powers, values in ((_words, w.hash), (_others, mix(w.hash ^ U(0x5851F42D4C957F2D)))):
            up, down = powers.get(len(values) + 1)
            sums = np.zeros(len(values) + 1, U)
            np.cumsum(values * up[:-1], out=sums[1:])
            self.sums.append((sums, down))

    def get(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = (mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U)) for sums, down in self.sums)
        return one, two


def sliding_min(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(minimum, its last place) of each ``n`` neighbours."""

    def lower(v: np.ndarray, p: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = slice(None, len(v) - step), slice(step, None)
        later = v[right] <= v[left]
        return np.where(later, v[right], v[left]), np.where(later, p[right], p[left])

    width, value, place = 1, x, np.arange(len(x))
    while width * 2 <= n:
        value, place = lower(value, place, width)
        width *= 2
    return lower(value, place, n - width) if n > width else (value, place)
