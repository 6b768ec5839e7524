"""Words and rolling hashes of Arrow text batches, without a Python object per word.

A batch's UTF-8 buffer is cut into blocks of whole documents (about ``BLOCK`` bytes, or one
longer document). All arrays below are per block, so memory follows the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_BASE, _WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def byte_class(inside) -> np.ndarray:
    """A 256-entry table: whether a byte belongs to a word."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Words of letters a-z, digits and everything beyond ASCII; the case of A-Z doesn't count.
ALNUM = byte_class(lambda b: chr(b).isalnum() and b < 128 or b >= 128)
#: Words of anything but ASCII white space.
NON_SPACE = byte_class(lambda b: b not in (9, 10, 11, 12, 13, 32))


def _byte_values(fold: bool) -> np.ndarray:
    values = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
    if fold:
        values[65:91] = values[97:123]
    return values


_VALUES = {False: _byte_values(False), True: _byte_values(True)}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n at least; base is odd."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        up = np.full(size, base, np.uint64)
        down = np.full(size, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        _POWERS[int(base)] = have = (np.cumprod(up), np.cumprod(down))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.type != pa.string():
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Block:
    """Words of some consecutive documents of a batch.

    rows: the documents, as positions in the batch; starts, ends: of words, in ``data``;
    first: of each document its first word, with a closing entry.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: range, inside: np.ndarray, fold: bool):
        self.data, self.rows, self.fold = data, rows, fold
        w = inside[data]
        begins, stops = w.copy(), w.copy()
        begins[1:] &= ~w[:-1]
        stops[:-1] &= ~w[1:]
        edges = np.unique(offsets[:-1])
        edges = edges[edges < len(data)]
        begins[edges] = w[edges]
        edges = edges[edges > 0] - 1
        stops[edges] = w[edges]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = _powers(_BASE, len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_VALUES[self.fold][self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def ends_of_docs(self) -> np.ndarray:
        """For each word, the index just past the last word of its document."""
        return np.repeat(self.first[1:], self.counts)

    def docs(self) -> np.ndarray:
        """For each word, its document's place in the block."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j of the block, joined by one space."""
        out = b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[i:j], self.ends[i:j]))
        return out.lower() if self.fold else out


def blocks(column: pa.Array, inside: np.ndarray, fold: bool = False) -> Iterator[Block]:
    data, offsets = utf8(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        yield Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], range(i, j), inside, fold)
        i = j


def grams(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of k word hashes, len(words) - k + 1 of them; runs across documents too."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _WORD_BASE + np.uint64(2 * seed * 0x632BE59B)
    if seed:
        words = mix(words + np.uint64(seed))
    up, down = _powers(base, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n] + np.uint64(k))


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each run of w entries, len(x) - w + 1 of them."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """The least hash of each run of w hashes."""
    return _sliding(hashes, w, np.minimum) if len(hashes) >= w else np.zeros(0, np.uint64)


def winnow(hashes: np.ndarray, w: int, valid: np.ndarray) -> np.ndarray:
    """Positions of hashes that are the least of some valid run of w hashes (all of them, on a tie)."""
    least = minima(hashes, w)
    if not len(least):
        return np.zeros(0, np.int64)
    least = np.where(valid[: len(least)], least, np.uint64(0))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero((_sliding(padded, w, np.maximum) == hashes) & (hashes > 0))
