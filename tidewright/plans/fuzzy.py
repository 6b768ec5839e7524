"""Pairs of texts of one block whose ratio reaches a percentage, found by an index of pieces instead of all pairs.

The ratio is 200 * s / (a + b), rounded, with s the length of a longest common subsequence and a, b those of the texts. A ratio bounds s
from below, and the unmatched characters d = a + b - 2s from above. The matched characters lie in d + 1 runs at most, so texts share at
least s - (d + 1) pairs of neighbouring characters (with a mark at either end, two more), and s characters, however they are ordered.

Of each text the pairs are ordered by rarity, and so many of the rarest are taken that similar texts have two of them in common (a prefix
filter for an overlap of two). Each two of them make a key; texts meet only through a key of their block. Keys that many texts of a block
have are refined: there texts must also share one of their rarest characters. What meets is compared by length, then by an edit distance with a
bound inside the JVM, and only what then is left by the ratio itself.

A block whose smaller side has at most ``_FEW`` values isn't indexed: all its values are compared in the JVM, so no value with more than ``_FEW`` others of a
larger side, which is less than its keys would cost. Joins are merged, never broadcast: Spark takes an exploded table for as small as its file.

Scale: keys of a text depend on its length, not on the block. Rarities are counted in ``_CELLS`` hashed cells, of which a table of that size is sent to the tasks. A hot
key falls into its refinements, and Spark splits what is still skewed, as nothing is gathered by key. Pairs that meet grow with the similar ones,
not with the square of the block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tidewright.stored import dropped, stored

#: Cells of rarity counts; texts with one key of a block from which the key is refined; values of a block's smaller side up to which all are compared.
_CELLS, _HOT, _FEW = 1 << 16, 64, 64


def ratio(a: str, b: str) -> int:
    """Percent of the letters of both that a longest common subsequence covers, rounded; 0 if either is empty."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = left = (1 << len(a)) - 1
    for c in b:
        own = left & places.get(c, 0)
        left = (left + own | left - own) & full
    return round(200 * (len(a) - left.bit_count()) / (len(a) + len(b)))


@F.pandas_udf(IntegerType())
def ratios(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="int32")


def least_common(a: int, b: int, percent: int) -> int:
    """The least subsequence with which texts of these lengths may reach the ratio; above min(a, b) if none may."""
    return -(-(2 * percent - 1) * (a + b) // 400)


def _overlaps(n: int, percent: int) -> tuple[int, int]:
    """The pairs of neighbours and the characters that a text of n characters shares with any similar one, at least."""
    grams = chars = n
    b = n * (2 * percent - 1) // (401 - 2 * percent)
    top = n * (401 - 2 * percent) // (2 * percent - 1) + 1
    # Both grow with the other's length but for steps of one, so that the least stands near the shortest.
    for m in range(max(1, b), min(top, b + 4) + 1):
        s = least_common(n, m, percent)
        if s <= min(n, m):
            grams, chars = min(grams, 3 * s - n - m + 1), min(chars, s)
    return grams, chars


def _numbered(tokens: list[str]) -> list[str]:
    """Repeated tokens told apart by their number."""
    seen: dict[str, int] = {}
    out = []
    for t in tokens:
        seen[t] = seen.get(t, 0) + 1
        out.append(f"{t}{seen[t]}")
    return out


def _grams(text: str) -> list[str]:
    marked = f"\x02{text}\x03"
    return _numbered([marked[i : i + 2] for i in range(len(marked) - 1)])


def _cell(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % _CELLS


def _hashed(*parts: str) -> int:
    """A number of 63 bits; equal numbers of different keys only make more texts meet."""
    raw = "\x1f".join(parts).encode("utf-8", "surrogatepass")
    return (zlib.crc32(raw) << 31 | zlib.adler32(raw) & 0x7FFFFFFF) & (1 << 63) - 1


def keys_of(text: str, percent: int, counts: np.ndarray) -> tuple[list[int], list[int]]:
    """The keys of a text, and those of its rarest characters."""
    need_grams, need_chars = _overlaps(len(text), percent)
    rare = lambda tokens: sorted(tokens, key=lambda t: (int(counts[_cell(t)]), t))
    grams, chars = _grams(text), _numbered(list(text))
    prefix = rare(grams)[: max(0, len(grams) - max(need_grams, 2) + 2)]
    return [_hashed(*pair) for pair in combinations(prefix, 2)], [_hashed(c) for c in rare(chars)[: max(1, len(chars) - need_chars + 1)]]


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_CELLS, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for t in _grams(text) + _numbered(list(text)):
                counts[_cell(t)] += 1
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["cell", "n"])


def _indexed(values: DataFrame, percent: int, counts: np.ndarray) -> DataFrame:
    """block, value, keys, chars"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [keys_of(t, percent, counts) for t in batch.column("value").to_pylist()]
            lists = [pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("value"), *lists], names=["block", "value", "keys", "chars"])

    return values.select("block", "value").mapInArrow(run, "block string, value string, keys array<bigint>, chars array<bigint>")


def _may_reach(a: str, b: str, percent: int) -> Column:
    """A test that all pairs of the ratio pass: the edit distance is at most what the ratio leaves."""
    total = F.length(a) + F.length(b)
    left = ((201 - 2 * percent) * total / 200).cast("int")
    long_enough = F.least(F.length(a), F.length(b)) * 400 >= (2 * percent - 1) * total
    return long_enough & (F.expr(f"levenshtein(`{a}`, `{b}`, cast((201 - {2 * percent}) * (length(`{a}`) + length(`{b}`)) / 200 as int))") >= 0) & (left >= 0)


def similar(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """block, a, b, ratio: values a of left and b of right in the same block that reach the ratio, as a stored table.

    left, right: block and value, texts. Null blocks or values and empty values meet nothing; repeated rows count once. ``percent`` is over 70, so that similar texts
    always share pieces.
    """
    if percent <= 70:
        raise ValueError("the index finds ratios over 70")
    sides = [stored(df.select("block", "value").filter("block is not null and value <> ''").distinct(), "fuzzy-values") for df in (left, right)]
    # Only blocks of both sides matter.
    sizes = [s.groupBy("block").agg(F.count("*").alias(f"n{i}")) for i, s in enumerate(sides)]
    both = stored(sizes[0].join(sizes[1].hint("merge"), "block").select("block", (F.least("n0", "n1") <= _FEW).alias("few")), "fuzzy-sizes")
    blocks = [stored(s.join(both.hint("merge"), "block"), "fuzzy-blocks") for s in sides]
    dropped(*sides, both)
    few = [h.filter("few").select("block", F.col("value").alias(n)) for h, n in zip(blocks, "ab")]
    close = few[0].join(few[1].hint("merge"), "block").filter(_may_reach("a", "b", percent))
    held = [h.filter("not few") for h in blocks]
    counts = np.zeros(_CELLS, np.int64)
    for row in held[0].unionByName(held[1]).select("value").mapInArrow(_counting, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # _CELLS rows at most
        counts[row["cell"]] = row["n"]
    tables = list(blocks)
    if counts.any():
        indexed = [stored(_indexed(h, percent, counts), "fuzzy-index") for h in held]
        rows = [t.select("block", F.col("value").alias(n), "chars", F.explode("keys").alias("key")) for t, n in zip(indexed, "ab")]
        hot = stored(reduce(DataFrame.unionByName, [r.groupBy("block", "key").count().filter(F.col("count") > _HOT).select("block", "key") for r in rows]).distinct(), "fuzzy-hot")
        plain = [r.drop("chars").join(hot.hint("merge"), ["block", "key"], "left_anti") for r in rows]
        fine = [r.join(hot.hint("merge"), ["block", "key"], "left_semi").select("block", "key", r.columns[1], F.explode("chars").alias("char")) for r in rows]
        # The cheap bounds come before pairs that met several times are put together.
        parts = [plain[0].join(plain[1].hint("merge"), ["block", "key"]), fine[0].join(fine[1].hint("merge"), ["block", "key", "char"])]
        close = close.unionByName(reduce(DataFrame.unionByName, [p.select("block", "a", "b").filter(_may_reach("a", "b", percent)) for p in parts]).distinct())
        tables += [*indexed, hot]
    out = stored(close.withColumn("ratio", ratios("a", "b")).filter(F.col("ratio") >= percent), "fuzzy-pairs")
    dropped(*tables)
    return out
