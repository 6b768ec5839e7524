"""Substring deduplication with a count-min prefilter.

First pass: each partition makes a count-min sketch of the documents in which windows occur. A
window is counted under its least word k-gram, so that neighbouring windows share a count: what
the sketch says of a k-gram is never below the count of any window counted under it. Partition
sketches are merged by adding their cells. Second pass: only windows whose estimate is two
or more are grouped by a 128-bit hash; a window below was in one
document and can't repeat, so none is lost. That hash is made of 64-bit hashes of words: two windows of different words count as equal only if
all their differing words have equal hashes, a chance of about 2**-64 a pair of windows that differ in one word, which is not looked at again. The sketch's width follows the corpus
(``cells_per_print`` a counted k-gram) up to ``max_bits``, which a corpus beyond some 100 GB fills; a full sketch filters less and changes no
result, but more windows are grouped.

Scale: a task resolves the repeats that it can see itself and sends one document a window and task,
so a passage in a third of all documents meets as one row a task. Removed runs are gathered by
document and joined with the text on the id.

Cases: ids have to be whole numbers. Null or empty text has no words, nothing is removed, kept text is empty. Texts of fewer
than ``window`` words have no window. Rows with equal ids are one document for the comparison of
ids (a window is never its own document's repeat), and what is removed at a place is removed from
each of them. Rows with a null id are returned whole and remove nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm import words as W


def _prints(block: W.Block, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; the first words of windows; the least k-gram of each."""
    h = block.hashes()
    least = W.minima(W.grams(h, k), window - k + 1)
    place = np.arange(len(least))
    at = place[place + window <= block.ends_of_docs()[: len(least)]]
    return h, at, least[at]


def _cells(prints: np.ndarray, bits: int) -> list[np.ndarray]:
    """A print's cell in each of the two rows of the sketch; the rows lie one behind the other."""
    first = prints & np.uint64((1 << bits) - 1)
    second = (W.mix(prints) >> np.uint64(64 - bits)) + np.uint64(1 << bits)
    return [first.astype(np.int64), second.astype(np.int64)]


def _saturated(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, back = np.unique(cells, return_inverse=True)
    return own, np.minimum(np.bincount(back, weights=counts), 2).astype(np.int64)


def _sketch(docs: DataFrame, window: int, k: int, bits: int) -> np.ndarray:
    """A bitmap of the cells whose merged count is two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []

        def out():
            c, n = np.concatenate([cells, *fresh]), np.concatenate([counts, np.ones(sum(map(len, fresh)), np.int64)])
            return _saturated(c, n)

        for batch in batches:
            for block in W.blocks(batch.column(1), W.NON_SPACE):
                _, at, least = _prints(block, window, k)
                if not len(at):
                    continue
                # Once a document: neighbours mostly share a print, so runs go first, then the rest.
                doc = block.docs()[at]
                new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]))
                doc, least = doc[new], least[new]
                order = np.lexsort((least, doc))
                doc, least = doc[order], least[order]
                least = least[np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])]
                fresh += _cells(least, bits)
            if sum(map(len, fresh)) > 1 << 21:
                cells, counts = out()
                fresh = []
                if len(cells) > 1 << 23:  # 128 MB
                    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts)], ["cell", "n"])
                    cells, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        cells, counts = out()
        for i in range(0, len(cells), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(cells[i : i + (1 << 18)]), pa.array(counts[i : i + (1 << 18)])], ["cell", "n"])

    merged = docs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n >= 2")
    rows = merged.groupBy(F.shiftright("cell", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("v")).toArrow()
    bitmap = np.zeros(max(1, 2 << bits >> 6), np.uint64)
    bitmap[rows["w"].to_numpy()] = rows["v"].to_numpy().view(np.uint64)
    return bitmap


def _repeated(docs: DataFrame, bitmap, window: int, k: int, bits: int, flush: int) -> DataFrame:
    """Windows estimated repeated. done: runs whose first document this task has seen to be another."""

    def estimate(prints: np.ndarray) -> np.ndarray:
        kept, found = bitmap.value, np.ones(len(prints), bool)
        for cell in _cells(prints, bits):
            found &= ((kept[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        return found

    def resolved(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, at = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, doc, h2, h1))
        h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        done = doc > least
        open_ = ~done
        yield from rows(h1[open_], h2[open_], doc[open_], at[open_], at[open_] + 1, False)
        doc, at = doc[done], at[done]
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)]) if len(doc) else np.zeros(0, bool)
        i = np.flatnonzero(first)
        stop = at[np.concatenate([i[1:], [len(at)]]) - 1] + 1 if len(i) else at
        # Keys of their own keep these from meeting in one task.
        key = W.mix(doc[i].astype(np.uint64) + W.mix(at[i].astype(np.uint64)))
        yield from rows(key, key, doc[i], at[i], stop, True)

    def rows(h1, h2, doc, at, stop, done) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(doc), 1 << 17):
            s = slice(i, i + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(h1[s].view(np.int64)), pa.array(h2[s].view(np.int64)), pa.array(doc[s]), pa.array(at[s].astype(np.int32)), pa.array(stop[s].astype(np.int32)), pa.array(np.full(len(doc[s]), done))], ["h1", "h2", "id", "at", "stop", "done"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in W.blocks(batch.column(1), W.NON_SPACE):
                h, at, least = _prints(block, window, k)
                hit = estimate(least)
                at = at[hit]
                if not len(at):
                    continue
                d = block.docs()[at]
                parts.append((W.grams(h, window, 1)[at], W.grams(h, window, 2)[at], ids[block.rows.start + d].astype(np.int64), at - block.first[d]))
                held += len(at)
                if held >= flush:
                    yield from resolved(parts)
                    parts, held = [], 0
        if parts:
            yield from resolved(parts)

    return docs.mapInArrow(run, "h1 long, h2 long, id long, at int, stop int, done boolean")


def _kept(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            runs = batch.column(2)
            for block in W.blocks(batch.column(1), W.NON_SPACE):
                for d, row in enumerate(block.rows):
                    a, b = int(block.first[d]), int(block.first[d + 1])
                    n_words[row] = b - a
                    if not runs[row].is_valid:
                        kept.append(block.text(a, b))
                        continue
                    packed = runs[row].values.to_numpy()  # first << 32 | last + 1
                    turn = np.zeros(b - a + 1, np.int64)
                    np.add.at(turn, packed >> 32, 1)
                    np.add.at(turn, (packed & 0xFFFFFFFF) + window - 1, -1)
                    stay = np.cumsum(turn[:-1]) == 0
                    n_removed[row] = (b - a) - int(stay.sum())
                    kept.append(b" ".join(block.data[x:y].tobytes() for x, y in zip(block.starts[a:b][stay], block.ends[a:b][stay])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])

    return docs.mapInArrow(run, "id long, n_words long, n_removed long, kept binary")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, k: int = 8, cells_per_print: int = 8, max_bits: int = 27, flush: int = 750_000) -> DataFrame:
    """Per document: id, n_words, n_removed, kept (UTF-8 of the kept words, joined by one space).

    Words covered by a window of ``window`` words that also starts in a document of smaller id go.
    k: words of the k-gram under which a window is counted; max_bits: 2**max_bits cells a row of the
    sketch at most (two bits a cell on the driver and in each worker); flush: windows that a task holds.
    """
    if not 1 <= k <= window:
        raise ValueError("k has to lie in 1..window")
    left = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = left.filter("id is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    prints = 2 * size / 7 / (window - k + 2)  # about 7 bytes a word; of each window - k + 2 k-grams two are a least one
    bits = min(max_bits, max(10, int(prints * cells_per_print).bit_length()))
    bitmap = docs.sparkSession.sparkContext.broadcast(_sketch(known, window, k, bits))
    found = _repeated(known, bitmap, window, k, bits, flush)
    least = F.min("id").over(Window.partitionBy("h1", "h2"))
    gone = found.withColumn("least", least).filter("done or least < id")
    runs = gone.groupBy("id").agg(F.collect_list(F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("stop").cast("long"))).alias("runs"))
    out = _kept(left.join(runs, "id", "left").select("id", "text", "runs"), window)
    return out.withColumnRenamed("id", id_col)


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
