"""Benchmark decontamination by winnowing.

Of every run of ``window - k + 1`` word k-grams the least hash is kept, so a passage of ``window``
words keeps the same fingerprint wherever it stands: any shared passage of that length shares a
kept fingerprint. Fingerprints of documents and of benchmark items are joined, and each hit is
extended word by word to the windows around it; only equal words count, so hashes decide nothing.

Scale: documents are read once. A Bloom bitmap of the benchmark's fingerprints (its size a
parameter, whatever the benchmark's size) lets only likely hits leave the scan; they alone are
shuffled. The join isn't hinted: Spark broadcasts the benchmark's fingerprints if they are small and
splits a skewed side if not.

Cases: null or empty text has no words and no hits. Items without words have no windows; items
of fewer than ``window`` words are one window of all their words. Repeated items count as one if
their ids agree, each by its id if not; hits of items with a null id count, only the id is left out
of the list of ids. Each row of documents is judged for itself and gives one row, whether its id is null or repeated: rows are
told apart by id, a hash of the text and their place in the scan (which matters for equal rows only, so a task that runs again does no harm). Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import words as W

#: What tells rows of documents apart.
_KEY = ["id", "text_hash", "at_row"]
_FOUND = "h long, size int, at int, lead int, context binary"
_ARROW = pa.struct([("h", pa.int64()), ("size", pa.int32()), ("at", pa.int32()), ("lead", pa.int32()), ("context", pa.binary())])


def _windows_of(block: W.Block, window: int, k: int, short: list[int], whole_short: bool, test=None):
    """Yields (document in the block, hash, words of the window, first word, words before it in the context, context)."""
    h, ends = block.hashes(), block.ends_of_docs()
    n, place = len(h), np.arange(len(h))
    g = W.grams(h, k)
    valid = place[: len(g)] + window <= ends[: len(g)]
    g = np.where(place[: len(g)] + k <= ends[: len(g)], g, W.TOP)
    at = W.winnow(g, window - k + 1, valid)
    if test is not None:
        at = at[test(g[at])]
    reach = window - k
    docs = block.docs()
    for i in at:
        d = docs[i]
        low, high = max(block.first[d], i - reach), min(block.first[d + 1], i + window)
        yield d, g[i], window, i - block.first[d], i - low, block.text(low, high)
    for size in short:
        g = W.mix(W.grams(h, size) + np.uint64(size))
        own = place[: len(g)] + size <= ends[: len(g)]
        if whole_short:
            own &= (ends[: len(g)] - size == place[: len(g)]) & np.isin(place[: len(g)], block.first)
        at = np.flatnonzero(own)
        if test is not None:
            at = at[test(g[at])]
        for i in at:
            d = docs[i]
            yield d, g[i], size, i - block.first[d], 0, block.text(i, i + size)


def _benchmark_side(items: DataFrame, window: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), []
            for block in W.blocks(batch.column(1), W.ALNUM, fold=True):
                for d, h, size, _, lead, context in _windows_of(block, window, k, list(range(1, window)), True):
                    out.append((ids[block.rows[d]].as_py(), int(h.astype(np.int64)), size, lead, context))
            cols = list(zip(*out)) or [[]] * 5
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["item", "h", "item_size", "item_lead", "item_context"])

    return items.mapInArrow(run, "item string, h long, item_size int, item_lead int, item_context binary").distinct()


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom bitmap of 2**bits places, two for each hash, gathered as at most 2**bits / 64 words."""
    mask = (1 << bits) - 1
    places = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 40 - bits // 2).bitwiseAND(mask))).alias("p"))
    rows = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy().astype(np.uint64)
    return out


def _document_side(docs: DataFrame, bitmap, bits: int, window: int, k: int, short: list[int]) -> DataFrame:
    id_type = docs.schema[0].dataType.simpleString()

    def test(h: np.ndarray) -> np.ndarray:
        kept, found = bitmap.value, np.ones(len(h), bool)
        for p in (h & np.uint64((1 << bits) - 1), (h >> np.uint64(40 - bits // 2)) & np.uint64((1 << bits) - 1)):
            found &= ((kept[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for block in W.blocks(batch.column(1), W.ALNUM, fold=True):
                n_words[block.rows.start : block.rows.stop] = block.counts
                for d, h, size, at, lead, context in _windows_of(block, window, k, short, False, test):
                    row = found[block.rows[d]] = found[block.rows[d]] or []
                    row.append({"h": int(h.astype(np.int64)), "size": size, "at": at, "lead": lead, "context": context})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n_words), pa.array(found, pa.list_(_ARROW))], ["id", "text_hash", "at_row", "n_words", "found"])

    return docs.mapInArrow(run, f"id {id_type}, text_hash long, at_row long, n_words long, found array<struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>>")


def _spans(joined: DataFrame, window: int, k: int) -> DataFrame:
    """Of each pair of fingerprints the words around them that agree: (start, end) if they fill a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for size, at, lead, mine, item_size, item_lead, theirs in zip(*(batch.column(i).to_pylist() for i in range(4, 11))):
                start = end = None
                if theirs is not None and size == item_size and at is not None:
                    if size < window:
                        if mine == theirs:
                            start, end = at, at + size
                    else:
                        a, b = mine.split(b" "), theirs.split(b" ")
                        left = 0
                        while left < min(lead, item_lead) and a[lead - left - 1] == b[item_lead - left - 1]:
                            left += 1
                        right = 0
                        while right < min(len(a) - lead, len(b) - item_lead) and a[lead + right] == b[item_lead + right]:
                            right += 1
                        if right >= k and left + right >= window:
                            start, end = at - left, at + right
                starts.append(start)
                ends.append(end)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), batch.column(11)], [*_KEY, "n_words", "start", "end", "item"])

    id_type = joined.schema[0].dataType.simpleString()
    return joined.mapInArrow(run, f"id {id_type}, text_hash long, at_row long, n_words long, start int, end int, item string")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 6, bloom_bits: int = 22) -> DataFrame:
    """Per row of docs: id, n_words, spans (array of start, end in words: merged hits), n_hit, items (sorted ids as strings), contaminated,
    null_item (whether an item with a null id is among the hits).

    window: words of a passage that counts as shared; k: words of a fingerprint (1 to window);
    bloom_bits: 2**bloom_bits bits of the bitmap, at most 28 (32 MB).
    """
    if not 1 <= k <= window or not 6 <= bloom_bits <= 28:
        raise ValueError("k has to lie in 1..window and bloom_bits in 6..28")
    left = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.monotonically_increasing_id().alias("at_row"))
    right = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    prints = _benchmark_side(right, window, k)
    short = [r[0] for r in prints.filter(F.col("item_size") < window).select("item_size").distinct().collect()]  # < window rows
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(prints.select("h"), bloom_bits))
    found = _document_side(left, bitmap, bloom_bits, window, k, short).select(*_KEY, "n_words", F.explode_outer("found").alias("f"))
    # A document without hits keeps one row; its key is its own, so that such rows don't meet in one task.
    found = found.select(*_KEY, "n_words", F.coalesce("f.h", F.xxhash64(*_KEY)).alias("h"), "f.size", "f.at", "f.lead", "f.context")
    joined = found.join(prints, "h", "left").select(*_KEY, "n_words", "size", "at", "lead", "context", "item_size", "item_lead", "item_context", "item")
    spans = _spans(joined, window, k)
    per_doc = spans.groupBy(*_KEY).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("raw"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.col("item")))).alias("items"),
        F.max(F.col("start").isNotNull() & F.col("item").isNull()).alias("null_item"),
    )
    merged = F.expr(
        "aggregate(raw, cast(array() as array<struct<start:int,end:int>>), (m, s) -> case"
        " when size(m) > 0 and element_at(m, -1).end >= s.start"
        " then concat(slice(m, 1, size(m) - 1), array(named_struct('start', element_at(m, -1).start, 'end', greatest(element_at(m, -1).end, s.end))))"
        " else concat(m, array(named_struct('start', s.start, 'end', s.end))) end)"
    )
    out = per_doc.withColumn("spans", merged).withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "spans", "items", (F.col("n_hit") > 0).alias("contaminated"), "null_item")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", (F.size("items") + F.col("null_item").cast("int")).cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
