"""Token ids in binary files: frequency-ranked, byte-aligned, with separate control bytes.

Format of one block: a header (magic, documents, ids), the ids of each document as 32-bit counts,
control bytes (two bits an id: its length in bytes less one, four ids a byte), then the
data bytes (ranks, little-endian, without leading zero bytes). Frequent ids have small ranks and so one
byte. The table from rank to id is stored beside. Decoding looks up the four lengths of each
control byte in a table of 256 rows and gathers the data bytes column by column.

Jobs: texts are ranged and sorted by document id and tokenised once into blocks; ids are
counted over all blocks; blocks are rewritten with ranks. Blocks are rows of Parquet tables,
which Spark writes to any store. A block knows how many ids its range holds before
it, and the reader adds the totals of the ranges before, one number a range.

Scale: a task holds a block of ``block_ids`` ids and one document; what reaches the driver is one
count an id of the vocabulary and one total a range. If the tokenizer's own rules are those of ``_RULES``, no
merge crosses white space or goes from a letter to ASCII punctuation other than an apostrophe, and case
doesn't count: then a word is tokenised once a worker as long as the cache of ``cache_words`` words has room.
Texts that hold the name of an added token, and all texts under other rules, are tokenised whole.

Cases: null or empty text has only the end id. A null document id sorts first. Rows that share an id are
ordered by a hash of the text and returned one by one; they may lie in several ranges, so no id is too frequent
for a task. Ids may have any type that can be sorted. Other columns are ignored. An empty table gives
empty files.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.tables import bounded_batches, shared_folder

MAGIC = b"TWRANK01"
#: Of each control byte the lengths of its four ids.
_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.int64)
_LOADED: dict[str, "Words"] = {}
# The normaliser and the pre-tokeniser under which words can be tokenised one by one.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Words:
    """A tokenizer with a cache of words and their ids."""

    def __init__(self, path: str, cache_words: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), cache_words
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.by_words = all(rules.get(k) == v for k, v in _RULES.items())
        self.added = [t["content"] for t in rules.get("added_tokens") or []]
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def _grown(self, array: np.ndarray, size: int) -> np.ndarray:
        return array if len(array) >= size else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])

    def places(self, words: list[str]) -> np.ndarray:
        """Where the ids of these words, which are distinct, stand in the cache."""
        found = [self.place.get(w, -1) for w in words]
        new = [w for w, p in zip(words, found) if p < 0]
        if not new:
            return np.array(found, np.int64)
        if len(self.place) + len(new) > self.limit:
            self.clear()
            found, new = [-1] * len(words), words
        fresh = len(self.place)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            n, sizes = len(self.place), np.fromiter(map(len, ids), np.int64, len(ids))
            held = self.used + int(sizes.sum())
            self.flat = self._grown(self.flat, held)
            self.starts = self._grown(self.starts, n + len(part) + 1)
            self.flat[self.used : held] = np.fromiter(chain.from_iterable(ids), np.uint32, held - self.used)
            self.starts[n : n + len(part) + 1] = self.used + np.concatenate([[0], np.cumsum(sizes)])
            self.used = held
            self.place.update(zip(part, range(n, n + len(part))))
        where = np.array(found, np.int64)
        where[where < 0] = np.arange(fresh, fresh + len(new))
        return where

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text's with end behind, and how many each has."""
        whole = np.full(len(texts), not self.by_words)
        for name in self.added:
            whole |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        plain = pc.ascii_lower(pc.replace_substring_regex(plain, r"(\pL)([!-&(-/:-@\[-`{-~])", r"\1 \2"))
        lists = pc.ascii_split_whitespace(plain)
        coded = lists.flatten().dictionary_encode()
        where = self.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        sizes = self.starts[where + 1] - self.starts[where]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[where] - (ends - sizes), sizes)]
        edges = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        counts = np.diff(edges)
        if whole.any():
            parts = [np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32) if whole[i] else ids[edges[i] : edges[i + 1]] for i in range(len(texts))]
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        out = np.full(len(ids) + len(counts), end, np.uint32)
        last = np.cumsum(counts + 1) - 1
        inside = np.ones(len(out), bool)
        inside[last] = False
        out[inside] = ids
        return out, counts + 1


def words_of(path: str, cache_words: int) -> Words:
    if path not in _LOADED:
        _LOADED[path] = Words(path, cache_words)
    return _LOADED[path]


def pack(ranks: np.ndarray, counts: np.ndarray) -> bytes:
    """A block of the ranks of some documents, counts of each."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    starts = np.cumsum(extra + 1) - extra - 1
    data = np.zeros(int((extra + 1).sum()), np.uint8)
    for i in range(4):
        own = extra >= i
        data[starts[own] + i] = ranks[own] >> 8 * i & 0xFF
    return MAGIC + struct.pack("<IQ", len(counts), len(ranks)) + counts.astype("<u4").tobytes() + control.tobytes() + data.tobytes()


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and counts of a block."""
    if block[:8] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, n = struct.unpack_from("<IQ", block, 8)
    raw = np.frombuffer(block, np.uint8, offset=20)
    counts = raw[: 4 * docs].view("<u4").astype(np.int64) if docs else np.zeros(0, np.int64)
    control, data = raw[4 * docs : 4 * docs + -(-n // 4)], raw[4 * docs + -(-n // 4) :]
    sizes = _LENGTHS[control].reshape(-1)[:n]
    starts = np.cumsum(sizes) - sizes
    ranks = data[starts].astype(np.uint32)
    for i in range(1, int(sizes.max(initial=1))):
        own = np.flatnonzero(sizes > i)
        ranks[own] |= data[starts[own] + i].astype(np.uint32) << np.uint32(8 * i)
    return ranks, counts


def _tokenised(docs: DataFrame, path: str, end: int, block_ids: int, cache_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = words_of(path, cache_words), TaskContext.get().partitionId()
        before = 0
        keys, ids, counts, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            own = pa.concat_arrays(keys)
            docs = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            coded = [pa.array([x], pa.binary()) for x in (np.concatenate(counts).astype("<u4").tobytes(), np.concatenate(ids).astype("<u4" if wide else "<u2").tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), docs, *coded], ["part", "before", "docs", "counts", "ids"])

        wide = words.tokenizer.get_vocab_size() > 1 << 16 or end >= 1 << 16
        for batch in batches:
            texts = batch.column(1).fill_null("")
            size = np.maximum(1, np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]))
            group = np.cumsum(size) // (1 << 22)  # about 4 MB of text at a time
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                own, n = words.encode(texts.slice(at[0], len(at)), end)
                keys.append(batch.column(0).slice(at[0], len(at)))
                ids.append(own)
                counts.append(n)
                held += len(own)
                if held >= block_ids:
                    yield out()
                    before, keys, ids, counts, held = before + held, [], [], [], 0
        if keys:
            yield out()

    return docs.select("id", "text").mapInArrow(run, f"part int, before long, docs array<{docs.schema['id'].dataType.simpleString()}>, counts binary, ids binary")


def _ids(row_ids: bytes, row_counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts = np.frombuffer(row_counts, "<u4").astype(np.int64)
    return np.frombuffer(row_ids, "<u2" if len(row_ids) == 2 * counts.sum() else "<u4").astype(np.int64), counts


def _frequencies(blocks: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids, counts in zip(batch.column(0), batch.column(1)):
                own = np.bincount(_ids(ids.as_py(), counts.as_py())[0], minlength=len(total))
                own[: len(total)] += total
                total = own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = blocks.select("ids", "counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(max(rows["id"].to_pylist(), default=0) + 1, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1_000_000, cache_words: int = 600_000) -> None:
    """Writes folder/blocks and folder/ranks in ascending order of document ids.

    tokenizer: a file of the tokenizers library; end_id: the id that ends each document.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    left = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = left.repartitionByRange("id", "h").sortWithinPartitions("id", "h")
    raw = f"{folder}/raw"
    _tokenised(ranged, tokenizer, end_id, block_ids, cache_words).write.parquet(raw)
    raw_blocks = spark.read.parquet(raw)
    counts = _frequencies(raw_blocks)
    order = np.lexsort((np.arange(len(counts)), -counts))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    shared = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, n = _ids(batch.column(4)[i].as_py(), batch.column(3)[i].as_py())
                block = pack(shared.value[own], n)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(3)), pa.array([len(own)], pa.int64()), pa.array([block], pa.binary())], ["part", "before", "docs", "n_ids", "block"])

    raw_blocks.select("part", "before", "docs", "counts", "ids").mapInArrow(run, f"part int, before long, docs {raw_blocks.schema['docs'].dataType.simpleString()}, n_ids long, block binary").write.parquet(f"{folder}/blocks")
    spark.createDataFrame([(order.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{folder}/ranks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit)."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one a range
    starts, at = {}, 0
    for part, n in totals:
        starts[part], at = at, at + n
    ids_of = np.frombuffer(spark.read.parquet(f"{folder}/ranks").first()["ids"], "<u4")
    shared = spark.sparkContext.broadcast((ids_of, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, starts = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ranks, counts = unpack(batch.column(3)[i].as_py())
                ids, edges = ids_of[ranks], np.concatenate([[0], np.cumsum(counts)])
                first = starts[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(2)[i].values, pa.array(first + edges[:-1]), pa.array([ids[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], ["doc_id", "start", "ids"])

    return blocks.select("part", "before", "docs", "block").mapInArrow(run, f"doc_id {blocks.schema['docs'].dataType.elementType.simpleString()}, start long, ids binary")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_token_files(spark, folder).select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
