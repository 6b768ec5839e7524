"""Byte-level BPE encoding and decoding with overlapping chunks.

A long text is cut into chunks that overlap; chunks are pre-tokenised in parallel, each from its
own first character. Two neighbours are stitched at the first place of the overlap where
both have a pre-token boundary right after a character that isn't white space: from there on
both splits are the same, as the pattern looks at nothing before a match. The pieces
between stitches are encoded in parallel and joined in order. Where an overlap has no such
place (one endless pre-token), the two chunks are joined and split as one. Decoding concatenates the
raw bytes of the ids.

Scale: a text of one chunk is encoded where it is read, without a shuffle. Only chunks of
longer texts are dealt out; what meets in one task is one document's.

Cases: null or empty text has no ids and decodes to no bytes. Rows that share an id are
returned one by one. Other columns are ignored. The names of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOADED: dict[tuple[str, str], tuple] = {}


def encoding(path: str, pattern: str):
    """The encoding of a rank file and each id's bytes; loaded once a worker."""
    if (path, pattern) not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _LOADED[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table
    return _LOADED[path, pattern]


def encode(text: str, path: str, pattern: str) -> np.ndarray:
    return np.array(encoding(path, pattern)[0].encode_ordinary(text), "<u4")


def decode(ids: np.ndarray, path: str, pattern: str) -> bytes:
    table = encoding(path, pattern)[1]
    return b"".join([table[i] for i in ids.tolist()])


def boundaries(text: str, pattern: str, start: int = 0) -> list[int]:
    """Ends of the pre-tokens of text from start on."""
    return [m.end() for m in regex.compile(pattern).finditer(text, start)]


def stitches(chunks: list[str], ends: list[list[int]], step: int, pattern: str) -> list[int]:
    """Where the pieces of a text end. Chunk i begins at i * step; ends: of its pre-tokens, in the chunk."""
    cuts, text, offset, own = [], chunks[0], 0, set(ends[0])
    for i in range(1, len(chunks)):
        begin = i * step
        shared = [begin + e for e in ends[i] if begin + e < offset + len(text) and begin + e - offset in own and not chunks[i][e - 1].isspace()]
        if shared:
            cuts.append(shared[0])
            text, offset, own = chunks[i], begin, set(ends[i])
        else:
            text = text[: begin - offset] + chunks[i]
            own = set(boundaries(text, pattern, (cuts[-1] if cuts else 0) - offset))
    return cuts


def _encoded(rows: DataFrame, path: str, pattern: str, keep_bytes: bool) -> DataFrame:
    """Rows of key columns and text, last: the text gives way to its ids and their decoded bytes."""
    keys = rows.schema[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [encode(text or "", path, pattern) for text in part.column(len(keys)).to_pylist()]
                raw = [decode(x, path, pattern) if keep_bytes else b"" for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(raw, pa.binary())], [*(k.name for k in keys), "ids", "raw"])

    return rows.mapInArrow(run, ", ".join([*(f"{k.name} {k.dataType.simpleString()}" for k in keys), "ids binary", "raw binary"]))


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32768, overlap: int = 1024, decoded: bool = True) -> DataFrame:
    """Per document: id, n_tokens, ids (little-endian unsigned 32-bit), raw (bytes decoded from the ids, or empty).

    chunk: characters after which a further chunk begins; overlap: characters that it shares with the one before.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("overlap has to lie in 1..chunk")
    left = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    limit = chunk + overlap
    short = _encoded(left.filter(F.coalesce(F.length("text") <= limit, F.lit(True))), path, pattern, decoded)
    id_type = left.schema["id"].dataType.simpleString()

    long_ = left.filter(F.length("text") > limit).withColumn("doc", F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id()))
    cut = F.expr(f"transform(sequence(0, cast((length(text) - {overlap} - 1) div {chunk} as int)), i -> substring(text, i * {chunk} + 1, {limit}))")
    chunks = long_.select("id", "doc", F.posexplode(cut).alias("n", "text")).repartition("doc", "n")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [boundaries(text, pattern) for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32()))], ["id", "doc", "n", "text", "ends"])

    def pieces(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        texts = rows["text"].tolist()
        cuts = stitches(texts, [list(x) for x in rows["ends"]], chunk, pattern)
        whole = texts[0] + "".join(t[overlap:] for t in texts[1:])
        edges = [0, *cuts, len(whole)]
        return pd.DataFrame({"id": [rows["id"].iloc[0]] * (len(edges) - 1), "doc": rows["doc"].iloc[0], "n": range(len(edges) - 1), "text": [whole[a:b] for a, b in zip(edges, edges[1:])]})

    found = chunks.mapInArrow(split, f"id {id_type}, doc string, n int, text string, ends array<int>")
    parts = found.groupBy("doc").applyInPandas(pieces, f"id {id_type}, doc string, n int, text string").repartition("doc", "n")

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        return pd.DataFrame({"id": [rows["id"].iloc[0]], "ids": [b"".join(rows["ids"])], "raw": [b"".join(rows["raw"])]})

    longer = _encoded(parts, path, pattern, decoded).groupBy("doc").applyInPandas(joined, f"id {id_type}, ids binary, raw binary")
    out = short.unionByName(longer)
    return out.select(F.col("id").alias(id_col), F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), "ids", "raw")


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
