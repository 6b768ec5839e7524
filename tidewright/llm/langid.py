"""Language identification with a string kernel.

Kernel: blended-spectrum presence. Two texts are as alike as the number of character n-grams
(n from 1 to ``n_max``, lower case) that both contain, divided by the root of the product of their
numbers of n-grams. Kernel rows against some landmark texts, whitened by the landmarks' own kernel
matrix (Nyström), are the features of a one-versus-rest ridge regression.

The kernel with the landmarks is linear in a text's n-grams, so landmarks and weights fold
into one table, n-gram by language, and a batch is scored as one presence-by-table product.
Only n-grams of the landmarks have a row there; a text's further n-grams count for its number of n-grams alone.
N-grams are told apart by 64-bit hashes.

Scale: training takes a bounded sample: of each language the ``per_language`` rows of least hash of id and
text, with texts of up to ``max_chars`` characters; only they reach the driver. Scoring is one pass without a
shuffle, and only texts go through Python. The broadcast table has a row for each n-gram of ``landmarks`` texts.

Cases: a text that is null, empty or without a letter is ``und`` with score 0. Null languages aren't
learned. Without any labelled text everything is ``und``. Ties go to the language that sorts first. A text for which
no language has a positive value gets score 0: the model rejects it. Rows that share an id are returned one
by one; equal rows are learned once. Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.tables import bounded_batches
from tidewright.llm.words import TOP, mix

UNDETERMINED = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FOUND = "struct<lang_pred: string, score: double>"


def presence(text: str, n_max: int) -> np.ndarray:
    """Hashes of the n-grams in text, sorted, each once."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = np.concatenate([[np.uint64(32)], codes, [np.uint64(32)]])
    out, h = [], np.zeros(len(codes) + 1, np.uint64)
    for n in range(1, n_max + 1):
        if len(codes) < n:
            break
        h = mix(h[: len(codes) - n + 1] * _STEP + codes[n - 1 :] + np.uint64(n))
        out.append(h)
    found = np.sort(np.concatenate(out))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


class Places:
    """Where hashes stand in a sorted array of distinct ones; found by their leading bits and a few steps."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(1, int(len(keys)).bit_length() + 1)
        self.keys = np.append(keys, TOP)
        cells = np.arange((1 << self.bits) + 1, dtype=np.uint64)
        self.starts = np.append(np.searchsorted(keys, cells[:-1] << np.uint64(64 - self.bits)), len(keys)).astype(np.int32)
        self.steps = int(np.diff(self.starts).max(initial=0))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Places of those hashes that are there."""
        at = self.starts[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = []
        for _ in range(self.steps):
            hit = self.keys[at] == hashes
            out.append(at[hit])
            at, hashes = at[~hit], hashes[~hit]
            at = np.minimum(at + 1, len(self.keys) - 1)
        return np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass(frozen=True)
class Model:
    """table: n-gram of the landmarks by language; languages: its columns, sorted."""

    languages: list[str]
    places: Places
    table: np.ndarray
    n_max: int

    def scores(self, texts: list[str]) -> np.ndarray:
        """Regression values of each text and language."""
        sets = [presence(t, self.n_max) for t in texts]
        known = [self.places.of(s) for s in sets]
        # Presence times table: rows picked, then summed by text; an empty row of zeros keeps every text.
        rows = self.table[np.concatenate([np.append(k, len(self.table) - 1) for k in known])]
        sums = np.add.reduceat(rows, np.cumsum([0, *(len(k) + 1 for k in known[:-1])]), axis=0)
        return sums / np.sqrt([len(s) for s in sets])[:, None]


def fit(texts: list[str], langs: list[str], landmarks: int = 256, ridge: float = 1e-2, n_max: int = 4) -> Model:
    """A model of some labelled texts; every len(texts) / landmarks-th is a landmark."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], Places(np.zeros(0, np.uint64)), np.zeros((1, 0), np.float32), n_max)
    picked = np.unique(np.linspace(0, len(texts) - 1, min(landmarks, len(texts))).astype(int))
    keys = np.unique(np.concatenate([presence(texts[i], n_max) for i in picked]))
    places = Places(keys)
    known, sizes = [], np.zeros(len(texts))
    for k, text in enumerate(texts):  # of each text only what the landmarks have is held
        own = presence(text, n_max)
        known.append(places.of(own))
        sizes[k] = len(own) ** 0.5
    kernel = np.zeros((len(texts), len(picked)))
    for low in range(0, len(picked), 16):  # some landmarks at a time, so that memory stays with 16 columns of n-grams
        part = picked[low : low + 16]
        marks = np.zeros((len(keys), len(part)), np.float32)
        for j, i in enumerate(part):
            marks[known[i], j] = 1 / sizes[i]
        for k, (own, z) in enumerate(zip(known, sizes)):
            kernel[k, low : low + len(part)] = marks[own].sum(axis=0, dtype=np.float64) / z
    values, vectors = np.linalg.eigh(kernel[picked])
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ whiten
    target = np.array([[float(lang == x) for x in languages] for lang in langs])
    weights = whiten @ np.linalg.solve(features.T @ features + ridge * len(texts) * np.eye(features.shape[1]) / 100, features.T @ target)
    table = np.zeros((len(keys) + 1, len(languages)), np.float32)
    for i, w in zip(picked, weights):
        table[known[i]] += (w / sizes[i]).astype(np.float32)
    return Model(languages, places, table, n_max)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder by folds."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, max_languages: int = 64, max_chars: int = 20_000, **options) -> Model:
    """A model of at most per_language texts of each of the max_languages most frequent languages.

    usable: of which rows it may learn; max_chars: longer texts aren't learned from. per_language * max_languages * max_chars
    bounds what reaches the driver.
    """
    text = F.col(text_col).cast("string")
    known = docs.filter(F.lit(True) if usable is None else usable).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h"), F.col(id_col).alias("id"))
    known = known.filter("lang is not null and id is not null").drop("id")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not counts:
        return fit([], [], **options)
    # Only hashes below a bound by language, of about twice the rows wanted, are ranked.
    bound = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(2**63 - 1, int(min(1.0, (4 * per_language + 50) / n) * 2**64) - 2**63)))])
    some = known.filter(F.col("lang").isin(list(counts))).filter(F.col("h") <= F.element_at(bound, F.col("lang"))).filter((F.length("text") <= max_chars) & F.col("text").rlike(r"\p{L}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = some.dropDuplicates(["lang", "h"]).withColumn("rank", rank).filter(F.col("rank") <= per_language).select("lang", "text", "h").collect()
    rows = sorted(rows, key=lambda r: (r["h"], r["lang"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], **options)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1: the share that the best language has of all positive values); columns of these names are replaced."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_FOUND)
    def found(column: pa.Array) -> pa.Array:
        own = shared.value
        langs, scores = [UNDETERMINED] * len(column), np.zeros(len(column))
        for at in range(0, len(column), 64):
            texts = column.slice(at, 64).to_pylist()
            some = [i for i, t in enumerate(texts) if t and own.languages and any(map(str.isalpha, t))]
            if not some:
                continue
            values = np.clip(own.scores([texts[i] for i in some]), 0, None)
            best, total = values.argmax(axis=1), values.sum(axis=1)
            for i, b, v, t in zip(some, best, values.max(axis=1), total):
                langs[at + i] = own.languages[b]
                scores[at + i] = float(v / t) if t > 0 else 0.0
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    named = docs.drop("lang_pred", "score")
    said = named.withColumn("__found", found(F.col(text_col).cast("string")))
    return said.withColumn("lang_pred", F.col("__found.lang_pred")).withColumn("score", F.col("__found.score")).drop("__found")


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, ~held_out(F.col("doc_id")))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
