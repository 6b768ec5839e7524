"""A corpus pipeline of five operators; each stage reads what the one before has written.

language_id    documents whose language can't be told go: null, empty or without a letter, or no language has a positive value.
line_dedup     lines similar to an earlier line go; a document of which all lines with a word have gone goes.
ngram_jaccard  of documents linked by five-word shingles at 0.8 or more the one of smallest id stays.
decontaminate  documents that share a passage with the benchmark go.
byte_bpe       texts become ids; the last stage returns doc_id, n_tokens, ids and a hash of the bytes they decode to.

Cases, in every stage: a null text is an empty one. Of rows that share an id line_dedup judges each; ngram_jaccard lets the one stay
whose text has the least hash (then the least row), and the others go. Rows without an id are judged by language_id, decontaminate and byte_bpe one by one; line_dedup and ngram_jaccard, which order
documents by id, let them pass. An empty table stays empty. Columns other than those of documents are dropped by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, decontaminate, jaccard, langid, lines
from tidewright.llm.tables import removed, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, langid.train(docs))
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") > 0)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(docs, min_words=1)
    left = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(docs, n=5, percent=80)
    others = found.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti").select(*COLUMNS)
    # Of rows of one id the one of least hash stays, wherever they lie; ids that repeat are few, so only their rows are grouped.
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    row = F.struct(*COLUMNS)
    least = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), row.alias("row"))).alias("x")).select("x.row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(least.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Rows are told apart by id and text, so that those without an id are judged one by one.
    keyed = docs.withColumn("__key", F.concat_ws(":", F.md5(F.coalesce("text", F.lit(""))), "doc_id"))
    found = decontaminate.decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__key")
    return keyed.join(found.filter("contaminated").select("__key"), "__key", "left_anti").select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids", F.sha2("raw", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: Language models, near-duplicate components and merges of byte pairs can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            removed(before)
        docs = before = out
    return docs
