"""Secret scans by patterns and by character Markov models.

Patterns give the base spans. Beside them, strings of 20 or more of the characters that keys are made of
are scored by two first-order character models, one of random strings and one of ordinary
identifiers: the log-likelihood ratio of the string's character pairs. Strings whose ratio reaches a
threshold and that overlap no base span are added. Both models are counted from labelled samples.

Only SQL functions touch the rows. A pattern's matches and the pieces between them give the
offsets: lengths are summed up in blocks, so a text with many matches stays near linear. The models'
ratios are a literal of 128 x 128 numbers.

Scale: one pass over the rows without a shuffle. Training reads a bounded sample of documents.

Cases: null text is empty and has no spans. Matches of one kind don't overlap; of different kinds they may.
Rows that share an id are returned one by one. Other columns are ignored. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Patterns of the base kinds, in their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]
#: What the models look at: a run of key characters, with a letter and a digit in it.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_VALUE = 6


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def running(numbers: Column, block: int = 256) -> Column:
    """Running sums of an int array: sums of blocks first, then within each block."""

    def within(a: Column, sums: Column) -> Column:
        base = F.transform(sums, lambda _, i: _sum(F.slice(sums, F.lit(1), i)))
        return let(base, lambda before: F.transform(a, lambda _, i: F.get(before, (i / block).cast("int")) + _sum(F.slice(a, (i / block).cast("int") * block + 1, i % block + 1))))

    def blocks(a: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / block).cast("int")), lambda b: _sum(F.slice(a, b * block + 1, F.lit(block))))
        return let(sums, lambda s: within(a, s))

    return let(numbers, blocks)


_SPAN = "array<struct<text:string,start:int,end:int>>"


def located(text: Column, pattern: str, quick: str | None = None) -> Column:
    """Matches of a pattern with their places: an array of text, start, end."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.transform(F.split(text, pattern, -1), lambda s: F.length(s)).alias("g"))

    def placed(z: Column) -> Column:
        m = z["m"]
        steps = F.transform(m, lambda x, i: F.get(z["g"], i) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0))
        # Sums of gaps and of the matches before.
        return let(running(steps), lambda starts: F.transform(m, lambda x, i: F.struct(x.alias("text"), F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(x)).alias("end"))))

    return F.when(F.coalesce(text.rlike(quick or pattern), F.lit(False)), let(found, placed)).otherwise(F.lit(None)).cast(_SPAN)


def _pairs(text: Column) -> Column:
    """Character pairs of an ASCII text as 128 * first + second."""
    return let(F.split(text, ""), lambda c: F.zip_with(c, F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.ascii(a) * 128 + F.ascii(b)))


def fit(samples: DataFrame, smoothing: float = 0.5, letters: int = 66) -> list[float]:
    """Log-likelihood ratios of character pairs from rows of text and label (1 random, 0 ordinary)."""
    pairs = samples.select("label", F.explode(_pairs(F.col("text"))).alias("pair")).filter("pair is not null and pair between 0 and 16383")
    counts = {0: {}, 1: {}}
    for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect():  # two tables of 128 x 128 at most
        counts[int(r["label"])][r["pair"]] = r["n"]
    sums = {k: [sum(v.get(128 * a + b, 0) for b in range(128)) for a in range(128)] for k, v in counts.items()}
    return [math.log((counts[1].get(p, 0) + smoothing) / (sums[1][p // 128] + smoothing * letters)) - math.log((counts[0].get(p, 0) + smoothing) / (sums[0][p // 128] + smoothing * letters)) for p in range(1 << 14)]


def ratio(text: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a text: over 0 speaks for a random string."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")  # a constant after folding
    return F.aggregate(_pairs(text), F.lit(0.0), lambda s, p: s + F.coalesce(F.get(table, p), F.lit(0.0)))


def default_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2000, n_random: int = 4000) -> DataFrame:
    """Labelled samples: random strings of several alphabets, made here; identifiers made of words of a bounded sample of documents, and numbers."""
    spark: SparkSession = docs.sparkSession
    seeds = spark.range(n_random).select("id", F.sha2(F.concat(F.lit("seed"), F.col("id").cast("string")), 256).alias("h"))
    random = seeds.select(F.when(F.col("id") % 3 == 0, F.col("h")).when(F.col("id") % 3 == 1, F.base64(F.unhex("h"))).otherwise(F.upper(F.translate(F.base64(F.unhex("h")), "+/=", "xyz"))).alias("text"), F.lit(1).alias("label"))
    numbers = seeds.filter("id % 10 = 0").select(F.regexp_replace(F.format_string("%020d", F.abs(F.xxhash64("id"))), "^", "20").alias("text"), F.lit(0).alias("label"))
    ids = [r["id"] for r in docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string")).alias("h")).filter("id is not null").orderBy("h", "id").limit(sample_docs).collect()]
    some = docs.filter(F.col(id_col).isin(ids)).select(F.col(text_col).cast("string").alias("t")) if ids else docs.select(F.lit(None).cast("string").alias("t")).limit(0)
    words = some.select(F.explode(F.regexp_extract_all("t", F.lit(r"\b[A-Za-z]{2,19}\b"), F.lit(0))).alias("w")).select(F.lower("w").alias("w"), F.initcap("w").alias("c"), F.upper("w").alias("u"), F.pmod(F.xxhash64("w"), F.lit(4)).alias("k"))
    shaped = words.select(F.when(F.col("k") == 0, F.concat_ws("_", "w", "w")).when(F.col("k") == 1, F.concat("w", "c")).when(F.col("k") == 2, F.concat_ws("_", "u", "u")).otherwise(F.concat_ws("-", "w", "w")).alias("text"), F.lit(0).alias("label"))
    plain = words.select(F.concat("w", "w").alias("text"), F.lit(0).alias("label"))
    return random.unionByName(numbers).unionByName(shaped).unionByName(plain)


def find_secrets(docs: DataFrame, model: list[float] | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 8.0) -> DataFrame:
    """Per row: id, base and spans (arrays of start, kind, end; kind counts in KINDS, from 0).

    model: of fit(), or None for base spans only; threshold: the ratio, in nats, from which a string is added.
    """
    left = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def kind(n: int, spans: Column) -> Column:
        return F.coalesce(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"))), F.array().cast("array<struct<start:int,kind:int,end:int>>"))

    text = F.col("text")
    assigned = F.filter(located(text, ASSIGN, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= LEAST_VALUE)
    out = left.withColumn("base", F.array_sort(F.concat(kind(0, assigned), kind(1, located(text, ACCESS)), kind(2, located(text, HEX)))))
    if model is None:
        return out.select(F.col("id").alias(id_col), "base", F.col("base").alias("spans"))
    likely = F.filter(located(text, CANDIDATE), lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]") & (ratio(s["text"], model) >= threshold))
    new = F.filter(kind(3, likely), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", new)).alias("spans"))


def written_out(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_secrets(docs, fit(default_samples(docs)))
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))
