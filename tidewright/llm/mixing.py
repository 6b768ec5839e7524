"""Mixing sources to target weights, in SQL functions only.

Words are summed by source and each source gets a target: its weight's part of ``percent`` percent of all words. Targets stop
at ``most`` times what the source has, and what is above goes to the other sources by weight, until none is above. A
source's rate is target / words (0 without words). Each document is taken floor(rate) times, and once more with the
fraction as probability: a draw from the SHA-256 of the document's key. One hash holds ``DRAWS`` draws of 32 bits; a source
uses that one of them with which its words come nearest its target (the first on a tie), so that one long document doesn't upset a small source.

Scale: texts are read once, for sizes and draws, which are written. Sums by source are combined before the shuffle, so a source
with a third of all rows is no hot key there. Sources are ranked by ranges and targets are found by aggregates over the
table of sources, however many there are. The join back is salted by document; its small side is repeated ``_SALTS`` times, and broadcast
only if Spark finds at run time that it is small.

Cases: a null or empty text has 0 words and is taken as often as any other of its source. Null sources are one source, the last. The key of a
document is its id, or the SHA-256 of its text where the id is null: rows of one key and source are taken alike. An
empty table gives an empty one. Without any word all targets are 0. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.tables import ranked, removed, salted_join, written

#: Draws in one hash, and the rounds after which sharing out must have settled.
DRAWS, _ROUNDS = 8, 1000
ADDED = ["size", "source_size", "target", "rate", "copies"]


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; no array of words is made."""
    marks = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]+", "a")
    return F.length(F.translate(marks, " \t\n\x0b\f\r", "")).cast("long")


def _draw(digest: Column, k: Column) -> Column:
    """The k-th number of a hash, from 0 up to 1."""
    return F.conv(F.substring(digest, k * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(float(1 << 32))


def _copies(rate: Column, draw: Column) -> Column:
    return F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] | DataFrame, percent: int, most: int) -> DataFrame:
    """source, words, target of the sources of sizes (source, size). weights: repeated over the sources in order of
    their names, nulls last; or a table source, weight (whole numbers; other sources get none)."""
    sums = written(sizes.groupBy("source").agg(F.sum("size").alias("words")), "mix-sources")
    if isinstance(weights, DataFrame):
        own = weights.select(F.col("source").alias("__s"), F.col("weight").cast("long").alias("weight"))
        weighed = sums.join(own, sums["source"].eqNullSafe(own["__s"]), "left").select("source", "words", F.coalesce("weight", F.lit(0)).alias("weight"))
    else:
        at = (F.col("rank") % len(weights) + 1).cast("int")
        weighed = ranked(sums, [F.col("source").asc_nulls_last()]).select("source", "words", F.element_at(F.array(*map(F.lit, weights)), at).cast("long").alias("weight"))
    table = written(weighed.select("*", F.col("words").cast("decimal(38,0)").alias("w"), F.col("weight").cast("decimal(38,0)").alias("share")), "mix-weights")
    removed(sums)
    total = table.agg(F.sum("w")).first()[0] or 0
    # A source is full if words * most * 100 * (weights that share) < weight * (what is left to share, in hundredths).
    full, found = F.lit(False), None
    for _ in range(_ROUNDS):
        open_, used = table.agg(F.sum(F.when(~full, F.col("share"))), F.sum(F.when(full, F.col("w")))).first() or (0, 0)
        state = (int(open_ or 0), percent * int(total) - 100 * most * int(used or 0))
        if state == found:
            break
        found = state
        as_decimal = lambda x: F.lit(str(x)).cast("decimal(38,0)")
        full = (F.col("w") * 100 * most * as_decimal(state[0])) < (F.col("share") * as_decimal(state[1])) if state[0] else F.lit(True)
    else:
        raise RuntimeError("targets didn't settle")
    share = (F.col("share") * F.lit(str(found[1])).cast("decimal(38,0)")).cast("double") / F.lit(float(100 * found[0] or 1))
    out = written(table.select("source", "words", F.when(full, (F.col("words") * most).cast("double")).otherwise(share).alias("target")), "mix-targets")
    removed(table)
    return out


def _plan(docs: DataFrame, kept: list[str], weights: tuple[int, ...] | DataFrame, percent: int, most: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row (the columns kept), size, source_size, target, rate, copies."""
    text = F.col(f"`{text_col}`").cast("string")
    key = F.coalesce(F.concat(F.lit("i"), F.col(f"`{id_col}`").cast("string")), F.concat(F.lit("t"), F.sha2(F.coalesce(text, F.lit("")), 256)))
    described = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{source_col}`").alias("source"), n_words(text).alias("size"), F.sha2(key, 256).alias("digest"))
    sizes = written(described, "mix-sizes")
    targets = source_targets(sizes.select("source", "size"), weights, percent, most)
    rated = targets.withColumn("rate", F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0))
    drawn = salted_join(sizes.select("source", "size", "digest"), rated, "source", "digest")
    copies = [_copies(F.col("rate"), _draw(F.col("digest"), F.lit(k))) for k in range(DRAWS)]
    # The draw of each source: of all the one whose words come nearest the target.
    taken = drawn.groupBy("source", "words", "target", "rate").agg(*[F.sum(F.col("size") * c).alias(f"t{k}") for k, c in enumerate(copies)])
    nearest = F.least(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(DRAWS)])["k"]
    chosen = written(taken.select("source", "words", "target", "rate", nearest.alias("k")), "mix-draws")
    removed(targets)
    own = _copies(F.col("rate"), _draw(F.col("digest"), F.col("k")))
    return salted_join(sizes, chosen, "source", "digest").select("row", "size", F.col("words").alias("source_size"), "target", "rate", own.alias("copies"))


def planned(docs: DataFrame, weights: tuple[int, ...] | DataFrame = (5, 2, 1), percent: int = 150, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs (all but the text if None) with size, source_size, target, rate and copies; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ADDED and (c != text_col if keep is None else c in keep)]
    return _plan(docs, kept, weights, percent, most, id_col, text_col, source_col).select("row.*", *ADDED)


def mixed(docs: DataFrame, weights: tuple[int, ...] | DataFrame = (5, 2, 1), percent: int = 150, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with copy (from 0; a column of that name is replaced)."""
    plan = _plan(docs, [c for c in docs.columns if c != "copy"], weights, percent, most, id_col, text_col, source_col)
    return plan.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*", F.col("copy") - 1).toDF(*[c for c in docs.columns if c != "copy"], "copy")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = planned(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
