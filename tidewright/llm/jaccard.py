"""N-gram Jaccard join under several global token orders.

A document's set is its distinct word n-grams. Documents with equal sets are one class and joined once.
Tokens are ordered by a class of rarity (occurrences are counted in ``2**bits`` hashed cells) and,
within it, by hash. In such an order two similar sets share a token within their prefixes, and at the
first shared token enough tokens have to remain on both sides: that is the positional
filter, and it leaves the smaller set a prefix of about half the length. Candidates are found under the first
order; they stay if their prefixes also share a token under each further order (other hashes),
which are compared as 16-bit values, so a coincidence may add a candidate and none is lost. Bits of
parity by part of the tokens bound the difference of two sets from below and drop pairs a little
below the threshold where buckets are joined. The sets of what is left are made again from the texts and compared whole, by 64-bit hashes of
their n-grams (n-grams of one document with equal hashes would count once).

Components need no link between documents already connected. So each token's bucket first links its
members to its least id, then, for ``rounds`` rounds, those of other components to a member chosen by
hash; only members that then still lie in different components are compared with each other. A large
group of near copies costs its size a round, not its square.

Scale: texts are read for counting, for sets, and for the pairs left. Buckets are joined by
shuffles that Spark splits when hot; the table of counts has a bounded size. Links and components stay in
tables of the shared folder.

Cases: ids have to be whole numbers. Null or empty text, or text without words: n_shingles 0, linked with nothing. Fewer words than n:
the whole sequence is the only n-gram. Rows of one id are one node; rows with a null id are returned without a
component. Repeated rows are returned each time. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import words as W
from tidewright.llm.components import components
from tidewright.llm.tables import bounded_batches, removed, written


#: A set's tokens are dealt into 2**PARITY_BITS parts; a bit says whether a part has an odd number of them.
PARITY_BITS = 9


def ceil_div(x, y):
    return -(-x // y)


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each text."""
    for block in W.blocks(column, W.NON_SPACE, fold=True):
        h = block.hashes()
        g = W.grams(h, n)
        for d, row in enumerate(block.rows):
            a, b = int(block.first[d]), int(block.first[d + 1])
            if b - a >= n:
                yield row, np.unique(g[a : b - n + 1])
            elif b > a:
                yield row, W.mix(W.grams(h[a:b], b - a) + np.uint64(b - a))
            else:
                yield row, np.zeros(0, np.uint64)


def _cell(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (W.mix(tokens) >> np.uint64(64 - bits)).astype(np.int64)


def _rarity(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """Of each cell a class that grows with its count; below twice the mean it is 0."""
    part = 1 << min(bits, 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            for block in W.blocks(batch.column(1), W.NON_SPACE, fold=True):
                h = block.hashes()
                g = W.grams(h, n)
                at = np.arange(len(g))
                own, times = np.unique(_cell(g[at + n <= block.ends_of_docs()[: len(g)]], bits), return_counts=True)
                counts[own] = np.minimum(counts[own].astype(np.int64) + times, 65_535)
        if counts.any():
            for i in range(0, len(counts), part):
                yield pa.RecordBatch.from_arrays([pa.array([i // part], pa.int32()), pa.array([pa.compress(counts[i : i + part].tobytes(), "zstd", asbytes=True)], pa.binary())], ["block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(pa.decompress(cells.as_py(), 2 * part, "zstd"), np.uint16)
                sums[block] = sums.get(block, 0) + own.astype(np.int64)
        for block, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(at + block * part), pa.array(own[at])], ["cell", "count"])

    sums = docs.mapInArrow(count, "block int, cells binary").repartition("block").mapInArrow(merge, "cell long, count long")
    sums = written(sums, "cells")  # partitions hold whole blocks, but a block met twice is added up here
    total = sums.agg(F.sum("count")).first()[0] or 0
    mean = total / (1 << bits)
    rows = sums.groupBy("cell").agg(F.sum("count").alias("count")).filter(F.col("count") >= max(2, 2 * mean)).toArrow()  # at most half the cells
    removed(sums)
    classes = np.zeros(1 << bits, np.uint8)
    counts = rows["count"].to_numpy()
    classes[rows["cell"].to_numpy()] = np.log2(np.maximum(counts, 2)).astype(np.uint8)
    return classes


def _described(docs: DataFrame, classes, n: int, percent: int, bits: int, orders: int) -> DataFrame:
    """Per document: size, two hashes of the set, prefix tokens in the first order, 16-bit prefixes in the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, s1, s2, tokens, others, parity = [], [], [], [], [], []
                for _, own in _sets(part.column(1), n):
                    sizes.append(len(own))
                    s1.append(np.int64(W.mix(own).sum(dtype=np.uint64).astype(np.int64)))
                    s2.append(np.int64(W.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    prefix = len(own) - ceil_div(percent * len(own), 100) + 1 if len(own) else 0
                    rank = table[_cell(own, bits)] if len(own) else own
                    tokens.append(own[np.lexsort((own, rank))[:prefix]].view(np.int64))
                    odd = np.bincount((W.mix(own ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - PARITY_BITS)).astype(np.int64), minlength=1 << PARITY_BITS) & 1
                    parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                    rest = []
                    for k in range(1, orders):
                        other = W.mix(own + np.uint64(k * 7919))
                        rest.append(np.unique((other[np.lexsort((other, rank))[:prefix]] & np.uint64(0xFFFF)).astype(np.uint16)).astype(np.int32))
                    others.append(rest)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.list_(pa.int32()))), pa.array(parity, pa.list_(pa.int64()))],
                    ["id", "n", "s1", "s2", "tokens", "others", "parity"],
                )

    return docs.mapInArrow(run, "id long, n int, s1 long, s2 long, tokens array<long>, others array<array<int>>, parity array<long>")


def _overlap(n1: Column, n2: Column, percent: int) -> Column:
    """The least intersection of similar sets: percent / (100 + percent) of the sum of sizes, rounded up."""
    return F.expr(f"(({percent} * ({n1} + {n2})) + {100 + percent} - 1) div {100 + percent}")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets, made from the texts, are similar, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                good = []
                for (_, x), (_, y) in zip(_sets(part.column(2), n), _sets(part.column(3), n)):
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    good.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
                kept = part.filter(pa.array(good, pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    pairs = written(pairs, "pairs")
    sides = pairs
    for x in "ab":  # only texts of documents that stand in a pair are shuffled
        own = texts.join(pairs.select(F.col(x).alias("id")).distinct(), "id", "left_semi")
        sides = sides.join(own.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")), x)
    both = sides.select("a", "b", "text_a", "text_b")
    links = written(both.mapInArrow(run, "a long, b long"), "links")
    removed(pairs)
    return links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90, orders: int = 3, max_bits: int = 24, rounds: int = 2) -> DataFrame:
    """Per document: id, n_shingles, component_id (the least id reachable by links of Jaccard similarity percent / 100 or more).

    n: words of a shingle; orders: global token orders; max_bits: 2**max_bits cells of the rarity table at most (a byte each in every worker); rounds: of links to one member a bucket before members are compared with each other.
    """
    if not 0 < percent <= 100 or orders < 1:
        raise ValueError("percent has to lie in 1..100 and orders be 1 or more")
    spark = docs.sparkSession
    bounded_batches(spark)
    left = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = left.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max_bits, max(10, int(size / 7 / 12).bit_length()))
    classes = spark.sparkContext.broadcast(_rarity(left, n, bits))
    described = written(_described(left, classes, n, percent, bits, orders), "sets")
    known = described.filter("id is not null and n > 0")
    reps = known.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("others").alias("others"), F.first("parity").alias("parity"))
    reps, sets = written(reps, "classes"), described
    described = written(sets.select("id", "n", "s1", "s2"), "set-keys")
    removed(sets)

    # Buckets of two or more, one of which at least can be the smaller of a pair there.
    rows = reps.select("rep", "n", F.posexplode("tokens").alias("pos", "token")).withColumn("small", F.expr(f"pos <= n - ({2 * percent} * n + {100 + percent} - 1) div {100 + percent}"))
    full = rows.groupBy("token").agg(F.count("*").alias("c"), F.max("small").alias("any_small"), F.min(F.struct("rep", "n", "pos")).alias("pivot")).filter("c > 1 and any_small")
    buckets = written(rows.join(full.select("token", "pivot"), "token"), "buckets")

    def fits(n1: str, p1: str, n2: str, p2: str) -> Column:
        need = _overlap(n1, n2, percent)
        return (F.expr(f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2})")) & (F.expr(f"{n1} - {p1}") >= need) & (F.expr(f"{n2} - {p2}") >= need)

    def even(n1: str, x: str, n2: str, y: str) -> Column:
        """Each part of odd parity in one set only holds a token that the other lacks; similar sets have few of these."""
        differ = " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(max(1, (1 << PARITY_BITS) // 64)))
        return F.expr(differ) <= F.expr(f"{n1} + {n2}") - 2 * _overlap(n1, n2, percent)

    def filtered(pairs: DataFrame) -> DataFrame:
        """Pairs whose prefixes also share a token under each further order, and whose parities agree well enough."""
        pairs = pairs.distinct()
        for x in "ab":
            pairs = pairs.join(reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("others").alias(f"others_{x}"), F.col("parity").alias(f"parity_{x}")), x)
        pairs = pairs.filter(even("n_a", "parity_a", "n_b", "parity_b"))
        shared = F.forall(F.arrays_zip("others_a", "others_b"), lambda z: F.arrays_overlap(z["others_a"], z["others_b"]))
        return pairs.filter(shared).select("a", "b").distinct()

    texts = left.filter("id is not null")
    stars = buckets.filter("rep <> pivot.rep").filter(fits("n", "pos", "pivot.n", "pivot.pos"))
    links = _verified(filtered(stars.select(F.col("rep").alias("a"), F.col("pivot.rep").alias("b"))), texts, n, percent)
    found = components(links)
    removed(links)

    member, table = buckets.drop("pivot"), buckets
    for k in range(rounds + 1):
        placed = member.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        pivot = F.min(F.struct(F.xxhash64(F.lit(k), "token", "rep").alias("h"), "rep", "n", "pos", "component")).alias("pivot")
        open_ = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), pivot).filter("low <> high").select("token", "pivot")
        placed = written(placed.join(open_, "token"), "open")
        removed(table)
        member, table = placed.drop("component", "pivot"), placed
        if k == rounds:
            break
        stars = placed.filter("component <> pivot.component").filter(fits("n", "pos", "pivot.n", "pivot.pos"))
        links = _verified(filtered(stars.select(F.least("rep", "pivot.rep").alias("a"), F.greatest("rep", "pivot.rep").alias("b"))), texts, n, percent)
        before, found = found, components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
        removed(links, before)
    member = placed.drop("pivot").join(reps.select("rep", "parity"), "rep")
    x = member.filter("small").select("token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("component").alias("ca"), F.col("parity").alias("qa"))
    y = member.select("token", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("component").alias("cb"), F.col("parity").alias("qb"))
    rest = x.join(y, "token").filter("ca <> cb and (na < nb or na = nb and a < b)").filter(fits("na", "pa", "nb", "pb")).filter(even("na", "qa", "nb", "qb")).select("a", "b")
    more = _verified(filtered(rest), texts, n, percent)
    final = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    classes_of = written(reps.select("s1", "s2", "rep").join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component")), "set-components")
    removed(reps, table, found, more, final)
    # Keys of empty sets and null ids are their own, so that they don't meet in one task.
    out = described.select("id", "n", F.when(F.col("n") > 0, F.col("s1")).otherwise(F.xxhash64("id")).alias("s1"), F.when(F.col("n") > 0, F.col("s2")).alias("s2"))
    out = out.join(classes_of, ["s1", "s2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
