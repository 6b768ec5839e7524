"""Line deduplication as an exact set-similarity join, in SQL functions only.

A line's set is its distinct lower-case words. A line goes if an earlier line (by document id, then
line number) has a Jaccard similarity of ``percent`` / 100 or more; lines are judged on the input, so
a line that goes itself still removes later ones. Lines of fewer than ``min_words`` distinct words stay; with 1, as
the query and the pipeline have it, every line that has a word is judged.

Lines of equal sets are one class (by 128 bits of the SHA-256 of the sorted words), and all but its first go.
Of each class words are ordered by rarity: by classes of their count in ``2**bits`` hashed cells, then by hash.
Similar sets share a word in their prefixes, with enough words left behind it on both sides (positional
filter) and sizes alike (length filter). Bits of parity by part of the words bound the difference of two sets
from below and drop more pairs; what passes is verified on the words themselves.

Buckets of a word with up to ``_LARGE`` lines are joined, all lines with all earlier ones, after one shuffle of one row a word. In
larger ones the lines that haven't gone are compared with the earliest of them, in a number of rounds; only lines that then still
stay are joined with the others, by the same filters, in a join that Spark splits where it is skewed. Of a line's candidates the
earliest is verified first, and the others only if the two differ: of a group of near copies each line is mostly read once.

Scale: texts are read for word counts, for sets, and for the lines in candidate pairs, which a bitmap of a
bounded size tells apart in the scan (above it more lines than needed are joined). The rarity classes take 2**bits
bytes. Nothing else is gathered. Tables between jobs lie in the shared folder.

Cases: null or empty texts have no lines that can go and are returned as they are. Documents with one
id are compared as one document: equal lines at the same place of both stay. Rows with a null id are returned
unchanged and remove nothing. An empty table gives an empty one. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.tables import removed, written

_ID, _TEXT = "__id", "__text"
#: Distinct words that a line needs to be judged, unless said otherwise.
MIN_WORDS = 5
#: Cells of word counts and of bitmaps at most, as powers of two, and characters of a table that are put together at a time.
_WORD_BITS, _BITMAP_BITS, _PART = 18, 24, 4096
#: Classes in a bucket that are compared all with all; at most so many rounds of comparisons with one, and pairs a line that end them early, as a round that removes few does.
_LARGE, _ROUNDS, _DENSE = 1 << 8, 6, 16


def _plain(text: Column) -> Column:
    """A lower-case text with its white space but newlines as blanks; most texts have no other, so that is looked for first."""
    lowered, rare = F.lower(text), [text.contains(c) for c in "\t\x0b\f\r"]
    return F.when(rare[0] | rare[1] | rare[2] | rare[3], F.regexp_replace(lowered, r"[\t\x0B\f\r]", " ")).otherwise(lowered)


def words(line: Column) -> Column:
    """The distinct words of a line of a plain text."""
    return F.array_remove(F.array_distinct(F.split(line, " ")), "")


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _filled(entries: Column, gap: str, size: int) -> Column:
    """Texts of structs (at, text), sorted, each at its place, with gap at every place without one; size: characters in all."""
    pieces = lambda e: F.transform(e, lambda x, i: F.concat(F.repeat(F.lit(gap), x["at"] - F.coalesce(F.get(e, i - 1)["at"], F.lit(-1)) - 1), x["text"]))
    return F.rpad(F.array_join(let(entries, pieces), ""), size, "@")


def _table(cells: DataFrame, size: int) -> DataFrame:
    """One row, one binary column: of each place 64 + value (0 to 63) as a byte; cells: place (distinct), value; places without one have 0."""
    entry = lambda at, text: F.array_sort(F.collect_list(F.struct(F.col(at).cast("int").alias("at"), text.alias("text"))))
    part = min(size, _PART)
    named = cells.select(F.expr(f"place div {part}").alias("part"), (F.col("place") % part).alias("at"), F.chr(F.col("value") + 64).alias("c"))
    parts = named.groupBy("part").agg(entry("at", F.col("c")).alias("e")).select("part", _filled(F.col("e"), "@", part).alias("t"))
    return parts.agg(entry("part", F.col("t")).alias("e")).select(_filled(F.col("e"), "@" * part, size).cast("binary").alias("table"))


def _byte(table: Column, place: Column) -> Column:
    return F.ascii(F.substring(table, place.cast("int") + 1, F.lit(1)).cast("string"))


def _member_test(hashes: DataFrame, most: int = _BITMAP_BITS):
    """A test on a hash that all of hashes (one column, h) pass and few others: a bitmap with four bits a byte."""
    hashes = written(hashes.distinct(), "line-members")
    bits = min(most, max(10, int(32 * hashes.count()).bit_length()))
    cell = F.shiftrightunsigned("h", 64 - bits)
    bit = F.when(cell % 4 == 0, 1).when(cell % 4 == 1, 2).when(cell % 4 == 2, 4).otherwise(8)
    cells = hashes.groupBy(F.shiftright(cell, 2).alias("place")).agg(F.bit_or(bit).alias("value"))
    table = written(_table(cells, 1 << bits - 2), "line-bitmap")
    removed(hashes)

    def test(h: Column) -> Column:
        cell = F.shiftrightunsigned(h, 64 - bits)
        return F.coalesce(F.getbit(_byte(table.scalar(), F.shiftright(cell, 2)), (cell % 4).cast("int")) == 1, F.lit(False))

    return test


def _word_classes(plain: DataFrame, bits: int) -> Column:
    """The least tokens of the cells of words, an array that is the same for all rows, by their rarity class: the binary logarithm of the count. A word of class 0 stands in one line only."""
    seen = plain.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w")).filter("w <> ''")
    counts = seen.groupBy(F.shiftrightunsigned(F.xxhash64("w"), 64 - bits).alias("place")).agg(F.count("*").alias("n")).filter("n > 1")
    places = plain.sparkSession.range(1 << bits).withColumnRenamed("id", "place")
    cells = places.join(counts, "place", "left").select("place", F.shiftleft(F.coalesce(F.length(F.bin("n")) - 1, F.lit(0)).cast("long"), 57).alias("value"))
    table = written(cells.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), ",").alias("classes")), "line-words")
    text = table.first()["classes"]
    removed(table)
    return F.split(F.lit(text), ",").cast("array<bigint>")


def _described(plain: DataFrame, classes: Column, bits: int, percent: int) -> DataFrame:
    """Of each line: place, key of its set, size, parity, and those prefix words that may occur elsewhere, with the position of the first."""
    lines = plain.select("id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    sets = lines.select("id", "line", words(F.col("text")).alias("w"))
    # These lambdas run once a word: class and hash in one number that sorts by rarity, and parities of all words and of those with bit 6 of it.
    token = lambda h: F.get(classes, F.shiftrightunsigned(h, 64 - bits)).bitwiseXOR(F.shiftrightunsigned(h, 7))
    key = F.substring(F.unhex(F.sha2(F.array_join(F.sort_array("w"), " "), 256)), 1, 16)
    tokens = sets.select("id", "line", F.size("w").alias("n"), key.alias("key"), F.sort_array(F.transform(F.transform("w", lambda w: F.xxhash64(w)), token)).alias("t"))
    odd = lambda bit: F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", bit(t), t.bitwiseAND(63).cast("int"))))
    all_, some = odd(lambda t: F.lit(1).cast("long")), odd(lambda t: F.shiftrightunsigned(t, 6).bitwiseAND(1))
    prefix = F.expr(f"slice(t, 1, n - ({percent} * n + 99) div 100 + 1)")
    shared = tokens.select("id", "line", "n", "key", all_.alias("p1"), some.alias("p2"), F.when(F.col("n") > 0, prefix).alias("t"))
    known = shared.withColumn("words", F.filter("t", lambda t: t >= _token(1)))
    return known.select("id", "line", "n", "key", "p1", "p2", (F.size("t") - F.size("words")).alias("skip"), "words")


def _token(rarity: int) -> int:
    """The least token of a rarity class."""
    return rarity << 57


_ROW = ["id", "line", "n", "pos", "p1", "p2"]


def _exploded(lines: DataFrame) -> DataFrame:
    """Prefix words of lines, a row each."""
    rows = lines.select("id", "line", "n", "p1", "p2", "skip", F.posexplode("words").alias("i", "word"))
    return rows.select("word", "id", "line", "n", (F.col("skip") + F.col("i")).alias("pos"), "p1", "p2")


def _pairs(xs: DataFrame, ys: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y: structs of id, line) of one word, y being earlier, whose sets may be similar, once each."""
    need = f"(({percent} * (nx + ny) + {99 + percent}) div {100 + percent})"
    side = lambda rows, name: rows.select("word", *[F.col(c).alias(c + name) for c in _ROW])
    both = side(xs, "x").join(side(ys, "y"), "word").filter(
        f"100 * least(nx, ny) >= {percent} * greatest(nx, ny) and least(nx - posx, ny - posy) >= {need}"
        f" and bit_count(p1x ^ p1y ^ p2x ^ p2y) + bit_count(p2x ^ p2y) <= nx + ny - 2 * {need}"
        " and (idy < idx or idy = idx and liney < linex)"
    )
    place = lambda name: F.struct(F.col(f"id{name}").alias("id"), F.col(f"line{name}").alias("line")).alias(name)
    return both.select("idx", "linex", "idy", "liney").distinct().select(place("x"), place("y"))


class _Judge:
    """Lines of candidate pairs, read once, and the verification of pairs (x, y: structs of id, line)."""

    def __init__(self, docs: DataFrame, needed: DataFrame, percent: int):
        place = lambda: F.xxhash64("id", "line")
        test = _member_test(needed.select(place().alias("h")))
        lines = docs.select(F.col(_ID).alias("id"), F.posexplode(F.split(_plain(F.col(_TEXT)), "\n")).alias("line", "text")).filter(test(place()))
        self.sets = written(lines.select(F.struct("id", "line").alias("at"), words(F.col("text")).alias("w")), "line-texts")
        self.percent, self.tables = percent, [self.sets]

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Those x that are similar to their y; a line stands once."""
        # Each side is joined with the pairs alone, so that lines in no pair aren't shuffled where pairs are few.
        side = lambda name: pairs.join(self.sets.select(F.col("at").alias(name), F.col("w").alias(f"w{name}")), name)
        both = side("x").join(side("y"), ["x", "y"])
        sized = both.select("x", F.size(F.array_intersect("wx", "wy")).alias("s"), (F.size("wx") + F.size("wy")).alias("n"))
        out = written(sized.filter(f"100 * s >= {self.percent} * (n - s)").select("x").distinct(), "lines-similar")
        self.tables.append(out)
        return out


def _hot_rounds(hot: DataFrame, judge: _Judge, percent: int) -> tuple[DataFrame, DataFrame]:
    """Lines of large buckets that have gone after rounds of comparisons with one line of each bucket, and the pairs still to be judged."""
    total, gone, tried, state = hot.count(), None, None, hot
    for _ in range(_ROUNDS):
        pivots = state.groupBy("word").agg(F.min(F.struct(*_ROW)).alias("p")).select("word", "p.*")
        pairs = written(_pairs(state, pivots, percent), "line-hot-stars")
        found = judge.similar(pairs)
        judge.tables.append(pairs)
        gone = found if gone is None else gone.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        rest = state.join(pivots.select("word", "id", "line"), ["word", "id", "line"], "left_anti").join(found.select("x.*"), ["id", "line"], "left_anti")
        state = written(rest, "line-open")
        judge.tables.append(state)
        work = state.groupBy("word").count().join(hot.groupBy("word").agg(F.count("*").alias("c")), "word").agg(F.sum(F.col("count") * F.col("c"))).first()[0] or 0
        if work <= _DENSE * total or found.count() < total >> 8 or found.isEmpty():
            break
    stay = hot.join(gone.select("x.*").distinct(), ["id", "line"], "left_anti")
    return gone, _pairs(stay, hot, percent).join(tried, ["x", "y"], "left_anti")


def removed_lines(docs: DataFrame, percent: int = 80, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, line) of the lines that go; docs: __id, __text without null ids."""
    plain = docs.select(F.col(_ID).alias("id"), _plain(F.col(_TEXT)).alias("text"))
    bits = min(_WORD_BITS, max(10, int(32 * docs.count()).bit_length()))
    described = written(_described(plain, _word_classes(plain, bits), bits, percent).filter(F.col("n") >= min_words), "line-sets")
    # Of lines of one set the earliest stands for all, with what is needed to compare it.
    firsts = described.groupBy("key").agg(F.min(F.struct("id", "line", "n", "p1", "p2", "skip", "words")).alias("first"))
    firsts = written(firsts.select("key", "first.*"), "line-classes")
    equal = written(described.select("key", "id", "line").join(firsts.select("key", "id", "line"), ["key", "id", "line"], "left_anti").select("id", "line"), "lines-equal")
    removed(described)

    rows = _exploded(firsts)
    often = F.col("word") >= _token(_LARGE.bit_length() - 1)
    large = written(rows.filter(often).groupBy("word").count().filter(F.col("count") > _LARGE).select("word"), "line-large")
    any_large = not large.isEmpty()
    # Both sides are the same rows, so they are shuffled once.
    small = (rows.join(large, "word", "left_anti") if any_large else rows).repartition("word")
    pairs = written(_pairs(small, small, percent), "line-pairs")
    tables = [large, pairs, equal]

    needed, hot = pairs.select(F.explode(F.array("x", "y")).alias("at")).select("at.*"), None
    if any_large:
        hot = written(rows.join(large, "word", "left_semi"), "line-hot")
        tables.append(hot)
        needed = needed.unionByName(hot.select("id", "line"))
    removed(firsts)
    judge = _Judge(docs, needed, percent)
    judge.tables += tables
    gone = []
    if hot is not None:
        more, late = _hot_rounds(hot, judge, percent)
        gone.append(more)
        pairs = written(pairs.join(more.select("x").distinct(), "x", "left_anti").unionByName(late).distinct(), "line-pairs")
        judge.tables.append(pairs)
    # The earliest candidate of a line first: the others are only read where it differs.
    nearest = written(pairs.groupBy("x").agg(F.min("y").alias("y")), "line-nearest")
    gone.append(judge.similar(nearest))
    others = written(pairs.join(gone[-1], "x", "left_anti").join(nearest, ["x", "y"], "left_anti"), "line-others")
    gone.append(judge.similar(others))
    judge.tables += [nearest, others]
    for found in gone:
        equal = equal.unionByName(found.select("x.*"))
    out = written(equal.distinct(), "lines-gone")
    removed(*judge.tables)
    return out


def _without(lines: Column, gone: Column) -> Column:
    """Lines but for those at the places gone, which are sorted: the pieces between them, put together."""
    piece = lambda g, i: F.coalesce(F.get(g, i - 1), F.lit(-1)) + 1
    both = F.struct(lines.alias("l"), gone.alias("g"))
    return let(both, lambda z: F.flatten(F.transform(F.sequence(F.lit(0), F.size(z["g"])), lambda i: F.slice(z["l"], piece(z["g"], i) + 1, F.coalesce(F.get(z["g"], i), F.size(z["l"])) - piece(z["g"], i)))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the lines that go taken out of the text, and n_lines, n_removed (columns of these names are replaced)."""
    named = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")])
    pure = named.select(F.col(id_col).alias(_ID), F.col(text_col).cast("string").alias(_TEXT)).filter(f"{_ID} is not null")
    gone = removed_lines(pure, percent, min_words)
    by_doc = gone.groupBy("id").agg(F.sort_array(F.collect_set("line")).alias("__gone"))
    lines = F.split(F.col(text_col).cast("string"), "\n")
    count = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    may = F.coalesce(_member_test(gone.select(F.xxhash64("id").alias("h")))(F.xxhash64(id_col)) & F.col(id_col).isNotNull(), F.lit(False))
    joined = named.filter(may).join(by_doc, F.col(id_col) == by_doc["id"], "left").drop(by_doc["id"])
    touched = joined.withColumn("n_lines", count).withColumn("n_removed", F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"))
    touched = touched.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(_without(lines, F.col("__gone")), "\n"))).drop("__gone")
    return touched.unionByName(named.filter(~may).withColumn("n_lines", count).withColumn("n_removed", F.lit(0).cast("long")))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), min_words=1)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
