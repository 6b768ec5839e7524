"""Mixing, vector codes and the Merkle manifest against brute force, plain Lloyd and DuckDB."""

import glob
import hashlib
import os
import random
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import codes, merkle, mixing, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_mixing", "op12_vector_codes", "op13_merkle"])
def test_queries(name, spark):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = duck.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


# ---- mixing

DOCS = "doc_id long, text string, source string, n long, words string"


def targets(sizes, weights=(5, 2, 1)):
    """Sharing out as the contract tells it, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    found, open_, rest = {}, list(names), Fraction(3 * sum(sizes.values()), 2)
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not above:
            return found | share
        for s in above:
            found[s] = Fraction(2 * sizes[s])
            rest -= 2 * sizes[s]
            open_.remove(s)
    return found


def corpus(rng, sources, n):
    rows = []
    for i in range(n):
        source = rng.choice(sources)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(1, 60))), source, i, None))
    return rows


def test_targets_and_copies(table):
    rng = random.Random(11)
    rows = corpus(rng, ["a", "b", "B", "é", "", None, "hot", "hot", "hot", "hot"], 600)
    rows += [(None, None, "a", 1, "x"), (None, "", None, 1, "x"), (None, "two words", "a", 2, "y"), (7, "same id", "a", 0, None), (7, "same id", "a", 0, None), (9000, "  \x1f\x0b", "none", 0, None)]
    docs = table(rows, DOCS)
    got = mixing.planned(docs, keep=["doc_id", "n", "source", "words"]).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").replace("\x0b", " ").replace("\n", " ").replace("\t", " ").split(" ")) - (text or "").replace("\x0b", " ").replace("\n", " ").replace("\t", " ").split(" ").count("")
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]))
        assert 0 <= r["copies"] <= 2 and r["copies"] - r["rate"] > -1 and r["copies"] - r["rate"] < 1
        taken[r["source"]] += r["size"] * r["copies"]
    for source, size in sizes.items():
        assert abs(taken[source] - want[source]) <= max(0.05 * want[source], 60)
    assert len({r["copies"] for r in got if r["doc_id"] == 7 and r["source"] == "a" and r["n"] == 0}) == 1
    again = mixing.planned(docs.repartition(7), keep=["doc_id", "n", "source", "words"]).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_the_mix_itself(table, clash):
    rng = random.Random(12)
    docs = clash(table(corpus(rng, ["a", "b", None], 60), DOCS).withColumn("size", F.lit("own")).withColumn("copy", F.lit(5)))
    plan = {r["doc_id"]: r["copies"] for r in mixing.planned(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows) == {k: v for k, v in plan.items() if v}
    assert {r["size"] for r in rows} == {"own"} and all(r["copy"] < plan[r["doc_id"]] for r in rows)


def test_mixing_by_a_table_of_weights_and_empty_tables(spark, table):
    docs = table([(i, "one two three four", "ab"[i % 2], 0, None) for i in range(40)], DOCS)
    weights = spark.createDataFrame([("a", 3), (None, 1)], "source string, weight long")
    found = mixing.planned(docs, weights, percent=50, most=4).select("source", "target").distinct().collect()
    assert {r["source"]: r["target"] for r in found} == {"a": 80.0, "b": 0.0}
    assert {r["target"] for r in mixing.planned(docs, percent=900).collect()} == {160.0}
    assert mixing.planned(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []
    blank = table([(1, None, "a", 0, None), (2, " ", "b", 0, None)], DOCS)
    assert {(r["size"], r["target"], r["copies"]) for r in mixing.planned(blank).collect()} == {(0, 0.0, 0)}


# ---- vector codes


def plain(rows, parts=8, entries=16, rounds=6):
    """Lloyd rounds over Python's numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(np.floor(x * 4096)) if abs(x) < 2**40 else int(x) * 4096 for x in r[1]] for r in kept]
    width = len(whole[0]) // parts
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books, found, error = [], [], [0] * len(whole)
    for p in range(parts):
        pieces = [w[p * width : (p + 1) * width] for w in whole]
        book = [list(x) for x, r in zip(pieces, kept) if r[0] is not None][:entries]
        for k in range(rounds + 1):
            near = [min((far(x, e), i) for i, e in enumerate(book)) for x in pieces]
            if k < rounds:
                for e in range(len(book)):
                    own = [x for x, n in zip(pieces, near) if n[1] == e]
                    if own:
                        book[e] = [sum(c) // len(own) for c in zip(*own)]
        books.append(book)
        found.append([n[1] for n in near])
        error = [e + n[0] for e, n in zip(error, near)]
    return sorted(zip([str(r[0]) for r in kept], ["".join(f"{c:02x}" for c in code) for code in zip(*found)], error)), books


VECTORS = "vec_id long, embedding array<float>, label int, code string, v string"


@pytest.mark.parametrize("kind", ["spread", "ties", "large"])
def test_codes_equal_plain_lloyd(table, kind):
    rng = np.random.default_rng(5)
    values = {"spread": lambda: rng.normal(0, 1, 16), "ties": lambda: rng.integers(-2, 3, 16) / 4096, "large": lambda: rng.normal(0, 1e9, 16)}[kind]
    rows = [(i, [float(x) for x in np.float32(values())], i % 3 or None, None, "x") for i in range(150)]
    rows += [(500 + i, rows[3][1], 1, None, None) for i in range(20)] + [(3, rows[3][1], 1, None, None), (4, rows[9][1], 2, None, None)]
    bad = [(600, None, 1, None, None), (601, [None] + rows[0][1][1:], 1, None, None), (602, [float("nan")] + rows[0][1][1:], 1, None, None), (603, [float("-inf")] * 16, 1, None, None), (604, [1.0], 1, None, None), (605, [], 1, None, None)]
    nameless = [(None, rows[5][1], None, None, None)]
    found, books = codes.coded(table(rows + bad + nameless, VECTORS))
    want, want_books = plain(rows + nameless)
    assert sorted((str(r["vec_id"]), r["code"].hex(), r["error"]) for r in found.collect()) == [(i, c, min(e, 2**63 - 1)) for i, c, e in want]
    assert [[list(map(int, e)) for e in b] for b in books] == want_books


def test_bounds_spare_distances(table):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 5, (16, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 16] + rng.normal(0, 0.1, 8))], 1, None, None) for i in range(800)]
    _, _, took = codes.learned(codes.usable(table(rows, VECTORS)), parts=2)
    assert took[0] == 800 * 2 * 16 and took[-1] < took[0] / 4


def test_few_vectors_and_none(table):
    rows = [(i, [float(i * k) for k in range(8)], None, None, None) for i in range(3)]
    found, books = codes.coded(table(rows, VECTORS))
    assert sorted((r["vec_id"], r["code"].hex(), r["error"]) for r in found.collect()) == [(i, c.replace("x", str(i)) if i else "00" * 8, 0) for i, c in enumerate(["", "00" + "0x" * 7, "00" + "0x" * 7])]
    back = {r["vec_id"]: r["vector"] for r in codes.decoded(found, books).collect()}
    assert back == {r[0]: r[1] for r in rows}
    for none in (table(rows, VECTORS).limit(0), table([(1, [1.0, 2.0], 1, None, None)], VECTORS), table([(None, [1.0] * 8, 1, None, None)], VECTORS)):
        assert codes.coded(none)[0].collect() == []


# ---- Merkle manifest


def h(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 16 * 16
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + 16])))
        i //= 16
    return out


def manifest(rows):
    by = {}
    for r in rows:
        leaf = h(*(field(r[c]) for c in merkle.FIELDS))
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    return Counter((x[1] if x[0] else None, x[2], trees[s][-1][0], top[-1][0], tuple(path(trees[s], i) + path(top, k))) for k, s in enumerate(names) for i, x in enumerate(sorted(by[s])))


def test_manifest(table, clash, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)  # blocks of 16 leaves, so that trees of a few hundred have levels above them
    rng = random.Random(13)
    rows = [{"doc_id": i, "source": rng.choice(["hot"] * 8 + ["é", "", None, "z"]), "lang": rng.choice([None, "en", ""]), "n_chars": rng.choice([None, i]), "text": rng.choice([None, "", "日本 text", f"Text {i}"])} for i in range(700)]
    rows += [{"doc_id": 10**6 + i, "source": f"s{i:02}", "lang": None, "n_chars": None, "text": "x" * i} for i in range(30)]
    rows += [{"doc_id": d, "source": "hot", "lang": "en", "n_chars": 1, "text": "same"} for d in (5, 5, 5, None, None)] + [{"doc_id": 5, "source": "hot", "lang": "en", "n_chars": 1, "text": "other"}]
    docs = clash(table([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string"))
    docs = docs.withColumn("tree", F.lit("own")).withColumn("proof", F.lit("own")).withColumn("leaf", F.lit("own"))
    found = merkle.proofs(docs)
    got = Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((x["left"], x["right"]) for x in r["proof"])) for r in found.collect())
    assert got == manifest(rows)
    assert found.filter(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_one_row_and_none(table):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = merkle.proofs(table([(1, None, None, None, None)], schema)).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] == h("1:1", "----") and one[0]["proof"] == []
    assert merkle.proofs(table([], schema)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 600, 4096])
def test_traversal_of_a_block(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = tree(leaves)
    depth = 3  # more heights than the blocks of the queries have
    full = levels + [[h(levels[-1][0])]] * 0
    while len(full) <= depth:
        full.append([h(*full[-1])])
    assert merkle.block_root(leaves, depth) == full[-1][0]
    for i, (left, right) in enumerate(merkle.traversed(leaves, depth)):
        assert list(zip(left, right)) == path(full, i)


def test_tampered_rows_are_found(spark):
    found = queries.QUERIES["op13_merkle"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in found:
        tampered = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in texts[r["doc_id"]] or "")
        assert r["verified"] == (not tampered) == (r["folded_root"] == r["root"])
