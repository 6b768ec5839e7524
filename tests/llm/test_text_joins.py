"""Decontamination, substrings, Jaccard join and line dedup against brute force."""

import glob
import hashlib
import os
import random
from collections import Counter

import duckdb
import pytest

from tests.llm.conftest import ALNUM, WORD, lower
from tidewright.llm import lines, queries
from tidewright.llm.components import components
from tidewright.llm.decontaminate import decontaminate
from tidewright.llm.jaccard import jaccard_components
from tidewright.llm.lines import dedup_lines
from tidewright.llm.substrings import dedup_substrings

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, spark):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())


def _hits(words, items):
    """Words hit and items with occurring windows, by looking everywhere."""
    hit, found = set(), set()
    for item, own in items:
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(hit), sorted(found)


def test_decontamination(table, clash, passages):
    shared = passages[6][1].split()
    items = [("7", " ".join(shared[2:14])), ("10", "ONE two"), ("3", None), ("4", ""), ("5", "one"), ("10", "one, TWO!"), ("6", "nothing of this kind stands in any of the documents at all"), (None, "one")]
    docs = clash(table(passages))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate(docs, clash(table(items, "item_id string, text string"))).collect()}
    known = [(i, ALNUM.findall(lower(t))) for i, t in items if i is not None]
    for doc, text in passages:
        words = ALNUM.findall(lower(text))
        assert got[doc] == (len(words), *_hits(words, known)), doc
    assert len(got) == len(passages) and got[6][1] >= 12


def test_decontamination_by_items_without_id(table, tmp_path, spark):
    passage = " ".join(f"p{i}" for i in range(12))
    table([(1, f"a {passage} b"), (2, "a b c"), (3, "short One"), (4, f"{passage} seven")]).write.parquet(str(tmp_path / "documents.parquet"))
    table([(None, passage), (None, "one"), ("7", "seven"), ("8", "never")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    read = {r["doc_id"]: (r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate(*(spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "benchmark"))).collect()}
    assert read == {1: (12, [], True), 2: (0, [], False), 3: (1, [], True), 4: (13, ["7"], True)}
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = duck.execute(queries.SQL["op1_decontamination"])
    names = [d[0] for d in want.description]
    got = queries.QUERIES["op1_decontamination"](spark, str(tmp_path))
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())


def test_substrings(table, clash, passages):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in dedup_substrings(clash(table(passages)), flush=500).collect()}
    texts = {i: WORD.findall(t or "") for i, t in passages}
    least = {}
    for doc in sorted(texts, reverse=True):
        for i in range(len(texts[doc]) - 49):
            least[tuple(texts[doc][i : i + 50])] = doc
    for doc, words in texts.items():
        gone = {p for i in range(len(words) - 49) if least[tuple(words[i : i + 50])] < doc for p in range(i, i + 50)}
        kept = " ".join(w for p, w in enumerate(words) if p not in gone).encode()
        assert got[doc] == (len(words), len(gone), bytearray(kept)), doc
    assert sum(r[1] for r in got.values()) > 1000


def _components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("n, percent, rounds", [(3, 90, 2), (5, 80, 0), (1, 60, 1)])
def test_jaccard(table, clash, passages, n, percent, rounds):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(clash(table(passages)), n=n, percent=percent, rounds=rounds).collect()}
    sets = {}
    for doc, text in passages:
        w = WORD.findall(lower(text))
        sets[doc] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = _components(links, sets)
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}


def test_jaccard_nulls_and_repeats(table):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "x y z"), (2, "x y z"), (3, "A B C D"), (4, None), (None, None)]
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard_components(table(rows)).collect())
    assert got == Counter([(None, None), (None, None), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)])


def test_components_of_a_long_path(spark, table):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (5, 5)]
    random.Random(1).shuffle(pairs)
    got = {r["node"]: r["component"] for r in components(table(pairs, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {101: 100} or got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


def _lines(rng, vocabulary):
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 30))] for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "a b c"), (4, "a b c")]
    for doc in range(5, 45):
        own = []
        for _ in range(rng.randrange(1, 8)):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = [rng.choice(vocabulary) for _ in range(12)]
            own.append(("  " if rng.random() < 0.2 else " ").join(words))
        rows.append((doc, "\n".join(own)))
    return rows


@pytest.mark.parametrize("seed, large, dense", [(1, 256, 16), (2, 4, 1)])
def test_lines(table, clash, monkeypatch, seed, large, dense):
    """Buckets joined at once, and large ones in many rounds or few."""
    monkeypatch.setattr(lines, "_LARGE", large)
    monkeypatch.setattr(lines, "_DENSE", dense)
    rng = random.Random(seed)
    rows = _lines(rng, [f"v{i}" for i in range(80)] + ["Ärger", "THE", "the"])
    docs = clash(table(rows))
    out = dedup_lines(docs)
    assert set(docs.columns) <= set(out.columns)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in out.collect()}
    earlier, want = [], {}
    for doc, text in sorted(rows):
        kept, removed = [], 0
        for line in (text or "").split("\n"):
            words = set(line.lower().split())
            again = len(words) >= 5 and any(100 * len(words & e) >= 80 * len(words | e) for e in earlier)
            if len(words) >= 5:
                earlier.append(words)
            removed += again
            kept += [] if again else [line]
        want[doc] = (None if text is None else "\n".join(kept), removed)
    assert got == want
    assert sum(r[1] for r in got.values()) > 20


def test_lines_are_read_once_for_verification(table, monkeypatch):
    """All candidates come from one join over the buckets, so texts are read once for them (twice before)."""
    built, shuffled = [], []
    judge, pairs = lines._Judge, lines._exploded
    monkeypatch.setattr(lines, "_Judge", lambda *a: built.append(1) or judge(*a))
    monkeypatch.setattr(lines, "_exploded", lambda *a: shuffled.append(1) or pairs(*a))
    rows = _lines(random.Random(3), [f"v{i}" for i in range(80)])
    assert dedup_lines(table(rows)).agg({"n_removed": "sum"}).first()[0] > 20
    assert (len(built), len(shuffled)) == (1, 1)


def test_lines_with_other_white_space(table):
    rows = [(1, "One two\tthree\x0bfour five\nsix"), (2, "one\f two  three four\rFIVE\r\nlast"), (3, "one two three four five")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(table(rows)).collect()}
    assert got == {1: rows[0][1], 2: "last", 3: ""}


def _short_lines(rng):
    base = [[f"s{rng.randrange(9)}" for _ in range(rng.randrange(1, 7))] for _ in range(30)] + [["日本語の行"], ["a", "a", "a"], ["x", "y", "z", "u"], ["x", "y", "z", "u", "v"]]
    rows = [(0, None), (1, ""), (2, " \n\t\n"), (3, "Of."), (4, "of.\n\nOF.  of.")]
    return rows + [(doc, "\n".join(" ".join(rng.choice(base)) for _ in range(rng.randrange(1, 6)))) for doc in range(5, 45)]


def test_query_judges_short_lines(table, tmp_path, spark):
    rows = _short_lines(random.Random(4))
    table(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text_sha256"]) for r in queries.QUERIES["op5_lines"](spark, str(tmp_path)).collect()}
    earlier, want = [], {}
    for doc, text in rows:
        kept, removed = [], 0
        for line in (text or "").split("\n"):
            words = set(line.lower().split())
            again = bool(words) and any(100 * len(words & e) >= 80 * len(words | e) for e in earlier)
            earlier += [words] if words else []
            removed += again
            kept += [] if again else [line]
        want[doc] = (0 if text is None else text.count("\n") + 1, removed, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert got == want
    assert sum(r[1] for r in got.values()) > 50


def test_lines_with_null_and_repeated_ids(table):
    line = "one two three four five six"
    rows = [(None, line), (1, line), (1, line), (2, line + "\nrest"), (None, line)]
    got = Counter((r["doc_id"], r["text"]) for r in dedup_lines(table(rows)).collect())
    assert got == Counter([(None, line), (None, line), (1, line), (1, line), (2, "rest")])


def test_empty_tables(table):
    docs = table([])
    assert dedup_lines(docs).collect() == []
    assert jaccard_components(docs).collect() == []
    assert dedup_substrings(docs).collect() == []
    assert decontaminate(docs, table([], "item_id string, text string")).collect() == []
    only = decontaminate(table([(1, "some words")]), table([], "item_id string, text string")).collect()
    assert [(r["n_words"], r["n_hit"]) for r in only] == [(2, 0)]


def test_query_columns(spark):
    row = queries.QUERIES["op1_decontamination"](spark, SF).filter("not contaminated").first()
    assert row["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_decontamination_judges_each_row(table):
    """Null and repeated ids, equal rows among them: a row each."""
    passage = " ".join(f"w{i}" for i in range(12))
    rows = [(None, f"x {passage}"), (None, "clean text"), (None, "clean text"), (7, passage), (7, "other words"), (7, "other words"), (8, None), (8, None)]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate(table(rows), table([("a", passage)], "item_id string, text string")).collect())
    assert got == [("7", 2, 0, False), ("7", 2, 0, False), ("7", 12, 12, True), ("8", 0, 0, False), ("8", 0, 0, False), ("None", 2, 0, False), ("None", 2, 0, False), ("None", 13, 12, True)]
