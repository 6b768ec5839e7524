"""Linkage of two whole tables against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.plans import combine, fuzzy, queries
from tidewright.plans.combine import link, link_files

SF = "/root/testdata/sf0.01"


def _score(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return round(200 * row[-1] / (len(a) + len(b)))


def _plain(r):
    squeezed = {c: " ".join((r[c] or "").lower().split()) for c in ("email", "full_name", "company", "city", "state")}
    return squeezed | {"id": r["contact_id"], "phone": re.sub("[^0-9]", "", r["phone"] or "")}


def test_link_fuzzy(spark):
    got = {r["contact_id"]: (r["Overlap_Tier"], r["Matched_With_Index"]) for r in queries.QUERIES["link_fuzzy"](spark, SF).collect()}
    master, other = (sorted((_plain(r) for r in df.collect()), key=lambda r: r["id"]) for df in queries._two_files(spark, SF))
    want = {}
    for o in other:
        tests = [
            lambda m: o["email"] and m["email"] == o["email"],
            lambda m: o["phone"] and m["phone"] == o["phone"] and _score(m["full_name"], o["full_name"]) >= 85,
            lambda m: m["city"] == o["city"] and m["state"] == o["state"] and _score(m["company"], o["company"]) >= 85 and _score(m["full_name"], o["full_name"]) >= 75,
        ]
        want[o["id"]] = next(((k, m["id"]) for k, t in enumerate(tests, 1) for m in master if t(m)), (None, None))
    assert got == want and len(got) == spark.read.parquet(f"{SF}/supplier.parquet").count()
    tiers, exact = Counter(t for t, _ in got.values()), Counter(r["Overlap_Tier"] for r in queries.QUERIES["link_tables"](spark, SF).collect())
    assert tiers[1] and tiers[2] > exact[2] and tiers[3] >= exact[3]


def test_fuzzy_tiers(spark):
    schema = "id long, email string, phone string, name string, city string, state string, company string"
    master = [(1, "a@x", None, "Zed", "Troy", "OH", "Acme Clinic"), (2, None, "555", "Maria Lopez", "Troy", "OH", "Acme Clinics"), (3, None, None, "Marie Lopes", "Troy", "OH", "Acme Clinic"), (4, None, None, "Maria Lopez", None, "OH", "Acme Clinic")]
    other = [(10, "A@X ", None, None, None, None, None), (11, None, "5-5-5", "Maria Lopz", None, None, None), (12, None, "555", "Nobody", None, None, None), (13, None, None, "maria  lopes", "troy", "oh", "acme clinic"), (14, None, None, "Maria Lopez", "Troy", "OH", "Other place"), (15, None, None, "Maria Lopez", None, "OH", "Acme Clinic")]
    frames = [spark.createDataFrame(rows, schema) for rows in (master, other)]
    found = link(*frames, "id", "id", "email", "phone", "name", "city", "state", "company", mode="fuzzy").collect()
    assert {r["id"]: (r["Overlap_Tier"], r["Matched_With_Index"]) for r in found} == {10: (1, 1), 11: (2, 2), 12: (None, None), 13: (3, 2), 14: (None, None), 15: (None, None)}


def test_similar_values_equal_all_pairs(spark):
    """Values that share long phrases, short ones, other alphabets, edits at both ends; hot keys are refined."""
    rng = random.Random(4)
    words = ["Clinic of ", "Saint ", "North", "east", " Labs", "Größe", "日本語", "x", "ab", " Ltd."]
    values = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(150)]
    for v in list(values):
        w = list(v)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "q", "th", "é"])
        values.append("".join(w))
    values = list(dict.fromkeys(v for v in values if v)) + [f"Clinic of Saint {i:03}" for i in range(120)]
    rows = [(rng.choice(["b1", "b1", "b1", "b2"]), v) for v in values]
    extra = [(None, "Clinic of "), ("b1", None), ("b1", ""), ("b3", "alone"), ("b1", "Clinic of ")]
    left, right = (spark.createDataFrame(part + extra, "block string, value string") for part in (rows[::2], rows[1::2]))
    for percent in (75, 85, 95):
        got = {(r["block"], r["a"], r["b"]): r["ratio"] for r in fuzzy.similar(left, right, percent).collect()}
        want = {(p, a, b): s for p, a in rows[::2] + extra for q, b in rows[1::2] + extra if p and p == q and a and b and (s := _score(a, b)) >= percent}
        assert got == want and len(want) > 100
    assert fuzzy.similar(left.limit(0), right, 85).collect() == []
    with pytest.raises(ValueError):
        fuzzy.similar(left, right, 60)


@given(st.text("abc é", min_size=1, max_size=14), st.text("abc é", min_size=1, max_size=14), st.sampled_from([71, 75, 85, 90, 99, 100]))
@settings(max_examples=400, deadline=None)
def test_similar_texts_share_keys(a, b, percent):
    if fuzzy.ratio(a, b) >= percent:
        for counts in (np.zeros(fuzzy._CELLS, int), np.arange(fuzzy._CELLS) % 7):
            one, other = fuzzy.keys_of(a, percent, counts), fuzzy.keys_of(b, percent, counts)
            assert set(one[0]) & set(other[0]) and set(one[1]) & set(other[1])


def test_a_large_block(spark):
    """Values of one block: what meets is a small part of all pairs."""
    rng = random.Random(5)
    make = lambda: "".join(rng.choice("etaoinshrdlucmfwypvbgkjqxz"[: rng.randrange(6, 27)]) for _ in range(rng.randrange(12, 24)))
    values = [make() for _ in range(4000)]
    near = [v[:3] + v[4:] for v in values[:300]]
    left = spark.createDataFrame([("b", v) for v in values], "block string, value string")
    right = spark.createDataFrame([("b", v) for v in near + [make() for _ in range(3700)]], "block string, value string")
    got = {(r["a"], r["b"]) for r in fuzzy.similar(left, right, 85).collect()}
    assert {(v, w) for v, w in zip(values, near)} <= got and len(got) < 1000


def test_reasons_and_fields(spark):
    schema = "id long, email string, phone string, name string, city string, state string, company string"
    master = [(1, None, "555", "Maria Lopez", "Troy", "OH", "Acme Clinic"), (2, None, "555", "Maria Lopes", "Troy", "OH", "Acme Clinics"), (3, "z@x", None, None, None, None, None)]
    other = [(10, None, "555", "Maria Lopes", None, None, None), (11, None, None, "Maria Lopze", "Troy", "OH", "Acme Clinicc"), (12, "Z@x", "555", "Maria Lopez", None, None, None)]
    frames = [spark.createDataFrame(rows, schema) for rows in (master, other)]
    shown = lambda **more: {r["id"]: (r["Overlap_Tier"], r["Matched_With_Index"], r["Match_Reason"]) for r in link(*frames, "id", "id", "email", "phone", "name", "city", "state", "company", **more).collect()}
    fuzzy_ones = shown(mode="fuzzy")
    assert fuzzy_ones[10] == (2, 1, "Tier 2: Phone + Name match (Name_Similarity=91%)")
    assert fuzzy_ones[11] == (3, 1, "Tier 3: Company + Location + Name match (Company_Similarity=96%, Name_Similarity=91%)")
    assert fuzzy_ones[12] == (1, 3, "Tier 1: Exact email match")
    assert shown()[10] == (2, 2, "Tier 2: Phone + Name match")
    assert shown(mode="fuzzy", fields=("email", "company"))[10] == (None, None, None)
    assert shown(mode="fuzzy", fields=("email", "name", "phone"))[11] == (None, None, None)
    assert shown(fields=("email",))[12] == (1, 3, "Tier 1: Exact email match")


def test_files_are_compared_by_what_a_row_has(spark):
    """The rules of several files: blank fields of the row don't count, name and one of company, city and state have to be there."""
    schema = "id long, email string, phone string, name string, city string, state string, company string"
    master = [(1, None, None, "Ann", "Troy", "OH", "Acme"), (2, None, None, "Ann", "Troy", None, None), (3, None, None, "Bob", None, None, "Acme")]
    other = [(10, None, None, "ann ", "TROY", None, None), (11, None, None, "Ann", None, "OH", " "), (12, None, None, "Ann", "Troy", None, "Acme"), (13, None, None, "Ann", None, None, None), (14, None, None, "Bob", "Troy", None, "Acme"), (15, None, None, None, "Troy", "OH", "Acme"), (16, None, None, "Bob", None, None, "ACME")]
    frames = {n: spark.createDataFrame(rows, schema) for n, rows in (("a", master), ("b", other))}
    found = link_files(frames, "id", "email", "phone", "name", "city", "state", "company").filter("Source_File = 'b'").collect()
    assert {r["id"]: (r["Overlap_Tier"], r["Matched_With_Index"]) for r in found} == {10: (3, 1), 11: (3, 1), 12: (3, 1), 13: (None, None), 14: (None, None), 15: (None, None), 16: (3, 3)}
    assert {r["Match_Reason"] for r in found} == {None, "Company + Location Match"}


def _plans(monkeypatch, module):
    """Plans of the tables that the module stores from now on, by name."""
    found, real = {}, module.stored

    def kept(df, name):
        found.setdefault(name, []).append(df._jdf.queryExecution().toString())
        return real(df, name)

    monkeypatch.setattr(module, "stored", kept)
    return found


def test_indexed_pairs_are_not_broadcast(spark, monkeypatch):
    """Small files may hold many keys; blocks with few values on one side need no index, and both ways find the same."""
    rng = random.Random(6)
    values = sorted({f"customer {rng.randrange(10**5):05}" for _ in range(120)})
    left, right = (spark.createDataFrame([(f"b{i % 2}", v) for i, v in enumerate(part)], "block string, value string") for part in (values[::2], values[1::2]))
    plans, got = _plans(monkeypatch, fuzzy), []
    for few in (0, 64):
        monkeypatch.setattr(fuzzy, "_FEW", few, raising=False)
        got.append({(r["block"], r["a"], r["b"], r["ratio"]) for r in fuzzy.similar(left, right, 85).collect()})
    pairs = [(f"b{i % 2}", v, f"b{j % 2}", w) for i, v in enumerate(values[::2]) for j, w in enumerate(values[1::2])]
    assert got[0] == got[1] == {(p, v, w, s) for p, v, q, w in pairs if p == q and (s := _score(v, w)) >= 85} and len(got[0]) > 100
    assert len(plans["fuzzy-index"]) == 2 and not any("Broadcast" in p for name in ("fuzzy-blocks", "fuzzy-hot", "fuzzy-pairs") for p in plans[name])


_PERSON = "id long, email string, phone string, name string, city string, state string, company string"


def test_forms_are_computed_once(spark, monkeypatch):
    """No join repeats the patterns by which fields are compared; a table's forms take two a text and three a phone."""
    row = (1, " A@x", "1 (555) 123-4567", " Ann  Lee ", "Troy", "OH", "Acme")
    frames = [spark.createDataFrame([row], _PERSON), spark.createDataFrame([(2, "b@x", "555.123.4567", "ANN LEE", None, None, None)], _PERSON)]
    plans = _plans(monkeypatch, combine)
    found = link(*frames, "id", "id", "email", "phone", "name", "city", "state", "company")
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["Overlap_Tier"], r["Matched_With_Index"]) for r in found.collect()] == [(2, 1)]
    found = link_files(dict(zip("ab", frames)), "id", "email", "phone", "name", "city", "state", "company")
    assert [r["Overlap_Tier"] for r in found.filter("Source_File = 'b'").collect()] == [2] and "regexp" not in plans["link-file"][0]
    assert all(p.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("regexp_replace") <= 5 * 2 + 4 for name in ("link-master", "link-other", "link-asked") for p in plans[name])


def test_files_by_three_joins(spark, monkeypatch):
    """One join a tier, whatever fields rows have; the same as brute force over all sets of fields."""
    rng = random.Random(7)
    some = lambda *values: rng.choice([None, " ", *values])
    make = lambda i: (i, some("a@x", "B@x") if rng.random() < 0.1 else None, some("555", "5-5-6") if rng.random() < 0.2 else None, some("Ann", "bob", "Eve"), some("Troy", "Ada"), some("OH", "ny"), some("Acme", "Labs", "Inc"))
    files = {n: [make(k * 100 + i) for i in range(60)] for k, n in enumerate("abc")}
    plans = _plans(monkeypatch, combine)
    found = link_files({n: spark.createDataFrame(rows, _PERSON) for n, rows in files.items()}, "id", "email", "phone", "name", "city", "state", "company").collect()
    plain = lambda r: [r[0], *[" ".join((x or "").lower().replace("-", "").split()) or None for x in r[1:]]]
    held, want = [plain(r) for r in files["a"]], {r[0]: (None, None) for r in files["a"]}
    for n in "bc":
        rows, new = [plain(r) for r in files[n]], []
        for r in rows:
            tests = [
                lambda m: r[1] and m[1] == r[1],  # noqa: B023
                lambda m: r[2] and r[3] and m[2:4] == r[2:4],  # noqa: B023
                lambda m: r[3] and m[3] == r[3] and any(r[4:]) and all(x is None or x == y for x, y in zip(r[4:], m[4:])),  # noqa: B023
            ]
            want[r[0]] = next(((k, m[0]) for k, t in enumerate(tests, 1) for m in held if t(m)), (None, None))
            new += [r] if want[r[0]][0] is None else []
        held += new
    assert {r["id"]: (r["Overlap_Tier"], r["Matched_With_Index"]) for r in found} == want and {t for t, _ in want.values()} == {None, 1, 2, 3}
    assert all(p.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("Join ") == 3 for p in plans["link-file"])
