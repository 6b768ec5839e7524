"""Golden cases of the table operations that SQL over the test tables doesn't reach."""

import pytest
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.plans.combine import combine
from tidewright.plans.workflow import apply


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *f(F.col("x"))).orderBy("i").collect()]


def test_titles(spark):
    want = {
        "Chief Executive Officer": (1, "Executive Leadership"), "CNO": (1, "Executive Leadership"), "VPs of Care": (1, "Executive Leadership"), "V.P.": (1, "Executive Leadership"),
        "Executive Director": (2, "Senior Director"), "Directors": (2, "Senior Director"), "Department Head": (2, "Senior Director"),
        "Nursing Managers": (3, "Manager/Administrator"), "Coordinator": (3, "Manager/Administrator"), "Team Leader": (4, "Supervisor/Lead"), "Charge Nurse": (4, "Supervisor/Lead"),
        "RN": (5, "Clinical"), "PA": (5, "Clinical"), "Physician Assistant": (5, "Clinical"), "Executive Assistant": (6, "Administrative Support"), "Secretary": (6, "Administrative Support"),
        "Unknown Title": (7, "Unknown/Other"), "": (7, "Unknown"),
    }
    assert values(spark, [*want, None], T.title_rank) == [*want.values(), (7, "Unknown")]


def test_addresses(spark):
    want = {
        "2000 Pepperell Pkwy": "2000 PEPPERELL PARKWAY", "789 W Broadway": "789 WEST BROADWAY", "100 N 5th St": "100 NORTH 5TH STREET", "200 SE Park Blvd": "200 SOUTHEAST PARK BOULEVARD",
        "150 Bergen St Ste 1": "150 BERGEN STREET SUITE 1", "300 Circle Dr, Apt 5": "300 CIRCLE DRIVE APARTMENT 5", "1 Oak Ave Flr 2 # 3": "1 OAK AVENUE FLOOR 2 NUMBER 3",
    }
    assert values(spark, list(want), lambda c: (T.address_key(c),)) == [(v,) for v in want.values()]


def test_levels_of_deduplication(spark):
    people = [("John", "Doe", "john@example.com", "123 Main St", "Boston", "MA", "555-1001")] * 2 + [("John", "Doe", None, "123 Main St", "Boston", "MA", "555-1001")]
    people += [("Jane", "Smith", "jane@example.com", "456 Oak Ave", "Chicago", "IL", "555-2001")] * 2 + [("Bob", "Johnson", None, "789 Pine Rd", "Denver", "CO", "555-3001")] * 2
    people += [("Alice", "Williams", None, None, None, None, "555-4001")] * 2 + [("Charlie", "Brown", "charlie@example.com", "321 Elm St", "Seattle", "WA", "555-5001")]
    people += [("David", "Davis", None, "654 Maple Dr", "Portland", "OR", "555-6001"), ("Eve", "Miller", None, None, None, None, "555-7001")]
    names = ["First Name", "Last Name", "Email Address", "Person Street", "Person City", "Person State", "Direct Phone Number"]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(people)], "id int, " + ", ".join(f"`{n}` string" for n in names))
    assert sorted(r["id"] for r in apply(df, "data_remove_duplicates", ["id"]).collect()) == [0, 2, 3, 5, 7, 9, 10, 11]


def test_header_row(spark):
    rows = [(1, "a", "Report", None), (1, "b", "Div", "Segment"), (2, "a", "1", "A"), (3, "a", "2", "B")]
    df = spark.createDataFrame(rows, "n int, `m.k` string, x string, y string")
    out = apply(df, "data_set_header_row", ["n", "m.k"], header_row_number=2)
    assert out.columns == ["n", "m.k", "Div", "Segment"]
    assert sorted(tuple(r)[2:] for r in out.collect()) == [("1", "A"), ("2", "B")]
    assert apply(df, "data_set_header_row", ["n", "m.k"], header_row_number=2, remove_above=False).count() == 3
    for bad, order in ((9, ["n", "m.k"]), (2, [])):
        with pytest.raises(ValueError):
            apply(df, "data_set_header_row", order, header_row_number=bad)


def test_patterns_and_blanks(spark):
    df = spark.createDataFrame([(1, "PO BOX 1", None), (2, " ", None), (3, "n/a", ""), (4, "Main St", "x")], "id int, a string, b string")
    kept = lambda **p: sorted(r["id"] for r in apply(df, "remove_rows_containing", columns=["a", "b"], **p).collect())
    assert (kept(), kept(remove_blanks=True), kept(preset="Remove Blanks")) == ([2, 3, 4], [3, 4], [1, 3, 4])


def test_states_by_the_ordered_names(spark):
    """Beginnings count in the order of a table that ends with Guam."""
    want = {"America": "AMERICA", "Washington DC": "WA", "washington d.c.": "WA", "District of Columbia": "DC", "new": "NH", "Virginia Beach": "VA", "West": "WV", "oh": "OH", "Miss": "MS", "guam": "GU", "American Samoa": "AMERICAN SAMOA", " texas ": "TX", "None": None, "nan": None, "": None, "Arkansas City": "AR", "v": "VT", "xyz": "XYZ"}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(want)], "i int, s string")
    assert [r["s"] for r in apply(df, "standardize_state", columns=["s"]).orderBy("i").collect()] == list(want.values())


def test_blanks_of_unicode(spark):
    assert values(spark, ["\u00a0 a\u3000\u2009b \u0085", "\x1c c \u202f"], lambda c: (T.squeezed(c), T.stripped(c))) == [("a b", "a\u3000\u2009b"), ("c", "c")]


def test_names_that_differ_by_case(spark):
    df = spark.createDataFrame([("a", "b")], "Name string, name string")
    assert tuple(apply(df, "text_uppercase", columns=["name"]).first()) == ("a", "B")


def test_names(spark):
    df = spark.createDataFrame([("Smith, John",), ("John Smith",), ("Cher",)], "n string")
    out = apply(df, "parse_contact_name", column="n", name_format="Last, First")
    assert {(r["First Name"], r["Last Name"]) for r in out.collect()} == {("John", "Smith"), ("Cher", "")}


def test_lookup_replaces_its_own_column(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    table = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "3")], "k string, v string").coalesce(1)
    out = apply(df, "data_vlookup", lookup_column="k", lookup_file=table, lookup_file_column="k", return_column="v", new_column="k", first_match=True)
    assert sorted(r["k"] or "" for r in out.collect()) == ["", "2", "3"]


def test_only_absent_columns_are_filled(spark):
    a, b = spark.createDataFrame([(1, None)], "x int, t string"), spark.createDataFrame([(None, 5)], "t string, y int")
    assert sorted(map(str, (tuple(r) for r in combine([a, b], fill="").collect()))) == sorted(map(str, [("1", None, ""), ("", None, "5")]))
