"""Findings of the quality checks on small tables."""

from tidewright.operators.base import REGISTRY
from tidewright.plans.quality import city_state_zip, column_kinds, quality, score, suggested
from tidewright.plans.workflow import Workflow


def found(df):
    return {r["finding"]: (r["columns"], r["affected_rows"]) for r in quality(df).collect()}


def test_findings(spark):
    rows = [("A", "PO Box 1", "AK", "x@y.com", "5551234567"), ("A", "1 Oak St", "ny", "bad", "12"), (None, None, None, None, None), ("A/P", "P. O. BOX 2", "HI", None, None)]
    df = spark.createDataFrame(rows, "name string, street string, state string, email string, `cell.phone` string")
    assert found(df) == {
        "po_boxes": ("street", 2), "excluded_states": ("state", 2), "generic_contacts": ("name", 1), "invalid_emails": ("email", 1),
        "invalid_phones": ("cell.phone", 1), "sparse_rows": ("", 1), "capitalisation": ("street", 4),
    }
    assert tuple(score(quality(df)).first()) == (100 - 30 - 15 - 4, 2, 3, 2)


def test_duplicates_by_id_and_by_rows(spark):
    df = spark.createDataFrame([(1, "A"), (1, "B"), (None, "C"), (None, "C"), (2, "D")], "id int, q string")
    assert found(df)["duplicates"] == ("id", 4)
    assert found(df.withColumnRenamed("id", "k"))["duplicates"] == ("k,q", 2)


def test_empty(spark):
    df = spark.createDataFrame([], "name string, x string")
    assert found(df) == {} and score(quality(df)).first()["score"] == 100
    assert column_kinds(df) == {"name": ("contact_name", 0.9), "x": ("unknown", 0.0)}


def test_kinds_by_content(spark):
    df = spark.createDataFrame([("a@b.co", "12345", "NY", "1 Elm St", "(555) 123-4567", "q")] * 3, "a string, b string, c string, d string, e string, f string")
    assert [k for k, _ in column_kinds(df).values()] == ["email", "zip", "state", "address1", "phone", "unknown"]


def test_suggested_steps_run(spark):
    df = spark.createDataFrame([(1, " a ", "po box 1", "AK", "x"), (1, "B", "PO BOX 2", "NY", "a@b.co")], "id int, name string, street string, state string, email string")
    steps = suggested(quality(df))
    assert [s["operation_id"] for s in steps] == ["text_uppercase", "data_remove_duplicates", "conditional_flag_contains", "validate_email", "conditional_flag_contains", "text_trim"]
    assert all(s["operation_id"] in REGISTRY for s in steps)
    assert Workflow(steps, ["id", "name"]).validate(df) == [] and Workflow(steps, ["id", "name"]).run(df).count() <= 1


def test_suggested_flags_are_what_was_counted(spark):
    """No row goes for its state or box; as many are flagged as the findings counted."""
    rows = [(1, "P. O. BOX 2", "GU"), (2, "1 Main", "mp"), (3, "post office  box 9", "Hawaii"), (4, "POBOX", "OH"), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, street string, state string")
    counted = {r["finding"]: r["affected_rows"] for r in quality(df).collect()}
    steps = [s for s in suggested(quality(df)) if s["operation_id"] == "conditional_flag_contains"]
    out = Workflow(steps, ["id"]).run(df)
    assert out.count() == 5
    assert out.filter("Excluded_State_Flag").count() == counted["excluded_states"] == 2
    assert out.filter("PO_Box_Flag").count() == counted["po_boxes"] == 3


def test_city_line(spark):
    rows = [("Chicago", "IL", "60601"), ("Chicago", "IL", None), ("Chicago", None, ""), (" ", "IL", "60601"), (None, None, "60601"), (None, None, None), ("Chicago", None, "60601")]
    df = spark.createDataFrame(rows, "c string, s string, z string")
    want = ["Chicago, IL 60601", "Chicago, IL", "Chicago", "IL 60601", "60601", "", "Chicago 60601"]
    assert [r[0] for r in df.coalesce(1).select(city_state_zip(df.c, df.s, df.z)).collect()] == want
