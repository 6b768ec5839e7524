"""One workflow over many tables."""

from tidewright.plans.batch import best_preset, fitting, preset_columns, run_batch
from tidewright.plans.workflow import Workflow

STEPS = [
    {"operation_id": "text_trim", "parameters": {"columns": ["name"]}},
    {"operation_id": "data_remove_rows_if", "parameters": {"column": "city", "condition": "is_blank"}},
    {"operation_id": "nothing_such", "parameters": {}},
    {"operation_id": "text_uppercase", "parameters": {"columns": ["name"]}, "enabled": False},
]


def test_tables_get_the_steps_that_fit(spark):
    a = spark.createDataFrame([(1, " x ", "Troy"), (2, "y", None)], "id int, name string, city string")
    b = spark.createDataFrame([(3, " z "), (4, None)], "id int, name string")
    c = spark.createDataFrame([("5", "w")], "id string, town string")
    done = run_batch({"a": a, "b": b, "c": c, "none": a.limit(0)}, Workflow(STEPS, ["id"]))
    assert done.rows.columns[0] == "Source_File"
    assert sorted((r["Source_File"], r["id"], r["name"], r["town"]) for r in done.rows.collect()) == [("a", "1", "x", None), ("b", "3", "z", None), ("b", "4", None, None), ("c", "5", None, "w")]
    assert {n: (t["rows_in"], t["rows_out"], t["removed"], t["steps"], [s["step"] for s in t["skipped"]]) for n, t in done.totals.items()} == {"a": (2, 1, 1, 2, [3]), "b": (2, 2, 0, 1, [2, 3]), "c": (1, 1, 0, 0, [1, 2, 3]), "none": (0, 0, 0, 2, [3])}
    assert [(r["Source_File"], r["id"], r["_Operation_ID"]) for r in done.removed.collect()] == [("a", 2, "data_remove_rows_if")]
    done.drop()
    assert run_batch({"c": c}, Workflow(STEPS, ["id"])).removed is None
    assert [s["reason"] for s in fitting(Workflow(STEPS), b)[1]] == ["data_remove_rows_if: no column city", "no operation nothing_such"]


def test_presets():
    presets = {"one": STEPS, "two": [{"operation_id": "validate_email", "parameters": {"column": "mail"}}, {"operation_id": "standardize_zip", "parameters": {"columns": "zip, plz"}}]}
    assert preset_columns(presets["one"]) == {"name", "city"} and preset_columns(presets["two"]) == {"mail", "zip", "plz"}
    assert best_preset(presets, ["mail", "zip"]) == ("two", 2 / 3) and best_preset({}, ["x"]) == (None, 0.0)
