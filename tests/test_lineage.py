"""Ids of rows and what workflows change."""

import pytest

from tidewright.plans.lineage import change_counts, difference, identified, preview, read_identified
from tidewright.plans.workflow import Workflow


def test_ids_of_files_dont_depend_on_tasks(spark, tmp_path):
    spark.range(500).selectExpr("id", "id % 7 as x").repartition(3).write.parquet(str(tmp_path / "t"))
    first = read_identified(spark, str(tmp_path / "t"))
    ids = {r["id"]: r["_row_id"] for r in first.collect()}
    again = {r["id"]: r["_row_id"] for r in read_identified(spark, str(tmp_path / "t")).repartition(5).collect()}
    assert ids == again and len(set(ids.values())) == 500


def test_preview(spark):
    df = identified(spark.createDataFrame([(1, " a ", "x"), (2, "b", None), (3, "c", "x"), (4, None, None)], "id int, name string, `a.b` string"), ["id"])
    steps = [
        {"operation_id": "text_trim", "parameters": {"columns": ["name"]}},
        {"operation_id": "data_remove_rows_if", "parameters": {"column": "a.b", "condition": "equals", "value": "X"}},
        {"operation_id": "clean_keep_columns", "parameters": {"columns_to_keep": ["id", "name"]}},
        {"operation_id": "data_add_multiple_columns", "parameters": {"columns": [{"name": "note"}]}},
        {"operation_id": "clean_remove_blank_rows", "parameters": {}},
    ]
    found = {r["_row_id"]: (r["change"], [tuple(c) for c in r["cells"]]) for r in preview(Workflow(steps), df).collect()}
    assert found == {
        '["1"]': ("removed", [("id", "1", None), ("name", " a ", None), ("a.b", "x", None)]), '["3"]': ("removed", [("id", "3", None), ("name", "c", None), ("a.b", "x", None)]),
        '["2"]': ("changed", [("note", None, "")]), '["4"]': ("changed", [("note", None, "")]),
    }
    counts = {(r["change"], r["column"]): r["n"] for r in change_counts(preview(Workflow(steps), df)).collect()}
    assert counts == {("removed", None): 2, ("changed", "note"): 2}
    with pytest.raises(ValueError):
        preview(Workflow(steps), df.drop("_row_id"))


def test_added_rows_and_types(spark):
    before = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "_row_id string, x int")
    after = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "_row_id string, x string")
    found = sorted((r["_row_id"] or "", r["change"], [tuple(c) for c in r["cells"]]) for r in difference(before, after).collect())
    assert found == [("", "removed", [("x", "3", None)]), ("b", "changed", [("x", "2", "3")]), ("c", "added", [("x", None, "4")])]
    assert difference(before.limit(0), before.limit(0)).collect() == []
