"""Exports read back; nothing is left behind by a failure."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from tidewright.sources.exports import comparison_sheets, export_groups, export_sheets, file_name, removed_rows, unique_names


def read(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.reader(f))


def test_names():
    assert [file_name(x) for x in ("a/b:c", "  x. ", None, "", "Größe (1)", "é" * 200)] == ["a_b_c", "x", "blank", "blank", "Größe (1)", "é" * 80]
    assert unique_names(["A", "a", "a/", None, "blank"]) == {"A": "A", "a": "a_2", "a/": "a_", "blank": "blank", None: "blank_2"}


def test_groups(spark, tmp_path):
    rows = [(i, ["north", "a/b", None, " ", "north "][i % 5], ["=1+1", "x,\"y\"\nz", None, ""][i % 4]) for i in range(101)]
    df = spark.createDataFrame(rows, "id int, region string, note string").repartition(4)
    gone = spark.createDataFrame(rows[:2], df.schema)
    found = export_groups(df, str(tmp_path / "out"), "region", removed=gone, max_rows=15, order=["id"]).collect()
    want = {"north": [r for r in rows if (r[1] or "").strip() == "north"], "a_b": [r for r in rows if r[1] == "a/b"], "blank": [r for r in rows if not (r[1] or "").strip()]}
    text = lambda v: "" if v is None else "'" + v if v.startswith("=") else v
    for name, own in want.items():
        n = -(-len(own) // 15)
        files = [f"{name}_processed{f'_{k + 1}' if n > 1 else ''}.csv" for k in range(n)]
        got = [r for f in files for r in read(tmp_path / "out" / f)[1:]]
        assert got == [[str(i), region or "", text(note)] for i, region, note in own]
        assert [read(tmp_path / "out" / f)[0] for f in files] == [["id", "region", "note"]] * n
        assert [r["rows"] for f in files for r in found if r["file"] == f] == [min(15, len(own) - 15 * k) for k in range(n)]
    assert len(read(tmp_path / "out" / "north_removed.csv")) == 2
    assert {r["file"] for r in found} == {f for f in os.listdir(tmp_path / "out") if not f.startswith(".")}
    with pytest.raises(FileExistsError):
        export_groups(df, str(tmp_path / "out"), "region")
    export_groups(df.limit(0), str(tmp_path / "out"), "region", overwrite=True)
    assert [f for f in os.listdir(tmp_path / "out") if not f.startswith(".")] == []
    with pytest.raises(ValueError):
        export_groups(df, str(tmp_path / "many"), "id", max_files=50)


def test_a_failure_leaves_nothing(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g")).withColumn("x", F.when(F.col("id") == 77, F.raise_error(F.lit("bad row"))).otherwise(F.col("id").cast("string")))
    with pytest.raises(Exception, match="bad row"):
        export_groups(df, str(tmp_path / "out"), "g")
    good = spark.range(3).select("id")
    with pytest.raises(Exception, match="bad row"):
        export_sheets({"good": good, "bad": df}, str(tmp_path / "both"))
    assert os.listdir(tmp_path) == []


def test_sheets(spark, tmp_path):
    a, b = spark.createDataFrame([(2, "x"), (1, "y")], "id int, `a,b` string"), spark.createDataFrame([], "id int, `a,b` string")
    found = export_sheets({"Results": a, "Removed": b, "results": a}, str(tmp_path / "book"), order=["id"], quote_all=True)
    assert sorted(map(tuple, found.collect())) == [("Removed.csv", "Removed", 1, 0), ("Results.csv", "Results", 1, 2), ("results_2.csv", "results", 1, 2)]
    assert read(tmp_path / "book" / "Results.csv") == [["id", "a,b"], ["1", "y"], ["2", "x"]] and read(tmp_path / "book" / "Removed.csv") == [["id", "a,b"]]
    assert (tmp_path / "book" / "Results.csv").read_text().startswith('"id","a,b"\n"1","y"')


def test_removed_rows_of_sheets(spark):
    a = spark.createDataFrame([(2, "p", "step"), (1, "q", "step")], "id int, x string, _Removed_By string")
    b = spark.createDataFrame([(5, "r", "own")], "id int, y string, RemovedReason string")
    out = removed_rows({"one": a, "two": b}, ["id"])
    assert out.columns[:3] == ["SourceSheet", "SourceRowIndex", "RemovedReason"]
    assert sorted((r["SourceSheet"], r["SourceRowIndex"], r["RemovedReason"], r["id"]) for r in out.collect()) == [("one", 0, "step", 1), ("one", 1, "step", 2), ("two", 0, "own", 5)]


def test_comparison(spark):
    linked = spark.createDataFrame([("a", 1, None, None, None, None), ("b", 2, 1, "Email Match", "a", 1)], "Source_File string, id int, Overlap_Tier int, Match_Reason string, Matched_File string, Matched_With_Index int")
    sheets = comparison_sheets(linked, linked.groupBy("Source_File").count(), {1: "Email", 2: "Phone"})
    assert list(sheets) == ["Summary", "Tier 1 Email", "Tier 2 Phone", "Unique"]
    assert [sheets[k].count() for k in sheets] == [2, 1, 0, 1] and sheets["Unique"].columns == ["Source_File", "id"]
