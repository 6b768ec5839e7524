"""Records of text files, with quoted line breaks over blocks, against Python's csv module."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.sources.records import combine_records, ends_within, header_key, read_records, with_fields


@given(st.lists(st.text('a",\n é', max_size=30), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_a_line_ends_as_the_csv_module_has_it(parts):
    text = "\n".join(parts)
    within = False
    for line in text.split("\n"):
        within = ends_within(line, within, ",")
    # An open quote takes what is put behind the text into its field; otherwise that is a record of its own.
    rows = [r for r in csv.reader(io.StringIO(text + "\nEND", newline="")) if r]
    assert within == (rows[-1] != ["END"])


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def quoted(field):
    return '"' + field.replace('"', '""') + '"'


def test_files_in_many_blocks(spark, tmp_path, small_blocks):
    rng = random.Random(3)
    want = {}
    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n")):
        rows = [["id", "note", "more"]]
        for i in range(150):
            note = rng.choice(["plain", 'inch 5" pipe', "", "é", quoted("two\nlines"), quoted('a "word", and\n\n"more"'), quoted("\n".join("long" * 20 for _ in range(8))), quoted("x") + "tail"])
            rows.append([str(i), note, rng.choice(["", "end", quoted("")])])
        text = end.join(",".join(r) for r in rows) + end
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
        want[name] = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    read = read_records(spark, [str(tmp_path / n) for n in want])
    found = with_fields(read.records).collect()
    assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 20
    for name, rows in want.items():
        got = [r["fields"] for r in sorted((r for r in found if r["file"].endswith(name)), key=lambda r: r["seq"])]
        assert got == rows
    assert read.broken.count() == 0
    read.drop()


def test_repair(spark, tmp_path):
    (tmp_path / "one.csv").write_text('﻿Name, Code ,,\nAnn,1,,\n\nBob,2,x\nC\n"D, E",3,,,\n  ,\n', encoding="utf-8")
    (tmp_path / "two.csv").write_text("NAME,\"code\"\nＦ,4\nG,5,\n", encoding="utf-8")
    paths = [str(tmp_path / n) for n in ("one.csv", "two.csv")]
    out = combine_records(spark, paths, places=True)
    assert out.header == ["Name", " Code "]
    assert sorted((r["Name"], r[" Code "]) for r in out.rows.collect()) == [("  ", ""), ("Ann", "1"), ("D, E", "3"), ("G", "5"), ("Ｆ", "4")]
    assert sorted((r["problem"], r["n_fields"], r["text"]) for r in out.bad.collect()) == [("too few fields", 1, "C"), ("too many fields", 3, "Bob,2,x")]
    out.drop()
    padded = combine_records(spark, paths, pad=True)
    assert ("C", None) in {tuple(r) for r in padded.rows.collect()}
    assert header_key("  \"Ｃode \t Name\" ") == "code name"
    (tmp_path / "three.csv").write_text("Name,Kode\nx,1\n")
    with pytest.raises(ValueError, match="differs"):
        combine_records(spark, [paths[0], str(tmp_path / "three.csv")])
    with pytest.raises(ValueError, match="columns"):
        (tmp_path / "four.csv").write_text("Name\nx\n")
        combine_records(spark, [paths[0], str(tmp_path / "four.csv")])


def test_open_quotes_are_bad_records(spark, tmp_path, small_blocks):
    path = tmp_path / "open.csv"
    path.write_text("a,b\n1,2\n3,\"never closed\n" + "".join(f"{i},{i}\n" for i in range(200)))
    out = combine_records(spark, [str(path)])
    assert [tuple(r) for r in out.rows.collect()] == [("1", "2")]
    assert {r["problem"] for r in out.bad.collect()} == {"open quote"} and out.bad.count() == 201
    path.write_text("a,b\n1,\"" + "x\n" * 50 + "\"\n2,3\n")
    out = combine_records(spark, [str(path)], max_lines=10)
    assert [tuple(r) for r in out.rows.collect()] == [("2", "3")] and out.bad.count() == 51
    path.write_text("")
    with pytest.raises(ValueError, match="no records"):
        combine_records(spark, [str(path)])
