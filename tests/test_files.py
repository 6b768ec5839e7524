"""Reading, combining and trimming files."""

import pytest

from tidewright.sources.files import combine_text, read_table, sniff, trimmed, write_text


def put(folder, name, data):
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder / name)


def test_combined_lines(spark, tmp_path):
    a = put(tmp_path, "a.csv", '"Cust No","Name",Zip\r\n1,"Ann ",2\r\n,,\r\n"","",""\r\n3,b,4\r\n')
    b = put(tmp_path, "b.csv", ' cust no , name,zip\n5,c,6\n\n"Cust  No","Name"\n7,d,8\ncust no,other,1\n')
    c = put(tmp_path, "c.csv", "")
    write_text(combine_text(spark, [a, b, c]), str(tmp_path / "out"))
    got = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert got == ['"Cust No","Name",Zip', '1,"Ann ",2', "3,b,4", "5,c,6", "7,d,8", "cust no,other,1"]
    with pytest.raises(ValueError):
        combine_text(spark, [c, a])


def test_order_over_many_blocks(spark, tmp_path):
    lines = ["h|k", *[f"{i}|x" for i in range(3000)]]
    paths = [put(tmp_path, f"{n}.txt", "\n".join(lines)) for n in "ab"]
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = combine_text(spark, paths, "|").orderBy("file", "block", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert [r["value"] for r in out] == [*lines, *lines[1:]] and len({r["block"] for r in out}) > 1


def test_encoding_of_a_late_line(spark, tmp_path):
    path = put(tmp_path, "x.csv", b"a;b\n" + b"1;2\n" * 50 + "é;€ “ü”\n".encode("cp1252"))
    assert sniff(spark, path) == ("windows-1252", ";")
    assert {tuple(r) for r in read_table(spark, path).collect()} == {("1", "2"), ("é", "€ “ü”")}
    assert sniff(spark, path, encoding="UTF-8") == ("UTF-8", ";")


def test_trimmed(spark):
    df = spark.createDataFrame([("a", None, "b", None), (None, None, None, None)], "p string, `q.r` string, s string, t string")
    assert trimmed(df).columns == ["p", "q.r", "s"] and trimmed(df).count() == 1
    assert trimmed(df.limit(0)).count() == 0
