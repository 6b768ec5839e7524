"""Readers and writers of tables; every column of a text file is text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text as T

ENCODINGS = ["UTF-8", "windows-1252"]


def sniff(spark: SparkSession, path: str, separators: str = ",|\t;", encoding: str | None = None) -> tuple[str, str]:
    """Encoding and separator of a text file, read by Spark from any store.

    The separator is the most frequent one of the first five lines. The encoding is UTF-8 unless any line of the whole
    file isn't, which takes a scan; so it isn't looked for if it is given.
    """
    table = spark.read.text(path)
    lines = [r["value"] for r in table.limit(5).collect()]
    if encoding is None:
        encoding = ENCODINGS[not table.filter(~F.is_valid_utf8("value")).isEmpty()]
    counts = {s: sum(x.count(s) for x in lines) for s in separators}
    best = max(separators, key=lambda s: counts[s])
    return encoding, best if counts[best] else ","


#: Spark's reader knows ISO 8859-1, from which windows-1252 differs by these characters.
_WESTERN = {code: bytes([code]).decode("cp1252") for code in range(0x80, 0xA0) if code not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _western(c: Column, is_text: bool) -> Column:
    return F.translate(c, "".join(map(chr, _WESTERN)), "".join(_WESTERN.values())) if is_text else c


def read_table(spark: SparkSession, path: str, header: bool = True, encoding: str | None = None, **options) -> DataFrame:
    """A Parquet, CSV, TSV or text table by its suffix."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    encoding, separator = sniff(spark, path, encoding=encoding)
    western = encoding.lower() in ("windows-1252", "cp1252")
    df = spark.read.options(**{"header": header, "sep": separator, "encoding": "iso-8859-1" if western else encoding, "mode": "PERMISSIVE", "escape": '"', **options}).csv(path)
    return df.select(*[_western(T.column(c), t == "string").alias(c.translate(_WESTERN)) for c, t in df.dtypes]) if western else df


def trimmed(df: DataFrame) -> DataFrame:
    """df without rows of nulls only and without the columns at its end that hold nothing, found by one aggregate."""
    counts = df.agg(*[F.count(T.column(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first() if df.columns else []
    held = max((i for i, n in enumerate(counts) if n), default=-1)
    return df.select(*map(T.column, df.columns[: held + 1])).filter(reduce(Column.__or__, [T.column(c).isNotNull() for c in df.columns])) if held >= 0 else df.limit(0)


_SPACES = r"[\s\u00A0\u2000-\u200A\u202F\u3000\uFEFF]+"


def _plain(c: Column) -> Column:
    """A line or a field of a header as it is compared: without quotes and case, each run of spaces as one."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c, "\"'", ""), _SPACES, " ")))


def combine_text(spark: SparkSession, paths: list[str], separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """The lines of several text files, as they are, under the header of the first; columns file, block, line, value.

    Blank lines and lines of separators and quotes only go. Of later files, lines that repeat the header go, as do those
    that begin with its first two fields. Order by file, block and line for the order of the files; block is where in
    the file a task began to read, so a large file is read by many. Without a line in the first file it is an error.
    """
    parts = []
    for i, path in enumerate(paths):
        lines = spark.read.option("encoding", encoding).text(path).withColumn("block", F.col("_metadata.file_block_start"))
        parts.append(lines.select(F.lit(i).alias("file"), "block", F.monotonically_increasing_id().alias("line"), "value"))
    head = parts[0].filter("block = 0").orderBy("line").first()
    if head is None:
        raise ValueError(f"no lines in {paths[0]}")
    fields = head["value"].split(separator)
    plain = lambda x: _plain(F.lit(x))
    own = F.split(F.col("value"), T.quoted(separator))
    again = _plain(F.col("value")) == plain(head["value"])
    if len(fields) > 1:
        again = again | (F.coalesce(_plain(F.get(own, F.lit(0))) == plain(fields[0]), F.lit(False)) & F.coalesce(_plain(F.get(own, F.lit(1))) == plain(fields[1]), F.lit(False)))
    empty = _plain(F.replace(F.col("value"), F.lit(separator), F.lit(""))) == ""
    first = (F.col("block") == 0) & (F.col("line") == head["line"])
    parts = [p.filter(first | ~empty if i == 0 else ~empty & ~again) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, parts)


def write_text(lines: DataFrame, path: str) -> None:
    """The lines of combine_text in their order, in files that follow each other by name."""
    lines.orderBy("file", "block", "line").select("value").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False, quote_all: bool = False, header: bool = True) -> None:
    """CSV files, or text files with every field quoted; one_file is for small results."""
    (df.coalesce(1) if one_file else df).write.options(header=header, quoteAll=quote_all, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).mode("overwrite").csv(path)


def write_grouped(df: DataFrame, path: str, column: str) -> None:
    """A folder for each value of a column."""
    df.repartition(column).write.partitionBy(column).mode("overwrite").option("header", True).csv(path)
