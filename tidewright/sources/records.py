"""Records of delimited text files whose quoted fields may hold line breaks, read by many tasks a file, and their repair.

A line break ends a record unless it stands within quotes, and whether it does depends on all that comes before. So each line is
taken as a function: in what state (outside or within quotes) it ends, for either state that it may begin in. A task composes the functions of the lines that
it reads; a block of a file is then a function too, and blocks are put together in the order of the file. With the state at the start
of each block known, every line knows its state and the line that its record began with, and only records of several lines are
grouped.

Quotes count as Python's csv module has it: they open at the start of a field only, double ones within are one, and what follows a closing quote up to the
separator belongs to the field.

Scale: files are split as Spark splits text. Lines are stored once, with their states for either start. What is gathered of a file is a few numbers a block. Lines of a record
are grouped by the record, up to ``max_lines``; a quote that is never closed would make the rest of a file one record, so
longer ones are bad records, line by line.

Cases: empty lines are no records. A carriage return before the line break goes. Headers are compared as NFKC texts without outer blanks, quotes and case; nameless columns are not
expected in rows. Rows with more fields than the header are trimmed if the surplus is empty, those with fewer are bad unless ``pad`` is given. A mark of byte order goes.
"""

from __future__ import annotations

import csv
import io
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidewright.functions import text as T
from tidewright.stored import dropped, stored

#: Lines of a record at most; a longer one is bad.
MAX_LINES = 10_000
_LINES = "file string, block bigint, seq bigint, value string, before0 boolean, before1 boolean, after0 boolean, after1 boolean, start0 bigint, start1 bigint"


def ends_within(line: str, within: bool, separator: str) -> bool:
    """Whether a line ends within quotes that began outside of them, or within."""
    at, n = 0, len(line)
    while True:
        if not within:
            # At the start of a field: past it, if it isn't quoted.
            while at < n and line[at] != '"':
                at = line.find(separator, at)
                if at < 0:
                    return False
                at += 1
            if at >= n:
                return False
            at += 1
        while True:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] != '"':
                break
            at += 2
        within = False
        at = line.find(separator, at + 1)
        if at < 0:
            return False
        at += 1


def _states(separator: str):
    """For lines in the order of their blocks: state before and after, and the start of the record, for either state at the block's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state, started = None, [False, True], [-1, -1]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            files, blocks, values = batch.column("file").to_pylist(), batch.column("block").to_numpy(), batch.column("value")
            seq = batch.column("seq").to_numpy()
            quoted = set(np.flatnonzero(batch.column("quoted").to_numpy(zero_copy_only=False)).tolist())
            fresh = {i for i in range(n) if (files[i], blocks[i]) != (files[i - 1], blocks[i - 1])} - {0} if n > 1 else set()
            if (files[0], blocks[0]) != place:
                fresh.add(0)
            before, after = np.zeros((2, n), bool), np.zeros((2, n), bool)
            edges = sorted(quoted | fresh)
            at = 0
            for i in [*edges, n]:
                for s in (0, 1):  # lines between have no quotes and keep the state
                    before[s, at:i] = after[s, at:i] = state[s]
                if i == n:
                    break
                if i in fresh:
                    state = [False, True]
                for s in (0, 1):
                    before[s, i] = state[s]
                if i in quoted:
                    line = values[i].as_py()
                    ends = {b: ends_within(line, b, separator) for b in set(state)}
                    state = [ends[b] for b in state]
                for s in (0, 1):
                    after[s, i] = state[s]
                at = i + 1
            starts = []
            bounds = [0, *sorted(fresh - {0}), n]
            for s in (0, 1):
                own = np.where(before[s], -1, seq)
                carried = -1 if 0 in fresh else started[s]
                for a, b in zip(bounds, bounds[1:]):
                    own[a] = max(own[a], carried)
                    np.maximum.accumulate(own[a:b], out=own[a:b])
                    carried = -1
                starts.append(own)
                started[s] = int(own[-1])
            place = files[-1], blocks[-1]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), batch.column("seq"), values, *map(pa.array, (before[0], before[1], after[0], after[1], starts[0], starts[1]))], names=[x.split()[0] for x in _LINES.split(", ")])

    return run


def _entries(blocks: pd.DataFrame) -> pd.DataFrame:
    """Of a file's blocks in order: the state at the start, and the start of the record that is open there."""
    blocks = blocks.sort_values("block")
    state, began, states, starts = False, -1, [], []
    for r in blocks.itertuples():
        states.append(state)
        starts.append(began)
        own = r.start1 if state else r.start0
        began = own if own >= 0 else began
        state = bool(r.after1 if state else r.after0)
    return pd.DataFrame({"file": blocks["file"], "block": blocks["block"], "within": states, "began": starts})


@dataclass
class Records:
    """records: file, seq, text of each whole record, n_lines; broken: the lines of those that are too long. Both read stored tables; drop() deletes them."""

    records: DataFrame
    broken: DataFrame
    tables: list[DataFrame]

    def drop(self) -> None:
        dropped(*self.tables)


def read_records(spark: SparkSession, paths: str | list[str], separator: str = ",", encoding: str = "UTF-8", max_lines: int = MAX_LINES) -> Records:
    """The records of text files: file, seq (their order within a file), text, n_lines."""
    raw = spark.read.options(encoding=encoding, lineSep="\n").text(paths)
    placed = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    first = (F.col("block") == 0) & F.col("value").startswith("﻿")
    placed = placed.withColumn("value", F.when(first, F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))).withColumn("quoted", F.contains("value", F.lit('"')))
    lines = stored(placed.mapInArrow(_states(separator), _LINES), "records-lines")
    last = F.max(F.struct("seq", "after0", "after1")).alias("l")
    blocks = lines.groupBy("file", "block").agg(last, F.max("start0").alias("start0"), F.max("start1").alias("start1")).select("file", "block", "l.after0", "l.after1", "start0", "start1")
    entries = stored(blocks.groupBy("file").applyInPandas(_entries, "file string, block bigint, within boolean, began bigint"), "records-blocks")
    own = lambda name: F.when(F.col("within"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    known = lines.join(entries, ["file", "block"]).select("file", "seq", "value", own("before").alias("before"), own("after").alias("after"), F.greatest(own("start"), "began").alias("start"))
    bare = lambda c: F.regexp_replace(c, "\r$", "")
    single = known.filter("not before and not after").select("file", "seq", bare(F.col("value")).alias("text"), F.lit(1).cast("bigint").alias("n_lines"))
    several = known.filter("before or after")
    sizes = several.groupBy("file", "start").agg(F.count("*").alias("n_lines"), F.bool_or(~F.col("after")).alias("closed"))
    fits = (F.col("n_lines") <= max_lines) & F.col("closed")
    whole = several.join(sizes.filter(fits), ["file", "start"]).groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("l"), F.first("n_lines").alias("n_lines"))
    joined = whole.select("file", F.col("start").alias("seq"), bare(F.array_join("l.value", "\n")).alias("text"), "n_lines")
    broken = several.join(sizes.filter(~fits), ["file", "start"]).select("file", "seq", F.col("value").alias("text"), F.col("start").alias("record"))
    return Records(single.filter("text <> ''").unionByName(joined), broken, [lines, entries])


def _fields_of(separator: str):
    @F.pandas_udf(ArrayType(StringType()))
    def fields(texts: pd.Series) -> pd.Series:
        csv.field_size_limit(1 << 30)
        return pd.Series([None if t is None else next(csv.reader(io.StringIO(t, newline=""), delimiter=separator), []) for t in texts], dtype=object)

    return fields


def with_fields(records: DataFrame, separator: str = ",") -> DataFrame:
    """records with fields; only texts with quotes go through Python."""
    text, quoted = F.col("text"), F.contains("text", F.lit('"'))
    return records.withColumn("fields", F.when(quoted, _fields_of(separator)(F.when(quoted, text))).otherwise(F.split(text, T.quoted(separator), -1)))


def header_key(name: str) -> str:
    """A header's name as it is compared."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", name).strip().strip('"').strip("'")).lower()


@dataclass
class Combined:
    """rows: the header's columns, and _file, _seq if asked; bad: file, seq, problem, n_fields, fields, text."""

    rows: DataFrame
    bad: DataFrame
    header: list[str]
    tables: list[DataFrame]

    def drop(self) -> None:
        dropped(*self.tables)


def combine_records(spark: SparkSession, paths: list[str], separator: str = ",", encoding: str = "UTF-8", pad: bool = False, places: bool = False, max_lines: int = MAX_LINES) -> Combined:
    """Rows of several files under one header; whatever doesn't fit it is told apart. Files whose headers differ are an error.

    Problems are 'too many fields', 'too few fields' and 'open quote' (one row a line).
    """
    read = read_records(spark, paths, separator, encoding, max_lines)
    found = stored(with_fields(read.records, separator), "records-fields")
    heads = found.groupBy("file").agg(F.min_by("fields", "seq").alias("fields"), F.min("seq").alias("seq"))
    rows = heads.collect()  # one a file
    if not rows:
        raise ValueError("no records")
    order = {spark._jvm.org.apache.hadoop.fs.Path(p).getName(): i for i, p in enumerate(paths)}
    rows.sort(key=lambda r: (order.get(r["file"].rsplit("/", 1)[-1], len(order)), r["file"]))
    named = {r["file"]: [f for f in r["fields"] if f] or list(r["fields"]) for r in rows}
    header = named[rows[0]["file"]]
    for file, own in named.items():
        if list(map(header_key, own)) != list(map(header_key, header)):
            differ = [f"{a!r} and {b!r}" for a, b in zip(header, own) if header_key(a) != header_key(b)][:3]
            raise ValueError(f"header of {file} has {len(own)} columns, the first {len(header)}" if len(own) != len(header) else f"header of {file} differs: {', '.join(differ)}")
    n = len(header)
    body = found.join(heads.select("file", F.col("seq").alias("__head")), "file").filter("seq > __head")
    size = F.size("fields")
    surplus = F.exists(F.slice("fields", n + 1, F.greatest(size, F.lit(1))), lambda f: f != "")
    problem = F.when((size > n) & surplus, "too many fields").when((size < n) & F.lit(not pad), "too few fields")
    judged = body.withColumn("problem", problem)
    where = [F.col("file").alias("_file"), F.col("seq").alias("_seq")] if places else []
    good = judged.filter("problem is null").select(*where, *[F.get("fields", i).alias(h) for i, h in enumerate(header)])
    bad = judged.filter("problem is not null").select("file", "seq", "problem", size.alias("n_fields"), "fields", "text")
    open_ = read.broken.select("file", "seq", F.lit("open quote").alias("problem"), F.lit(None).cast("int").alias("n_fields"), F.lit(None).cast("array<string>").alias("fields"), "text")
    return Combined(good, bad.unionByName(open_), header, [*read.tables, found])
