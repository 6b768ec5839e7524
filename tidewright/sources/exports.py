"""Exports as named files: one a group or sheet, in numbered parts where it is large, published together.

Tasks write into a staging folder by Spark's own commit protocol, so a task that fails or runs twice leaves nothing; then the files get their names and the
folder its place, by renames in whatever store it lies. If anything fails the staging folder goes and the target never shows.

Scale: a part is written by one task and holds ``max_rows`` rows at most. Rows are numbered within their group by counts of stored partitions, so no task sees all of a large
group. What reaches the driver is a row for each file that is to be named, of which ``max_files`` may be.

Cases: null, empty and blank groups are one group, ``blank``. Names keep letters, digits, blanks and ``-_.()``; groups whose names agree then are told apart by a number. Text that a
spreadsheet would take for a formula gets an apostrophe. Without rows there are no files of a group, and a sheet is a file with its header.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.stored import dropped, stored

_LONGEST = 80


def file_name(group: str | None) -> str:
    """A group's name as a file can have it."""
    own = re.sub(r"[^\w .()-]+", "_", (group or "").strip()).strip(" .")
    return own[:_LONGEST] or "blank"


def unique_names(groups: list[str | None]) -> dict[str | None, str]:
    """Names of groups; those that agree but for case are numbered."""
    out, seen = {}, set()
    for g in sorted(groups, key=lambda g: (g is None, g or "")):
        name, k = file_name(g), 1
        while (own := name if k == 1 else f"{name}_{k}").lower() in seen:
            k += 1
        seen.add(own.lower())
        out[g] = own
    return out


def _safe(c: Column, kind: str) -> Column:
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c) if kind == "string" else c


class _Store:
    """Renames and deletions in the store of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def folder(self, path: str) -> None:
        self.fs.mkdirs(self.path(path))

    def move(self, source: str, target: str) -> None:
        if not self.fs.rename(self.path(source), self.path(target)):
            raise OSError(f"can't rename {source} to {target}")

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def files(self, path: str) -> list[str]:
        return [s.getPath().toString() for s in self.fs.listStatus(self.path(path)) if s.getPath().getName().startswith("part-")] if self.exists(path) else []


def _numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """df, which has __group, as a stored table, and it with __rank: places from 0 within a group, by order or as rows come."""
    dealt = df.repartitionByRange("__group", *map(T.column, order)) if order else df
    held = stored(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "export")
    sizes = held.groupBy("__group", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("__group").alias("__g"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__group", "__part").orderBy(*map(T.column, order), "__at"))
    placed = held.withColumn("__own", own).join(starts, (F.col("__group") == F.col("__g")) & (F.col("__part") == F.col("__p")))
    return held, placed.withColumn("__rank", F.col("__start") + F.col("__own") - 1)


def _staged(df: DataFrame, group: Column, store: _Store, staging: str, suffix: str, max_rows: int, max_files: int, order: list[str], quote_all: bool, names: list[str] | None) -> list[tuple[str, str | None, int, int]]:
    """Writes the files of df into staging; (file, group, part, rows) of each. names: of the only group."""
    columns = [F.struct(*[_safe(T.column(c), kind).alias(c) for c, kind in df.dtypes]).alias("row")]
    keyed = df.select(F.coalesce(F.nullif(F.trim(T.text(group)), F.lit("")), F.lit("")).alias("__group"), *[T.column(c).alias(c) for c in order], *columns)
    held, placed = _numbered(keyed, order)
    try:
        counts = held.groupBy("__group").count().limit(max_files + 1).collect()
        parts = {r["__group"]: -(-r["count"] // max_rows) for r in counts}
        if sum(parts.values()) > max_files:
            raise ValueError(f"over {max_files} files")
        called = {"": names[0]} if names else unique_names([g or None for g in parts])
        work = f"{staging}/.{uuid.uuid4().hex}"
        spread = placed.withColumn("__file", F.expr(f"cast(__rank div {max_rows} as int)"))
        # A task may write several small files, but a file is one task's: rows of a part go where its name and number send them.
        dealt = spread.repartition(F.col("__group"), F.col("__file")).sortWithinPartitions("__group", "__file", "__rank")
        folder = F.sha1("__group").alias("__folder")
        dealt.select("row.*", folder, "__file").write.partitionBy("__folder", "__file").options(header=True, quoteAll=quote_all, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(work)
        found = []
        digest = {r["__folder"]: r for r in held.select("__group").distinct().select("__group", folder).collect()}
        for key, row in digest.items():
            g, n = row["__group"], parts[row["__group"]]
            name = called[g] if names else called[g or None]
            for k in range(n):
                (file,) = store.files(f"{work}/__folder={key}/__file={k}")
                target = f"{name}{suffix}{f'_{k + 1}' if n > 1 else ''}.csv"
                store.move(file, f"{staging}/{target}")
                total = next(r["count"] for r in counts if r["__group"] == g)
                found.append((target, g or None, k + 1, min(max_rows, total - k * max_rows)))
        store.delete(work)
        return found
    finally:
        dropped(held)


def _published(spark: SparkSession, folder: str, overwrite: bool, write) -> DataFrame:
    """Runs write(store, staging), gives the staging folder its place, and returns what was written as a table."""
    folder = folder.rstrip("/")
    store = _Store(spark, folder)
    if store.exists(folder) and not overwrite:
        raise FileExistsError(folder)
    staging = f"{folder}.staging-{uuid.uuid4().hex}"
    try:
        store.folder(staging)
        found = write(store, staging)
        if store.exists(folder):
            store.delete(folder)
        store.move(staging, folder)
    finally:
        if store.exists(staging):
            store.delete(staging)
    return spark.createDataFrame(found, "file string, name string, part int, rows long")


def export_groups(df: DataFrame, folder: str, column: str, suffix: str = "_processed", removed: DataFrame | None = None, max_rows: int = 1_000_000, max_files: int = 10_000, order: list[str] | None = None, quote_all: bool = False, overwrite: bool = False) -> DataFrame:
    """A CSV file for each value of a column, and one with ``_removed`` for that of removed rows if given; returns file, name, part, rows."""
    parts = [(df, suffix)] + ([(removed, "_removed")] if removed is not None else [])

    def write(store: _Store, staging: str) -> list:
        return [x for own, end in parts for x in _staged(own, T.column(column), store, staging, end, max_rows, max_files, order or [], quote_all, None)]

    return _published(df.sparkSession, folder, overwrite, write)


def export_sheets(sheets: dict[str, DataFrame], folder: str, max_rows: int = 1_000_000, max_files: int = 10_000, order: list[str] | None = None, quote_all: bool = False, overwrite: bool = False) -> DataFrame:
    """Named tables as CSV files, all or none; an empty one is a file with its header."""
    spark = next(iter(sheets.values())).sparkSession
    called = unique_names(list(sheets))

    def write(store: _Store, staging: str) -> list:
        found = []
        for name, df in sheets.items():
            own = [c for c in order or [] if c in df.columns]
            files = _staged(df, F.lit(""), store, staging, "", max_rows, max_files, own, quote_all, [called[name]])
            if not files:
                work = f"{staging}/.{uuid.uuid4().hex}"
                header = ",".join('"' + c.replace('"', '""') + '"' if quote_all or re.search(r'[",\r\n]', c) else c for c in df.columns)
                spark.createDataFrame([(header,)], "value string").coalesce(1).write.text(work)
                store.move(store.files(work)[0], f"{staging}/{called[name]}.csv")
                store.delete(work)
                files = [(f"{called[name]}.csv", None, 1, 0)]
            found += [(file, name, part, rows) for file, _, part, rows in files]
        return found

    return _published(spark, folder, overwrite, write)


def removed_rows(removed: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """Removed rows of several sheets as one: SourceSheet, SourceRowIndex (places from 0 in the given order) and RemovedReason first, unless they are there."""
    frames = []
    for name, df in removed.items():
        keyed = df.select(F.lit("").alias("__group"), *[T.column(c).alias(f"__o{i}") for i, c in enumerate(order)], F.struct(*map(T.column, df.columns)).alias("row"))
        _, placed = _numbered(keyed, [f"__o{i}" for i in range(len(order))])
        first = {"SourceSheet": F.lit(name), "SourceRowIndex": F.col("__rank"), "RemovedReason": F.col("row._Removed_By") if "_Removed_By" in df.columns else F.lit("")}
        frames.append(placed.select(*[v.alias(k) for k, v in first.items() if k not in df.columns], "row.*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def comparison_sheets(linked: DataFrame, summary: DataFrame, tiers: dict[int, str]) -> dict[str, DataFrame]:
    """What link_files and link_summary found, as sheets: the summary, the matches of each tier, and the rows without one."""
    own = {f"Tier {k} {name}": linked.filter(F.col("Overlap_Tier") == k) for k, name in tiers.items()}
    return {"Summary": summary} | own | {"Unique": linked.filter("Overlap_Tier is null").drop("Overlap_Tier", "Match_Reason", "Matched_File", "Matched_With_Index")}
