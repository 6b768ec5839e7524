"""Rows that can be told apart through a workflow, and what a workflow changes in them.

A row's id is made where it is read: the file and the row's place in it, which don't depend on how the file is split over tasks. Operations carry it like any
column (those that choose columns keep it), so two states of a table are compared by one join on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators.base import ROW_ID
from tidewright.plans.workflow import Workflow

_CELLS = "array<struct<column: string, before: string, after: string>>"


def read_identified(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with ``_row_id``: the file's name, and the row's number in it."""
    return spark.read.parquet(path).select("*", F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")).alias(ROW_ID))


def identified(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with ``_row_id`` made of its own key columns, which have to tell rows apart; null and empty differ."""
    return df.withColumn(ROW_ID, F.to_json(F.array(*[T.text(T.column(k)) for k in keys])))


def _text(name: str, side: str, there: bool) -> Column:
    return T.text(F.col(f"{side}.`{name.replace('`', '``')}`")) if there else F.lit(None).cast("string")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of both that differ: _row_id, change ('changed', 'removed' or 'added') and cells (column, before, after).

    Values are compared as text, nulls as equal. Columns that only one of them has count as null in the other, so a row of a table that got
    a column is changed if its value isn't null. Rows without an id equal no others. A removed or added row has all its cells that aren't null.
    """
    names = list(dict.fromkeys([c for c in [*before.columns, *after.columns] if c != ROW_ID]))
    old, new = before.select(F.col(ROW_ID).alias("old_id"), F.struct(*[T.column(c) for c in before.columns]).alias("b")), after.select(F.col(ROW_ID).alias("new_id"), F.struct(*[T.column(c) for c in after.columns]).alias("a"))
    both = old.join(new, F.col("old_id") == F.col("new_id"), "full")
    cells = []
    for c in names:
        was, now = _text(c, "b", c in before.columns), _text(c, "a", c in after.columns)
        cells.append(F.when(~was.eqNullSafe(now), F.struct(F.lit(c).alias("column"), was.alias("before"), now.alias("after"))))
    change = F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").otherwise("changed")
    found = both.select(F.coalesce("old_id", "new_id").alias(ROW_ID), change.alias("change"), F.array_compact(F.array(*cells)).cast(_CELLS).alias("cells"))
    return found.filter((F.col("change") != "changed") | (F.size("cells") > 0))


def preview(workflow: Workflow, df: DataFrame) -> DataFrame:
    """What a workflow changes in df, which has ``_row_id``."""
    if ROW_ID not in df.columns:
        raise ValueError(f"the table needs the column {ROW_ID}: see read_identified and identified")
    own = Workflow(workflow.steps, [*workflow.order, ROW_ID])
    return difference(df, own.run(df))


def change_counts(changes: DataFrame) -> DataFrame:
    """Changed cells by column, and removed and added rows (column null)."""
    cells = changes.filter("change = 'changed'").select("change", F.explode("cells.column").alias("column"))
    rows = changes.filter("change <> 'changed'").select("change", F.lit(None).cast("string").alias("column"))
    return cells.unionByName(rows).groupBy("change", "column").agg(F.count("*").alias("n"))
