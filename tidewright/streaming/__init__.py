"""Workflows over streams: operations that look at one row at a time run on a stream as they do on a table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from tidewright.operators.base import get
from tidewright.plans.workflow import Workflow

#: Operations that compare rows with one another, so that a stream would have to end first.
ACROSS_ROWS = {"data_remove_duplicates", "data_keep_best_contact_per_location", "data_keep_best_by_value", "data_sort", "data_set_header_row"}


def over_stream(stream: DataFrame, steps: list[dict[str, Any]], order: list[str] | None = None) -> DataFrame:
    """The rows that a workflow's steps make of a stream, without state; steps that compare rows raise a ValueError.

    Lookup tables are static. Nulls, ties and empty batches are treated as each operation says.
    """
    names = [get(s.get("operation_id") or s.get("class") or s.get("id")).id for s in steps]
    across = [n for n in names if n in ACROSS_ROWS]
    if across:
        raise ValueError(f"not on a stream: {', '.join(across)}")
    return Workflow(steps, order or []).run(stream)
