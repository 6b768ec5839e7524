"""One workflow over many tables: a plan, a job, totals by table.

Each table gets the steps that it has the columns for; the others are skipped and named. All tables are one union, written once; rows that came in and went out are
observed by table while it is written, so no table is counted for itself. Removed rows are a union of their own.

Cases: a table without a fitting step comes out as it is. Tables may differ in columns; a column of differing types is text. Empty tables count 0. Steps that are
turned off are neither run nor skipped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators.base import Keep, get
from tidewright.plans.workflow import Workflow, step_id
from tidewright.stored import dropped, stored

SOURCE = "Source_File"


def fitting(workflow: Workflow, df: DataFrame) -> tuple[Workflow, list[dict[str, Any]]]:
    """The workflow without steps that the table can't take, and these with the reason."""
    kept, skipped = [], []
    for n, step in enumerate(workflow.steps, 1):
        if not step.get("enabled", True):
            continue
        id = step_id(step)
        try:
            op = get(id)
            if not op.needs_data:
                out = op.run(df, step.get("parameters") or step.get("params") or {}, [c for c in workflow.order if c in df.columns])
                df = out.kept() if isinstance(out, Keep) else out
                df.schema  # noqa: B018 - a plan that can't be made shows here
            kept.append(step)
        except Exception as e:
            skipped.append({"step": n, "operation_id": id, "reason": f"no operation {id}" if isinstance(e, KeyError) else str(e).split("\n")[0]})
    return Workflow(kept, workflow.order), skipped


def preset_columns(steps: list[dict[str, Any]]) -> set[str]:
    """Columns that the steps of a preset name."""
    found: set[str] = set()
    for step in steps:
        given = step.get("parameters") or step.get("params") or {}
        for name, value in given.items():
            if name in ("column", "columns", "location_columns") or name.endswith("_column"):
                found |= {x.strip() for x in (value.split(",") if isinstance(value, str) else value or []) if x.strip()}
    return found - {step.get("parameters", {}).get("new_column") for step in steps}


def best_preset(presets: dict[str, list[dict[str, Any]]], columns: list[str]) -> tuple[str | None, float]:
    """The preset of which most named columns are there, and their share; of equals the first."""
    shares = {n: len(own & set(columns)) / len(own) for n, steps in presets.items() if (own := preset_columns(steps))}
    name = max(shares, key=lambda n: shares[n], default=None)
    return name, shares.get(name, 0.0)


def _one(parts: list[DataFrame]) -> DataFrame:
    kinds: dict[str, set[str]] = {}
    for p in parts:
        for name, kind in p.dtypes:
            kinds.setdefault(name, set()).add(kind)
    mixed = [n for n, k in kinds.items() if len(k) > 1]
    parts = [p.withColumns({c: T.text(T.column(c)) for c in p.columns if c in mixed}) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@dataclass
class Batch:
    """rows: what all tables keep, with Source_File first; removed: rows that went, with the step (None if no step removes any); totals: by table rows_in, rows_out, removed, steps and skipped steps."""

    rows: DataFrame
    removed: DataFrame | None
    totals: dict[str, dict[str, Any]]

    def drop(self) -> None:
        dropped(self.rows)


def run_batch(tables: dict[str, DataFrame], workflow: Workflow) -> Batch:
    """The workflow over named tables, in one job."""
    plans = {name: fitting(workflow, df) for name, df in tables.items()}
    seen = {name: (Observation(), Observation()) for name in tables}
    parts, gone = [], []
    for name, df in tables.items():
        own, _ = plans[name]
        out = own.run(df.observe(seen[name][0], F.count("*").alias("n"))).observe(seen[name][1], F.count("*").alias("n"))
        parts.append(out.select(F.lit(name).alias(SOURCE), *[T.column(c) for c in out.columns if c != SOURCE]))
        if (removed := own.removed(df)) is not None:
            gone.append(removed.select(F.lit(name).alias(SOURCE), *[T.column(c) for c in removed.columns if c != SOURCE]))
    rows = stored(_one(parts), "batch")
    totals = {}
    for name, (own, skipped) in plans.items():
        came, went = (o.get["n"] for o in seen[name])
        totals[name] = {"rows_in": came, "rows_out": went, "removed": came - went, "steps": len(own.steps), "skipped": skipped}
    return Batch(rows, _one(gone) if gone else None, totals)
