"""Workflows: ordered operations compiled into one lazy plan, with an account of removed rows."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import row_ops, text_ops  # noqa: F401 - they register operations
from tidewright.operators.base import ALIASES, REGISTRY, Keep, get


def step_id(step: dict[str, Any]) -> str | None:
    """The operation of a step, by operation_id, class, id or, as older files have it, the name of a class or of the operation.

    UppercaseOperation, Uppercase and text uppercase are text_uppercase: words joined by underscores, if one operation is called so or ends so.
    """
    given = step.get("operation_id") or step.get("class") or step.get("id") or step.get("name")
    if given is None or given in REGISTRY or given in ALIASES:
        return given
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+", "_", given.strip().removesuffix("Operation")).strip("_").lower()
    if words in REGISTRY or words in ALIASES:
        return words
    ends = [o for o in REGISTRY if o.endswith(f"_{words}")]
    return ends[0] if len(ends) == 1 else given


@dataclass
class Workflow:
    """steps: {operation_id, parameters, enabled}; order: columns that tell the order of rows."""

    steps: list[dict[str, Any]]
    order: list[str] = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str, order: list[str] | None = None) -> Workflow:
        found = json.loads(text)
        steps = found["operations"] if isinstance(found, dict) else found
        return cls(sorted(steps, key=lambda s: s.get("order", 0)), order or [])

    def to_json(self) -> str:
        return json.dumps({"operations": self.steps}, indent=1)

    def _walk(self, df: DataFrame):
        for n, step in enumerate(self.steps, 1):
            if not step.get("enabled", True):
                continue
            op = get(step_id(step))
            out = op.run(df, step.get("parameters") or step.get("params") or {}, [c for c in self.order if c in df.columns])
            yield n, op, out
            df = out.kept() if isinstance(out, Keep) else out

    def run(self, df: DataFrame) -> DataFrame:
        """The rows that all steps keep."""
        for _, _, out in self._walk(df):
            df = out.kept() if isinstance(out, Keep) else out
        return df

    def removed(self, df: DataFrame) -> DataFrame | None:
        """The rows that steps removed, as they were before, with the step's name, id and number."""
        parts = [out.removed().withColumns({"_Removed_By": F.lit(op.id), "_Operation_ID": F.lit(op.id), "_Step": F.lit(n)}) for n, op, out in self._walk(df) if isinstance(out, Keep)]
        if not parts:
            return None
        kinds: dict[str, set[str]] = {}
        for part in parts:
            for name, kind in part.dtypes:
                kinds.setdefault(name, set()).add(kind)
        mixed = {name for name, found in kinds.items() if len(found) > 1}
        parts = [p.withColumns({c: F.col(f"`{c}`").cast("string") for c in p.columns if c in mixed}) for p in parts]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def preview(self, df: DataFrame, rows: int = 100) -> DataFrame:
        return self.run(df.limit(rows))

    def validate(self, df: DataFrame) -> list[str]:
        """What is wrong with the steps, found from the schema alone."""
        problems = []
        for n, step in enumerate(self.steps, 1):
            id = step_id(step)
            try:
                op = get(id)
            except KeyError:
                problems.append(f"step {n}: no operation {id}")
                continue
            if op.needs_data or not step.get("enabled", True):
                continue
            try:
                out = op.run(df, step.get("parameters") or step.get("params") or {}, [c for c in self.order if c in df.columns])
                df = out.kept() if isinstance(out, Keep) else out
            except Exception as e:  # a plan that can't be made is what is looked for
                problems.append(f"step {n}: {id}: {e}")
        return problems


def apply(df: DataFrame, operation_id: str, order: list[str] | None = None, /, **parameters) -> DataFrame:
    return Workflow([{"operation_id": operation_id, "parameters": parameters}], order or []).run(df)


def operations() -> list[str]:
    return sorted(REGISTRY)
