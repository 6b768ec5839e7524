"""Operations: named, parameterised steps from a table to a table.

An operation returns a DataFrame, or a Keep: the predicate of rows that stay, or a flag column by which
kept and removed rows are told apart, so that removed rows come from the same plan without a join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Keep:
    """frame: rows with a boolean expression ``stays``; drop: helper columns that leave with it."""

    frame: DataFrame
    stays: Column
    drop: tuple[str, ...] = ()

    def kept(self) -> DataFrame:
        return self.frame.filter(self.stays).drop(*self.drop)

    def removed(self) -> DataFrame:
        return self.frame.filter(self.stays.isNull() | ~self.stays).drop(*self.drop)


@dataclass(frozen=True)
class Operation:
    id: str
    category: str
    apply: Callable[[DataFrame, dict[str, Any], list[str]], DataFrame | Keep]
    params: dict[str, Any] = field(default_factory=dict)
    needs_data: bool = False

    @property
    def description(self) -> str:
        return (self.apply.__doc__ or "").strip()

    def filled(self, given: dict[str, Any]) -> dict[str, Any]:
        """Parameters with defaults, lists from comma texts and numbers from texts."""
        out = {}
        for name, default in self.params.items():
            value = given.get(name)
            if value is None:
                value = default
            if default is list and isinstance(value, str):
                value = [x.strip() for x in value.split(",") if x.strip()]
            if isinstance(default, bool) and isinstance(value, str):
                value = value.strip().lower() in ("true", "yes", "1")
            elif isinstance(default, int) and not isinstance(default, bool) and isinstance(value, (str, float)):
                value = int(float(value))
            out[name] = value
        missing = [n for n, v in out.items() if isinstance(v, type)]
        if missing:
            raise ValueError(f"{self.id}: missing {', '.join(missing)}")
        return out

    def run(self, df: DataFrame, given: dict[str, Any], order: list[str]) -> DataFrame | Keep:
        p = self.filled(given)
        for name in self.params:
            if name in ("column", "columns", "location_columns") and self.params[name] in (str, list):
                lost = [c for c in ([p[name]] if isinstance(p[name], str) else p[name]) if isinstance(c, str) and c not in df.columns]
                if lost and self.id not in ("clean_keep_columns",):
                    raise ValueError(f"{self.id}: no column {', '.join(lost)}")
        return self.apply(df, p, order)


#: Column that tells rows apart through a workflow; operations that choose columns keep it.
ROW_ID = "_row_id"
REGISTRY: dict[str, Operation] = {}
ALIASES = {"text_title_case": "text_titlecase"}


def operation(id: str, category: str, needs_data: bool = False, **params):
    """Registers a function as an operation. A parameter's value is its default, or a type if it is required."""

    def register(f):
        REGISTRY[id] = Operation(id, category, f, params, needs_data)
        return f

    return register


def get(id: str) -> Operation:
    return REGISTRY[ALIASES.get(id, id)]


def search(words: str) -> list[Operation]:
    words = words.lower()
    return [o for o in REGISTRY.values() if words in o.id.lower() or words in o.category.lower() or words in o.description.lower()]


def by_category(category: str) -> list[Operation]:
    return [o for o in REGISTRY.values() if o.category == category]


def categories() -> dict[str, int]:
    """How many operations each category has."""
    out: dict[str, int] = {}
    for o in REGISTRY.values():
        out[o.category] = out.get(o.category, 0) + 1
    return dict(sorted(out.items()))


def described() -> list[dict[str, Any]]:
    """Every operation as plain values, by id: what it is and its parameters, with defaults or the types of required ones."""
    shown = lambda v: {"required": v.__name__} if isinstance(v, type) else {"default": v}
    return [{"operation_id": o.id, "category": o.category, "description": o.description, "needs_data": o.needs_data, "parameters": {n: shown(v) for n, v in o.params.items()}} for _, o in sorted(REGISTRY.items())]


def each(df: DataFrame, columns: list[str], f) -> DataFrame:
    """f of each of the columns, in place, in one projection."""
    from tidewright.functions.text import column

    return df.withColumns({c: f(column(c)) for c in columns})


def ordering(order: list[str], last: bool = False) -> list[Column]:
    from tidewright.functions.text import column

    return [(column(c).desc_nulls_last() if last else column(c).asc_nulls_first()) for c in order] or [F.monotonically_increasing_id()]
