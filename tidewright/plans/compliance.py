"""What is wrong in each column by its kind, with rows as examples; whether a table is of the standard format or a vendor's export.

Rules are data: a kind of column, a code, and a test of a value. All rules of all columns are compiled into one aggregate over one scan: a count each,
and as examples the least keys of three classes of a hash, so that what an aggregate holds doesn't grow with what it finds. Names are judged on the driver.

Cases: nulls are passed over. An empty table has no issues. Columns of unknown kind have no rules. The key is judged by its name only: its values name
rows, and whole numbers of five digits look like zip codes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import headers as H
from tidewright.functions import text as T
from tidewright.functions import values as V
from tidewright.plans.mapping import compliance, standard_name
from tidewright.plans.quality import column_kinds, kind_by_name

#: Rows that a finding names at most.
EXAMPLES = 3


@dataclass(frozen=True)
class Rule:
    """hit: which values are meant; share: the finding holds only above this share of the values that aren't null."""

    kinds: tuple[str, ...]
    code: str
    hit: Callable[[Column], Column]
    share: float = 0.0


def _mixed(c: Column) -> Column:
    """Neither all capitals nor all small letters; a text without letters is neither."""
    return ~((c == F.upper(c)) & (c != F.lower(c))) & ~((c == F.lower(c)) & (c != F.upper(c)))


RULES = [
    Rule(("email",), "invalid_email", lambda c: ~c.rlike(V.EMAIL)),
    Rule(("phone",), "not_10_digits", lambda c: F.length(F.regexp_replace(c, "[^0-9]", "")) != 10),
    Rule(("zip",), "invalid_zip", lambda c: ~c.rlike(r"^\d{5}(-\d{4})?$")),
    Rule(("state",), "excluded_state", lambda c: F.upper(c).isin(V.COSTLY_STATES)),
    Rule(("company", "contact_name", "first_name", "last_name"), "mixed_case", _mixed, 0.3),
    Rule(("address1", "address2"), "po_box", lambda c: c.rlike(V.PO_BOX)),
]


def column_issues(df: DataFrame, key: str, kinds: dict[str, str] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """column, kind, issue, rows, held (values that aren't null) and examples (keys as text, sorted) of what is wrong; kinds: told by names and contents unless given."""
    kinds = {c: k for c, (k, _) in column_kinds(df.drop(T.column(key))).items()} | {key: kind_by_name(key)} if kinds is None else kinds
    tests = [(c, kinds[c], r) for c in df.columns for r in rules or RULES if kinds.get(c) in r.kinds]
    named = T.text(T.column(key))
    part = F.pmod(F.xxhash64(named), F.lit(EXAMPLES))
    aggs: list[Column] = []
    for i, (c, _, rule) in enumerate(tests):
        own = T.text(T.column(c))
        hit = F.coalesce(rule.hit(own), F.lit(False)) & own.isNotNull()
        aggs += [F.count_if(hit).alias(f"n{i}"), F.count(own).alias(f"h{i}"), *[F.min(F.when(hit & (part == j), named)).alias(f"e{i}_{j}") for j in range(EXAMPLES)]]
    found = []
    for i, (c, kind, rule) in enumerate(tests):
        examples = F.array_sort(F.array_compact(F.array(*[F.col(f"e{i}_{j}") for j in range(EXAMPLES)])))
        values = {"column": F.lit(c), "kind": F.lit(kind), "issue": F.lit(rule.code), "rows": F.col(f"n{i}"), "held": F.col(f"h{i}"), "share": F.lit(rule.share), "examples": examples}
        found.append(F.struct(*[v.alias(name) for name, v in values.items()]))
    none = F.array().cast("array<struct<column: string, kind: string, issue: string, rows: bigint, held: bigint, share: double, examples: array<string>>>")
    out = df.agg(*(aggs or [F.count("*").alias("n")])).select(F.inline(F.array(*found) if found else none))
    return out.filter((F.col("rows") > 0) & (F.col("rows") > F.col("share") * F.col("held"))).drop("share")


def format_findings(names: list[str]) -> list[dict]:
    """What keeps columns from the standard format: code, severity, columns, and steps of a workflow that mend it."""
    plan = {n: standard_name(n) for n in names}
    report = compliance(names)
    remove = [n for n, p in plan.items() if p[1] == "remove"]
    rename = [(n, p[0]) for n, p in plan.items() if p[1] == "rename" and p[2] >= 0.90]
    review = [n for n, p in plan.items() if p[1] == "review"]
    found = []
    if remove:
        found.append({"finding": "unwanted_columns", "severity": "recommended", "columns": remove, "steps": [{"operation_id": "clean_remove_columns", "parameters": {"columns": remove}}]})
    if rename:
        found.append({"finding": "columns_to_rename", "severity": "recommended", "columns": [n for n, _ in rename], "steps": [{"operation_id": "text_rename_column", "parameters": {"old_name": a, "new_name": b}} for a, b in rename]})
    if review:
        found.append({"finding": "columns_to_review", "severity": "optional", "columns": review, "steps": []})
    if report["missing"]:
        found.append({"finding": "missing_columns", "severity": "critical", "columns": report["missing"], "steps": []})
    if report["percent"] < 100:
        found.append({"finding": "compliance", "severity": "recommended", "columns": [], "steps": [], "percent": report["percent"]})
    return found


def vendor_export(names: list[str]) -> tuple[str | None, float]:
    """Whether columns are those of a vendor's export, and how surely; two of its own ids have to be there."""
    if len(set(names) & set(H.VENDOR_IDS)) < 2:
        return None, 0.0
    known = len(set(names) & set(H.VENDOR_CONTACTS))
    return "vendor_contacts", min(0.9 + (known - 8) * 0.01, 0.99) if known >= 8 else 0.7
