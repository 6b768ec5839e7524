"""The quality of a contact table: kinds of its columns, counts of what is wrong, a score and steps that mend it.

All counts but that of duplicates are one aggregate over one scan; repeated keys are counted by a grouping with
partial sums. An empty table has no findings and the score 100.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.functions import values as V

POINTS = {"critical": 15, "recommended": 5, "optional": 2}


def kind_by_name(name: str) -> str | None:
    """The first kind of which a pattern stands in the column's name."""
    own = name.lower().strip()
    return next((kind for kind, patterns in V.COLUMN_KINDS.items() if any(re.search(p, own) for p in patterns)), None)


def column_kinds(df: DataFrame) -> dict[str, tuple[str, float]]:
    """Kind and confidence of each column, by its name or else by the shares of its values that look like one.

    Columns with telling names cost nothing; the others' shares come as one row from one aggregate.
    """
    found = {c: (kind, 0.9) for c in df.columns if (kind := kind_by_name(c))}
    asked = [c for c in df.columns if c not in found]
    if asked:
        aggs = []
        for i, c in enumerate(asked):
            own = T.text(T.column(c))
            looks = {kind: own.rlike(p) for kind, p in V.CONTENT_KINDS.items()} | {"digit": own.rlike("[0-9]"), "street": F.lower(own).rlike("|".join(V.STREET_HINTS))}
            aggs += [F.avg(hit.cast("int")).alias(f"{kind}{i}") for kind, hit in looks.items()]
        row = df.agg(*aggs).first()
        for i, c in enumerate(asked):
            share = lambda kind: row[f"{kind}{i}"] or 0.0  # noqa: B023, E731
            kind = next((k for k in V.CONTENT_KINDS if share(k) > 0.7), None)
            placed = share("digit") > 0.5 and share("street") > 0.3
            found[c] = (kind, 0.8) if kind else ("address1", 0.7) if placed else ("unknown", 0.0)
    return {c: found[c] for c in df.columns}


def _names(tests: dict[str, Column]) -> Column:
    """The names of which the test holds, comma-joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in tests.items()])), ",") if tests else F.lit("")


def quality(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Findings as rows: finding, severity, columns (comma-joined), affected_rows; nothing wrong, no row.

    Repeated rows are told by the first column of customer ids, else by whole rows; nulls equal each other there and
    all members count. Sparse rows lack half of the columns or more. PO boxes and generic names count each value that
    has one (generic names each word that it has); other checks pass over nulls.
    """
    kinds = kinds or {c: k for c, (k, _) in column_kinds(df).items()}
    of = lambda *wanted: [c for c in df.columns if kinds.get(c) in wanted]
    aggs = {"rows": F.count("*")}
    findings: list[tuple[str, str, Column, Column]] = []

    def add(finding: str, severity: str, columns: list[str], tests: list[Column]) -> None:
        if tests:
            for i, t in enumerate(tests):
                aggs[f"{finding}{i}"] = F.count_if(t)
            findings.append((finding, severity, F.lit(",".join(columns)), sum((F.col(f"{finding}{i}") for i in range(1, len(tests))), F.col(f"{finding}0"))))

    texts = [c for c, t in df.dtypes if t == "string"]
    for i, c in enumerate(texts):
        aggs[f"space{i}"] = F.count_if(T.column(c).startswith(" ") | T.column(c).endswith(" "))
    spaced = {c: F.col(f"space{i}") > 0 for i, c in enumerate(texts)}
    labels = of("company", "contact_name", "address1", "city")
    for i, c in enumerate(labels):
        own = T.text(T.column(c))
        aggs[f"upper{i}"], aggs[f"held{i}"] = F.count_if((own == F.upper(own)) & (own != F.lower(own))), F.count(own)
    mixed = {c: F.col(f"upper{i}") < F.col(f"held{i}") * 0.9 for i, c in enumerate(labels)}

    missing = sum((T.column(c).isNull().cast("int") for c in df.columns), F.lit(0))
    add("sparse_rows", "recommended", [], [missing >= len(df.columns) / 2])
    places = of("address1", "address2")
    add("po_boxes", "critical", places, [T.text(T.column(c)).rlike(V.PO_BOX) for c in places])
    states = of("state")[:1]
    add("excluded_states", "critical", states, [F.upper(T.text(T.column(c))).isin(V.COSTLY_STATES) for c in states])
    people = of("contact_name", "first_name", "last_name")
    add("generic_contacts", "recommended", people, [F.upper(T.text(T.column(c))).contains(w) for c in people for w in V.GENERIC_CONTACTS])
    emails, phones = of("email")[:1], of("phone")[:1]
    add("invalid_emails", "optional", emails, [~T.text(T.column(c)).rlike(V.EMAIL) for c in emails])
    add("invalid_phones", "optional", phones, [F.length(F.regexp_replace(T.text(T.column(c)), "[^0-9]", "")) != 10 for c in phones])

    for finding, tests in (("whitespace", spaced), ("capitalisation", mixed)):
        if tests:
            findings.append((finding, "recommended", _names(tests), F.when(_names(tests) != "", F.col("rows")).otherwise(0)))
    counts = df.agg(*[a.alias(n) for n, a in aggs.items()])
    parts = F.array(*[F.struct(F.lit(f).alias("finding"), F.lit(s).alias("severity"), c.alias("columns"), n.cast("long").alias("affected_rows")) for f, s, c, n in findings])
    keys = of("customer_id")[:1] or df.columns
    members = df.groupBy(*map(T.column, keys)).agg(F.count("*").alias("members")).filter("members > 1")
    repeated = members.agg(F.sum("members").alias("affected_rows")).select(F.lit("duplicates").alias("finding"), F.lit("critical").alias("severity"), F.lit(",".join(keys)).alias("columns"), "affected_rows")
    return counts.select(F.inline(parts)).unionByName(repeated).filter("affected_rows > 0")


def score(findings: DataFrame) -> DataFrame:
    """One row: 100 less the points of each finding, 0 at least, and the findings by severity."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in POINTS]
    points = sum((F.col(s) * p for s, p in POINTS.items()), F.lit(0))
    return findings.agg(*counts).select(F.greatest(F.lit(0), 100 - points).cast("long").alias("score"), *POINTS)


def suggested(findings: DataFrame) -> list[dict]:
    """Steps of a workflow that mend the findings; findings are a dozen rows at most, so they come to the driver."""
    steps = []
    for row in sorted(findings.collect(), key=lambda r: r["finding"]):
        columns = row["columns"].split(",")
        make = {
            "duplicates": lambda: ("data_remove_duplicates", {"columns": columns, "keep": "first", "multi_level_deduplication": False}),  # noqa: B023
            "sparse_rows": lambda: ("clean_remove_blank_rows", {}),
            "whitespace": lambda: ("text_trim", {"columns": columns}),  # noqa: B023
            "capitalisation": lambda: ("text_uppercase", {"columns": columns}),  # noqa: B023
            "excluded_states": lambda: ("conditional_flag_contains", {"column": columns[0], "text": f"^({'|'.join(V.COSTLY_STATES)})$", "flag_column": "Excluded_State_Flag"}),  # noqa: B023
            "invalid_emails": lambda: ("validate_email", {"column": columns[0]}),  # noqa: B023
        }.get(row["finding"])
        if row["finding"] == "po_boxes":  # a flag for each column, by the pattern that the finding counted
            steps += [{"operation_id": "conditional_flag_contains", "parameters": {"column": c, "text": V.PO_BOX.removeprefix("(?i)"), "flag_column": "PO_Box_Flag" + (f"_{c}" if i else "")}} for i, c in enumerate(columns)]
        if make:
            operation, parameters = make()
            steps.append({"operation_id": operation, "parameters": parameters})
    return steps


def city_state_zip(city: Column, state: Column, code: Column) -> Column:
    """'City, ST 12345' of what is there; nulls and blanks leave neither commas nor spaces."""
    town, own, number = (F.nullif(T.stripped(c), F.lit("")) for c in (city, state, code))
    return F.concat_ws(" ", F.nullif(F.concat_ws(", ", town, own), F.lit("")), number)
