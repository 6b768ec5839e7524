"""Mapping of a file's columns to a wanted schema, and its application with issues as data.

Names are compared on the driver: only they are looked at, a few hundred at most. Application is one projection and one scan: the rows
that come out carry what is wrong with them, are stored once, and their counts are observed while they are written; the mapped rows and the table of
issues both read that table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewright.functions import headers as H
from tidewright.functions import text as T
from tidewright.functions import values as V
from tidewright.plans.quality import city_state_zip
from tidewright.stored import dropped, stored

#: The least ratio of a candidate, of an assignment, of rivals that count as a conflict, and the labels of confidence.
FLOOR, ASSIGNED, RIVALS, LABELS = 0.62, 0.75, 0.10, {"high": 0.92, "med": 0.72}
#: Column of a letter that is put together.
_PLACE = "City, State, Zip"


def words_of(name: str) -> str:
    """A column's name as it is compared: lower case, words with single spaces, # as the only sign."""
    return " ".join(re.sub(r"[^\w\s#]|[_-]", " ", str(name).lower()).split())


def alike(a: str, b: str) -> float:
    """Gestalt ratio: twice the characters in matching blocks by those of both."""
    return SequenceMatcher(None, a, b).ratio()


@dataclass
class Mapping:
    """columns: of each target its source or None; contact: 'use_contact', 'build_first_last' or 'blank'; places: sources of city, state and zip that are put together."""

    columns: dict[str, str | None]
    confidence: dict[str, str] = field(default_factory=dict)
    conflicts: list[dict] = field(default_factory=list)
    contact: str = "blank"
    first: str | None = None
    last: str | None = None
    places: dict[str, str | None] = field(default_factory=dict)
    blank: list[str] = field(default_factory=lambda: list(H.MAIL_BLANK))

    def sources(self) -> list[str]:
        """The sources that are used."""
        derived = [self.first, self.last] if self.contact == "build_first_last" else []
        return [s for s in dict.fromkeys([*self.columns.values(), *derived, *self.places.values()]) if s]

    def dropped(self, names: list[str]) -> list[str]:
        used = set(self.sources())
        return [n for n in names if n not in used]


def _scores(names: list[str], wanted: dict[str, list[str]]) -> dict[str, dict[str, float]]:
    """Of each target the candidates with their best ratios."""
    plain = {n: words_of(n) for n in names}
    out: dict[str, dict[str, float]] = {}
    for target, synonyms in wanted.items():
        known = [words_of(s) for s in [*synonyms, target]]
        found = {n: max(alike(p, s) for s in known) for n, p in plain.items()}
        out[target] = {n: x for n, x in found.items() if x >= FLOOR}
    return out


def _assigned(scores: dict[str, dict[str, float]], names: list[str], shared: bool) -> dict[str, str | None]:
    """Targets get their best source; unless sources may be shared, pairs are taken from the best down while both are free."""
    best = lambda target: max(scores[target], key=lambda n: scores[target][n], default=None)
    if shared:
        return {t: n if (n := best(t)) and scores[t][n] >= ASSIGNED else None for t in scores}
    order = {n: i for i, n in enumerate(names)}
    pairs = sorted((-x, i, order[n], t, n) for i, t in enumerate(scores) for n, x in scores[t].items() if x >= ASSIGNED)
    out: dict[str, str | None] = dict.fromkeys(scores)
    taken: set[str] = set()
    for _, _, _, target, name in pairs:
        if out[target] is None and name not in taken:
            out[target] = name
            taken.add(name)
    return out


def infer(names: list[str], letter: bool = False, shared: bool = False) -> Mapping:
    """The mapping of columns to those of a mail file, or of a letter. shared: one source may be several targets', each for itself."""
    wanted = {t: H.MAIL[m] for t, m in H.LETTER.items() if m} if letter else H.MAIL
    scores = _scores(names, wanted)
    chosen = _assigned(scores, names, shared)
    out = Mapping(chosen)
    for target, own in scores.items():
        source = chosen[target]
        score = own.get(source, 0.0) if source else 0.0
        out.confidence[target] = next((label for label, least in LABELS.items() if score >= least), "low")
        rivals = [n for n, x in sorted(own.items(), key=lambda p: -p[1]) if source and n != source and x >= score - RIVALS]
        if rivals:
            out.conflicts.append({"target": target, "candidates": [source, *rivals], "chosen": source, "score": score})
    plain = {n: words_of(n) for n in names}
    person = lambda known, word: next((n for n, p in reversed(plain.items()) if p in known or alike(p, word) >= 0.88), None)
    first, last = person(H.FIRST_NAMES, "first name"), person(H.LAST_NAMES, "last name")
    out.first, out.last = first, last
    out.contact = "use_contact" if set(plain.values()) & set(H.CONTACTS) else "build_first_last" if first or last else "blank"
    if out.contact != "use_contact":
        out.columns["Contact"] = None
        out.confidence["Contact"] = "high" if out.contact == "build_first_last" else "low"
    if letter:
        out.places = _assigned(_scores(names, {k: H.MAIL[k] for k in ("City", "State", "Zip")}), names, shared)
        out.columns = {t: out.columns.get(t) for t in H.LETTER}
        out.blank = ["KeyCode"]
    return out


@dataclass
class Mapped:
    """rows: exactly the targets, in order, behind the key columns; issues: key columns, target, code, value; counts: rows and issues by code and target; notes: what is wrong with the mapping itself."""

    rows: DataFrame
    issues: DataFrame
    counts: dict[str, int]
    notes: list[dict]
    table: DataFrame

    def drop(self) -> None:
        dropped(self.table)


def _notes(mapping: Mapping, names: list[str]) -> list[dict]:
    out, seen = [], {}
    for target, source in mapping.columns.items():
        if target == _PLACE or target == "Contact" and mapping.contact == "build_first_last":
            continue
        if source is None or source not in names:
            if target not in mapping.blank:
                out.append({"code": "MISSING_REQUIRED_FIELD", "target": target, "source": source})
        elif source in seen:
            out.append({"code": "DUPLICATE_SOURCE_USED", "target": target, "source": source, "other": seen[source]})
        else:
            seen[source] = target
    return out


def _checks(target: str, value: Column) -> dict[str, Column]:
    """What may be wrong with a value, by code."""
    own = T.stripped(value)
    held = F.coalesce(own, F.lit("")) != ""
    figures = F.length(F.regexp_replace(own, "[^0-9]", ""))
    found = {"BLANK_VALUE": ~held}
    if target == "Email Address":
        found["INVALID_EMAIL"] = held & ~own.rlike(V.EMAIL)
    elif target == "Telephone":
        found["INVALID_PHONE"] = held & ~figures.isin(10, 11)
    elif target == "Zip":
        found["INVALID_ZIP"] = held & ~own.rlike(r"^\d{5}(-?\d{4})?$")
    elif target == "State":
        found["UNKNOWN_STATE"] = held & T.state_code(value, keep=False).isNull()
    return found


def apply_mapping(df: DataFrame, mapping: Mapping, keys: list[str] | None = None) -> Mapped:
    """df under the mapping. A target without a source is blank (an empty text); a source that isn't there counts as none.

    Values are texts or as they are in the source; a contact is built of first and last name without outer blanks, nulls left out. Issues are looked for in targets
    with a source but for those that most files lack; null, empty and blank values are one issue.
    """
    keys, names = keys or [], df.columns
    there = lambda s: s if s in names else None
    made: dict[str, Column] = {}
    for target, source in mapping.columns.items():
        if target == _PLACE:
            parts = [T.column(s) if (s := there(mapping.places.get(p))) else F.lit("") for p in ("City", "State", "Zip")]
            made[target] = city_state_zip(*parts)
        elif target == "Contact" and mapping.contact == "build_first_last":
            parts = [F.nullif(T.stripped(T.column(s)), F.lit("")) for s in (there(mapping.first), there(mapping.last)) if s]
            made[target] = F.concat_ws(" ", *parts)
        else:
            made[target] = T.column(source) if there(source) else F.lit("")
    looked = [t for t in made if t not in mapping.blank and (t == _PLACE or there(mapping.columns[t]) or t == "Contact" and mapping.contact == "build_first_last")]
    issue = lambda target, code, hit: F.when(hit, F.struct(F.lit(target).alias("target"), F.lit(code).alias("code"), T.text(F.col("v")[target]).alias("value")))
    held = df.select(F.struct(*[T.column(k) for k in keys] or [F.lit(None).alias("none")]).alias("k"), F.struct(*[c.alias(t) for t, c in made.items()]).alias("v"))
    tests = [(t, code, F.coalesce(hit, F.lit(False))) for t in looked for code, hit in _checks(t, F.col("v")[t]).items()]
    none = F.array().cast("array<struct<target: string, code: string, value: string>>")
    judged = held.withColumn("issues", F.array_compact(F.array(*[issue(*t) for t in tests])) if tests else none)
    counts = Observation("mapping")
    has = lambda t, code: F.exists("issues", lambda x: (x["target"] == t) & (x["code"] == code))
    totals = [F.count_if(has(t, code)).alias(f"{code}: {t}") for t, code, _ in tests]
    table = stored(judged.observe(counts, F.count("*").alias("rows"), *totals), "mapped")
    shown = [F.col("k")[k].alias(k) for k in keys]
    rows = table.select(*shown, *[F.col("v")[t].alias(t) for t in made])
    issues = table.filter(F.size("issues") > 0).select("k", F.explode("issues").alias("i")).select(*shown, "i.target", "i.code", "i.value")
    return Mapped(rows, issues, dict(counts.get), _notes(mapping, names), table)


# ---- the standard format

#: The least ratio of a name that isn't an alias, of one that may be renamed for sure, and of one that is renamed without being asked.
NEAR, SURE, RENAMED = 0.85, 0.90, 0.95


def _aliases() -> dict[str, tuple[str, float]]:
    """Lower-case names and aliases, with the standard name and a confidence; later ones win."""
    out: dict[str, tuple[str, float]] = {}
    for name, aliases in (H.STANDARD | H.STANDARD_OPTIONAL).items():
        out[name.lower()] = (name, 1.0)
        out |= {a.lower(): (name, 0.98) for a in aliases}
    return out


def standard_name(name: str) -> tuple[str | None, str, float, str]:
    """The standard name of a column, what to do with it (keep, rename, review, remove), the confidence and the reason."""
    own, known = str(name).strip(), _aliases()
    if not own:
        return None, "remove", 0.0, "empty name"
    low = own.lower()
    if found := known.get(low.replace(" ", "_")):
        return (found[0], "keep", 1.0, "standard name") if own == found[0] else (found[0], "rename", found[1], f"alias: {own}")
    near = {k: alike(low, k) * (0.9 if abs(len(low) - len(k)) > 5 else 1) for k in known}
    best = max(near, key=lambda k: near[k])
    if near[best] >= NEAR:
        return known[best][0], "rename" if near[best] >= SURE else "review", near[best], f"like {best}"
    for kind, patterns in H.UNWANTED.items():
        if any(re.search(p.replace("*", ".*"), own, re.IGNORECASE) for p in patterns):
            return None, "remove", 0.0, f"not wanted: {kind}"
    return None, "review", 0.0, "unknown"


def to_standard(df: DataFrame, every: bool = False) -> DataFrame:
    """df with surely known columns renamed (every: all that may be), unwanted ones removed, and standard ones first, in order. Of columns that would share a name the first gets it."""
    plan = {c: standard_name(c) for c in df.columns}
    names, taken = {}, {c for c, p in plan.items() if p[1] != "rename"}
    for c, (standard, action, sure, _) in plan.items():
        if action == "remove":
            continue
        new = standard if action == "rename" and (every or sure >= RENAMED) and standard not in taken else c
        taken.add(new)
        names[c] = new
    order = {n: i for i, n in enumerate([*H.STANDARD, *H.STANDARD_OPTIONAL])}
    kept = sorted(names, key=lambda c: order.get(names[c], len(order)))
    return df.select(*[T.column(c).alias(names[c]) for c in kept])


def compliance(names: list[str]) -> dict:
    """How far columns are of the standard format: those found, their share, required ones that lack, and columns by what is to be done."""
    plan = [standard_name(n) for n in names]
    found = {p[0] for p in plan if p[0]}
    actions = {a: sum(p[1] == a for p in plan) for a in ("keep", "rename", "review", "remove")}
    return {"columns": len(names), "found": sorted(found), "percent": 100 * len(found) / len(H.STANDARD), "missing": [c for c in H.STANDARD_REQUIRED if c not in found], "actions": actions}


def issue_summary(mapped: Mapped) -> DataFrame:
    """Issues by target and code, with the number of rows."""
    return mapped.issues.groupBy("target", "code").agg(F.count("*").alias("rows"))


def union_mapped(frames: dict[str, DataFrame], letter: bool = False) -> DataFrame:
    """Several files, each under its own mapping, as one table with Source_File first; every target is text."""
    parts = []
    for name, df in frames.items():
        done = apply_mapping(df, infer(df.columns, letter))
        parts.append(done.rows.select(F.lit(name).alias("Source_File"), *[T.text(T.column(c)).alias(c) for c in done.rows.columns]))
    return reduce(DataFrame.unionByName, parts)
