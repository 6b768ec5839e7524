"""Column expressions that operators share; all are built-in functions, so they stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions import values as V


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text(c: Column) -> Column:
    return c.cast("string")


#: White space as Python's strip has it, the blanks of Unicode included.
_BLANK = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(text(c), f"^{_BLANK}+|{_BLANK}+$", "")


def squeezed(c: Column) -> Column:
    return F.regexp_replace(stripped(c), f"{_BLANK}+", " ")


def plain_number_text(c: Column) -> Column:
    """Text without the .0 that whole floating-point numbers carry."""
    return F.regexp_replace(stripped(c), r"\.0$", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(plain_number_text(c), "[^0-9]", "")


def zfill(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, "0"))


def title(c: Column) -> Column:
    """Each run of letters with a capital first."""
    return F.array_join(F.transform(F.regexp_extract_all(text(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def number(c: Column) -> Column:
    """A double, or null where the text isn't a number."""
    own = stripped(c)
    return F.when(own.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), own.try_cast("double"))


def blank(c: Column, enhanced: bool = True) -> Column:
    return c.isNull() | F.lower(stripped(c)).isin(V.BLANKS) if enhanced else c.isNull()


def contains(c: Column, pattern: str, case: bool = False) -> Column:
    return F.coalesce(text(c).contains(pattern) if case else F.lower(text(c)).contains(pattern.lower()), F.lit(False))


def lookup(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def state_code(c: Column, keep: bool = True) -> Column:
    """The code of a state by code, name or abbreviation; else the text in capitals (or null)."""
    own = F.upper(squeezed(c))
    bare = F.regexp_replace(own, r"\.", "")
    known = F.coalesce(F.when(own.isin(V.STATE_CODES), own), lookup(own, V.STATE_NAMES), F.when(bare.isin(V.STATE_CODES), bare), lookup(bare, V.STATE_SHORT))
    return F.coalesce(known, own) if keep else known


def phone_digits(c: Column, drop_country: bool = True) -> Column:
    own = digits(c)
    return F.when((F.length(own) == 11) & own.startswith("1") & F.lit(drop_country), F.substring(own, 2, 10)).otherwise(own)


def address_key(c: Column) -> Column:
    """An address in capitals with types of streets, directions and units written out."""
    words = F.split(squeezed(F.regexp_replace(F.upper(text(c)), "[,.;]", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.coalesce(lookup(w, V.UNITS | V.DIRECTIONS | V.STREET_TYPES), w)), " ")


def text_key(c: Column) -> Column:
    return squeezed(F.regexp_replace(F.upper(text(c)), r"[^\w\s]", " "))


def title_rank(c: Column) -> tuple[Column, Column]:
    own = F.upper(squeezed(c))
    rank, name = F.lit(7), F.lit("Unknown/Other")
    for k in sorted(V.TITLES, reverse=True):
        short = "|".join(w for w in V.TITLES[k][1] if w in V.SHORT_TITLES)
        anywhere = "|".join(re.escape(w) for w in V.TITLES[k][1] if w not in V.SHORT_TITLES)
        hit = own.rlike(anywhere + (f"|(?<![A-Z])({short})S?(?![A-Z])" if short else ""))
        rank, name = F.when(hit, k).otherwise(rank), F.when(hit, V.TITLES[k][0]).otherwise(name)
    empty = own.isNull() | (own == "")
    return F.when(empty, 7).otherwise(rank), F.when(empty, "Unknown").otherwise(name)


def quoted(pattern: str) -> str:
    return "".join("\\" + x if re.match(r"[\\.\[\]{}()*+?^$|/#&~-]", x) else x for x in pattern)
