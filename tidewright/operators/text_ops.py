"""Text, phone, code and column operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.functions import values as V
from tidewright.operators.base import ROW_ID, each, operation

for _id, _f in {"text_uppercase": lambda c: F.upper(T.text(c)), "text_lowercase": lambda c: F.lower(T.text(c)), "text_titlecase": T.title, "text_trim": T.squeezed}.items():
    operation(_id, "Text", columns=list)(lambda df, p, order, f=_f: each(df, p["columns"], f))


@operation("text_concatenate", "Text", columns=list, separator=" ", new_column=str, remove_original=False)
def concatenate(df, p, order):
    """Joins columns into one."""
    out = df.withColumn(p["new_column"], F.concat_ws(p["separator"], *[F.coalesce(T.text(T.column(c)), F.lit("")) for c in p["columns"]]))
    return out.drop(*p["columns"]) if p["remove_original"] else out


@operation("text_split", "Text", column=str, separator=",", new_columns=list, remove_original=False)
def split(df, p, order):
    """Splits a column into named columns; what is beyond them is dropped, what lacks is null."""
    separator = T.quoted(p["separator"]) if len(p["separator"]) == 1 else p["separator"]
    parts = F.split(T.text(T.column(p["column"])), separator)
    out = df.withColumns({n: F.get(parts, i) for i, n in enumerate(p["new_columns"])})
    return out.drop(p["column"]) if p["remove_original"] else out


@operation("text_remove_special", "Text", columns=list, keep_spaces=True, keep_numbers=True)
def remove_special(df, p, order):
    """Keeps letters, and digits and white space if asked."""
    kept = "A-Za-z" + "0-9" * p["keep_numbers"] + r"\s" * p["keep_spaces"]
    return each(df, p["columns"], lambda c: F.regexp_replace(T.text(c), f"[^{kept}]", ""))


@operation("text_find_replace", "Text", columns=list, find_text=str, replace_text="", case_sensitive=False)
def find_replace(df, p, order):
    """Replaces a literal text."""
    put = p["replace_text"].replace("\\", "\\\\").replace("$", "\\$")
    return each(df, p["columns"], lambda c: F.regexp_replace(T.text(c), ("" if p["case_sensitive"] else "(?i)") + T.quoted(p["find_text"]), put))


@operation("text_add_prefix_suffix", "Text", columns=list, prefix="", suffix="")
def prefix_suffix(df, p, order):
    """Puts texts before and behind."""
    return each(df, p["columns"], lambda c: F.concat(F.lit(p["prefix"]), T.text(c), F.lit(p["suffix"])))


def _part(c, how, n, start=1):
    c = T.text(c)
    if how == "LEFT":
        return F.substring(c, 1, n)
    if how == "RIGHT":
        return c if n == 0 else F.right(c, F.lit(n))
    return F.substring(c, max(1, start), n)


for _id, _how in (("text_left", "LEFT"), ("text_right", "RIGHT")):
    operation(_id, "Text", column=str, length=int, new_column=None)(lambda df, p, order, how=_how: df.withColumn(p["new_column"] or p["column"], _part(T.column(p["column"]), how, int(p["length"]))))


@operation("text_mid", "Text", column=str, start=int, length=int, new_column=None)
def mid(df, p, order):
    """Characters from a place on."""
    return df.withColumn(p["new_column"] or p["column"], _part(T.column(p["column"]), "MID", int(p["length"]), int(p["start"])))


@operation("extract_text", "Text", column=str, extract_type="LEFT", num_chars=5, start_position=1, new_column="Extracted")
def extract_text(df, p, order):
    """Left, right or middle characters into a new column."""
    return df.withColumn(p["new_column"], _part(T.column(p["column"]), p["extract_type"], p["num_chars"], p["start_position"]))


@operation("text_len", "Text", column=str, new_column=str)
def length(df, p, order):
    """Characters of a text."""
    return df.withColumn(p["new_column"], F.length(T.text(T.column(p["column"]))))


@operation("text_phone_format", "Text", column=str, new_column=None, remove_invalid=False)
def phone_format(df, p, order):
    """The last ten digits as (xxx) xxx-xxxx."""
    c = T.column(p["column"])
    d = F.right(T.digits(c), F.lit(10))
    shown = F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))
    return df.withColumn(p["new_column"] or p["column"], F.when(F.length(d) == 10, shown).otherwise(F.lit("") if p["remove_invalid"] else T.text(c)))


@operation("text_standardize_phone_numbers", "Text", phone_column=str, output_format="Digits Only (2564294000)", handle_extensions=False, remove_country_code=True, validate_length=False)
def phone_standard(df, p, order):
    """Phone numbers in one of four formats, with extensions if asked."""
    c = T.column(p["phone_column"])
    pattern = r"(?i)\s*(?:ext\.?|x|extension)\s*(\d+)\s*$"
    ext = F.regexp_extract(T.text(c), pattern, 1) if p["handle_extensions"] else F.lit("")
    d = T.phone_digits(F.regexp_replace(T.text(c), pattern, "") if p["handle_extensions"] else c, p["remove_country_code"])
    a, b, e = F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4)
    shown = {"D": d, "(": F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), e), "-": F.concat_ws("-", a, b, e), "+": F.concat(F.lit("+1 ("), a, F.lit(") "), b, F.lit("-"), e)}
    kind = "D" if p["output_format"].startswith("Digits") else "+" if p["output_format"].startswith("International") else "-" if "Dashes" in p["output_format"] else "("
    tail = F.when(ext != "", F.concat(F.lit(" x"), ext)).otherwise("")
    out = df.withColumn(p["phone_column"], F.coalesce(F.concat(F.when(F.length(d) == 10, shown[kind]).otherwise(T.stripped(c)), tail), F.lit("")))
    return df.withColumn(p["phone_column"] + "_Phone_Valid", F.coalesce(F.length(d) == 10, F.lit(False))).withColumn(p["phone_column"], F.coalesce(F.concat(F.when(F.length(d) == 10, shown[kind]).otherwise(T.stripped(c)), tail), F.lit(""))) if p["validate_length"] else out


@operation("standardize_phone", "Cleaning", columns=list, remove_country_code=True)
def phone_number(df, p, order):
    """Phone digits as a whole number."""
    return each(df, p["columns"], lambda c: T.phone_digits(c, p["remove_country_code"]).try_cast("bigint"))


@operation("standardize_zip", "Cleaning", columns=list, format_type="ZIP+4 (preserve)")
def zip_code(df, p, order):
    """Five digits with leading zeros, and four more if there are any or a place for them is asked for."""

    def one(c):
        own = F.regexp_replace(T.plain_number_text(c), "[^0-9-]", "")
        parts = F.split(own, "-")
        five = F.substring(T.zfill(F.get(parts, 0), 5), 1, 5)
        four = F.when(F.coalesce(F.get(parts, 1), F.lit("")) != "", F.substring(T.zfill(F.get(parts, 1), 4), 1, 4))
        kind = p["format_type"]
        full = five if kind.startswith("5-digit only") else F.concat_ws("-", five, F.coalesce(four, F.lit("0000"))) if "placeholder" in kind else F.concat_ws("-", five, four)
        return F.when(own != "", full)

    return each(df, p["columns"], one)


@operation("standardize_state", "Cleaning", columns=list)
def state(df, p, order):
    """State codes: two letters as they are, names and their beginnings by the first name in order."""

    def one(c):
        own = F.upper(T.stripped(c))
        out = own
        for name, code in reversed(V.PREFIX_STATES.items()):
            out = F.when(F.lit(name).startswith(own) | own.startswith(name), code).otherwise(out)
        return F.when(own.isin("", "NAN", "NONE"), F.lit(None).cast("string")).when(F.length(own) == 2, own).otherwise(F.coalesce(T.lookup(own, V.PREFIX_STATES), out))

    return each(df, p["columns"], one)


@operation("zoominfo_state_converter", "Vendor files", column=str, flag_unconverted=False)
def state_converter(df, p, order):
    """State codes by code, name or abbreviation; else unchanged."""
    c = T.column(p["column"])
    code = T.state_code(c, keep=False)
    out = df.withColumns({p["column"]: F.coalesce(code, T.text(c))} | ({p["column"] + "_Converted": code.isNotNull()} if p["flag_unconverted"] else {}))
    return out


@operation("validate_state", "Validation", column=str, auto_convert=True, flag_invalid=True)
def validate_state(df, p, order):
    """Whether a state is one of 51 codes, after turning names into codes if asked."""
    c = T.column(p["column"])
    own = F.upper(T.stripped(c))
    code = F.coalesce(T.lookup(own, V.STATE_NAMES), own) if p["auto_convert"] else own
    new = {p["column"]: code} if p["auto_convert"] else {}
    return df.withColumns(new | ({p["column"] + "_Valid": F.coalesce(code.isin(V.STATES_51), F.lit(False))} if p["flag_invalid"] else {}))


@operation("validate_email", "Validation", column=str, flag_invalid=True)
def validate_email(df, p, order):
    """Whether a text has the shape of an e-mail address."""
    good = F.coalesce(T.text(T.column(p["column"])).rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), F.lit(False))
    return df.withColumn(p["column"] + "_Valid", good) if p["flag_invalid"] else df


@operation("parse_contact_name", "Cleaning", column=str, first_name_col="First Name", last_name_col="Last Name", name_format="First Last", remove_original=False)
def contact_name(df, p, order):
    """First and last name."""
    own = T.squeezed(T.column(p["column"]))
    if p["name_format"] == "Last, First":
        parts, bare = F.split(own, r"\s*,\s*", 2), F.split(own, " ", 2)
        comma = own.contains(",")
        first = F.when(comma, F.get(parts, 1)).otherwise(F.get(bare, 0))
        last = F.when(comma, F.get(parts, 0)).otherwise(F.coalesce(F.get(bare, 1), F.lit("")))
    else:
        parts = F.split(own, " ", 2)
        first, last = F.get(parts, 0), F.coalesce(F.get(parts, 1), F.lit(""))
        if p["name_format"] == "Last First":
            first, last = last, first
    out = df.withColumns({p["first_name_col"]: first, p["last_name_col"]: last})
    return out.drop(p["column"]) if p["remove_original"] else out


def _code(c, n):
    """The digits of a whole number with leading zeros behind its sign; zeros where there is none."""
    own = F.regexp_replace(T.stripped(c), r"\..*$", "")
    figures = F.regexp_replace(own, "[^0-9]", "")
    return F.when(F.coalesce(figures, F.lit("")) == "", "0" * n).otherwise(F.concat(F.when(own.startswith("-"), "-").otherwise(""), T.zfill(figures, n)))


@operation("text_standardize_customer_numbers", "Text", customer_number_column=str, segment_column=str, customer_length=8, segment_length=2, blank_segment_value="00")
def customer_numbers(df, p, order):
    """Customer and segment numbers with leading zeros; a null customer is all zeros, a blank segment has a value of its own."""
    c, s = T.column(p["customer_number_column"]), T.column(p["segment_column"])
    empty = F.coalesce(T.stripped(s), F.lit("")) == ""
    return df.withColumns({p["customer_number_column"]: _code(c, p["customer_length"]), p["segment_column"]: F.when(empty, p["blank_segment_value"]).otherwise(_code(s, p["segment_length"]))})


@operation("text_clean_mailing_customer_data", "Text", customer_column=str, customer_length=8, segment_column=None, segment_length=2, handle_non_hyphenated="Pad as-is", blank_segments_to_zero=False)
def mailing_customers(df, p, order):
    """The part of a customer number before the hyphen, with leading zeros."""
    c = T.column(p["customer_column"])
    own = T.plain_number_text(c)
    padded = T.zfill(F.regexp_replace(F.substring_index(own, "-", 1), "[^0-9]", ""), p["customer_length"])
    other = {"Pad as-is": padded, "Mark as error": F.concat(F.lit("ERROR: "), own)}.get(p["handle_non_hyphenated"], T.text(c))
    new = {p["customer_column"]: F.when(T.blank(c), T.text(c)).when(own.contains("-"), padded).otherwise(other)}
    if p["segment_column"]:
        s = T.column(p["segment_column"])
        figures = F.coalesce(T.digits(s), F.lit(""))
        new[p["segment_column"]] = F.when(figures == "", "0" * p["segment_length"] if p["blank_segments_to_zero"] else "").otherwise(T.zfill(figures, p["segment_length"]))
    return df.withColumns(new)


@operation("zoominfo_split_address", "Vendor files", mode="Split Full Address", source_column=str, address2_column=None, suite_keywords=V.SUITES, address1_output="Address 1", address2_output="Address 2", remove_original=False)
def split_address(df, p, order):
    """Splits an address at its last suite word."""
    words = "|".join(T.quoted(w.strip()) for w in p["suite_keywords"].split(",") if w.strip() != "#")
    c = T.column(p["source_column"])
    pattern = rf"(?is)^(.*)\b((?:{words})\b.*)$"
    head, tail = F.regexp_extract(T.text(c), pattern, 1), F.regexp_extract(T.text(c), pattern, 2)
    one = F.when(tail != "", F.regexp_replace(T.stripped(head), r"[,\s]+$", "")).otherwise(T.stripped(c))
    if p["mode"] == "Split Full Address":
        out = df.withColumns({p["address1_output"]: one, p["address2_output"]: T.stripped(tail)})
        return out.drop(p["source_column"]) if p["remove_original"] else out
    two = p["address2_column"] or "Address 2"
    old = T.column(two) if two in df.columns else F.lit(None).cast("string")
    return df.withColumns({p["source_column"]: one, two: F.when(tail != "", T.stripped(tail)).otherwise(old)})


@operation("clean_remove_columns", "Cleaning", columns=list)
def remove_columns(df, p, order):
    """Drops columns."""
    return df.drop(*p["columns"])


@operation("clean_keep_columns", "Cleaning", columns_to_keep=list)
def keep_columns(df, p, order):
    """Keeps columns, in the order of the table."""
    kept = [c for c in df.columns if c in p["columns_to_keep"] or c == ROW_ID]
    if not set(kept) - {ROW_ID}:
        raise ValueError("clean_keep_columns: none of the columns exists")
    return df.select(*map(T.column, kept))


@operation("data_reorder_columns", "Columns", column_order=list, keep_unlisted=False)
def reorder(df, p, order):
    """Columns in a given order."""
    first = [c for c in p["column_order"] if c in df.columns]
    return df.select(*map(T.column, first + [c for c in df.columns if c not in first and (p["keep_unlisted"] or c == ROW_ID)]))


@operation("text_rename_column", "Text", old_name=str, new_name=str)
def rename(df, p, order):
    """Renames a column."""
    if p["old_name"] not in df.columns or p["new_name"] in df.columns:
        raise ValueError("text_rename_column: the old name has to exist and the new one not")
    return df.withColumnRenamed(p["old_name"], p["new_name"])


@operation("text_rename_batch", "Text", column_mappings=None, mappings=None)
def rename_batch(df, p, order):
    """Renames columns, swaps included."""
    pairs = p["mappings"] or {m.get("old_name", m.get("old")): m.get("new_name", m.get("new")) for m in p["column_mappings"] or []}
    names = [pairs.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("text_rename_batch: names clash")
    return df.toDF(*names)


@operation("standardize_column_names", "Cleaning", mapping="Customer #=Customer, Email Address=Email")
def column_names(df, p, order):
    """Renames by a text of Old=New pairs; names that don't exist are ignored."""
    return df.withColumnsRenamed({a.strip(): b.strip() for a, b in (x.split("=", 1) for x in p["mapping"].split(",") if "=" in x)})


@operation("data_add_multiple_columns", "Columns", columns=None)
def add_columns(df, p, order):
    """Adds columns, blank or with a value; existing ones are skipped, overwritten or avoided."""
    for spec in p["columns"] or []:
        name, exists = spec["name"], spec.get("on_exists", "skip")
        value = spec.get("value", spec.get("default_value")) if spec.get("default_type", "blank") == "value" else ""
        if name in df.columns and exists == "skip":
            continue
        if name in df.columns and exists == "rename":
            name = next(f"{name}_{i}" for i in range(1, len(df.columns) + 2) if f"{name}_{i}" not in df.columns)
        for kind in (int, float):
            if isinstance(value, str):
                try:
                    value = kind(value)
                except ValueError:
                    pass
        df = df.withColumn(name, F.lit(value))
    return df


@operation("add_column_smart", "Columns", new_column_name=str, mode="constant", constant_value="", timestamp_format="YYYY-MM-DD", smart_rule="country_from_location", city_column=None, state_column=None, zip_column=None, email_column=None, full_name_column=None, name_part="first", now=None)
def add_smart(df, p, order):
    """Adds a constant, the time of the run, or a value found by a rule."""
    if p["mode"] == "constant":
        value = F.lit(p["constant_value"])
    elif p["mode"] == "timestamp":
        shape = {"YYYY-MM-DD": "yyyy-MM-dd", "MM/DD/YYYY": "MM/dd/yyyy"}.get(p["timestamp_format"], "yyyy-MM-dd'T'HH:mm:ss")
        value = F.date_format(F.lit(p["now"]).cast("timestamp") if p["now"] else F.current_timestamp(), shape)
    elif p["smart_rule"] == "email_domain":
        own = T.stripped(T.column(p["email_column"]))
        value = F.coalesce(F.when(own.contains("@"), F.lower(F.substring_index(own, "@", -1))), F.lit(""))
    elif p["smart_rule"] == "parse_name":
        words = F.split(T.squeezed(T.column(p["full_name_column"])), " ")
        value = F.coalesce(F.get(words, 0) if p["name_part"] == "first" else F.when(F.size(words) > 1, F.element_at(words, -1)), F.lit(""))
    else:
        state = F.upper(T.stripped(T.column(p["state_column"]))).isin(V.STATES_51) if p["state_column"] else F.lit(False)
        size = F.length(F.regexp_replace(T.plain_number_text(T.column(p["zip_column"])), "[^0-9]", "")).isin(5, 9) if p["zip_column"] else F.lit(False)
        value = F.when(F.coalesce(state, F.lit(False)) | F.coalesce(size, F.lit(False)), "USA").otherwise("")
    return df.withColumn(p["new_column_name"], value)
