"""Filters, flags, lookups, deduplication, sorting, numbers and dates."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.functions import values as V
from tidewright.operators.base import Keep, each, operation, ordering

_COMPARE = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "=": "__eq__", "!=": "__ne__"}


@operation("data_filter_by_value", "Data", column=str, operator=str, value=float, action="keep")
def filter_by_value(df, p, order):
    """Keeps or removes rows by comparing a number; what isn't a number only differs."""
    c = T.column(p["column"])
    own = c if df.schema[p["column"]].dataType.typeName() in ("double", "long", "integer", "float", "decimal", "short") else T.number(c)
    hit = getattr(own, _COMPARE[p["operator"]])(F.lit(float(p["value"])))
    if p["operator"] == "!=":
        hit = hit | own.isNull()
    return Keep(df, hit) if p["action"] == "keep" else Keep(df, hit.isNull() | ~hit)


@operation("data_remove_rows_if", "Data Matching", column=str, condition="is_blank", value="", case_sensitive=False, enhanced_blank_detection=False, smart_address_detection=True)
def remove_rows_if(df, p, order):
    """Removes rows where a column is blank, contains or equals a text, or is false."""
    name, c = p["column"], T.column(p["column"])
    own = T.text(c) if p["case_sensitive"] else F.lower(T.text(c))
    value = p["value"] if p["case_sensitive"] else p["value"].lower()
    if p["condition"] == "is_blank":
        names = [name]
        if p["smart_address_detection"] and any(w in name.lower() for w in ("street", "address")) and "email" not in name.lower():
            names = [x for x in df.columns if any(w in x.lower() for w in ("street", "address")) and "email" not in x.lower()]
        return Keep(df, reduce(or_, [~T.blank(T.column(x), p["enhanced_blank_detection"]) for x in names]))
    if p["condition"] == "contains":
        return Keep(df, ~F.coalesce(own.contains(value), F.lit(False)))
    if p["condition"] == "equals":
        return Keep(df, ~own.eqNullSafe(value))
    if p["condition"] == "not_equals":
        return Keep(df, own == value)
    return Keep(df, c.isNull() | ~F.lower(T.stripped(c)).isin("false", "0", "no", "n"))


def _patterns(p):
    return V.PRESETS.get(p["preset"]) or [x.strip() for x in p["patterns"].split(",") if x.strip()]


@operation("remove_rows_containing", "Cleaning", columns=list, patterns="PO BOX, P.O. BOX, P O BOX", preset="Custom (use patterns above)", case_sensitive=False, match_whole_cell=False, remove_blanks=False)
def remove_containing(df, p, order):
    """Removes rows with any of some patterns in any of some columns, and if asked for those with all of them empty; the preset for blanks has no patterns."""
    cols = [T.column(c) for c in p["columns"]]
    only_blanks = p["preset"] == "Remove Blanks"
    empty = reduce(and_, [F.coalesce(T.stripped(c), F.lit("")).isin("", "nan", "None", "NaT", "<NA>") for c in cols])
    if only_blanks or not _patterns(p):
        return Keep(df, ~empty if only_blanks or p["remove_blanks"] else F.lit(True))

    def hit(c, x):
        if not p["match_whole_cell"]:
            return T.contains(c, x, p["case_sensitive"])
        own = T.stripped(c)
        return F.coalesce(own == x if p["case_sensitive"] else F.upper(own) == x.upper(), F.lit(False))

    stays = ~reduce(or_, [hit(c, x) for c in cols for x in _patterns(p)])
    return Keep(df, stays & ~empty if p["remove_blanks"] else stays)


@operation("flag_rows_containing", "Cleaning", columns=list, patterns="PO BOX, P.O. BOX", preset="Custom (use patterns above)", flag_column="_FLAG_REMOVE", flag_reason=True)
def flag_containing(df, p, order):
    """Names the patterns found, column by column, or puts an X."""
    hits = [F.when(T.contains(T.column(c), x), F.lit(x)) for c in p["columns"] for x in _patterns(p)]
    found = F.concat_ws(", ", *hits)
    return df.withColumn(p["flag_column"], found if p["flag_reason"] else F.when(found != "", "X").otherwise(""))


@operation("remove_flagged_rows", "Cleaning", flag_column=str, remove_flag_column=True)
def remove_flagged(df, p, order):
    """Removes rows that carry a flag."""
    c = T.column(p["flag_column"])
    return Keep(df, c.isNull() | T.stripped(c).isin("", "nan", "None", "NaN"), (p["flag_column"],) if p["remove_flag_column"] else ())


@operation("remove_excluded_states", "Vendor files", column=str, excluded_states="AK,HI,PR,VI")
def remove_states(df, p, order):
    """Removes rows of some states."""
    names = p["excluded_states"] if isinstance(p["excluded_states"], list) else [x.strip() for x in p["excluded_states"].split(",")]
    return Keep(df, F.coalesce(~F.upper(T.text(T.column(p["column"]))).isin([x.upper() for x in names]), F.lit(True)))


@operation("filter_lower_48", "Cleaning", state_column=str, country_column="", normalize_states=True, remove_blank_states=True, require_usa_country=True, allow_blank_country=True, include_dc=False)
def lower_48(df, p, order):
    """Keeps rows of the contiguous states."""
    c = T.column(p["state_column"])
    code = T.state_code(c) if p["normalize_states"] else F.upper(T.stripped(c))
    empty = F.coalesce(T.stripped(c), F.lit("")) == ""
    stays = F.when(empty, F.lit(not p["remove_blank_states"])).otherwise(code.isin(V.LOWER_48 + ["DC"] * p["include_dc"]))
    if p["country_column"] and p["require_usa_country"]:
        land = F.upper(F.regexp_replace(F.coalesce(T.stripped(T.column(p["country_column"])), F.lit("")), r"\.", ""))
        stays = stays & (land.isin(V.USA) | ((land == "") & F.lit(p["allow_blank_country"])))
    return Keep(df, stays)


@operation("clean_remove_blank_rows", "Cleaning")
def remove_blank_rows(df, p, order):
    """Removes rows of nulls only."""
    return Keep(df, reduce(or_, [T.column(c).isNotNull() for c in df.columns if c not in order]))


@operation("clean_fill_missing", "Cleaning", columns=list, fill_value="N/A")
def fill_missing(df, p, order):
    """Puts a value for nulls."""
    return each(df, p["columns"], lambda c: F.coalesce(T.text(c), F.lit(p["fill_value"])))


@operation("conditional_flag_contains", "Conditional", column=str, text=str, flag_column="Flag")
def flag_contains(df, p, order):
    """Whether a regular expression is found, in either case."""
    return df.withColumn(p["flag_column"], F.coalesce(T.text(T.column(p["column"])).rlike("(?i)" + p["text"]), F.lit(False)))


@operation("data_vlookup", "Data Matching", lookup_column=str, lookup_file=object, lookup_file_column=str, return_column=str, new_column=str, first_match=False, null_keys="match")
def vlookup(df, p, order):
    """Looks a column's values up in a table (a DataFrame, or the path of a CSV or Parquet table); every match gives a row, or the table's first."""
    other = p["lookup_file"]
    if isinstance(other, str):
        from tidewright.sources.files import read_table

        other = read_table(df.sparkSession, other)
    table = other.select(T.column(p["lookup_file_column"]).alias("__key"), T.column(p["return_column"]).alias("__value"))
    if p["first_match"]:
        table = table.withColumn("__at", F.monotonically_increasing_id()).groupBy("__key").agg(F.min_by("__value", "__at").alias("__value"))
    key = F.col("__own")
    on = key.eqNullSafe(F.col("__key")) if p["null_keys"] == "match" else key == F.col("__key")
    # The looked up column may itself be the one that the result replaces.
    own = df.withColumn("__own", T.column(p["lookup_column"])).drop(p["new_column"])
    return own.join(table, on, "left").drop("__key", "__own").withColumnRenamed("__value", p["new_column"])


@operation("data_remove_duplicates", "Data Matching", multi_level_deduplication=True, columns="", keep="first", smart_matching=False, address_columns="", email_column="Email Address")
def remove_duplicates(df, p, order):
    """Keeps the first or last row of each key; by levels e-mail, name and address, name and phone if the columns are there."""
    listed = lambda v: v if isinstance(v, list) else [x.strip() for x in v.split(",") if x.strip()]
    places = set(listed(p["address_columns"])) | {c for c in df.columns if "street" in c.lower() or "address" in c.lower() and "email" not in c.lower()}
    key = lambda c: (T.address_key(T.column(c)) if c in places else T.text_key(T.column(c))) if p["smart_matching"] else T.column(c)
    name, where = ["First Name", "Last Name"], ["Person Street", "Person City", "Person State"]
    mail, phone = p["email_column"], "Direct Phone Number"
    if p["multi_level_deduplication"] and all(c in df.columns for c in [*name, *where, mail, phone]):
        level = F.when(T.column(mail).isNotNull(), 1).when(T.column("Person Street").isNotNull(), 2).otherwise(3)
        at = lambda n, c: F.when(level.isin(n), T.text(key(c)))
        keys = [level, at([1], mail), *[at([2, 3], c) for c in name], *[at([2], c) for c in where], at([3], phone)]
    else:
        keys = [key(c) for c in (listed(p["columns"]) or [c for c in df.columns if c not in order])]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering(order, p["keep"] == "last")))
    return Keep(df.withColumn("__rank", rank), F.col("__rank") == 1, ("__rank",))


@operation("data_keep_best_contact_per_location", "Data Matching", location_columns="Hospital Name,Address", title_column=str, tie_breaker="first", add_rank_column=True)
def best_contact(df, p, order):
    """Keeps the contact with the best title of each place; ties by order."""
    where = p["location_columns"] if isinstance(p["location_columns"], list) else [c.strip() for c in p["location_columns"].split(",")]
    rank, _ = T.title_rank(T.column(p["title_column"]))
    own = df.withColumn("Title Rank", rank)
    place = F.row_number().over(Window.partitionBy(*map(T.column, where)).orderBy("Title Rank", *ordering(order, p["tie_breaker"] == "last")))
    return Keep(own.withColumn("__rank", place), F.col("__rank") == 1, ("__rank",) if p["add_rank_column"] else ("__rank", "Title Rank"))


@operation("data_analyze_title_ranks", "Analysis", title_column=str)
def title_ranks(df, p, order):
    """The rank and kind of each title."""
    rank, name = T.title_rank(T.column(p["title_column"]))
    return df.withColumns({"Title Rank Number": rank, "Title Rank Category": name})


@operation("data_keep_best_by_value", "Data", email_column=str, value_column=str, keep_blank_emails=True, tie_breaker="first")
def best_by_value(df, p, order):
    """Keeps the row of the largest value for each e-mail; ties by order."""
    mail, value = T.column(p["email_column"]), T.column(p["value_column"])
    empty = F.coalesce(T.stripped(mail), F.lit("")) == ""
    # Blank e-mails are spread by a hash of the row, so they don't meet in one task.
    spread = F.when(empty, F.xxhash64(*[T.column(c) for c in (order or df.columns)]))
    rank = F.row_number().over(Window.partitionBy(F.when(~empty, mail), spread).orderBy(T.number(value).desc_nulls_last(), *ordering(order, p["tie_breaker"] == "last")))
    return Keep(df.withColumn("__rank", rank), F.when(empty, F.lit(p["keep_blank_emails"])).otherwise(F.col("__rank") == 1), ("__rank",))


@operation("data_sort", "Data Matching", columns=list, ascending=True)
def sort(df, p, order):
    """Sorts; nulls last either way."""
    keys = [T.column(c).asc_nulls_last() if p["ascending"] else T.column(c).desc_nulls_last() for c in p["columns"]]
    return df.orderBy(*keys, *map(T.column, order))


@operation("data_set_header_row", "Transform", needs_data=True, header_row_number=2, remove_above=True)
def header_row(df, p, order):
    """Makes a row (1 is the first) the header; it and, unless they are to stay, the rows above it go. Rows need an order."""
    if not order:
        raise ValueError("data_set_header_row: rows need an order, as Spark's tables have none")
    names = [c for c in df.columns if c not in order]
    number = int(p["header_row_number"])
    first = df.orderBy(*ordering(order)).limit(number).collect()  # the rows down to the header
    if number < 1 or len(first) < number:
        raise ValueError(f"data_set_header_row: no row {number}")
    row = first[-1]
    same = reduce(and_, [T.column(c).eqNullSafe(F.lit(row[c])) for c in order])
    above, equal = F.lit(False), F.lit(True)
    for c in order:  # in the order of ordering(): ascending, nulls first
        less = T.column(c).isNull() if row[c] is None else T.column(c).isNull() | (T.column(c) < F.lit(row[c]))
        above = above | (equal & less & ~T.column(c).eqNullSafe(F.lit(row[c])))
        equal = equal & T.column(c).eqNullSafe(F.lit(row[c]))
    out = df.filter(~F.coalesce(same | above if p["remove_above"] else same, F.lit(False)))
    fresh, used = {}, set(order)
    for i, c in enumerate(names):
        new = str(row[c]) if row[c] is not None else f"Column_{i + 1}"
        while new in used:
            new += "_"
        used.add(new)
        fresh[c] = new
    return out.toDF(*[fresh.get(c, c) for c in out.columns])


def _numbers(df, names, only_numeric):
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte") or f.dataType.typeName().startswith("decimal")}
    return [T.column(c).cast("double") if c in numeric else T.number(T.column(c)) for c in names if not only_numeric or c in numeric]


def _total(cols):
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols], F.lit(0.0))


for _id, _only in (("math_add_columns", False), ("math_sum", True)):
    operation(_id, "Math", columns=list, new_column=str)(lambda df, p, order, only=_only: df.withColumn(p["new_column"], _total(_numbers(df, p["columns"], only))))


@operation("math_average", "Math", columns=list, new_column=str)
def average(df, p, order):
    """Mean of the numbers of a row."""
    cols = _numbers(df, p["columns"], True)
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols], F.lit(0))
    return df.withColumn(p["new_column"], F.when(count > 0, _total(cols) / count))


@operation("math_multiply", "Math", column1=str, column2=str, new_column=str)
def multiply(df, p, order):
    """Product of two columns."""
    a, b = _numbers(df, [p["column1"], p["column2"]], False)
    return df.withColumn(p["new_column"], a * b)


@operation("math_round", "Math", column=str, decimals=int, new_column=None)
def round_half_even(df, p, order):
    """Rounds halves to the even digit."""
    return df.withColumn(p["new_column"] or p["column"], F.bround(_numbers(df, [p["column"]], False)[0], int(p["decimals"])))


@operation("math_percentage", "Math", numerator_column=str, denominator_column=str, new_column=str, multiply_by_100=True)
def percentage(df, p, order):
    """Share in percent with two decimals; null where the denominator is 0."""
    a, b = _numbers(df, [p["numerator_column"], p["denominator_column"]], False)
    return df.withColumn(p["new_column"], F.bround(F.try_divide(a, b) * (100 if p["multiply_by_100"] else 1), 2))


@operation("date_format", "Dates", column=str, format="MM/DD/YYYY", inputs="yyyy-MM-dd HH:mm:ss,yyyy-MM-dd,MM/dd/yyyy,M/d/yyyy,dd-MM-yyyy")
def date_format(df, p, order):
    """Dates in another format; the first input format that fits counts, null if none does."""
    c = T.column(p["column"])
    read = c if df.schema[p["column"]].dataType.typeName() in ("timestamp", "date") else F.coalesce(*[F.try_to_timestamp(T.stripped(c), F.lit(x)) for x in p["inputs"].split(",")])
    return df.withColumn(p["column"], F.date_format(read, {"MM/DD/YYYY": "MM/dd/yyyy", "DD/MM/YYYY": "dd/MM/yyyy"}.get(p["format"], "yyyy-MM-dd")))


def _midpoint(c):
    """The middle of a range such as 1-50 or $5 - $10, rounded down; 500+ is 500, and Jan-50, as spreadsheets write 1-50, is a range too."""
    own = T.stripped(c)
    month = reduce(lambda out, m: F.when(F.upper(F.regexp_extract(own, r"^([A-Za-z]{3})-\d+$", 1)) == m[1], str(m[0])).otherwise(out), enumerate(V.MONTHS, 1), F.lit(None).cast("string"))
    own = F.when(month.isNotNull(), F.concat_ws("-", month, F.regexp_extract(own, r"-(\d+)$", 1))).otherwise(own)
    plus = F.regexp_extract(own, r"^\$?\s*(\d+(?:\.\d+)?)\s*\+$", 1).try_cast("double")
    span = r"^\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*$"
    bare = F.regexp_replace(own, r"\$", "")
    low, high = F.regexp_extract(bare, span, 1).try_cast("double"), F.regexp_extract(bare, span, 2).try_cast("double")
    return F.floor(F.coalesce(plus, (low + high) / 2)).cast("bigint")


@operation("formstack_partial_lead_scoring", "Forms", quantity_column=str, budget_column=str)
def lead_scoring(df, p, order):
    """Midpoints of quantity and budget ranges and their product; null where a text is no range."""
    kind = next((v for k, v in V.ENTITIES.items() if k in p["quantity_column"].lower()), V.ENTITIES["employee"])
    q, b = _midpoint(T.column(p["quantity_column"])), _midpoint(T.column(p["budget_column"]))
    return df.withColumns({f"Average Number of {kind}": q, f"Budget per {kind}": b, "Lead Score": q * b})
