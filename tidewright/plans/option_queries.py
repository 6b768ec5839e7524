"""Queries of the options that the plain queries leave at their defaults, over values as people write them.

Each frame takes its values by the key of a table of the driver; what they should become stands in the SQL value by value, from the rules of the
operations, not from their code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.plans.combine import combine
from tidewright.plans.queries import _on, _view
from tidewright.plans.workflow import apply


def _case(values: list[str | None], key: str = "o_orderkey", quote: bool = True) -> str:
    """A value by the remainder of a key."""
    shown = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if quote else v
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {shown(v)}" for i, v in enumerate(values)) + " end"


def _frame(values: list[str | None], name: str = "x", table: str = "orders", key: str = "o_orderkey", quote: bool = True) -> str:
    return f'select {key} as id, {_case(values, key, quote)} as "{name}" from {table}'


def _pair(values: list[str | None], wanted: list[str | None], operation: str, name: str = "x", shown: str | None = None, quote: bool = True, wanted_quote: bool = True, **parameters):
    """A query that turns values into wanted ones by an operation, and its SQL."""
    shown = shown or name
    return _on(_frame(values, name, quote=quote), "orders", operation, ["id", shown], **parameters), f'select o_orderkey as id, cast({_case(wanted, quote=wanted_quote)} as {"varchar" if wanted_quote else "double"}) as "{shown}" from orders'


PHONES = ["2564294000", "(256) 429-4000", "1-256-429-4000", "256.429.4000 ext 12", "12", None, "2564294000.0"]
_SHAPES = {"digits": ("Digits Only (2564294000)", "2564294000"), "brackets": ("Standard (256) 429-4000", "(256) 429-4000"), "dashes": ("Dashes 256-429-4000", "256-429-4000"), "international": ("International +1 (256) 429-4000", "+1 (256) 429-4000")}
ZIPS = ["12345-6789", "123", "12345", "1234-56", "abc", None, "9021.0", " 02101 "]
_ZIPS = {
    "5-digit only": ["12345", "00123", "12345", "01234", None, None, "09021", "02101"],
    "ZIP+4 (preserve)": ["12345-6789", "00123", "12345", "01234-0056", None, None, "09021", "02101"],
    "ZIP+4 with placeholder": ["12345-6789", "00123-0000", "12345-0000", "01234-0056", None, None, "09021-0000", "02101-0000"],
}
STATES = ["Ohio", " ny ", "Calif.", "California", "America", "Washington DC", "new", "District of Columbia", "XX", "None", None, "Virginia Beach", "puerto rico", "Guam", "m"]
_STATES = ["OH", "NY", "CALIF.", "CA", "AMERICA", "WA", "NH", "DC", "XX", None, None, "VA", "PR", "GU", "ME"]
#: Texts for the conditions by which rows go.
FLAGS = ["False", " no ", "0", "N", "true", "yes", "", None, "Acme clinic", "ACME"]


def _removed(condition: str, stay: list[int], **parameters):
    """Rows of FLAGS of which those at the places stay."""
    run = _on(_frame(FLAGS), "orders", "data_remove_rows_if", ["id"], column="x", condition=condition, **parameters)
    return run, f"select o_orderkey as id from orders where o_orderkey % {len(FLAGS)} in ({', '.join(map(str, stay))})"


#: Two columns of an address, of which either may hold it.
PLACES = "select o_orderkey as id, case o_orderkey % 4 when 0 then '1 Main St' when 1 then 'N/A' when 2 then null else 'x' end as \"Street\", case o_orderkey % 3 when 0 then ' ' when 1 then '2 Oak' end as \"Mailing Address\", case when o_orderkey % 5 > 0 then 'a@b.co' end as \"Email Address\" from orders"


def _parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    a = _view(spark, "select c_custkey as k, c_name as n, c_mktsegment as s from customer", "customer", sf_dir)
    b = _view(spark, "select s_name as n, s_suppkey as k, s_nationkey as b from supplier", "supplier", sf_dir)
    return [a, b]


def _combined(columns: str):
    return lambda spark, sf_dir: combine(_parts(spark, sf_dir), columns)


def combine_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that agree but for case and outer blanks; rows of nulls only go."""
    a = _view(spark, "select case when c_custkey % 5 > 0 then c_custkey end as k, case when c_custkey % 5 > 1 then c_name end as n from customer", "customer", sf_dir)
    b = _view(spark, "select s_suppkey as K, s_name as N from supplier", "supplier", sf_dir).toDF("K", " N")
    return combine([a, b], "strict")


def combine_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine(_parts(spark, sf_dir), fill="none")


def _smart(shown: str, **parameters):
    sql = 'select o_orderkey as id, case o_orderkey % 3 when 0 then \'oh\' when 1 then \'Ontario\' end as "st", case o_orderkey % 4 when 0 then \'43210\' when 1 then \'12\' when 2 then \'432101234.0\' end as "zip", case o_orderkey % 5 when 0 then \' Ann  Lee Poe \' when 1 then \'Cher\' when 2 then \'\' when 3 then \'Bob Ray\' end as "person" from orders'
    return _on(sql, "orders", "add_column_smart", ["id", shown], new_column_name=shown, **parameters)


_PEOPLE = {"first": ["Ann", "Cher", "", "Bob", ""], "last": ["Poe", "", "", "Ray", ""]}

PAIRS = (
    {
        f"phones_{kind}": _pair(PHONES, [one, one, one, f"{one} x12", "12", "", one], "text_standardize_phone_numbers", "phone", phone_column="phone", output_format=name, handle_extensions=True)
        for kind, (name, one) in _SHAPES.items()
    }
    | {f"zips_{i}": _pair(ZIPS, wanted, "standardize_zip", columns=["x"], format_type=kind) for i, (kind, wanted) in enumerate(_ZIPS.items(), 1)}
    | {
        "states_by_name": _pair(STATES, _STATES, "standardize_state", columns=["x"]),
        "titles_of_names": _pair(["o'neil mc-donald", "x1y 2nd", "ÉCOLE élan", None, ""], ["O'Neil Mc-Donald", "X1Y 2Nd", "École Élan", None, ""], "text_titlecase", columns=["x"]),
        "rounded_halves": _pair(["0.5", "1.5", "2.5", "-0.5", "-1.5", "null", "3.25"], ["0.0", "2.0", "2.0", "0.0", "-2.0", "null", "3.0"], "math_round", quote=False, wanted_quote=False, column="x", decimals=0),
        "rounded_quarters": _pair(["0.25", "0.75", "1.125", "-0.25", "null", "7"], ["0.2", "0.8", "1.1", "-0.2", "null", "7.0"], "math_round", quote=False, wanted_quote=False, column="x", decimals=1),
        "dates_as_text": _pair(["2024-02-29", "2023-02-29", "12/31/1999", "1/2/2003", "2020-01-05 10:11:12", "soon", None, "31-12-2001"], ["29/02/2024", None, "31/12/1999", "02/01/2003", "05/01/2020", None, None, "31/12/2001"], "date_format", column="x", format="DD/MM/YYYY"),
        "rows_contain": _removed("contains", [0, 1, 2, 3, 4, 5, 6, 7], value="acme"),
        "rows_contain_case": _removed("contains", [0, 1, 2, 3, 4, 5, 6, 7, 9], value="Acme", case_sensitive=True),
        "rows_equal": _removed("equals", [0, 1, 2, 3, 4, 5, 6, 7, 8], value="acme"),
        "rows_not_equal": _removed("not_equals", [9], value="acme"),
        "rows_false": _removed("is_false", [4, 5, 6, 7, 8, 9]),
        "rows_blank": _removed("is_blank", [0, 1, 2, 3, 4, 5, 6, 8, 9]),
        "rows_address": (
            _on(PLACES, "orders", "data_remove_rows_if", ["id"], column="Street", condition="is_blank", enhanced_blank_detection=True),
            f'select id from ({PLACES}) p where coalesce("Street" in (\'1 Main St\', \'x\'), false) or coalesce("Mailing Address" = \'2 Oak\', false)',
        ),
        "smart_country": (
            _smart("land", mode="smart", smart_rule="country_from_location", state_column="st", zip_column="zip"),
            "select o_orderkey as id, case when o_orderkey % 3 = 0 or o_orderkey % 4 in (0, 2) then 'USA' else '' end as land from orders",
        ),
        "smart_time": (_smart("at", mode="timestamp", timestamp_format="MM/DD/YYYY", now="2024-02-29 12:00:00"), "select o_orderkey as id, '02/29/2024' as \"at\" from orders"),
        "combine_common": (_combined("common"), "select c_custkey as k, c_name as n from customer union all select s_suppkey, s_name from supplier"),
        "combine_first": (_combined("first"), "select c_custkey as k, c_name as n, c_mktsegment as s from customer union all select s_suppkey, s_name, null from supplier"),
        "combine_strict": (combine_strict, "select * from (select case when c_custkey % 5 > 0 then c_custkey end as k, case when c_custkey % 5 > 1 then c_name end as n from customer union all select s_suppkey, s_name from supplier) where k is not null or n is not null"),
        "combine_filled": (combine_filled, "select c_custkey as k, c_name as n, c_mktsegment as s, 'none' as b from customer union all select s_suppkey, s_name, 'none', cast(s_nationkey as varchar) from supplier"),
    }
    | {f"smart_{part}_name": (_smart("part", mode="smart", smart_rule="parse_name", full_name_column="person", name_part=part), f"select o_orderkey as id, {_case(wanted)} as part from orders") for part, wanted in _PEOPLE.items()}
)
