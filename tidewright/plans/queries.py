"""Queries over the driver's tables, each with the same in DuckDB's SQL.

The Spark side is made of the engine's operations; the SQL is written separately.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.plans.combine import combine, groupable, link, link_files, link_summary, with_source
from tidewright.plans.quality import city_state_zip, column_kinds, quality, score
from tidewright.plans.workflow import Workflow, apply

CONTACTS = """select c_custkey as contact_id, '  ' || replace(c_name, '#', ' ') || ' ' as full_name,
 case when c_custkey % 5 = 0 then null else lower(c_mktsegment) || '_' || cast(c_custkey % 400 as varchar(20)) || '@example.com' end as email,
 case when c_custkey % 7 = 0 then null else '(' || lpad(cast(200 + c_custkey % 700 as varchar(20)), 3, '0') || ') ' || lpad(cast(c_custkey % 1000 as varchar(20)), 3, '0') || '.' || lpad(cast(c_custkey % 50 as varchar(20)), 4, '0') end as phone,
 case when c_custkey % 6 = 0 then null when c_custkey % 11 = 0 then 'N/A' else cast(1 + c_custkey % 97 as varchar(20)) || ' Main St' || case when c_custkey % 4 = 0 then ' Ste ' || cast(c_custkey % 9 as varchar(20)) else '' end end as street,
 case c_nationkey % 5 when 0 then 'Ohio' when 1 then 'NY' when 2 then 'ak' when 3 then 'Puerto Rico' else 'Calif.' end as state,
 cast(c_custkey % 9000 as varchar(20)) as zip,
 case c_mktsegment when 'BUILDING' then 'CEO' when 'MACHINERY' then 'Nursing Manager' when 'FURNITURE' then 'Charge Nurse' when 'HOUSEHOLD' then 'RN' else 'Receptionist' end as title,
 c_acctbal as amount from customer"""


#: Contacts with a company and a town, of all customers and of all suppliers.
PLACED = f"select *, 'Clinic of ' || title as company, 'Town ' || cast(contact_id % 500 as varchar(20)) as city from ({CONTACTS}) c"
SUPPLIERS = """select s_suppkey as contact_id, ' ' || replace(s_name, 'Supplier#', 'CUSTOMER  ') || case when s_suppkey % 4 = 0 then ' Jr' when s_suppkey % 4 = 1 then ' of the North' else '' end as full_name,
 case when s_suppkey % 5 = 1 then 'Building_' || cast(s_suppkey % 400 as varchar(20)) || '@Example.com' end as email,
 case when s_suppkey % 2 = 0 then lpad(cast(200 + s_suppkey % 700 as varchar(20)), 3, '0') || lpad(cast(s_suppkey % 1000 as varchar(20)), 3, '0') || lpad(cast(s_suppkey % 50 as varchar(20)), 4, '0') end as phone,
 case s_suppkey % 3 when 0 then 'clinic  of ' when 1 then 'Clinics of ' else 'Labs for ' end || case s_nationkey % 3 when 0 then 'CEO' when 1 then 'Charge Nurse' else 'RN' end as company,
 'town ' || cast(s_suppkey % 500 as varchar(20)) as city,
 case s_nationkey % 5 when 0 then 'ohio' when 1 then 'NY' when 2 then 'ak' when 3 then 'Puerto Rico' else 'Calif.' end as state from supplier"""


#: The same contacts in other words: e-mails of every fourth only, names and companies with other spaces and case.
REWRITTEN = f"select contact_id + 7 as contact_id, case when contact_id % 4 = 0 then upper(email) end as email, phone, '   ' || lower(full_name) as full_name, upper(company) || ' ' as company, case when contact_id % 9 > 0 then city end as city, state from ({PLACED}) p"


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CONTACTS.replace("from customer", "from {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def _on_contacts(operation: str, shown: list[str], **parameters):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply(contacts(spark, sf_dir), operation, ["contact_id"], **parameters).select("contact_id", *shown)

    return run


def _table(name: str, operation: str, shown: list[str], order: list[str], **parameters):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply(spark.read.parquet(f"{sf_dir}/{name}.parquet"), operation, order, **parameters).select(*shown)

    return run


WORKFLOW = [
    {"operation_id": "text_trim", "parameters": {"columns": ["full_name"]}},
    {"operation_id": "text_uppercase", "parameters": {"columns": ["state"]}},
    {"operation_id": "data_remove_rows_if", "parameters": {"column": "street", "condition": "is_blank"}},
    {"operation_id": "data_remove_duplicates", "parameters": {"multi_level_deduplication": False, "columns": "email", "keep": "first"}},
    {"operation_id": "data_sort", "parameters": {"columns": ["amount"], "ascending": False}},
]


def workflow_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workflow(WORKFLOW, ["contact_id"]).run(contacts(spark, sf_dir)).select("contact_id", "full_name", "email", "state", "amount")


def workflow_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workflow(WORKFLOW, ["contact_id"]).removed(contacts(spark, sf_dir)).select("contact_id", "_Operation_ID", "_Step")


def vlookup_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return apply(customers, "data_vlookup", lookup_column="c_nationkey", lookup_file=nation, lookup_file_column="n_nationkey", return_column="n_name", new_column="nation").select("c_custkey", "nation")


def combine_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return combine([c, s]).select("name", "segment", "balance")


def _two_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _view(spark, PLACED, "customer", sf_dir), _view(spark, SUPPLIERS, "supplier", sf_dir)


_CONTACT = ("contact_id", "contact_id", "email", "phone", "full_name", "city", "state", "company")


def link_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contacts, written otherwise and under other ids, against themselves; phone and name don't count."""
    master = _view(spark, PLACED, "customer", sf_dir)
    other = _view(spark, REWRITTEN, "customer", sf_dir)
    return link(master, other, *_CONTACT, fields=("email", "company", "city", "state")).select("contact_id", "Overlap_Tier", "Matched_With_Index", "Match_Reason")


def _link_tables(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return link(*_two_files(spark, sf_dir), *_CONTACT, mode).select("contact_id", "Overlap_Tier", "Matched_With_Index", "Match_Reason")

    return run


#: People of all customers with the columns that levels of deduplication look at.
PEOPLE = """select c_custkey as id, 'First ' || cast(c_custkey % 40 as varchar(20)) as "First Name", c_mktsegment as "Last Name",
 case when c_custkey % 3 = 0 then 'a' || cast(c_custkey % 90 as varchar(20)) || '@example.com' end as "Email Address",
 case when c_custkey % 4 <> 1 then cast(c_custkey % 20 as varchar(20)) || case when c_custkey % 2 = 0 then ' N. Main St, Apt 5' else ' north main Street Apartment  5' end end as "Person Street",
 'Town' as "Person City", 'OH' as "Person State", cast(c_custkey % 30 as varchar(20)) as "Direct Phone Number", cast(floor(c_acctbal) as integer) as amount from customer"""
#: Survey answers and numbers as people write them.
ANSWERS = """select o_orderkey as id, case o_orderkey % 6 when 0 then '1-50' when 1 then 'Jan-50' when 2 then '500+' when 3 then '100 - 250' when 4 then 'many' end as staff_count,
 case o_orderkey % 5 when 0 then '$5-$10' when 1 then '$20 - $30' when 2 then '1.5-2.5' when 3 then '50 people' else '5' end as budget,
 case o_orderkey % 5 when 0 then '5164.0' when 1 then '-5' when 2 then '12-34' when 3 then null else '123456789' end as number,
 case o_orderkey % 4 when 0 then ' 7 ' when 1 then 'x' when 2 then '' else '10.0' end as segment from orders"""


def _view(spark: SparkSession, sql: str, table: str, sf_dir: str) -> DataFrame:
    return spark.sql(sql.replace(f"from {table}", f"from {{{table}}}").replace('"', "`"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def _on(sql: str, table: str, operation: str, shown: list[str] | None = None, **parameters):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = apply(_view(spark, sql, table, sf_dir), operation, ["id"], **parameters)
        return out.select(*[T.column(c) for c in shown]) if shown else out

    return run


def remove_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = apply(spark.read.parquet(f"{sf_dir}/documents.parquet"), "flag_rows_containing", columns=["text"], patterns="license, password")
    return apply(flagged, "remove_flagged_rows", flag_column="_FLAG_REMOVE").select("doc_id", "n_chars")


def header_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third nation's row becomes the header."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("n_regionkey"))
    return apply(nation, "data_set_header_row", ["n_nationkey"], header_row_number=3).toDF("n_nationkey", "a", "b")


#: Contacts with repeated customers, boxes, generic names and numbers and addresses that don't hold.
MESSY = f"""select contact_id % 1100 as customer_id, case when contact_id % 13 = 0 then 'Office Manager' when contact_id % 17 = 0 then null else full_name end as full_name,
 case when contact_id % 9 = 0 then 'nobody(at)example.com' else email end as email, case when contact_id % 10 = 0 then '555-01' else phone end as phone,
 case when contact_id % 8 = 0 then 'P.O. Box ' || zip when contact_id % 19 = 0 then 'Post Office Box 7' else street end as street, upper(title) as company, state, zip,
 case when contact_id % 3 = 0 then null else email end as note, title, 'Town ' || cast(contact_id % 500 as varchar(20)) as city from ({CONTACTS}) c"""
_MAIL = "^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}$"
_FINDINGS = f"""with t as (select * from ({MESSY}) m), f as (
 select 'duplicates' as finding, 'critical' as severity, 'customer_id' as columns, sum(n) as affected_rows from (select count(*) as n from t group by customer_id) g where n > 1
 union all select 'sparse_rows', 'recommended', '', count(*) from t where 11 - (case when customer_id is null then 0 else 1 end + case when full_name is null then 0 else 1 end + case when email is null then 0 else 1 end + case when phone is null then 0 else 1 end + case when street is null then 0 else 1 end + case when company is null then 0 else 1 end + case when state is null then 0 else 1 end + case when zip is null then 0 else 1 end + case when note is null then 0 else 1 end + case when title is null then 0 else 1 end + case when city is null then 0 else 1 end) >= 5.5
 union all select 'po_boxes', 'critical', 'street', count(*) from t where street like 'P.O. Box %' or street like 'Post Office Box %'
 union all select 'excluded_states', 'critical', 'state', count(*) from t where upper(state) in ('AK', 'HI', 'PR', 'GU', 'VI', 'AS', 'MP')
 union all select 'generic_contacts', 'recommended', 'full_name', 2 * count(*) from t where full_name = 'Office Manager'
 union all select 'invalid_emails', 'optional', 'email', count(*) from t where email is not null and not regexp_matches(email, '{_MAIL}')
 union all select 'invalid_phones', 'optional', 'phone', count(*) from t where phone is not null and length(regexp_replace(phone, '[^0-9]', '', 'g')) <> 10
 union all select 'whitespace', 'recommended', 'full_name', case when count_if(full_name like ' %' or full_name like '% ') > 0 then count(*) else 0 end from t
 union all select 'capitalisation', 'recommended', 'full_name,street,city', count(*) from t)
 select finding, severity, columns, cast(affected_rows as bigint) as affected_rows from f where affected_rows > 0"""


def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_view(spark, MESSY, "customer", sf_dir))


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(quality_findings(spark, sf_dir))


def column_kinds_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c, kind, confidence) for c, (kind, confidence) in column_kinds(_view(spark, MESSY, "customer", sf_dir)).items()]
    return spark.createDataFrame(rows, "name string, kind string, confidence double")


def city_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _view(spark, PLACED, "customer", sf_dir)
    return df.select("contact_id", city_state_zip(F.expr("if(contact_id % 3 = 0, ' ', city)"), F.expr("if(contact_id % 4 = 0, null, state)"), F.expr("if(contact_id % 5 = 0, '', zip)")).alias("line"))


#: A third file: the suppliers again, under other ids, without most e-mails and phones, and with some of company, city and state.
AGAIN = f"""select contact_id + 5 as contact_id, full_name, case when contact_id % 9 = 0 then email end as email, case when contact_id % 8 = 0 then phone end as phone,
 case when contact_id % 3 > 0 then company end as company, case when contact_id % 5 > 1 then city else ' ' end as city, case when contact_id % 7 > 2 then state end as state from ({SUPPLIERS}) s"""


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers = _two_files(spark, sf_dir)
    return link_files({"customers": customers, "suppliers": suppliers, "again": _view(spark, AGAIN, "supplier", sf_dir)}, "contact_id", *_CONTACT[2:])


def link_three_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select("Source_File", "contact_id", "Overlap_Tier", "Match_Reason", "Matched_File", "Matched_With_Index")


def link_three_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_summary(_linked(spark, sf_dir))


def _keyed(sql: str, file: int) -> str:
    return f"select {file} * 1000000000 + contact_id as pos, contact_id as id, lower(email) as email, {_NUMBER.format('phone')} as phone, lower({_TRIM.format('full_name')}) as name, nullif(lower({_TRIM.format('company')}), '') as company, nullif(lower(trim(city)), '') as city, lower(state) as state from ({sql}) t"


def _tiers(other: str, master: str) -> str:
    return (
        f"select o.*, (select min(pos) from {master} m where m.email = o.email) as a, (select min(pos) from {master} m where m.phone = o.phone and m.name = o.name) as b,"
        f" (select min(pos) from {master} m where coalesce(o.company, o.city, o.state) is not null and (o.company is null or m.company = o.company) and (o.city is null or m.city = o.city) and (o.state is null or m.state = o.state) and m.name = o.name) as c from {other} o"
    )


def _three_files() -> str:
    own = "pos, id, email, phone, name, company, city, state"
    return (
        f"with f0 as ({_keyed(PLACED, 0)}), f1 as ({_keyed(SUPPLIERS, 1)}), f2 as ({_keyed(AGAIN, 2)}), t1 as ({_tiers('f1', 'f0')}),"
        f" m1 as (select {own} from f0 union all select {own} from t1 where coalesce(a, b, c) is null), t2 as ({_tiers('f2', 'm1')}),"
        " u as (select 'customers' as s, id, cast(null as bigint) as a, cast(null as bigint) as b, cast(null as bigint) as c from f0 union all select 'suppliers', id, a, b, c from t1 union all select 'again', id, a, b, c from t2)"
        ' select s as "Source_File", id as contact_id, case when a is not null then 1 when b is not null then 2 when c is not null then 3 end as "Overlap_Tier",'
        " case when a is not null then 'Email Match' when b is not null then 'Phone + Name Match' when c is not null then 'Company + Location Match' end as \"Match_Reason\","
        " case coalesce(a, b, c) // 1000000000 when 0 then 'customers' when 1 then 'suppliers' end as \"Matched_File\", coalesce(a, b, c) % 1000000000 as \"Matched_With_Index\" from u"
    )


def union_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return with_source({"customer": read("customer").select("c_custkey", "c_name"), "supplier": read("supplier").select("s_suppkey", F.col("s_name").alias("c_name"))})


def groupable_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groupable(contacts(spark, sf_dir).select("contact_id", "state", "title", "email"))


def _first_of(keys: str) -> str:
    return f"select id from (select *, row_number() over (partition by {keys} order by id) as r from p) where r = 1"


_STREET = "split_part(\"Person Street\", ' ', 1) || ' NORTH MAIN STREET APARTMENT 5'"
_LEVELS = 'case when "Email Address" is not null then 1 when "Person Street" is not null then 2 else 3 end'
_BY_LEVEL = _LEVELS + ', case when {0} = 1 then "Email Address" end, case when {0} > 1 then "First Name" end, case when {0} > 1 then "Last Name" end, case when {0} = 2 then {1} end, case when {0} = 3 then "Direct Phone Number" end'
_CODE = "case when regexp_replace(split_part(trim({0}), '.', 1), '[^0-9]', '', 'g') = '' or {0} is null then repeat('0', {1}) else case when trim({0}) like '-%' then '-' else '' end || case when length(regexp_replace(split_part(trim({0}), '.', 1), '[^0-9]', '', 'g')) >= {1} then regexp_replace(split_part(trim({0}), '.', 1), '[^0-9]', '', 'g') else lpad(regexp_replace(split_part(trim({0}), '.', 1), '[^0-9]', '', 'g'), {1}, '0') end end"

_C = f"with contacts as ({CONTACTS}) "
_TRIM = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_NUMBER = "regexp_replace({0}, '[^0-9]', '', 'g')"
_STATES = "case state when 'Ohio' then 'OH' when 'NY' then 'NY' when 'ak' then 'AK' when 'Puerto Rico' then 'PR' else 'CA' end"
_RANKS = "case title when 'CEO' then 1 when 'Nursing Manager' then 3 when 'Charge Nurse' then 4 when 'RN' then 5 else 6 end"

#: Name: the Spark query and its SQL.
PAIRS = {
    "workflow_contacts": (workflow_contacts, _C + f"select contact_id, {_TRIM.format('full_name')} as full_name, email, upper(state) as state, amount from (select *, row_number() over (partition by email order by contact_id) as r from contacts where street is not null) where r = 1"),
    "workflow_removed": (workflow_removed, _C + "select contact_id, 'data_remove_rows_if' as \"_Operation_ID\", 3 as \"_Step\" from contacts where street is null union all select contact_id, 'data_remove_duplicates', 4 from (select *, row_number() over (partition by email order by contact_id) as r from contacts where street is not null) where r > 1"),
    "text_uppercase": (_on_contacts("text_uppercase", ["state"], columns=["state"]), _C + "select contact_id, upper(state) as state from contacts"),
    "text_lowercase": (_on_contacts("text_lowercase", ["title"], columns=["title"]), _C + "select contact_id, lower(title) as title from contacts"),
    "text_titlecase": (_on_contacts("text_titlecase", ["title"], columns=["title"]), _C + "select contact_id, case title when 'CEO' then 'Ceo' when 'RN' then 'Rn' else title end as title from contacts"),
    "text_trim": (_on_contacts("text_trim", ["full_name"], columns=["full_name"]), _C + f"select contact_id, {_TRIM.format('full_name')} as full_name from contacts"),
    "text_concatenate": (_on_contacts("text_concatenate", ["both"], columns=["state", "email"], separator="|", new_column="both"), _C + "select contact_id, state || '|' || coalesce(email, '') as \"both\" from contacts"),
    "text_split": (_table("orders", "text_split", ["o_orderkey", "a", "b"], [], column="o_orderpriority", separator="-", new_columns="a,b"), "select o_orderkey, split_part(o_orderpriority, '-', 1) as a, case when contains(o_orderpriority, '-') then split_part(o_orderpriority, '-', 2) end as b from orders"),
    "text_remove_special": (_table("documents", "text_remove_special", ["doc_id", "text"], [], columns=["text"]), "select doc_id, regexp_replace(text, '[^A-Za-z0-9\\s]', '', 'g') as text from documents"),
    "text_find_replace": (_table("part", "text_find_replace", ["p_partkey", "p_brand"], [], columns=["p_brand"], find_text="brand#", replace_text="B$"), "select p_partkey, regexp_replace(p_brand, 'brand#', 'B$', 'gi') as p_brand from part"),
    "text_add_prefix_suffix": (_table("part", "text_add_prefix_suffix", ["p_partkey", "p_brand"], [], columns=["p_brand"], prefix="<", suffix=">"), "select p_partkey, '<' || p_brand || '>' as p_brand from part"),
    "text_left": (_table("part", "text_left", ["p_partkey", "x"], [], column="p_name", length=4, new_column="x"), "select p_partkey, left(p_name, 4) as x from part"),
    "text_right": (_table("part", "text_right", ["p_partkey", "x"], [], column="p_name", length=4, new_column="x"), "select p_partkey, right(p_name, 4) as x from part"),
    "text_mid": (_table("part", "text_mid", ["p_partkey", "x"], [], column="p_name", start=3, length=5, new_column="x"), "select p_partkey, substr(p_name, 3, 5) as x from part"),
    "extract_text": (_table("part", "extract_text", ["p_partkey", "Extracted"], [], column="p_name"), "select p_partkey, left(p_name, 5) as \"Extracted\" from part"),
    "text_len": (_table("part", "text_len", ["p_partkey", "n"], [], column="p_name", new_column="n"), "select p_partkey, cast(length(p_name) as integer) as n from part"),
    "text_phone_format": (_on_contacts("text_phone_format", ["phone"], column="phone"), _C + f"select contact_id, regexp_replace({_NUMBER.format('phone')}, '^(...)(...)(....)$', '(\\1) \\2-\\3') as phone from contacts"),
    "standardize_phone": (_on_contacts("standardize_phone", ["phone"], columns=["phone"]), _C + f"select contact_id, cast({_NUMBER.format('phone')} as bigint) as phone from contacts"),
    "standardize_zip": (_on_contacts("standardize_zip", ["zip"], columns=["zip"]), _C + "select contact_id, lpad(zip, 5, '0') as zip from contacts"),
    "zoominfo_state_converter": (_on_contacts("zoominfo_state_converter", ["state"], column="state"), _C + f"select contact_id, {_STATES} as state from contacts"),
    "validate_state": (_on_contacts("validate_state", ["state", "state_Valid"], column="state"), _C + "select contact_id, case state when 'Ohio' then 'OH' when 'NY' then 'NY' when 'ak' then 'AK' when 'Puerto Rico' then 'PR' else 'CALIF.' end as state, state in ('Ohio', 'NY', 'ak') as \"state_Valid\" from contacts"),
    "validate_email": (_on_contacts("validate_email", ["email_Valid"], column="email"), _C + "select contact_id, coalesce(regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$'), false) as \"email_Valid\" from contacts"),
    "parse_contact_name": (_on_contacts("parse_contact_name", ["f", "l"], column="full_name", first_name_col="f", last_name_col="l"), _C + f"select contact_id, split_part({_TRIM.format('full_name')}, ' ', 1) as f, split_part({_TRIM.format('full_name')}, ' ', 2) as l from contacts"),
    "zoominfo_split_address": (_on_contacts("zoominfo_split_address", ["a1", "a2"], source_column="street", address1_output="a1", address2_output="a2"), _C + "select contact_id, case when contains(street, ' Ste ') then split_part(street, ' Ste ', 1) else street end as a1, case when street is null then null when contains(street, ' Ste ') then 'Ste ' || split_part(street, ' Ste ', 2) else '' end as a2 from contacts"),
    "clean_fill_missing": (_on_contacts("clean_fill_missing", ["email"], columns=["email"]), _C + "select contact_id, coalesce(email, 'N/A') as email from contacts"),
    "add_column_smart": (_on_contacts("add_column_smart", ["domain"], new_column_name="domain", mode="smart", smart_rule="email_domain", email_column="email"), _C + "select contact_id, coalesce(split_part(email, '@', 2), '') as domain from contacts"),
    "data_filter_by_value": (_table("lineitem", "data_filter_by_value", ["l_orderkey", "l_linenumber", "l_quantity"], [], column="l_quantity", operator=">=", value=30), "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 30"),
    "data_remove_rows_if": (_on_contacts("data_remove_rows_if", ["street"], column="street", condition="is_blank", enhanced_blank_detection=True), _C + "select contact_id, street from contacts where street is not null and lower(trim(street)) not in ('', 'n/a', 'na', 'null', 'none')"),
    "remove_rows_containing": (_table("documents", "remove_rows_containing", ["doc_id"], [], columns=["text"], patterns="license, password"), "select doc_id from documents where not (contains(lower(text), 'license') or contains(lower(text), 'password'))"),
    "flag_rows_containing": (_table("documents", "flag_rows_containing", ["doc_id", "_FLAG_REMOVE"], [], columns=["text"], patterns="license, password"), "select doc_id, concat_ws(', ', case when contains(lower(text), 'license') then 'license' end, case when contains(lower(text), 'password') then 'password' end) as \"_FLAG_REMOVE\" from documents"),
    "remove_excluded_states": (_on_contacts("remove_excluded_states", ["state"], column="state"), _C + "select contact_id, state from contacts where upper(state) not in ('AK', 'HI', 'PR', 'VI')"),
    "filter_lower_48": (_on_contacts("filter_lower_48", ["state"], state_column="state"), _C + "select contact_id, state from contacts where state in ('Ohio', 'NY', 'Calif.')"),
    "conditional_flag_contains": (_on_contacts("conditional_flag_contains", ["Flag"], column="title", text="nurs"), _C + "select contact_id, contains(lower(title), 'nurs') as \"Flag\" from contacts"),
    "data_vlookup": (vlookup_nation, "select c_custkey, n_name as nation from customer left join nation on c_nationkey = n_nationkey"),
    "data_remove_duplicates": (_on_contacts("data_remove_duplicates", ["phone"], multi_level_deduplication=False, columns="phone", keep="last"), _C + "select contact_id, phone from (select *, row_number() over (partition by phone order by contact_id desc) as r from contacts) where r = 1"),
    "keep_best_contact": (_on_contacts("data_keep_best_contact_per_location", ["Title Rank"], location_columns="state,zip", title_column="title"), _C + f"select contact_id, \"Title Rank\" from (select *, {_RANKS} as \"Title Rank\", row_number() over (partition by state, zip order by {_RANKS}, contact_id) as r from contacts) where r = 1"),
    "data_analyze_title_ranks": (_on_contacts("data_analyze_title_ranks", ["Title Rank Number"], title_column="title"), _C + f"select contact_id, {_RANKS} as \"Title Rank Number\" from contacts"),
    "data_keep_best_by_value": (_on_contacts("data_keep_best_by_value", ["email", "amount"], email_column="email", value_column="amount"), _C + "select contact_id, email, amount from (select *, row_number() over (partition by email order by amount desc nulls last, contact_id) as r from contacts) where email is null or r = 1"),
    "data_sort": (_table("orders", "data_sort", ["o_orderkey", "o_totalprice"], ["o_orderkey"], columns=["o_totalprice"], ascending=False), "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey"),
    "math_add_columns": (_table("lineitem", "math_add_columns", ["l_orderkey", "l_linenumber", "x"], [], columns=["l_quantity", "l_tax"], new_column="x"), "select l_orderkey, l_linenumber, 0.0::double + l_quantity + l_tax as x from lineitem"),
    "math_multiply": (_table("lineitem", "math_multiply", ["l_orderkey", "l_linenumber", "x"], [], column1="l_quantity", column2="l_discount", new_column="x"), "select l_orderkey, l_linenumber, l_quantity * l_discount as x from lineitem"),
    "math_average": (_table("lineitem", "math_average", ["l_orderkey", "l_linenumber", "x"], [], columns=["l_quantity", "l_tax"], new_column="x"), "select l_orderkey, l_linenumber, (0.0::double + l_quantity + l_tax) / 2 as x from lineitem"),
    "date_format": (_table("orders", "date_format", ["o_orderkey", "o_orderdate"], [], column="o_orderdate"), "select o_orderkey, strftime(o_orderdate, '%m/%d/%Y') as o_orderdate from orders"),
    "combine_all": (combine_all, "select c_name as name, c_mktsegment as segment, cast(null as double) as balance from customer union all select s_name, null, s_acctbal from supplier"),
    "data_remove_duplicates_levels": (_on(PEOPLE, "customer", "data_remove_duplicates", ["id"]), f"with p as ({PEOPLE}) " + _first_of(_BY_LEVEL.format(_LEVELS, '"Person Street"'))),
    "data_remove_duplicates_smart": (_on(PEOPLE, "customer", "data_remove_duplicates", ["id"], multi_level_deduplication=False, columns="Person Street,Last Name", smart_matching=True), f"with p as ({PEOPLE}) " + _first_of(_STREET + ', "Last Name"')),
    "clean_keep_columns": (_on(PEOPLE, "customer", "clean_keep_columns", columns_to_keep=["amount", "id"]), f"select id, amount from ({PEOPLE})"),
    "clean_remove_columns": (_on(ANSWERS, "orders", "clean_remove_columns", columns=["number", "segment"]), f"select id, staff_count, budget from ({ANSWERS})"),
    "clean_remove_blank_rows": (_on("select o_orderkey as id, case when o_orderkey % 3 > 0 then o_orderstatus end as a, case when o_orderkey % 2 > 0 then o_orderpriority end as b from orders", "orders", "clean_remove_blank_rows"), "select o_orderkey as id, case when o_orderkey % 3 > 0 then o_orderstatus end as a, case when o_orderkey % 2 > 0 then o_orderpriority end as b from orders where o_orderkey % 6 > 0"),
    "data_add_multiple_columns": (_on(PEOPLE, "customer", "data_add_multiple_columns", ["id", "note", "amount", "amount_1", "Last Name"], columns=[{"name": "note"}, {"name": "amount", "default_type": "value", "value": "7", "on_exists": "rename"}, {"name": "Last Name", "default_type": "value", "value": "x", "on_exists": "overwrite"}, {"name": "id", "default_type": "value", "value": "1"}]), f"select id, '' as note, amount, cast(7 as integer) as amount_1, 'x' as \"Last Name\" from ({PEOPLE})"),
    "data_reorder_columns": (_on(ANSWERS, "orders", "data_reorder_columns", column_order=["segment", "id"]), f"select segment, id from ({ANSWERS})"),
    "text_rename_column": (_on(ANSWERS, "orders", "text_rename_column", ["id", "Segment No."], old_name="segment", new_name="Segment No."), f"select id, segment as \"Segment No.\" from ({ANSWERS})"),
    "text_rename_batch": (_on(ANSWERS, "orders", "text_rename_batch", ["id", "number", "segment"], mappings={"number": "segment", "segment": "number"}), f"select id, segment as number, number as segment from ({ANSWERS})"),
    "standardize_column_names": (_on(PEOPLE, "customer", "standardize_column_names", ["id", "Email"], mapping="Email Address=Email, Not There=X"), f"select id, \"Email Address\" as \"Email\" from ({PEOPLE})"),
    "standardize_state": (_on_contacts("standardize_state", ["state"], columns=["state"]), _C + "select contact_id, case state when 'Ohio' then 'OH' when 'NY' then 'NY' when 'ak' then 'AK' when 'Puerto Rico' then 'PR' else 'CALIF.' end as state from contacts"),
    "formstack_partial_lead_scoring": (
        _on(ANSWERS, "orders", "formstack_partial_lead_scoring", ["id", "Average Number of Staff", "Budget per Staff", "Lead Score"], quantity_column="staff_count", budget_column="budget"),
        f"with a as (select id, cast(case staff_count when '1-50' then 25 when 'Jan-50' then 25 when '500+' then 500 when '100 - 250' then 175 end as bigint) as q, cast(case budget when '$5-$10' then 7 when '$20 - $30' then 25 when '1.5-2.5' then 2 end as bigint) as b from ({ANSWERS}))"
        ' select id, q as "Average Number of Staff", b as "Budget per Staff", q * b as "Lead Score" from a',
    ),
    "math_percentage": (_table("orders", "math_percentage", ["o_orderkey", "x"], [], numerator_column="o_custkey", denominator_column="o_orderkey", new_column="x", multiply_by_100=False), "select o_orderkey, round_even(cast(o_custkey as double) / nullif(o_orderkey, 0), 2) as x from orders"),
    "math_round": (_table("part", "math_round", ["p_partkey", "x"], [], column="p_size", decimals=0, new_column="x"), "select p_partkey, cast(p_size as double) as x from part"),
    "math_sum": (_table("lineitem", "math_sum", ["l_orderkey", "l_linenumber", "x"], [], columns=["l_quantity", "l_returnflag", "l_linenumber"], new_column="x"), "select l_orderkey, l_linenumber, l_quantity + l_linenumber as x from lineitem"),
    "remove_flagged_rows": (remove_flagged, "select doc_id, n_chars from documents where not (contains(lower(text), 'license') or contains(lower(text), 'password'))"),
    "data_set_header_row": (header_row, "select n_nationkey, n_name as a, cast(n_regionkey as varchar) as b from (select *, row_number() over (order by n_nationkey) as r from nation) where r > 3"),
    "text_standardize_customer_numbers": (_on(ANSWERS, "orders", "text_standardize_customer_numbers", ["id", "number", "segment"], customer_number_column="number", segment_column="segment"), f"select id, {_CODE.format('number', 8)} as number, case when trim(segment) = '' then '00' else {_CODE.format('segment', 2)} end as segment from ({ANSWERS})"),
    "text_clean_mailing_customer_data": (
        _on(ANSWERS, "orders", "text_clean_mailing_customer_data", ["id", "number", "segment"], customer_column="number", segment_column="segment"),
        f"select id, case number when '5164.0' then '00005164' when '-5' then '00000000' when '12-34' then '00000012' else number end as number, case segment when ' 7 ' then '07' when '10.0' then '10' else '' end as segment from ({ANSWERS})",
    ),
    "text_standardize_phone_numbers": (_on_contacts("text_standardize_phone_numbers", ["phone"], phone_column="phone"), _C + f"select contact_id, coalesce({_NUMBER.format('phone')}, '') as phone from contacts"),
    "link_exact": (
        link_exact,
        f"with m as ({_keyed(PLACED, 0)}), o as ({_keyed(REWRITTEN, 0)}), f as (select o.id, (select min(id) from m where m.email = o.email) as a, (select min(id) from m where m.company = o.company and m.city = o.city and m.state = o.state and m.name = o.name) as c from o)"
        " select id as contact_id, case when a is not null then 1 when c is not null then 3 end as \"Overlap_Tier\", coalesce(a, c) as \"Matched_With_Index\", case when a is not null then 'Tier 1: Exact email match' when c is not null then 'Tier 3: Company + Location + Name match' end as \"Match_Reason\" from f",
    ),
    "link_files": (link_three_files, _three_files()),
    "link_files_summary": (
        link_three_summary,
        f"select \"Source_File\", count(*) as records, count(*) filter (where \"Overlap_Tier\" = 1) as tier1_matches, count(*) filter (where \"Overlap_Tier\" = 2) as tier2_matches, count(*) filter (where \"Overlap_Tier\" = 3) as tier3_matches,"
        f" count(*) filter (where \"Overlap_Tier\" is null) as unique_records, round(count(\"Overlap_Tier\") * 100 / count(*), 2) as overlap_rate from ({_three_files()}) x group by rollup(\"Source_File\")",
    ),
    "with_source": (
        union_with_source,
        "select 'customer' as \"Source_File\", c_custkey, c_name, null::bigint as s_suppkey from customer union all select 'supplier', null, s_name, s_suppkey from supplier",
    ),
    "groupable_columns": (
        groupable_columns,
        "with d as (select count(*) as n, count(distinct contact_id) as a, count(distinct state) as b, count(distinct title) as c, count(distinct email) as e"
        f" from ({CONTACTS}) t), u as (select n, 'contact_id' as \"column\", a as v from d union all select n, 'state', b from d union all select n, 'title', c from d union all select n, 'email', e from d)"
        " select \"column\", v as distinct_values from u where v <= 100 and v * 2 < n",
    ),
    "quality_findings": (quality_findings, _FINDINGS),
    "quality_score": (
        quality_score,
        f"select greatest(0, 100 - 15 * critical - 5 * recommended - 2 * optional)::bigint as score, critical, recommended, optional from (select count_if(severity = 'critical')::bigint as critical, count_if(severity = 'recommended')::bigint as recommended, count_if(severity = 'optional')::bigint as optional from ({_FINDINGS}) x) y",
    ),
    "column_kinds": (
        column_kinds_contacts,
        "select * from (values ('customer_id', 'customer_id', 0.9::double), ('full_name', 'contact_name', 0.9), ('email', 'email', 0.9), ('phone', 'phone', 0.9), ('street', 'address1', 0.9), ('company', 'company', 0.9),"
        " ('state', 'state', 0.9), ('zip', 'zip', 0.9), ('note', 'email', 0.8), ('title', 'unknown', 0.0), ('city', 'city', 0.9)) v(name, kind, confidence)",
    ),
    "city_line": (
        city_line,
        f"with p as (select contact_id, case when contact_id % 3 = 0 then '' else city end as c, case when contact_id % 4 = 0 then '' else state end as s, case when contact_id % 5 = 0 then '' else zip end as z from ({PLACED}) q)"
        " select contact_id, trim(c || case when c <> '' and s <> '' then ', ' else '' end || s || case when z <> '' then ' ' || z else '' end) as line from p",
    ),
    "link_tables": (
        _link_tables("exact"),
        f"with m as (select contact_id as id, lower(email) as email, {_NUMBER.format('phone')} as phone, lower({_TRIM.format('full_name')}) as name, lower({_TRIM.format('company')}) as company, lower(city) as city, lower(state) as state from ({PLACED})),"
        f" o as (select contact_id as id, lower(email) as email, {_NUMBER.format('phone')} as phone, lower({_TRIM.format('full_name')}) as name, lower({_TRIM.format('company')}) as company, lower(city) as city, lower(state) as state from ({SUPPLIERS})),"
        " f as (select o.id, (select min(id) from m where m.email = o.email) as a, (select min(id) from m where m.phone = o.phone and m.name = o.name) as b,"
        " (select min(id) from m where m.company = o.company and m.city = o.city and m.state = o.state and m.name = o.name) as c from o)"
        " select id as contact_id, case when a is not null then 1 when b is not null then 2 when c is not null then 3 end as \"Overlap_Tier\", coalesce(a, b, c) as \"Matched_With_Index\","
        " case when a is not null then 'Tier 1: Exact email match' when b is not null then 'Tier 2: Phone + Name match' when c is not null then 'Tier 3: Company + Location + Name match' end as \"Match_Reason\" from f",
    ),
}

#: DuckDB has no ratio by common subsequences, so link_fuzzy has no SQL.
QUERIES = {name: pair[0] for name, pair in PAIRS.items()} | {"link_fuzzy": _link_tables("fuzzy")}
SQL = {name: pair[1] for name, pair in PAIRS.items()}
