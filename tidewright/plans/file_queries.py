"""Queries of files, mappings and lineage over the driver's tables, with their SQL."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import headers as H
from tidewright.plans.batch import run_batch
from tidewright.plans.compliance import column_issues
from tidewright.plans.lineage import identified, preview
from tidewright.plans.mapping import Mapped, apply_mapping, infer, issue_summary, to_standard
from tidewright.plans.queries import _C, _MAIL, _TRIM, MESSY, SUPPLIERS, WORKFLOW, _view, contacts
from tidewright.plans.validation import occurrences, pending, status_counts, validated
from tidewright.plans.workflow import Workflow
from tidewright.sources.headers import header_rows
from tidewright.sources.records import combine_records
from tidewright.stored import _delete, shared_folder

#: Customers as lines of a file: a quoted note with line breaks, surplus separators, and some with fields too many or too few.
LINES = """select concat(cast(c_custkey as varchar(20)),
 case when c_custkey % 13 = 0 then '' else concat(',"', c_name, ' ""', c_mktsegment, '""', case when c_custkey % 5 = 0 then concat(chr(10), 'second, line', chr(10)) else '' end, '",', cast(c_nationkey as varchar(20)),
 case when c_custkey % 11 = 0 then ',more' when c_custkey % 3 = 0 then ',,' else '' end) end) as value from {customer}"""


def _under_header(header: str):
    """Lines of each part with a header before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], names=["value"])
        yield from batches

    return run


def record_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as text files, read back as records: those that hold, and what is wrong with the others."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    lines = spark.sql(LINES, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    lines.repartition(5).mapInArrow(_under_header("Key,\"Name\",Phone,"), "value string").write.text(path)
    atexit.register(_delete, spark, path)
    found = combine_records(spark, [path])
    good = found.rows.select(F.col("Key").cast("bigint").alias("key"), F.col("Name").alias("name"), F.col("Phone").alias("phone"), F.lit(None).cast("string").alias("problem"))
    return good.unionByName(found.bad.select(F.get("fields", F.lit(0)).cast("bigint").alias("key"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("phone"), "problem"))


MESSY_WITH_ID = MESSY.replace("select contact_id % 1100 as customer_id", "select contact_id, contact_id % 1100 as customer_id")
#: The columns of MESSY under names that files have.
_NAMES = {"customer_id": "Customer ID", "full_name": "Full Name", "email": "E-mail", "phone": "Phone #", "street": "Street Address", "company": "Company Name", "state": "State", "zip": "Zip Code", "note": "Remarks", "title": "Job Title", "city": "Town"}
_TARGETS = {"Cust": "customer_id", "Company": "company", "Address1": "street", "City": "city", "State": "state", "Zip": "zip", "Contact": "full_name", "Title": "title", "Telephone": "phone", "Email Address": "email"}


def _mapped(spark: SparkSession, sf_dir: str) -> Mapped:
    df = _view(spark, MESSY, "customer", sf_dir).withColumnsRenamed(_NAMES)
    return apply_mapping(df, infer(df.columns))


def mapping_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).rows


def mapping_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issue_summary(_mapped(spark, sf_dir))


def standard_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("Phone_Number"), F.col("c_acctbal").alias("Match_Score"), F.col("c_mktsegment").alias("Segment#"), F.col("c_name").alias("CompanyName"), F.col("c_custkey").alias("Cust_ID"), (F.col("c_nationkey") + 1).alias("Colour"))
    return to_standard(df)


def preview_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that the contact workflow changes, and the rows that it removes."""
    changes = preview(Workflow(WORKFLOW, ["contact_id"]), identified(contacts(spark, sf_dir), ["contact_id"]))
    key = F.get(F.from_json("_row_id", "array<string>"), F.lit(0)).cast("int").alias("contact_id")
    cells = changes.filter("change = 'changed'").select(key, "change", F.inline("cells"))
    gone = changes.filter("change <> 'changed'").select(key, "change", *[F.lit(None).cast("string").alias(c) for c in ("column", "before", "after")])
    return cells.unionByName(gone)


#: What stands above the customers of each segment's file.
_HEAD, _ABOVE = "Customer#,Company,Street,City,State,Zip,Phone", "Export Report,Data Source:,Date: today,Sheet 1,From: x,,"
_TOPS = {"BUILDING": [_HEAD], "AUTOMOBILE": [_ABOVE, _HEAD], "MACHINERY": [_ABOVE, _ABOVE, _HEAD], "FURNITURE": ["a,b,c,d,e,f,g"], "HOUSEHOLD": ["x,Customer Name and more,my city,q,r,s,t"]}


def header_rows_of_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as a file for each segment, some under lines of a report; where their headers are."""
    path = f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.lit("some name"), F.lit("5 Main"), F.lit("Troy"), F.lit("OH"), F.lit("45373"), F.lit("555"))
    body = customers.select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").cast("long").alias("at"), line.alias("value"))
    tops = spark.createDataFrame([(s, i - 10, x) for s, lines in _TOPS.items() for i, x in enumerate(lines)], "segment string, at long, value string")
    lines = body.unionByName(tops.join(customers.select(F.col("c_mktsegment").alias("segment")).distinct(), "segment", "left_semi"))
    # Lines of a file are one task's, in order; its size is bounded by what one wants in a file.
    lines.repartition("segment").sortWithinPartitions("segment", "at").select("segment", "value").write.partitionBy("segment").text(path)
    atexit.register(_delete, spark, path)
    found = header_rows(spark, path)
    return found.select(F.regexp_extract("file", "segment=([A-Z]+)", 1).alias("segment"), "row", "score", "known", "cells", "skip")


#: Results of a validation: of each address of a customer whose key isn't a multiple of three a first and, for some, a later one.
RESULTS = f"""select upper(email) as "Email", case when contact_id % 4 = 0 then 'risky' when contact_id % 4 = 1 then 'undeliverable' else 'deliverable' end as status, contact_id as validated_at from ({MESSY_WITH_ID}) m where email is not null and contact_id % 3 > 0"""


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sheets = {"people": _view(spark, MESSY_WITH_ID, "customer", sf_dir), "again": _view(spark, f"select contact_id, note from ({MESSY_WITH_ID}) m", "customer", sf_dir)}
    found = occurrences(sheets, {"people": "email", "again": "note", "absent": "x"}, ["contact_id"])
    results = _view(spark, RESULTS, "customer", sf_dir).withColumn("validated_at", F.timestamp_seconds("validated_at"))
    return found, results


def email_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(*_checked(spark, sf_dir)).select("SourceSheet", "contact_id", "Email", "Email_Validated", "Email_status", "Email_error")


def email_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending(*_checked(spark, sf_dir)).select("Email", "occurrences")


def email_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_counts(validated(*_checked(spark, sf_dir)))


def column_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by column; an example of each that is a row of it."""
    found = column_issues(_view(spark, MESSY_WITH_ID, "customer", sf_dir).drop("customer_id"), "contact_id")
    return found.select("column", "kind", "issue", "rows", "held", (F.size("examples") > 0).alias("named"))


def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workflow over customers and suppliers, of which the latter have no street."""
    tables = {"customers": contacts(spark, sf_dir), "suppliers": _view(spark, SUPPLIERS, "supplier", sf_dir)}
    steps = [*WORKFLOW[:3], {"operation_id": "data_add_multiple_columns", "parameters": {"columns": [{"name": "checked", "default_type": "value", "value": "yes"}]}}]
    return run_batch(tables, Workflow(steps, ["contact_id"])).rows.select("Source_File", "contact_id", "full_name", "state", "street", "checked")


_STATUS = f"""with m as ({MESSY_WITH_ID}), f as (select 'people' as "SourceSheet", contact_id, lower(trim(email)) as "Email" from m where email is not null union all select 'again', contact_id, lower(trim(note)) from m where note is not null),
 r as (select lower("Email") as e, arg_max(status, (validated_at, status)) as status from ({RESULTS}) x group by 1),
 s as (select f.*, regexp_matches("Email", '{_MAIL}') as good, r.status from f left join r on r.e = f."Email"),
 c as (select "SourceSheet", contact_id, "Email", good and status is not null as "Email_Validated", case when not good then 'invalid_format' else coalesce(status, 'unknown') end as "Email_status", case when not good then 'Invalid email format' when status is null then 'Not validated' end as "Email_error" from s)"""

_KEPT = "(select *, row_number() over (partition by email order by contact_id) as r from contacts where street is not null)"
_ISSUES = f"""with t as (select * from ({MESSY}) m), i as (
 {' union all '.join(f"select '{target}' as target, 'BLANK_VALUE' as code, count(*) as n from t where trim(coalesce(cast({c} as varchar), '')) = ''" for target, c in _TARGETS.items())}
 union all select 'Email Address', 'INVALID_EMAIL', count(*) from t where trim(email) <> '' and not regexp_matches(trim(email), '{_MAIL}')
 union all select 'Telephone', 'INVALID_PHONE', count(*) from t where trim(phone) <> '' and length(regexp_replace(phone, '[^0-9]', '', 'g')) not in (10, 11)
 union all select 'Zip', 'INVALID_ZIP', count(*) from t where trim(zip) <> '' and not regexp_matches(trim(zip), '^[0-9]{{5}}(-?[0-9]{{4}})?$')
 union all select 'State', 'UNKNOWN_STATE', count(*) from t where state is not null and lower(state) not in ('ohio', 'ny', 'ak', 'puerto rico', 'calif.'))
 select target, code, cast(n as bigint) as rows from i where n > 0"""

PAIRS = {
    "record_repair": (
        record_repair,
        "select c_custkey::bigint as key, case when p is null then c_name || ' \"' || c_mktsegment || '\"' || case when c_custkey % 5 = 0 then chr(10) || 'second, line' || chr(10) else '' end end as name, case when p is null then cast(c_nationkey as varchar) end as phone, p as problem"
        " from (select *, case when c_custkey % 13 = 0 then 'too few fields' when c_custkey % 11 = 0 then 'too many fields' end as p from customer)",
    ),
    "mapping_mail": (mapping_mail, "select " + ", ".join(f'{_TARGETS[t]} as "{t}"' if t in _TARGETS else f"'' as \"{t}\"" for t in H.MAIL) + f" from ({MESSY}) m"),
    "mapping_issues": (mapping_issues, _ISSUES),
    "standard_format": (standard_format, 'select c_custkey as "Customer", c_mktsegment as "Segment", c_name as "Company", c_nationkey as "Phone", c_nationkey + 1 as "Colour" from customer'),
    "preview_diff": (
        preview_diff,
        _C + f"select contact_id, 'changed' as change, 'full_name' as \"column\", full_name as before, {_TRIM.format('full_name')} as after from {_KEPT} where r = 1 and full_name <> {_TRIM.format('full_name')}"
        f" union all select contact_id, 'changed', 'state', state, upper(state) from {_KEPT} where r = 1 and state <> upper(state)"
        f" union all select contact_id, 'removed', null, null, null from contacts where contact_id not in (select contact_id from {_KEPT} where r = 1)",
    ),
    "email_status": (email_status, _STATUS + ' select * from c'),
    "email_pending": (email_pending, _STATUS + ' select "Email", count(*) as occurrences from s where good and status is null group by "Email"'),
    "email_counts": (
        email_counts,
        _STATUS + """ select count(*)::bigint as occurrences, count(distinct "Email")::bigint as addresses, count_if("Email_status" = 'deliverable')::bigint as deliverable, count_if("Email_status" = 'risky')::bigint as risky,
 count_if("Email_status" = 'undeliverable')::bigint as undeliverable, count_if("Email_status" in ('unknown', 'invalid_format'))::bigint as unknown, count_if("Email_status" in ('risky', 'undeliverable'))::bigint as bad from c""",
    ),
    "header_rows": (
        header_rows_of_segments,
        "select v.* from (values ('BUILDING', 0, 1.0::double, 7, 7, false), ('AUTOMOBILE', 1, 0.95, 7, 7, true), ('MACHINERY', 2, 0.9, 7, 7, true), ('FURNITURE', 0, 0.0, 0, 7, false), ('HOUSEHOLD', 0, 1::double / 7, 1, 7, false)) v(segment, \"row\", score, known, cells, skip)"
        " where segment in (select c_mktsegment from customer)",
    ),
    "column_issues": (
        column_issue_counts,
        f"""with t as ({MESSY_WITH_ID}), i as (
 select 'email' as "column", 'email' as kind, 'invalid_email' as issue, count_if(not regexp_matches(email, '{_MAIL}')) as n, count(email) as held from t
 union all select 'note', 'email', 'invalid_email', count_if(not regexp_matches(note, '{_MAIL}')), count(note) from t
 union all select 'phone', 'phone', 'not_10_digits', count_if(length(regexp_replace(phone, '[^0-9]', '', 'g')) <> 10), count(phone) from t
 union all select 'zip', 'zip', 'invalid_zip', count_if(not regexp_matches(zip, '^[0-9]{{5}}(-[0-9]{{4}})?$')), count(zip) from t
 union all select 'state', 'state', 'excluded_state', count_if(upper(state) in ('AK', 'HI', 'PR', 'GU', 'VI', 'AS', 'MP')), count(state) from t
 union all select 'company', 'company', 'mixed_case', count_if(company <> upper(company) and company <> lower(company)), count(company) from t
 union all select 'full_name', 'contact_name', 'mixed_case', count_if(full_name <> upper(full_name) and full_name <> lower(full_name)), count(full_name) from t
 union all select 'street', 'address1', 'po_box', count_if(street like 'P.O. Box %' or street like 'Post Office Box %'), count(street) from t)
 select "column", kind, issue, n::bigint as rows, held::bigint as held, true as named from i where n > case issue when 'mixed_case' then 0.3 * held else 0 end""",
    ),
    "batch_rows": (
        batch_rows,
        _C + f"select 'customers' as \"Source_File\", contact_id, {_TRIM.format('full_name')} as full_name, upper(state) as state, street, 'yes' as checked from contacts where street is not null"
        f" union all select 'suppliers', contact_id, {_TRIM.format('full_name')}, upper(state), null, 'yes' from ({SUPPLIERS}) s",
    ),
}
