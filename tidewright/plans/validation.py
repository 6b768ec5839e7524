"""Results of an e-mail validation, kept by address and joined back to every occurrence.

The validation itself is somebody else's: its results come as tables of address, status and details. Here is what is left to ask for, in chunks that can be
sent one by one; results appended so that a chunk that comes twice counts once; and the state of every occurrence.

Scale: addresses are combined before the shuffle, what is known is taken out by an anti-join, and chunks are dealt by a hash of the address, so none of them is gathered.
Occurrences of one address are joined to its one result in a join that Spark splits where it is skewed.

Cases: addresses are compared in lower case without outer blanks; null and blank ones are no occurrences. An address that hasn't the form of one is ``invalid_format`` and never
asked for. Of several results of an address the latest counts (then the greatest by its other columns). Results without an address are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.functions import values as V

#: Columns of results beside address; those that a table lacks are null.
DETAILS = {"status": "string", "substatus": "string", "free": "boolean", "domain": "string", "mx_found": "boolean", "role": "boolean", "disposable": "boolean", "accept_all": "boolean", "error": "string", "validated_at": "timestamp"}
STATUSES = ["deliverable", "risky", "undeliverable"]


def address(c: Column) -> Column:
    """The address as it is compared, null if there is none."""
    return F.nullif(F.lower(T.stripped(c)), F.lit(""))


def occurrences(sheets: dict[str, DataFrame], columns: dict[str, str], keys: list[str]) -> DataFrame:
    """SourceSheet, the key columns and Email of each address in the sheets' columns; sheets without a column are passed over."""
    frames = []
    for name, df in sheets.items():
        if columns.get(name) in df.columns:
            frames.append(df.select(F.lit(name).alias("SourceSheet"), *[T.column(k).alias(k) for k in keys], address(T.column(columns[name])).alias("Email")))
    if not frames:
        raise ValueError("no sheet has its column")
    return reduce(DataFrame.unionByName, frames).filter("Email is not null")


def latest(results: DataFrame) -> DataFrame:
    """One result an address: Email and DETAILS."""
    details = [(F.col(c) if c in results.columns else F.lit(None)).cast(kind).alias(c) for c, kind in DETAILS.items()]
    known = results.select(address(T.column("Email")).alias("Email"), *details).filter("Email is not null")
    order = F.struct("validated_at", *[c for c in DETAILS if c != "validated_at"])
    return known.groupBy("Email").agg(F.max(order).alias("r")).select("Email", *[F.col("r")[c].alias(c) for c in DETAILS])


def pending(found: DataFrame, results: DataFrame, chunks: int = 1) -> DataFrame:
    """Addresses of good form without a result: Email, occurrences, chunk (0 up to chunks)."""
    asked = found.filter(F.col("Email").rlike(V.EMAIL)).groupBy("Email").agg(F.count("*").alias("occurrences"))
    left = asked.join(latest(results).select("Email"), "Email", "left_anti")
    return left.withColumn("chunk", F.pmod(F.xxhash64("Email"), F.lit(chunks)).cast("int"))


def append_chunk(results: DataFrame, path: str, batch: str, chunk: int) -> None:
    """Keeps the results of one chunk of a batch in a folder; the same chunk again takes the former's place, so that a repeated job does no harm."""
    results.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}/chunk={chunk}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All results that were appended."""
    schema = "Email string, " + ", ".join(f"{c} {kind}" for c, kind in DETAILS.items())
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def validated(found: DataFrame, results: DataFrame) -> DataFrame:
    """Every occurrence with what is known of its address; status 'unknown' where nothing is yet, 'invalid_format' where it isn't an address."""
    good = F.col("Email").rlike(V.EMAIL)
    known = latest(results).withColumnsRenamed({c: f"Email_{c}" for c in DETAILS})
    out = found.join(known, "Email", "left").withColumn("Email_Validated", good & F.col("Email_status").isNotNull())
    status = F.when(~good, "invalid_format").otherwise(F.coalesce("Email_status", F.lit("unknown")))
    error = F.when(~good, "Invalid email format").when(~F.col("Email_Validated"), "Not validated").otherwise(F.col("Email_error"))
    return out.withColumns({"Email_status": status, "Email_error": error})


def status_counts(checked: DataFrame) -> DataFrame:
    """One row: occurrences, addresses, occurrences by status (unknown has those of bad form), and bad: risky and undeliverable ones."""
    # Addresses are counted by a grouping with partial sums, not by one task's set.
    each = checked.groupBy("Email", "Email_status").agg(F.count("*").alias("n"))
    sums = [F.coalesce(F.sum(F.when(F.col("Email_status") == s, F.col("n"))), F.lit(0)).alias(s) for s in STATUSES]
    other = F.coalesce(F.sum(F.when(F.col("Email_status").isin("unknown", "invalid_format"), F.col("n"))), F.lit(0)).alias("unknown")
    out = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"), F.count("*").alias("addresses"), *sums, other)
    return out.withColumn("bad", F.col("risky") + F.col("undeliverable"))
