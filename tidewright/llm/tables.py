"""Tables written between jobs, in the folder that the cluster names for checkpoints, and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder if Spark runs on this machine alone; on a cluster, whose machines
    share no such folder, a ValueError.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session hold ``BATCH`` bytes at most (or one row), not 64 MB and 10,000 rows, however long texts are."""
    if int(spark.conf.get(_BATCH_BYTES, "67108864b").rstrip("b")) > BATCH:
        spark.conf.set(_BATCH_BYTES, str(BATCH))


def written(df: DataFrame, name: str, cleanup: bool = True) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and no lost executor can undo it.

    With the table written, the shuffles that led to it have no further use and are removed with the job.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, str(cleanup).lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later job reads."""
    for df in tables:
        spark, path = df.sparkSession, df.written_to
        jvm = spark.sparkContext._jvm
        jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm.org.apache.hadoop.fs.Path(path), True)


#: Parts into which every key of a salted join falls.
_SALTS = 16


def salted_join(rows: DataFrame, table: DataFrame, key: str, salt: str) -> DataFrame:
    """rows with the columns of table, which has each key (null too) once; rows of one key are dealt over ``_SALTS`` tasks by the column salt.

    table is repeated as often; if it turns out to be small at run time, Spark broadcasts it instead.
    """
    part = F.pmod(F.xxhash64(salt), F.lit(_SALTS)).cast("int")
    parts = table.withColumnRenamed(key, "__key").withColumn("__part", F.explode(F.array(*map(F.lit, range(_SALTS)))))
    dealt = rows.withColumn("__salt", part)
    return dealt.join(parts, dealt[key].eqNullSafe(parts["__key"]) & (dealt["__salt"] == parts["__part"])).drop("__key", "__part", "__salt")


def ranked(df: DataFrame, order: list[Column], by: str | None = None, partitions: int | None = None) -> DataFrame:
    """df, stored, with rank: each row's place from 0 in the given order, over all or within each value of ``by`` (which then leads the order).

    Rows are dealt over tasks by ranges of the order; places within a range are counted there, and the ranges' sizes added up: no task sees all rows, nor all of one value.
    """
    keys = [] if by is None else [by]
    sent = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    # Without a shuffle to write it back, the stored range is the one that the rows were dealt to.
    held = written(sent.withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = written(held.groupBy("__range", *keys).agg(F.count("*").alias("__n")), "range-sizes")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", *keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = held.withColumn("__at", F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*order)))
    same = within["__range"] == starts["__range"]
    for k in keys:
        same = same & within[k].eqNullSafe(starts[k])
    return within.join(starts, same).select(*[within[c] for c in df.columns], (F.col("__start") + F.col("__at") - 1).alias("rank"))
