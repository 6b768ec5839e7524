"""Which of the first rows of each file is its header: all files of a folder at once.

Rows are scored by what share of their cells are names of the standard format (a name within a longer text counts half, halves are rounded down in sum), less half
the share of cells that look like what stands above a header, less a twentieth for each row above. The best row of a file is its header; of equals the first.

Scale: of each file only the lines of its first block are looked at, and of these only the first few leave their task. Scores are expressions; one row a file comes out.

Cases: rows with fewer than ``LEAST`` cells that aren't blank score 0. Lines are rows here, quoted line breaks aside. Empty files have no row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import headers as H
from tidewright.functions import text as T
from tidewright.sources.records import with_fields

#: Rows that are looked at, cells that a header has at least, and the least score of a header that isn't the first row.
SCANNED, LEAST, SURE = 5, 5, 0.70


def header_score(fields: Column, row: Column) -> tuple[Column, Column, Column]:
    """Score, cells with names of the standard format, and cells that aren't blank, of a row's fields at a place from 0."""
    names = sorted({n.lower() for name, aliases in H.STANDARD.items() for n in [name, *aliases]})
    anywhere, above = "|".join(map(re.escape, names)), "|".join(re.escape(w.lower()) for w in H.ABOVE_HEADERS)
    cells = F.filter(F.transform(fields, lambda f: F.lower(T.stripped(f))), lambda f: f != "")
    n = F.size(cells)
    points = F.aggregate(cells, F.lit(0), lambda a, c: a + F.when(c.isin(names), 2).when(c.rlike(anywhere), 1).otherwise(0))
    known = F.floor(points / 2).cast("int")
    upper = F.size(F.filter(cells, lambda c: c.rlike(above)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), known / n - 0.5 * upper / n - 0.05 * row))
    enough = n >= LEAST
    return F.when(enough, score).otherwise(0.0), F.when(enough, known).otherwise(0), n


def header_rows(spark: SparkSession, paths: str | list[str], separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Of each file: file, row (from 0), score, known, cells, header (its fields), and skip: whether rows above it are surely no data."""
    raw = spark.read.option("encoding", encoding).text(paths)
    first = raw.filter("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", "^﻿", "").alias("text"))
    at = F.row_number().over(Window.partitionBy("file").orderBy("seq")) - 1
    top = with_fields(first.withColumn("row", at).filter(F.col("row") < SCANNED), separator)
    score, known, cells = header_score(F.col("fields"), F.col("row"))
    scored = top.select("file", "row", score.alias("score"), known.alias("known"), cells.alias("cells"), F.col("fields").alias("header"))
    best = scored.groupBy("file").agg(F.max(F.struct("score", (-F.col("row")).alias("back"), "row", "known", "cells", "header")).alias("b"))
    return best.select("file", "b.row", "b.score", "b.known", "b.cells", "b.header", ((F.col("b.row") > 0) & (F.col("b.score") >= SURE)).alias("skip"))
