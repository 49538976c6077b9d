"""Grouping runs whose time ranges overlap (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import folder_time
from .ordering import previous_max_then_sum


def islands(ranges: DataFrame, rows_per_chunk: int | None = None) -> DataFrame:
    """ranges (path, start, end): adds island, numbered from 1 by time.  Ranges that only touch don't merge.

    Rows without start or end are left out; ties of start go by end and path.
    """
    rows = ranges.where("start is not null and `end` is not null")
    order = ["start", "end", "path"]
    new = F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), 1).otherwise(0)
    return previous_max_then_sum(rows, [], order, F.col("end"), new, "island", rows_per_chunk=rows_per_chunk)


def named_groups(grouped: DataFrame) -> DataFrame:
    """Per island: number of runs, time range (nanoseconds) and the name <first start>_group_<n>."""
    out = grouped.groupBy("island").agg(F.count(F.lit(1)).alias("runs"), F.min("start").alias("start"), F.max("end").alias("end"))
    return out.withColumn("group_name", F.concat(folder_time(F.col("start")), F.lit("_group_"), F.col("island").cast("string")))
