"""Kernel statistics that grow with the files that arrive, without reading earlier files again.

Of each file, key and kernel a state is kept: counts, sum, mean, sum of squared deviations, bounds and the first kernel's place.
States of all files merge into the statistics of a full run, in any order (the deviations by the formula of Chan, Golub and
LeVeque).  They are stored in a fixed number of buckets of files, so that an update rewrites the buckets of its
files alone; a file that arrives again replaces its states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import saved

BUCKETS = 64


def file_states(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The states of links (see `correlate.linked`) of one or more files; rows without k_dur count in n alone."""
    dur = F.col("k_dur").cast("double")
    return links.groupBy("file", *keys, "k_name").agg(
        F.count(F.lit(1)).alias("n"), F.count(dur).alias("n_dur"), F.avg(dur).alias("mean"), (F.var_pop(dur) * F.count(dur)).alias("m2"),
        F.min(dur).alias("low"), F.max(dur).alias("high"), F.sum(dur).alias("total"), F.min(F.struct("k_ts", "k_pos")).alias("first_seen"),
    )


def merged(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`aggregate.kernel_statistics` of all files that the states are of."""
    group = [*keys, "k_name"]
    named = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    means = saved(states.groupBy(*group).agg((F.sum(F.col("mean") * F.col("n_dur")) / F.sum("n_dur")).alias("_grand")).select(*named, "_grand"), "means")
    on: Column = F.lit(True)
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    count = F.sum("n_dur")
    spread = F.sum(F.col("m2") + F.col("n_dur") * F.pow(F.col("mean") - F.col("_grand"), F.lit(2)))
    return (
        states.join(means, on).groupBy(*group)
        .agg(
            F.first("_grand").alias("mean_dur"), F.min("low").alias("min_dur"), F.max("high").alias("max_dur"), F.when(count > 1, spread / (count - 1)).otherwise(0.0).alias("var_dur"),
            F.sum("total").alias("sum_dur"), F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"),
        )
        .where("mean_dur is not null")
    )


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The states below path, or None before the first update."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def update(spark: SparkSession, path: str, links: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Puts the states of links' files among those below path, and returns the statistics of all files so far."""
    bucket = F.pmod(F.xxhash64("file"), F.lit(buckets)).cast("int").alias("bucket")
    new = saved(file_states(links, keys).select("*", bucket), "states")
    old = stored(spark, path)
    if old is not None:
        files = new.select("file", "bucket").distinct()
        others = old.join(files.select("bucket").distinct(), "bucket", "left_semi").join(files.select("file"), "file", "left_anti")
        new = saved(new.unionByName(others.select(new.columns)), "states")  # what is read mustn't be what is written
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return merged(spark.read.parquet(path).drop("bucket"), keys)
