"""Running numbers and running maxima over ordered groups of any size.

A window over a hot group would sort it in one task.  Here rows are range-partitioned by group and order and
stored; a partition's rows of a group are a chunk.  Windows run inside chunks, and what earlier chunks add comes from
one small row per chunk.  A group of any size is cut into as many chunks as its rows need, and since partitions are
ranges, only a partition's first group can have earlier chunks and only its last one later ones: the small
table has two rows a partition at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import saved


#: Bytes of the tables that are read (compressed) for one range.
RANGE_BYTES = 64 << 20


def bytes_read(df: DataFrame) -> int:
    """The size of the tables that df is made of, by Spark's statistics of the plan's leaves."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)  # larger: unknown


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of all keys, nulls included."""
    return reduce(lambda on, k: on & left[k].eqNullSafe(right[k]), keys, F.lit(True))


def chunked(df: DataFrame, keys: Sequence[str], order: str, rows_per_chunk: int | None = None) -> DataFrame:
    """df, stored in ranges of (keys, order), with the number of the range as _chunk.

    Rows of equal keys and order are in one range.  There are as many ranges as give about rows_per_chunk; else the session's
    number of shuffle partitions, or more, so that a range stays at about RANGE_BYTES of what is read, however large that is.
    """
    by = [*keys, order]
    if rows_per_chunk is not None:
        ranged = df.repartitionByRange(max(1, -(-df.count() // rows_per_chunk)), *by)
    else:
        n = bytes_read(df) // RANGE_BYTES
        ranged = df.repartitionByRange(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartitionByRange(*by)
    return saved(ranged.withColumn("_chunk", F.spark_partition_id()), "ranges")


def edges(parts: DataFrame, keys: Sequence[str], *columns: Column) -> DataFrame:
    """(keys, _chunk, aggregates): of each range its first and its last group."""
    if not keys:
        return parts.groupBy("_chunk").agg(*columns)
    group = F.struct(*keys)
    ends = saved(parts.groupBy("_chunk").agg(F.min(group).alias("_low"), F.max(group).alias("_high")), "ends")
    # one row a partition
    outer = parts.join(F.broadcast(ends), "_chunk").where(group.eqNullSafe(F.col("_low")) | group.eqNullSafe(F.col("_high")))
    return outer.groupBy(*keys, "_chunk").agg(*columns)


def _carried(parts: DataFrame, keys: Sequence[str], value: Column, over: str) -> DataFrame:
    """Of the chunks with earlier ones: the aggregate of value over all earlier chunks of the group, as _carry."""
    total = {"sum": F.sum, "max": F.max}[over]
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    return saved(edges(parts, keys, total(value).alias("_part")).select(*keys, "_chunk", total("_part").over(earlier).alias("_carry")).where("_carry is not null"), "carried")


def _joined(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    carry = carry.select(*(F.col(c).alias(f"_r_{c}") for c in (*keys, "_chunk")), "_carry")
    on = reduce(lambda on, k: on & F.col(k).eqNullSafe(F.col(f"_r_{k}")), keys, F.col("_chunk") == F.col("_r__chunk"))
    # two rows a partition at most
    return df.join(F.broadcast(carry), on, "left").drop(*(f"_r_{c}" for c in (*keys, "_chunk")))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], alias: str, first: int = 0, rows_per_chunk: int | None = None) -> DataFrame:
    """Numbers the rows of each group by order, from first on; order must be total for equal results on reruns."""
    parts = chunked(df, keys, order[0], rows_per_chunk)
    carry = _carried(parts, keys, F.lit(1), "sum")
    inside = F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(*order))
    return _joined(parts.withColumn("_inside", inside), carry, keys).withColumn(alias, (F.col("_inside") + F.coalesce("_carry", F.lit(0)) + (first - 1)).cast("bigint")).drop("_chunk", "_carry", "_inside")


def previous_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, alias: str, strictly: bool = False, rows_per_chunk: int | None = None) -> DataFrame:
    """The greatest value of the rows before each row (strictly: of smaller order[0]); null for the first."""
    return _previous_max(chunked(df.withColumn("_value", value), keys, order[0], rows_per_chunk), keys, order, alias, strictly).drop("_chunk")


def _previous_max(parts: DataFrame, keys: Sequence[str], order: Sequence[str], alias: str, strictly: bool = False) -> DataFrame:
    w = W.partitionBy(*keys, "_chunk").orderBy(*order)
    # strictly: rows of equal order are peers, and the frame ends before the first of them
    within = w.rowsBetween(W.unboundedPreceding, -1)
    if strictly:
        peers = W.partitionBy(*keys, "_chunk", order[0]).orderBy(*order[1:]).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        before = parts.withColumn("_running", F.max("_value").over(within)).withColumn("_before", F.first("_running").over(peers)).drop("_running")
    else:
        before = parts.withColumn("_before", F.max("_value").over(within))
    return _joined(before, _carried(parts, keys, F.col("_value"), "max"), keys).withColumn(alias, F.greatest("_before", "_carry")).drop("_carry", "_before", "_value")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, alias: str, rows_per_chunk: int | None = None) -> DataFrame:
    """The sum of value up to and with each row."""
    return _running_sum(chunked(df.withColumn("_value", value), keys, order[0], rows_per_chunk), keys, order, alias).drop("_chunk")


def _running_sum(parts: DataFrame, keys: Sequence[str], order: Sequence[str], alias: str) -> DataFrame:
    inside = F.sum("_value").over(W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return _joined(parts.withColumn("_inside", inside), _carried(parts, keys, F.col("_value"), "sum"), keys).withColumn(alias, F.col("_inside") + F.coalesce("_carry", F.lit(0))).drop("_carry", "_value", "_inside")


def previous_max_then_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, then: Column, alias: str, reach: str = "_reach", rows_per_chunk: int | None = None) -> DataFrame:
    """The running sum of `then`, which may use the greatest value before each row as column reach; cut into chunks once."""
    seen = _previous_max(chunked(df.withColumn("_value", value), keys, order[0], rows_per_chunk), keys, order, reach)
    return _running_sum(saved(seen.withColumn("_value", then).drop(reach), "seen"), keys, order, alias).drop("_chunk")
