"""Overlap join: which intervals of one table meet which of another, for any number and length of either.

Time is cut into bins of each power of two.  An interval lives on the level of its own length, where it touches two bins
at most; it also asks in the bins that it touches on each coarser level that the other table has.  So each pair meets on the level
of its longer interval, in an equi-join of (keys, level, bin), and counts in the bin in which the overlap begins, once.  An interval
makes two rows a level at most, and there are no more levels than bits in a length.

A bin in which very many rows ask is dealt out over several tasks, and the rows that live there go to each of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved

#: Rows of the left table in a bin from which it is split.
HOT = 200_000


def _level(start: Column, end: Column) -> Column:
    """The smallest power of two that is more than the length: bins that long are touched twice at most."""
    return F.ceil(F.log2(F.greatest(end - start, F.lit(0)).cast("double") + 2)).cast("int")


def _binned(df: DataFrame, level: Column) -> DataFrame:
    """df once for each level and each bin on it that it touches."""
    at = df.withColumn("_at", F.explode(level))
    return at.withColumn("_bin", F.explode(F.expr("sequence(shiftright(_start, _at), shiftright(_end, _at))")))


def _met(short: DataFrame, long: DataFrame, keys: Sequence[str], hot: int, strictly: bool) -> DataFrame:
    """(keys, a, b): rows of short and of long that overlap, where long's level is the same or a coarser one (strictly: coarser)."""
    levels = sorted(r[0] for r in long.select("_level").distinct().collect())  # as many as bits at most
    coarser = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x > F.col("_level") if strictly else x >= F.col("_level"))
    asked, there = _binned(short, coarser), _binned(long, F.array("_level"))
    place = [*keys, "_at", "_bin"]
    counts = asked.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot)
    crowded = saved(counts.select(*(F.col(c).alias(f"_h{c}") for c in place), F.ceil(F.col("_n") / hot).cast("int").alias("_salts")), "crowded")
    equal = lambda other: reduce(lambda on, c: on & F.col(c).eqNullSafe(F.col(f"{other}{c}")), place, F.lit(True))

    def salted(df: DataFrame, salt: Column) -> DataFrame:
        return df.join(crowded, equal("_h"), "left").withColumn("_salt", salt).drop("_salts", *(f"_h{c}" for c in place))

    salts = F.coalesce("_salts", F.lit(1))
    left = salted(asked, F.pmod(F.xxhash64("_row"), salts).cast("int"))
    right = salted(there, F.explode(F.sequence(F.lit(0), salts - 1)))
    right = right.select(*(F.col(c).alias(f"_r{c}") for c in (*place, "_salt", "_start", "_end", "_row")))
    meets = (F.col("_start") <= F.col("_r_end")) & (F.col("_end") >= F.col("_r_start")) & F.expr("shiftright(greatest(_start, _r_start), _at) = _bin")
    return left.join(right, equal("_r") & (F.col("_salt") == F.col("_r_salt")) & meets).select(*keys, F.col("_row").alias("a"), F.col("_r_row").alias("b"))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], left_columns: Sequence[str], right_columns: Sequence[str], hot: int = HOT) -> DataFrame:
    """The pairs of rows with equal keys (null ones alike) whose intervals overlap: keys, left_columns and right_columns.

    left and right hold keys, and whole numbers start and end of a closed interval.  Rows without either, or that end before
    they start, meet nothing.  No column name may be on both sides.
    """

    def prepared(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
        start, end = F.col("start").cast("bigint"), F.col("end").cast("bigint")
        rows = df.where("start is not null and `end` is not null and start <= `end`")
        return saved(rows.select(*keys, start.alias("_start"), end.alias("_end"), _level(start, end).alias("_level"), F.struct(*columns).alias("_row")), name)

    a, b = prepared(left, left_columns, "left"), prepared(right, right_columns, "right")
    both = _met(a, b, keys, hot, False).select(*keys, "a", "b").unionAll(_met(b, a, keys, hot, True).select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    return both.select(*keys, "a.*", "b.*")
