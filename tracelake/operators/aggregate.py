"""Grouping operations and statistics of their kernels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tuple_text
from ..storage import saved
from .ordering import numbered

FIELDS = ("call_stack", "name", "shape", "dtype", "fwd_bwd_type", "pid", "tid", "op_index")


def checked_fields(fields: Sequence[str]) -> list[str]:
    """The grouping fields, or ValueError if they are none, unknown, repeated or mix op_index with others."""
    fields = list(fields)
    if not fields or not all(fields):
        raise ValueError("grouping fields are missing")
    if unknown := [f for f in fields if f not in FIELDS]:
        raise ValueError(f"unknown grouping field {unknown[0]}; known: {', '.join(FIELDS)}")
    if len(set(fields)) < len(fields):
        raise ValueError("grouping fields are repeated")
    if "op_index" in fields and len(fields) > 1:
        raise ValueError("op_index groups alone")
    return fields


def kernel_statistics(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and kernel: mean, min, max, sum and sample variance of dur (0 for one), count (rows without dur count).

    Kernels without any dur are left out.
    """
    return (
        links.groupBy(*keys, "k_name")
        .agg(
            F.avg("k_dur").alias("mean_dur"),
            F.min("k_dur").alias("min_dur"),
            F.max("k_dur").alias("max_dur"),
            F.coalesce(F.var_samp("k_dur"), F.lit(0.0)).alias("var_dur"),
            F.sum("k_dur").alias("sum_dur"),
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("k_ts", "k_pos")).alias("first_seen"),
        )
        .where("mean_dur is not null")
    )


def kernel_totals(statistics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: kernel_count, mean, min, max and total of its kernels, and their names in order of appearance.

    The total takes rows without dur as if they had their kernel's mean; kernel_sum_duration leaves them out.
    """
    named = F.transform(F.array_sort(F.collect_list(F.struct("first_seen", "k_name", "n"))), lambda s: F.struct(s["k_name"].alias("name"), s["n"].alias("n")))
    return (
        statistics.groupBy(*keys)
        .agg(
            F.sum("n").alias("kernel_count"),
            F.sum(F.col("mean_dur") * F.col("n")).alias("kernel_total_duration"),
            F.sum("sum_dur").alias("kernel_sum_duration"),
            F.min("min_dur").alias("kernel_min_duration"),
            F.max("max_dur").alias("kernel_max_duration"),
            named.alias("kernels"),
        )
        .withColumn("kernel_mean_duration", F.col("kernel_total_duration") / F.col("kernel_count"))
    )


def with_share(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """kernel_duration_ratio: percent of the grand total (per label with by); 0 where that is 0."""
    totals = saved(totals, "totals")  # few rows, each from many; they are read twice
    if by:
        out = totals.join(totals.groupBy(*by).agg(F.sum("kernel_total_duration").alias("_grand")), list(by))
    else:
        out = totals.withColumn("_grand", totals.agg(F.sum("kernel_total_duration")).scalar())
    share = F.coalesce(F.try_divide(F.col("kernel_total_duration"), F.col("_grand")) * 100, F.lit(0.0))
    return out.withColumn("kernel_duration_ratio", share).drop("_grand")


def kernel_span(links: DataFrame, keys: Sequence[str], starts: bool = False) -> DataFrame:
    """First start, last end and number of the kernels of each key, combined before the shuffle.

    starts also lists all starts, sorted: for reports alone, whose cells show them; `kernel_starts` gives them as rows.
    """
    listed = [F.sort_array(F.collect_list("k_ts")).alias("kernel_timestamps")] if starts else []
    return links.groupBy(*keys).agg(
        F.min("k_ts").alias("kernel_timestamp_start"),
        F.max(F.col("k_ts") + F.coalesce("k_dur", F.lit(0.0))).alias("kernel_timestamp_end"),
        F.count("k_ts").alias("kernel_starts"),
        *listed,
    )


def kernel_starts(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, place, k_ts): the starts of each key's kernels in order, from 0."""
    return numbered(links.select(*keys, "k_ts", "k_pos"), keys, ["k_ts", "k_pos"], "place").select(*keys, "place", "k_ts")


def streams(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    return links.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("k_stream")), ",").alias("stream"))


def first_rows(cpu: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Of each key the columns of its first row by (file, ts, pos)."""
    first = F.min_by(F.struct(*columns), F.struct("file", "ts", "pos"))
    return cpu.groupBy(*keys).agg(first.alias("first"))


def merged_stacks(keys: DataFrame, others: Sequence[str], stack: str = "call_stack") -> DataFrame:
    """Maps each distinct (others, stack) to the stack that it merges into, as merged_stack.

    A stack that begins another one (frame by frame, others equal) merges into the first, by its text, of those
    that begin no other.  Stacks send their prefixes, so the work is linear in their total length.  Rows without
    stack are left out.
    """
    distinct = saved(keys.where(F.col(stack).isNotNull()).select(*others, stack).distinct(), "stacks")
    heads = F.transform(F.sequence(F.lit(0), F.size(stack) - 1), lambda n: F.slice(F.col(stack), 1, n))
    extended = distinct.where(F.size(stack) > 0).select(*others, F.explode(heads).alias("_head")).distinct()
    on_head = F.col("l._s").eqNullSafe(F.col("r._head"))
    for o in others:
        on_head = on_head & F.col(f"l.{o}").eqNullSafe(F.col(f"r.{o}"))
    left = distinct.withColumn("_s", F.col(stack)).alias("l")
    longest = left.join(extended.alias("r"), on_head, "left_anti").select(*(F.col(f"l.{o}") for o in others), F.col(f"l.{stack}").alias(stack))
    heads_of = longest.where(F.size(stack) > 0).select(*others, F.col(stack).alias("_full"), F.explode(heads).alias("_head"))
    target = heads_of.groupBy(*others, "_head").agg(F.min_by("_full", tuple_text(F.col("_full"))).alias("_full")).alias("r")
    out = left.join(target, on_head, "left")
    return out.select(*(F.col(f"l.{o}").alias(o) for o in others), F.col(f"l.{stack}").alias(stack), F.coalesce("_full", "_s").alias("merged_stack"))


def with_merged_stacks(rows: DataFrame, others: Sequence[str]) -> DataFrame:
    """rows with their stacks replaced by those that they merge into."""
    target = merged_stacks(rows, others).select(*(F.col(o).alias(f"_t_{o}") for o in others), F.col("call_stack").alias("_t_stack"), "merged_stack")
    on = F.col("call_stack") == F.col("_t_stack")
    for o in others:
        on = on & F.col(o).eqNullSafe(F.col(f"_t_{o}"))
    return rows.join(target, on).withColumn("call_stack", F.col("merged_stack")).drop("merged_stack", "_t_stack", *(f"_t_{o}" for o in others))
