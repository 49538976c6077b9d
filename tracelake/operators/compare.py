"""Comparing labelled sets of traces side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import change_text


def side_by_side(rows: DataFrame, keys: Sequence[str], labels: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key (null keys too) with <label>_<column> for each label, and has_<label>: a full outer join by key.

    rows has one row per key and label.  Columns of absent labels are null.
    """
    aggregates: list[Column] = []
    for label in labels:
        here = F.col("label") == label
        aggregates += [F.first(F.when(here, F.col(c)), ignorenulls=True).alias(f"{label}_{c}") for c in columns]
        aggregates.append(F.coalesce(F.bool_or(here), F.lit(False)).alias(f"has_{label}"))
    return rows.groupBy(*keys).agg(*aggregates)


def value_sets(cpu: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key and label: the sorted distinct values of each column, as set_<column>."""
    return cpu.groupBy(*keys, "label").agg(*(F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(f"set_{c}") for c in columns))


def set_equality(sets: DataFrame, keys: Sequence[str], labels: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """<column>_equal of the first two labels; the set of an absent label is empty."""
    wide = side_by_side(sets, keys, labels[:2], [f"set_{c}" for c in columns])
    none = F.array().cast("array<string>")

    def of(label: str, column: str) -> Column:
        return F.coalesce(F.col(f"{label}_set_{column}"), none)

    return wide.select(*keys, *(f"has_{x}" for x in labels[:2]), *((of(labels[0], c) == of(labels[1], c)).alias(f"{c}_equal") for c in columns))


def mean_ratio(wide: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Ratio of the second label's mean to the first one's and its text, where both are positive."""
    a, b = labels[:2]
    first, second = F.col(f"{a}_kernel_mean_duration"), F.col(f"{b}_kernel_mean_duration")
    ratio = F.when((first > 0) & (second > 0), second / first)
    name = f"{b}_vs_{a}"
    return wide.withColumn(f"{name}_mean_duration_ratio", ratio).withColumn(f"{name}_performance_improvement", F.when(ratio.isNotNull(), change_text(ratio)))
