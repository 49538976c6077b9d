"""Linking host operations to the device kernels that they launch, and choosing representatives.

cpu and kernels have file, ext_id, name, ts, dur and pos; other columns are carried along.  Rows without ext_id link
with nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.text import normalize_stack, stack_text
from ..storage import saved
from .ordering import numbered

LINK = ["file", "ext_id"]


def common_ids(cpu: DataFrame, kernels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose id occurs on both sides."""
    return cpu.join(kernels.select(LINK).distinct(), LINK, "left_semi"), kernels.join(cpu.select(LINK).distinct(), LINK, "left_semi")


def filter_names(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    keep = patterns.chosen(F.col("name"), include, exclude)
    return df if keep is None else df.where(keep)


def filter_ids(cpu: DataFrame, kernels: DataFrame, include_op: Sequence[str] = (), exclude_op: Sequence[str] = (), include_kernel: Sequence[str] = (), exclude_kernel: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Keeps an id if its operations or its kernels pass, then filters the rows of those ids.

    An excluded operation rejects its id on the operations' side.
    """
    cpu_ids = _passing(cpu, include_op, exclude_op)
    kernel_ids = _passing(kernels, include_kernel, exclude_kernel)
    ids = cpu_ids.unionAll(kernel_ids).distinct()
    return (
        filter_names(cpu.join(ids, LINK, "left_semi"), include_op, exclude_op),
        filter_names(kernels.join(ids, LINK, "left_semi"), include_kernel, exclude_kernel),
    )


def _passing(df: DataFrame, include: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    wanted = patterns.any_of(F.col("name"), include) if include else F.lit(True)
    banned = patterns.any_of(F.col("name"), exclude) if exclude else F.lit(False)
    return df.groupBy(LINK).agg(F.bool_or(wanted).alias("_w"), F.bool_or(banned).alias("_b")).where("_w and not _b").select(LINK)


def representative_kernels(kernels: DataFrame) -> DataFrame:
    """One kernel per id: the longest (no dur counts as 0), the first by pos on ties.  Combined before the shuffle."""
    rest = [c for c in kernels.columns if c not in LINK]
    return best_kernels(kernels, rest).select(*LINK, *(F.col(f"k.{c}").alias(c) for c in rest))


def best_kernels(kernels: DataFrame, columns: Sequence[str], chosen: Column | None = None, by: Sequence[str] = LINK) -> DataFrame:
    """(by, k) of each id that has kernels: k holds columns of the representative of those that are chosen, null if none is."""
    row, order = F.struct(*columns), F.struct(F.coalesce("dur", F.lit(0.0)), -F.col("pos"))
    return kernels.groupBy(*by).agg((F.max_by(row, order) if chosen is None else F.max_by(F.when(chosen, row), F.when(chosen, order))).alias("k"))


def representative_operations(cpu: DataFrame, coarse: bool = False, strict: bool = False) -> DataFrame:
    """Within an id and a name, drops operations whose stack text begins the stack text of another one.

    Of equal texts the first by pos stays.  Where any operation of the group has a stack, those without drop out;
    strict raises if null stacks and others meet.  A text begins another one of its group if and only if it begins
    the next distinct text in binary order, so no pairs are formed.
    """
    group = [*LINK, "name"]
    text = stack_text(normalize_stack(F.col("call_stack"), coarse))
    facts = cpu.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_or(F.length(text) > 0).alias("_any"),
        F.bool_or(F.col("call_stack").isNull()).alias("_null"),
        F.bool_or(F.col("call_stack").isNotNull()).alias("_full"),
    )
    if strict:
        message = F.lit("operations of one id and name with and without call stack")
        facts = facts.where(F.when(F.col("_null") & F.col("_full"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    # an operation that is alone stays; the others are few as a rule, which Spark knows once they are stored
    several = saved(facts.where("_n > 1").select(*group, "_any"), "several")
    texts = cpu.join(several, group).withColumn("_s", text)
    one = texts.where("_s <> ''").groupBy(*group, "_s").agg(F.min("pos").alias("pos"))
    after = F.lead("_s").over(W.partitionBy(group).orderBy("_s"))
    kept = one.withColumn("_next", after).where("_next is null or not startswith(_next, _s)").select("file", F.col("pos").alias("_pos"))
    bare = texts.where("not _any").select("file", F.col("pos").alias("_pos"))
    chosen = saved(kept.unionAll(bare).select(F.col("file").alias("_file"), "_pos"), "chosen")
    among = cpu.join(several, group, "left_semi")
    return cpu.join(several, group, "left_anti").unionAll(among.join(chosen, (cpu["file"] == chosen["_file"]) & (cpu["pos"] == chosen["_pos"]), "left_semi"))


def with_op_index(cpu: DataFrame) -> DataFrame:
    """op_index: place of a row in its file by ts (then pos), from 0."""
    return numbered(cpu, ["file"], ["ts", "pos"], "op_index")


def linked(cpu: DataFrame, kernels: DataFrame, carry: Sequence[str], on: Sequence[str] = LINK) -> DataFrame:
    """Each operation with each kernel of its id: the columns carry of cpu, and k_name, k_ts, k_dur, k_stream.

    on: ["ext_id"] where ids are one's own over all files, so that kernels need no file.
    """
    left = cpu.select(*LINK, *(c for c in carry if c not in LINK))
    right = kernels.select(*on, F.col("name").alias("k_name"), F.col("ts").alias("k_ts"), F.col("dur").alias("k_dur"), F.col("stream_id").alias("k_stream"), F.col("pos").alias("k_pos"))
    return left.join(right, list(on))
