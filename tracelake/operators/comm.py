"""Collectives across ranks: the first of each file, fastest and slowest rank, and comparing two ranks' sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.time import apart, end_text, readable
from .ordering import numbered, previous_max

#: Collectives kept of a file, and the distance in microseconds from which ranks count as apart.
FIRST = 6
APART_US = 5000.0
META = ("name", "in_msg_nelems", "out_msg_nelems", "group_size", "dtype", "process_group_ranks")


def first_collectives(events: DataFrame, prefix: str, n: int = FIRST) -> DataFrame:
    """The first n rows of each file, by pos, whose name begins with prefix and whose phase is X; comm_idx from 0.

    Spark keeps n rows of a file in each task before the shuffle.
    """
    matching = events.where(F.col("name").startswith(prefix) & (F.col("ph") == "X"))
    ranked = matching.withColumn("_rn", F.row_number().over(W.partitionBy("file").orderBy("pos"))).where(F.col("_rn") <= n)
    return ranked.withColumn("comm_idx", (F.col("_rn") - 1).cast("int")).drop("_rn")


def last_file_wins(collectives: DataFrame) -> DataFrame:
    """Of several files of one (step, card) only the last by path."""
    last = collectives.groupBy("step", "card").agg(F.max("file").alias("file"))
    return collectives.join(last, ["step", "card", "file"], "left_semi")


def fastest_and_slowest(collectives: DataFrame) -> DataFrame:
    """Per step and comm_idx: the fastest and slowest card (the first on ties), their ratio and the number of cards.

    The describing columns are those of the first card; the ratio is infinite if the fastest took no time.
    """
    meta = [c for c in META if c in collectives.columns]
    order = F.struct("file", "card")
    dur = F.coalesce("dur", F.lit(0.0))
    entry = F.struct(F.col("card"), dur.alias("dur"))
    out = collectives.groupBy("step", "comm_idx").agg(
        F.min_by(F.struct(*meta), order).alias("m"),
        F.min_by(entry, F.struct(dur, F.struct("file", "card"))).alias("f"),
        F.max(dur).alias("slowest_duration_us"),
        F.count(F.lit(1)).alias("total_cards"),
        F.min(F.struct((-dur).alias("d"), F.col("file"), F.col("card"))).alias("s"),
    )
    fast, slow = F.col("f.dur"), F.col("slowest_duration_us")
    return out.select(
        "step", "comm_idx", *(F.col(f"m.{c}").alias(c) for c in meta),
        F.col("f.card").alias("fastest_card"), fast.alias("fastest_duration_us"),
        F.col("s.card").alias("slowest_card"), slow,
        F.when(fast > 0, slow / fast).otherwise(F.lit(float("inf"))).alias("duration_ratio"), "total_cards",
    )


def collective_kernels(events: DataFrame, prefix: str) -> DataFrame:
    """Kernels whose name begins with prefix, numbered per file by ts as comm_idx."""
    return numbered(events.where((F.col("cat") == "kernel") & F.col("name").startswith(prefix)), ["file"], ["ts", "pos"], "comm_idx")


def nth_collective(events: DataFrame, prefix: str, n: int) -> DataFrame:
    """The n-th (from 0) collective kernel of each file that has so many."""
    return collective_kernels(events, prefix).where(F.col("comm_idx") == n)


def in_range(events: DataFrame, start: Column, end: Column, ids: DataFrame | None = None) -> DataFrame:
    """Rows that overlap the closed range, of the given ids (file, ext_id) alone if there are any."""
    out = events.where((F.col("ts") <= end) & (F.col("ts") + F.coalesce("dur", F.lit(0.0)) >= start))
    return out if ids is None else out.join(ids.select("file", "ext_id").distinct(), ["file", "ext_id"], "left_semi")


def previous_kernel(targets: DataFrame, kernels: DataFrame, pattern: str) -> DataFrame:
    """As-of join: to each target (file, pos, ts) the kernel matching pattern from its name's start on that begins
    earlier and ends last, as prev_pos, prev_name and prev_end; null if there is none.

    Targets and kernels are merged in order of ts and a running maximum carries the kernel, so that neither a range
    join nor a window over a whole file is needed.
    """
    ends = (F.col("ts") + F.coalesce("dur", F.lit(0.0))).alias("end")
    candidate = F.struct(ends, F.col("pos"), F.col("name"))
    rows = kernels.where(F.col("name").rlike(f"^(?:{pattern})")).select("file", "ts", "pos", candidate.alias("cand"), F.lit(False).alias("is_target"))
    wanted = targets.select("file", "ts", "pos", F.lit(None).cast(rows.schema["cand"].dataType).alias("cand"), F.lit(True).alias("is_target"))
    found = previous_max(rows.unionAll(wanted), ["file"], ["ts", "is_target", "pos"], F.col("cand"), "prev", strictly=True).where("is_target")
    return found.select("file", "pos", "ts", F.col("prev.pos").alias("prev_pos"), F.col("prev.name").alias("prev_name"), F.col("prev.end").alias("prev_end"))


def analysis_window(found: DataFrame, events: DataFrame) -> DataFrame:
    """Adds window_start (end of the previous collective, or the first ts of the file) and window_end (the target's ts)."""
    first = events.groupBy("file").agg(F.min("ts").alias("_first"))
    return found.join(first, "file", "left").withColumn("window_start", F.coalesce("prev_end", "_first")).withColumn("window_end", F.col("ts")).drop("_first")


def zipped(a: DataFrame, b: DataFrame, limit: float = APART_US) -> DataFrame:
    """The i-th collectives (comm_idx) of two ranks side by side, up to the shorter sequence, and how far apart they are."""
    side = lambda df, s: df.select("comm_idx", *(F.col(c).alias(f"{c}_{s}") for c in ("name", "ts", "dur")))
    starts, ends, far = apart(F.col("ts_a"), F.col("dur_a"), F.col("ts_b"), F.col("dur_b"), limit)
    return side(a, "a").join(side(b, "b"), "comm_idx").select("*", starts.alias("start_diff"), ends.alias("end_diff"), far.alias("apart"), (F.col("name_a") == F.col("name_b")).alias("same_name"))


def pair_report(a: DataFrame, b: DataFrame, limit: float = APART_US) -> DataFrame:
    """The i-th collectives of two ranks side by side as a report: names, times, distances, message and group sizes.

    Ranks have their own base times, so distances are those of absolute times where both files have one.
    """

    def side(df: DataFrame, s: str) -> DataFrame:
        at = F.coalesce(F.col("base_ns") / 1000, F.lit(0.0)) + F.col("ts")
        start = readable(F.col("base_ns"), F.col("ts"))
        return df.select(
            "comm_idx", F.col("name").alias(f"{s}_name"), F.coalesce(start, F.format_string("%.2f", "ts")).alias(f"{s}_start"),
            F.coalesce(end_text(start, F.col("dur")), F.format_string("%.2f", F.col("ts") + F.col("dur"))).alias(f"{s}_end"), at.alias(f"_at_{s}"), F.col("dur").alias(f"_dur_{s}"),
            *(F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(f"{s}_{c}") for c in ("in_msg_nelems", "group_size")),
        )

    starts, ends, far = apart(F.col("_at_fast"), F.col("_dur_fast"), F.col("_at_slow"), F.col("_dur_slow"), limit)
    both = side(a, "fast").join(side(b, "slow"), "comm_idx")
    equal = lambda c: (F.col(f"fast_{c}") == F.col(f"slow_{c}")).alias(f"same_{c}")
    return both.select(
        (F.col("comm_idx") + 1).alias("number"), "fast_name", "fast_start", "fast_end", "slow_name", "slow_start", "slow_end", equal("name"),
        F.round(starts, 2).alias("start_diff_us"), F.round(ends, 2).alias("end_diff_us"), far.alias("apart"),
        "fast_in_msg_nelems", "slow_in_msg_nelems", equal("in_msg_nelems"), "fast_group_size", "slow_group_size", equal("group_size"),
    )


def same_sequence(a: DataFrame, b: DataFrame, by: str = "end") -> DataFrame:
    """Whether two sequences have equal names in order (by end, then pos): one row, equal and both lengths."""

    def order(df: DataFrame, side: str) -> DataFrame:
        ended = df.withColumn("end", F.col("ts") + F.coalesce("dur", F.lit(0.0)))
        return numbered(ended, [], [by, "pos"], "rn").select("rn", F.col("name").alias(f"name_{side}"))

    both = order(a, "a").join(order(b, "b"), "rn", "full_outer")
    return both.agg(
        F.coalesce(F.bool_and(F.col("name_a").eqNullSafe(F.col("name_b"))), F.lit(True)).alias("equal"),
        F.count("name_a").alias("n_a"), F.count("name_b").alias("n_b"),
    )


def consistent(a: DataFrame, b: DataFrame, n: int, limit: float = APART_US) -> DataFrame:
    """One row: consistent is whether both ranks have an n-th collective and no pair is further apart than limit."""
    pairs = zipped(a, b, limit).agg(F.coalesce(F.bool_and(~F.col("apart")), F.lit(True)).alias("near"), F.coalesce(F.bool_and("same_name"), F.lit(True)).alias("same_names"), F.max("comm_idx").alias("last"))
    return pairs.select((F.col("near") & (F.coalesce("last", F.lit(-1)) >= n)).alias("consistent"), "same_names")
