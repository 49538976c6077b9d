"""Forward-backward flows: backward operations and all below them take the stack of their forward operation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved


def flow_pairs(flows: DataFrame) -> DataFrame:
    """flows (file, flow_id, ph, ts, pos): fwd_ts and bwd_ts of each flow that has both, the last written of each kind."""
    return (
        flows.where("ph in ('s', 'f') and flow_id is not null")
        .groupBy("file", "flow_id")
        .agg(
            F.max(F.when(F.col("ph") == "s", F.struct("pos", "ts")))["ts"].alias("fwd_ts"),
            F.max(F.when(F.col("ph") == "f", F.struct("pos", "ts")))["ts"].alias("bwd_ts"),
            F.max("pos").alias("flow_pos"),
        )
        .where("fwd_ts is not null and bwd_ts is not null")
    )


def paired_operations(nested: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file, pos, fwd_stack) of the backward operations; both times must equal the start of a cpu_op exactly.

    The last cpu_op of a start counts; of several flows into one operation the last written does.
    """
    times = pairs.select("file", F.explode(F.array("fwd_ts", "bwd_ts")).alias("ts")).distinct()
    at = nested.where("cat = 'cpu_op'").join(times, ["file", "ts"], "left_semi").groupBy("file", "ts").agg(F.max(F.struct("pos", "call_stack")).alias("op"))
    forward = at.select("file", F.col("ts").alias("fwd_ts"), F.col("op.call_stack").alias("fwd_stack")).where("size(fwd_stack) > 0")
    backward = at.select("file", F.col("ts").alias("bwd_ts"), F.col("op.pos").alias("pos"))
    found = pairs.join(forward, ["file", "fwd_ts"]).join(backward, ["file", "bwd_ts"])
    return found.groupBy("file", "pos").agg(F.max(F.struct("flow_pos", "fwd_stack"))["fwd_stack"].alias("fwd_stack"))


def propagate(nested: DataFrame, paired: DataFrame) -> DataFrame:
    """Stack and phase of paired operations and of their descendants; the outermost paired operation wins."""
    above = nested.select("file", "pos", F.posexplode("path").alias("level", "up")).select("file", F.col("pos").alias("row_pos"), "level", F.col("up.pos").alias("pos"))
    # stored, so that Spark knows how few they may be
    won = saved(above.join(paired, ["file", "pos"]).groupBy("file", "row_pos").agg(F.min(F.struct("level", "fwd_stack"))["fwd_stack"].alias("fwd_stack")), "below")
    out = nested.join(won.withColumnRenamed("row_pos", "pos"), ["file", "pos"], "left")
    hit = F.col("fwd_stack").isNotNull()
    return out.withColumn("call_stack", F.coalesce("fwd_stack", "call_stack")).withColumn("phase", F.when(hit, "bwd").otherwise(F.col("phase"))).drop("fwd_stack")
