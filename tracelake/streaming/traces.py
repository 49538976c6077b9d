"""Trace folders as streams: new files are read as they come, running kernel statistics and idle-gap sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.traces import parsed_events

_FILE = "baseTimeNanoseconds bigint, traceEvents array<variant>"
_EVENT = ("name", "cat", "ph", "pid", "tid", "ts", "dur", "args", "id", "stream")


def stream_traces(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Events of the trace files of a folder, each file once."""
    raw = spark.readStream.schema(_FILE).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("baseTimeNanoseconds").alias("base_ns"), F.posexplode("traceEvents").alias("pos", "e"))
    return parsed_events(rows.select("file", "base_ns", F.col("pos").cast("bigint").alias("pos"), *(F.try_variant_get("e", f"$.{c}", "variant").alias(c) for c in _EVENT)))


def running_kernel_time(events: DataFrame) -> DataFrame:
    """Count and total dur per kernel so far (update or complete mode)."""
    return events.where("cat = 'kernel'").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("dur").alias("total_dur"))


def busy_sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of rows of a key that are less than gap apart, with their count; rows later than late are dropped."""
    window = F.session_window(time, gap)
    out = events.withWatermark(time, late).groupBy(key, window).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
