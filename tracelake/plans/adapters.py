"""Views of the driver's tables as trace events."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.runs import FOLDERS, uri_of
from ..storage import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; times without zone count in the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as host operations; a file is a year."""
    return table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").cast("string").alias("file"), F.year("o_orderdate").cast("string").alias("label"),
        F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("ext_id"), F.col("o_orderpriority").alias("name"), F.lit("cpu_op").alias("cat"),
        F.col("o_orderstatus").alias("dtype"), F.col("o_custkey").cast("string").alias("shape"),
        F.unix_micros("o_orderdate").cast("double").alias("ts"), F.lit(1.0).alias("dur"), (F.col("o_custkey") % 8).alias("pid"), F.col("o_custkey").alias("tid"),
    )


def kernels(spark: SparkSession, sf_dir: str, operations: DataFrame | None = None) -> DataFrame:
    """Line items as kernels; with operations each is in the file of its operation.  pos is an item's place in its file of the table."""
    out = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ext_id"), F.col("_metadata.row_index").alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("name"), F.lit("kernel").alias("cat"),
        F.unix_micros("l_shipdate").cast("double").alias("ts"), F.col("l_extendedprice").alias("dur"), F.col("l_suppkey").alias("stream_id"),
    )
    if operations is None:
        return out.withColumn("file", F.lit("all"))
    return out.join(operations.select("file", "ext_id"), "ext_id")


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals on the threads user_id; their names are frames."""
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("file"), F.lit(0).alias("pid"), F.col("user_id").alias("tid"), F.col("event_id").alias("pos"), F.col("event_type").alias("name"),
        F.lit("cpu_op").alias("cat"), F.unix_micros("ts").alias("ts"), (F.col("value") * 600_000_000).cast("bigint").alias("dur"), F.col("props").alias("args"),
    )


def collectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as collectives of cards (suppliers) in steps (months)."""
    item = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"]
    step, card = F.month("l_shipdate"), F.col("l_suppkey").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("_", card.cast("string"), step.cast("string")).alias("file"), step.alias("step"), card.alias("card"),
        F.struct(*item).alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("name"), F.lit("X").alias("ph"),
        F.unix_micros("l_shipdate").cast("double").alias("ts"), F.col("l_extendedprice").alias("dur"), F.col("l_quantity").cast("bigint").alias("in_msg_nelems"),
        "l_orderkey",
    )


def trace_files(spark: SparkSession, sf_dir: str, gzip: bool = False) -> str:
    """Orders and line items written as profiler traces, a file for each month of orders; returns their folder.

    A file is an object with a base time and one event a line.  Every seventh line item has no dur.
    """
    month, names = F.date_format("o_orderdate", "yyyy-MM").alias("month"), ["month", "at", "kind", "key", "line", "name", "customer", "stream", "dur", "dtype"]
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    no = lambda kind: F.lit(None).cast(kind)
    operations = orders.select(month, F.unix_micros("o_orderdate"), F.lit(0), "o_orderkey", F.lit(0), "o_orderpriority", "o_custkey", no("bigint"), no("double"), "o_orderstatus").toDF(*names)
    # both tables grow, so they are joined by shuffle at every size
    items = items.join(orders.select(month, F.col("o_orderkey").alias("l_orderkey")).hint("merge"), "l_orderkey")
    kernels = items.select("month", F.unix_micros("l_shipdate"), F.lit(1), "l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus"), no("bigint"), "l_suppkey", "l_extendedprice", no("string")).toDF(*names)
    low, high = -(1 << 62), 1 << 62
    frames = orders.select(month).distinct().select("month", F.explode(F.array(F.lit(low), F.lit(high))).alias("at"))
    frames = frames.select("month", "at", F.lit(2), no("bigint"), F.lit(0), no("string"), no("bigint"), no("bigint"), no("double"), no("string")).toDF(*names)
    # what is shuffled are the columns; lines are made of them behind it
    rows = operations.unionAll(kernels).unionAll(frames).repartition("month").sortWithinPartitions("month", "at", "kind", "key", "line")
    event = lambda *columns: F.concat(F.to_json(F.struct(*columns)), F.lit(","))
    external, custkey = F.col("key").alias("External id"), F.col("customer")
    operation = event(F.col("name"), F.lit("cpu_op").alias("cat"), F.lit("X").alias("ph"), (custkey % 8).alias("pid"), custkey.alias("tid"), F.col("at").alias("ts"), F.lit(1).alias("dur"),
                      F.struct(external, F.when(custkey % 3 > 0, F.col("dtype")).alias("Input type"), F.array(custkey % 5).alias("Input Dims")).alias("args"))
    kernel = event(F.col("name"), F.lit("kernel").alias("cat"), F.lit("X").alias("ph"), F.lit(0).alias("pid"), F.lit(1).alias("tid"), F.col("at").alias("ts"), F.when(F.col("line") < 7, F.col("dur")).alias("dur"),
                   F.struct(external, "stream").alias("args"))
    # an event without a name closes the list, so that each line before it ends in a comma
    frame = F.when(F.col("at") == low, F.lit('{"baseTimeNanoseconds": 0, "traceEvents": [')).otherwise(F.lit('{"ph": "M", "ts": 4e15}]}'))
    lines = rows.select("month", F.when(F.col("kind") == 0, operation).when(F.col("kind") == 1, kernel).otherwise(frame).alias("value"))
    folder = f"{scratch_dir(spark)}/traces-{uuid.uuid4().hex}"
    lines.write.partitionBy("month").option("compression", "gzip" if gzip else "none").text(folder)
    return folder


def run_folder(spark: SparkSession, sf_dir: str) -> str:
    """Line items as the collectives of a run of 48 files: card is the supplier modulo 4, step the month; returns the folder."""
    folder = uri_of(f"{scratch_dir(spark)}/run-{uuid.uuid4().hex}")
    item = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(f"{folder}/{FOLDERS}"), (F.col("l_suppkey") % 4).cast("string"), F.lit("_0/"), (F.col("l_suppkey") % 4).cast("string"), F.lit("_"), F.month("l_shipdate").cast("string"), F.lit(".json")).alias("file"), *item,
        F.to_json(F.struct(F.concat("l_returnflag", "l_linestatus").alias("name"), F.lit("kernel").alias("cat"), F.lit("X").alias("ph"), F.unix_micros("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("dur"),
                           F.struct(F.col("l_quantity").cast("bigint").alias("In msg nelems"), F.lit("bf16").alias("dtype"), F.col("l_orderkey").alias("order")).alias("args"))).alias("event"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, out = None, None
        for batch in batches:
            for file, event in zip(batch.column("file").to_pylist(), batch.column("event").to_pylist(), strict=True):
                if file != name:
                    if out:
                        out.write(b"]}")
                        out.close()
                    system, path = fs.FileSystem.from_uri(file)
                    system.create_dir(path.rsplit("/", 1)[0])
                    name, out = file, system.open_output_stream(path)
                    out.write(json.dumps({"baseTimeNanoseconds": 5})[:-1].encode() + b', "traceEvents": [')
                else:
                    out.write(b",\n")
                out.write(event.encode())
        if out:
            out.write(b"]}")
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([0 if name is None else 1])], ["n"])

    # a file is written by one task, row by row, and anew if the task is
    rows.repartition("file").sortWithinPartitions("file", *item).select("file", "event").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return folder
