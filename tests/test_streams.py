"""Streams in several cuts against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import correlate, flow, nesting
from tracelake.streaming import calls

CALLS = "file string, pid int, tid int, pos long, name string, ts double, dur double"
END = 9e9


@pytest.fixture
def states(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    calls.state_store(spark)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def stream(spark, folder, rows, schema, cuts):
    """The rows as a stream of as many batches as cuts gives, with times as `at`."""
    bounds = [0, *cuts, len(rows)]
    for a, b in zip(bounds, bounds[1:]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("at", F.timestamp_micros(F.col("ts").cast("long")))


def run(df, folder):
    """The rows that come until the source is empty; the state stays in folder."""
    out = []
    q = df.writeStream.foreachBatch(lambda batch, _: out.extend(batch.collect())).outputMode("append").option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None
    return out


@pytest.mark.parametrize("cuts", [(30, 60, 90), (75,)])
def test_nesting(spark, states, tmp_path, cuts):
    """Rows out of order by up to three seconds, in several cuts; what comes behind the watermark is dropped."""
    rng = random.Random(1)
    rows = [("f", 0, t % 2, t, f"n{t}", 1e6 + t * 1e5 + rng.randrange(3_000_000), float(rng.randrange(50_000, 2_000_000))) for t in range(120)]
    rows += [("f", 0, 1, 500, "same", 2e6, 1e6), ("f", 0, 1, 501, "same", 2e6, 1e6), ("f", None, 1, 502, "no thread", 2e6, 1e6), ("f", 0, 1, 503, "no length", 2e6, 0.0)]
    rows.sort(key=lambda r: r[3] if r[3] < 500 else 10 + r[3] / 1000)
    far = [("f", 0, 7, 900, "far", END, 1.0), ("f", 0, 7, 901, "too late", 5.0, 1.0)]
    source = stream(spark, tmp_path / "in", [*rows, far[0]], CALLS, cuts)
    got = {r.pos: (r.parent_pos, r.depth) for r in run(calls.stream_nesting(source, "at", "4 seconds"), tmp_path / "cp")}
    want = {r.pos: (r.parent_pos, r.depth) for r in nesting.nest(spark.createDataFrame(rows, CALLS), paths=False).collect()}
    assert got == want and len(want) == 122
    # the stream goes on from its state: a row behind the watermark gives nothing, a new one does
    spark.createDataFrame([far[1], ("f", 0, 7, 902, "further", 2 * END, 1.0)], CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert [r.pos for r in run(calls.stream_nesting(source, "at", "4 seconds"), tmp_path / "cp")] == [900]


def test_flow_pairs(spark, states, tmp_path):
    """Pairs as in a batch; one-sided flows are told when their time is over, and rows after that begin anew."""
    schema = "file string, flow_id string, ph string, pos long, ts double"
    rng = random.Random(2)
    rows = [("f", f"x{i % 20}", "sf"[(i // 20) % 2], i, 1e6 * (1 + i // 10)) for i in range(80)]
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[4] // 3e6)
    rows += [("f", "start", "s", 200, 9e6), ("f", "finish", "f", 201, 9e6), ("f", None, "s", 202, 9e6), ("f", "other", "t", 203, 9e6), ("f", "end", "s", 999, END)]
    source = stream(spark, tmp_path / "in", rows, schema, (25, 50))
    got = sorted((r.flow_id, r.fwd_ts, r.bwd_ts, r.flow_pos) for r in run(calls.stream_flow_pairs(source, "at", "10 seconds"), tmp_path / "cp"))
    batch = flow.flow_pairs(spark.createDataFrame(rows, schema))
    want = [(r.flow_id, r.fwd_ts, r.bwd_ts, r.flow_pos) for r in batch.collect()]
    assert got == sorted([*want, ("start", 9e6, None, 200), ("finish", None, 9e6, 201)]) and len(want) == 20


@pytest.mark.parametrize("cuts", [(40, 80), (1,)])
def test_links(spark, tmp_path, cuts):
    schema = "file string, ext_id long, name string, pos long, ts double, dur double, stream_id long"
    rng = random.Random(3)
    cpu = [("f", None if i % 11 == 0 else i % 50, f"op{i % 5}", i, 1e6 * i + 1, 1.0, None) for i in range(120)]
    kernels = [("f", None if i % 13 == 0 else i % 50, f"k{i % 3}", 1000 + i, 1e6 * i + rng.randrange(500_000), float(i), 7) for i in range(120) if i % 50 != 7]
    sides = [stream(spark, tmp_path / n, [*rows, ("f", -1 - j, "end", 9000 + j, END, 1.0, None)], schema, cuts) for j, (n, rows) in enumerate((("c", cpu), ("k", kernels)))]
    got = run(calls.stream_links(*sides, "at", "5 seconds", "300 seconds"), tmp_path / "cp")
    tables = [spark.createDataFrame(rows, schema) for rows in (cpu, kernels)]
    linked = correlate.linked(*tables, ["name", "pos"]).select("file", "ext_id", "name", "pos", "k_name", "k_dur", "k_pos").collect()
    alone = {r[3] for r in cpu if r[1] is not None} - {r.pos for r in linked}
    assert sorted(tuple(r) for r in got if r.k_pos is not None) == sorted(tuple(r) for r in linked)
    assert {r.pos for r in got if r.k_pos is None} == alone and alone
    assert set(correlate.common_ids(*tables)[0].select("pos").toPandas().pos) == {r.pos for r in got if r.k_pos is not None}
