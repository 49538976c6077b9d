"""Call nesting and flow pairing of events that come as a stream.

Both keep what is open in Spark's state store, per thread or per flow, and let timers of event time decide when a row's
answer is final.  Rows wait until the watermark has passed them and are then taken in order of time, so the results are those
of the batch operators however the rows are cut into batches and in whatever order they come.  Rows that come behind the
watermark are dropped (by Spark), and rows that it hasn't reached at the end of the stream have no result yet.

The session needs the RocksDB state store (`state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.nesting import THREAD

#: Rows that are put into the state at once.
AT_ONCE = 10_000
_OPEN = T.StructType([T.StructField("end", T.DoubleType()), T.StructField("pos", T.LongType()), T.StructField("depth", T.IntegerType())])
_BEST = T.StructType([T.StructField("ph", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("ts", T.DoubleType()), T.StructField("seen", T.LongType())])


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Nesting(StatefulProcessor):
    """State of a thread: the rows that wait for the watermark, and the rows that are still open, outermost first."""

    def __init__(self, row: T.StructType) -> None:
        self.row = row
        names = row.fieldNames()
        self.us, self.ts, self.dur, self.pos = (names.index(f) for f in ("_us", "ts", "dur", "pos"))
        self.out = Row(*(f for f in names if f != "_us"), "parent_pos", "depth")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.open = handle.getListState("open", _OPEN)
        self.timer = handle.getValueState("timer", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        first, own = None, None
        while some := list(islice(rows, AT_ONCE)):
            own = own or itemgetter(*(some[0].__fields__.index(f) for f in self.row.fieldNames()))
            some = [own(r) for r in some]
            self.waiting.appendList(some)  # each call is a turn to the state store and back
            least = min(r[self.us] for r in some)
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.timer.clear()
        passed, us, ts, dur, pos = timerValues.getCurrentWatermarkInMs() * 1000, self.us, self.ts, self.dur, self.pos
        rows = [tuple(r) for r in self.waiting.get()]
        done = sorted((r for r in rows if r[us] <= passed), key=lambda r: (r[ts], r[pos]))
        left = [r for r in rows if r[us] > passed]
        self.waiting.put(left) if left else self.waiting.clear()
        if left:
            self._wake(min(r[us] for r in left))
        stack = [tuple(x) for x in self.open.get()]
        for r in done:
            end = float(r[ts]) + float(r[dur])
            while stack and stack[-1][0] < end:
                stack.pop()
            up, depth = (stack[-1][1], stack[-1][2] + 1) if stack else (None, 0)
            if stack and stack[-1][0] == end:
                stack.pop()
            stack.append((end, r[pos], depth))
            yield self.out(*r[:us], *r[us + 1 :], up, depth)
        self.open.put(stack) if stack else self.open.clear()

    def _wake(self, us: int) -> None:
        """One timer, at the first waiting row."""
        at = -(-us // 1000)
        known = self.timer.get()
        if known is not None and known[0] <= at:
            return
        if known is not None:
            self.handle.deleteTimer(known[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


def stream_nesting(events: DataFrame, time: str, late: str = "10 seconds", keys: Sequence[str] = THREAD) -> DataFrame:
    """events of a stream with parent_pos and depth, as `nesting.nest` gives them.  time: a column of timestamps that orders rows as ts does."""
    valid = events.where("dur > 0")
    for k in keys:
        valid = valid.where(F.col(k).isNotNull())
    rows = valid.withWatermark(time, late).withColumn("_us", F.unix_micros(time))
    kept = T.StructType([f for f in rows.schema.fields if f.name != time])
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept.fields if f.name != "_us"), T.StructField("parent_pos", T.LongType()), T.StructField("depth", T.IntegerType())])
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in kept.fields])
    return rows.groupBy(*keys).transformWithState(Nesting(plain), out, "Append", "EventTime")


class Flows(StatefulProcessor):
    """State of a flow: the last written start and finish, and when the last row of it came."""

    def __init__(self, wait_ms: int) -> None:
        self.wait = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getListState("best", _BEST)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        best = {x[0]: tuple(x) for x in self.best.get()}
        before = max((x[3] for x in best.values()), default=None)
        for r in rows:
            seen = max(r["_us"] // 1000, *(x[3] for x in best.values())) if best else r["_us"] // 1000
            if r["ph"] not in best or best[r["ph"]][1] < r["pos"]:
                best[r["ph"]] = (r["ph"], r["pos"], float(r["ts"]), seen)
            best = {k: (*x[:3], seen) for k, x in best.items()}
        self.best.put(list(best.values()))
        after = max(x[3] for x in best.values())
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before + self.wait)
            self.handle.registerTimer(after + self.wait)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        best = {x[0]: tuple(x) for x in self.best.get()}
        self.best.clear()
        ts = lambda ph: best[ph][2] if ph in best else None
        yield Row(file=key[0], flow_id=key[1], fwd_ts=ts("s"), bwd_ts=ts("f"), flow_pos=max(x[1] for x in best.values()))

    def close(self) -> None:
        pass


def stream_flow_pairs(flows: DataFrame, time: str, late: str = "10 seconds", wait_ms: int = 60_000) -> DataFrame:
    """(file, flow_id, fwd_ts, bwd_ts, flow_pos) of the flows of a stream, once no row of a flow has come for wait_ms of event time.

    A flow of which only one end came has a null at the other (`flow.flow_pairs` leaves these out).  Rows of a flow
    that come after its result begin another one.
    """
    rows = flows.where("ph in ('s', 'f') and flow_id is not null").withWatermark(time, late).select("file", "flow_id", "ph", F.col("ts").cast("double").alias("ts"), "pos", time, F.unix_micros(time).alias("_us"))
    kinds = dict(flows.dtypes)
    return rows.groupBy("file", "flow_id").transformWithState(Flows(wait_ms), f"file {kinds['file']}, flow_id {kinds['flow_id']}, fwd_ts double, bwd_ts double, flow_pos bigint", "Append", "EventTime")


def stream_links(cpu: DataFrame, kernels: DataFrame, time: str, late: str = "10 seconds", apart: str = "1 minute") -> DataFrame:
    """Operations of a stream beside the kernels of their id in another stream: `correlate.linked`, and operations without kernels once none can come.

    time is a column of timestamps of both.  A kernel counts if it begins no more than `apart` before or after its operation, so Spark can
    forget what is older.  Columns: file, ext_id, name, pos, and k_name, k_dur, k_pos (null without a kernel).  Rows without id link with nothing and are left out.
    """
    left = cpu.where("ext_id is not null").withWatermark(time, late).select("file", "ext_id", "name", "pos", F.col(time).alias("_at"))
    right = kernels.where("ext_id is not null").withWatermark(time, late).select(
        F.col("file").alias("_file"), F.col("ext_id").alias("_ext_id"), F.col("name").alias("k_name"), F.col("dur").alias("k_dur"), F.col("pos").alias("k_pos"), F.col(time).alias("_k_at")
    )
    on = f"file = _file and ext_id = _ext_id and _k_at between _at - interval {apart} and _at + interval {apart}"
    return left.join(right, F.expr(on), "leftOuter").select("file", "ext_id", "name", "pos", "k_name", "k_dur", "k_pos")
