"""Clock arithmetic as column expressions.  Times of events are microseconds, base times nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def absolute_ns(base_ns: Column, ts: Column) -> Column:
    """Nanoseconds since the epoch; null if the base time is."""
    return base_ns.cast("bigint") + (ts * 1000).cast("bigint")


def _micros(ns: Column) -> Column:
    return F.call_function("div", ns.cast("bigint"), F.lit(1000).cast("bigint"))


def readable(base_ns: Column, ts: Column) -> Column:
    """The absolute time as text in the session's time zone; null if the base time is."""
    return F.date_format(F.timestamp_micros(_micros(absolute_ns(base_ns, ts))), TEXT)


def micros_of(text: Column) -> Column:
    """Microseconds since the epoch of a readable time; 0.0 if it isn't one."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(text, F.lit(TEXT))).cast("double"), F.lit(0.0))


def end_text(start: Column, dur: Column) -> Column:
    """The readable end of an interval whose start is readable text."""
    micros = F.unix_micros(F.try_to_timestamp(start, F.lit(TEXT))) + dur.cast("bigint")
    return F.date_format(F.timestamp_micros(micros), TEXT)


def micros_text(value: Column) -> Column:
    return F.format_string("%.2fμs", value)


def folder_time(ns: Column) -> Column:
    return F.date_format(F.timestamp_micros(_micros(ns)), "yyyy-MM-dd_HH-mm-ss")


def millis_of(value: Column) -> Column:
    """Milliseconds of a number, of its text or of an ISO-8601 time; null if it is none of these."""
    text = value.cast("string")
    return F.coalesce(text.try_cast("bigint"), F.unix_millis(F.try_to_timestamp(text)))


def apart(ts_a: Column, dur_a: Column, ts_b: Column, dur_b: Column, limit: float = 5000.0) -> tuple[Column, Column, Column]:
    """Distances of the starts and of the ends of two intervals, and whether one is over the limit."""
    starts, ends = F.abs(ts_a - ts_b), F.abs(ts_a + dur_a - ts_b - dur_b)
    return starts, ends, (starts > limit) | (ends > limit)
