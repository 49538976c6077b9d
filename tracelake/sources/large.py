"""Trace files of any size, scanned by byte ranges in many tasks.

A range may begin anywhere: inside a string, or many levels deep.  What it needs to know about the bytes before it are two
numbers, whether they leave a string open and how deep they nest.  A first pass (`range_facts`) measures each range under both
answers to the first question; `settled` chains these small rows in order, per file.  The second pass
(`range_events`) then scans each range from its true state, with numpy over pieces of bounded size: an event belongs to the range
that holds the comma or bracket before it, and the last one is read on beyond the range's end.  Whether the list
that a range begins in is the one of the events is settled by the ranges before it, too, and so are the events' places.

Events come as JSON texts, which Spark parses.  Compressed files have one range, since they can't be entered in the
middle; they are still read piece by piece, so that a task holds a piece and an event.  Nothing comes before that range, so no
pass settles how it begins, and its events are handed on as they are found, without being stored (`read_compressed`).  Ranges are
read with pyarrow's file systems.  Files that end inside a string or a bracket, or that close more than they open, raise an error.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from functools import partial
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import saved

#: Bytes of a range, and of what is scanned at once inside one.
RANGE, PIECE = 64 << 20, 4 << 20
ROWS_AT_ONCE = 20_000
#: Bytes that are first read behind a range, for the end of its last event.
BEYOND = 16 << 10
#: Bytes before a piece that stay in sight: those between a key and its value must fit.
SIGHT = 4096
#: Bytes of a trace for each of its compressed file, at most, about.
PACKED = 24
_BASE_KEY = b"baseTimeNanoseconds"
_EVENTS_KEY = re.compile(rb'(?<!\\)"traceEvents"[ \t\r\n]*:[ \t\r\n]*\Z')
_BASE = re.compile(rb'(?<!\\)"baseTimeNanoseconds"[ \t\r\n]*:[ \t\r\n]*(-?[0-9]+)(?=[ \t\r\n,}])')
_OPEN, _CLOSE, _COMMA = b"[{", b"]}", b","
_DEPTH = np.zeros(256, np.int8)
_DEPTH[list(_OPEN)], _DEPTH[list(_CLOSE)] = 1, -1
_MARK = np.zeros(256, bool)
_MARK[list(_OPEN + _CLOSE + _COMMA)] = True

WHOLE = "id int, pos bigint, events array<string>, base_ns bigint"
#: Events of a compressed file that go into a row, so that one parser reads them all.
TOGETHER = 100
FACTS = "file string, part int, quotes bigint, outside bigint, inside bigint, root string"
#: kind: an event, a base time (as n), or what the range has: `first` events of the list that it begins in and n of its own list; open is whether it ends in the events' list (null: it holds no list's begin).
ROWS = "file string, part int, kind string, at bigint, first boolean, event string, n bigint, open boolean"


def opened(uri: str) -> tuple[IO[bytes], int | None]:
    """A file at its begin, and its size where places in it can be gone to."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if path.endswith(".gz"):
        return gzip.GzipFile(fileobj=system.open_input_stream(path, compression=None)), None
    f = system.open_input_file(path)
    return f, f.size()


def before(f: IO[bytes], start: int) -> bytes:
    """The bytes before start that a scan from there must see: SIGHT, and more while they are backslashes."""
    n = min(SIGHT, start)
    while True:
        f.seek(start - n)
        out = f.read(n)
        if n == start or out.strip(b"\\"):
            return out
        n = min(2 * n, start)


def pieces(f: IO[bytes], start: int, stop: int | None, piece: int) -> Iterator[bytes]:
    """The bytes of [start, stop), to the end of the file where stop is None."""
    while stop is None or start < stop:
        got = f.read(piece if stop is None else min(piece, stop - start))
        if not got:
            return
        yield got
        start += len(got)


def growing(f: IO[bytes], piece: int, most: int) -> Iterator[bytes]:
    """The bytes up to the end of the file, in pieces that double up to `most` bytes."""
    while got := f.read(piece):
        yield got
        piece = min(2 * piece, most)


class Scan:
    """The brackets and commas outside strings of a text that comes piece by piece, and how deep they stand."""

    def __init__(self, sight: bytes = b"", in_string: bool = False, depth: int = 0) -> None:
        self.sight, self.in_string, self.depth = sight, in_string, depth

    def quotes(self, data: np.ndarray) -> np.ndarray:
        """The places of the quotes that begin or end strings: those behind an even number of backslashes."""
        found = np.flatnonzero(data == 0x22)
        slashes = np.flatnonzero(data == 0x5C)
        kept = len(self.sight) - len(self.sight.rstrip(b"\\"))
        if len(found) and (len(slashes) or kept):
            # the runs of backslashes, each with its first place; one that ends the last piece goes on
            head = np.flatnonzero(np.append(True, slashes[1:] != slashes[:-1] + 1)) if len(slashes) else np.zeros(0, np.int64)
            begin = np.repeat(slashes[head], np.diff(np.append(head, len(slashes))))
            at = np.searchsorted(slashes, found) - 1
            near = (at >= 0) & (slashes[at] == found - 1) if len(slashes) else np.zeros(len(found), bool)
            run = np.where(near, found - begin[at], 0) if len(slashes) else np.zeros(len(found), np.int64)
            run += np.where(run == found, kept, 0)  # a run from the piece's first byte on, or none before its first quote
            found = found[run % 2 == 0]
        return found

    def marks(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, bytes, depth behind each) of the marks of a piece."""
        quotes = self.quotes(data)
        places = np.flatnonzero(_MARK[data])
        inside = np.zeros(len(data), bool)
        inside[quotes] = True
        np.logical_xor.accumulate(inside, out=inside)
        places = places[inside[places] == self.in_string]
        depth = self.depth + np.cumsum(_DEPTH[data[places]], dtype=np.int64)
        self.in_string ^= len(quotes) % 2 == 1
        return places, data[places], depth

    def passed(self, piece: bytes, depth: np.ndarray) -> None:
        self.depth = int(depth[-1]) if len(depth) else self.depth
        run = len(piece) - len(piece.rstrip(b"\\"))
        if run == len(piece):
            self.sight += piece
        else:
            n = max(SIGHT, run + 1)
            self.sight = piece[-n:] if len(piece) >= n else (self.sight + piece)[-n:]


def facts(uri: str, part: int, start: int, stop: int | None, piece: int) -> dict:
    """What a range does to the state: its quotes, and its change of depth if it begins outside a string or inside."""
    f, size = opened(uri)
    with f:
        sight, root = b"", None
        if size is not None:
            sight = before(f, start)
            f.seek(start)
        scan, quotes, change = Scan(sight), 0, np.zeros(2, np.int64)
        for got in pieces(f, start, stop, piece):
            data = np.frombuffer(got, np.uint8)
            found, places = scan.quotes(data), np.flatnonzero(_MARK[data])
            odd = (np.searchsorted(found, places) + quotes) % 2
            change += np.bincount(odd, _DEPTH[data[places]], 2).astype(np.int64)
            quotes += len(found)
            scan.passed(got, odd[:0])
            if part == 0 and root is None:
                root = got.removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode("latin-1") or None
    return {"file": uri, "part": part, "quotes": quotes, "outside": int(change[0]), "inside": int(change[1]), "root": root}


#: Events of one list: the place of the first, whether the list is inherited, a text, and where in it they start and end.
Run = tuple[int, bool, bytes, np.ndarray, np.ndarray]


class Range:
    """The events of a range, from its settled state."""

    def __init__(self, root: str, in_string: bool, depth: int, sight: bytes) -> None:
        self.level = 1 if root == "[" else 2
        self.bare = root == "["
        self.scan = Scan(sight, in_string, depth)
        self.held: list[bytes] | None = None  # what is read of an event whose end isn't
        self.inherited, self.wanted, self.begun = True, True, False  # of the list that the scan is in
        self.first = self.own = 0  # events so far, of the inherited list and of the events' own
        self.blank = False  # whether the held event stands right behind the list's bracket

    def feed(self, got: bytes, owned: bool = True) -> tuple[list[tuple[int, bool, bytes]], list[int], bool]:
        """(place, inherited, text) of the events that end in a piece, base times, and whether an unowned scan is done."""
        found, bases, done = self.runs(got, owned)
        each = lambda at, first, text, starts, ends: ((at + i, first, text[a:b]) for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)))
        return [x for run in found for x in each(*run)], bases, done

    def runs(self, got: bytes, owned: bool = True) -> tuple[list[Run], list[int], bool]:
        """`feed` with the events of a list that end in a piece as one run, without a step for each of them."""
        data = np.frombuffer(got, np.uint8)
        sight = self.scan.sight
        places, kinds, depth = self.scan.marks(data)
        bases = [] if self.bare else self.bases(sight, got, places, depth)
        change = _DEPTH[kinds]
        own = np.flatnonzero(np.where(change < 0, depth == self.level - 1, depth == self.level))
        places, kinds, opens, closes = places[own], kinds[own], change[own] > 0, change[own] < 0
        found: list[Run] = []
        done = False
        if len(places) and self.held is not None:
            self.held.append(got[self.at : places[0]])
            text = b"".join(self.held)
            self.held = None
            if not (self.blank and closes[0] and not text.strip()):
                self.add(found, text, np.zeros(1, np.int64), np.full(1, len(text)))
        if len(places) and not owned:
            done = True
        elif len(places):
            # a list's events stand between its bracket, which is the first mark of its own, and the marks behind each
            heads = np.flatnonzero(opens).tolist()
            for a, b in zip([0, *heads], [*heads, len(places)], strict=True):
                if a == b:
                    continue
                if opens[a]:
                    place = int(places[a])
                    self.inherited, self.begun = False, True
                    self.wanted = kinds[a] == 0x5B and (self.bare or _EVENTS_KEY.search((sight + got[max(0, place - SIGHT) : place])[-SIGHT:]) is not None)
                if not self.wanted:
                    continue
                at = a + np.flatnonzero(~closes[a : min(b, len(places) - 1)])
                if len(at) and opens[at[0]] and closes[at[0] + 1] and not got[places[at[0]] + 1 : places[at[0] + 1]].strip():
                    at = at[1:]
                self.add(found, got, places[at] + 1, places[at + 1])
            if not closes[-1] and self.wanted:
                self.held, self.at, self.blank = [], int(places[-1]) + 1, bool(opens[-1])
        if self.held is not None:
            self.held.append(got[self.at :])
            self.at = 0
        self.scan.passed(got, depth)
        return found, bases, done or (not owned and self.held is None)

    def add(self, found: list[Run], text: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        """Numbers a run of events of the list that the scan is in."""
        if not len(starts):
            return
        found.append((self.first if self.inherited else self.own, self.inherited, text, starts, ends))
        if self.inherited:
            self.first += len(starts)
        else:
            self.own += len(starts)

    def bases(self, sight: bytes, got: bytes, places: np.ndarray, depth: np.ndarray) -> list[int]:
        """Base times whose end lies in the piece."""
        whole = sight + got
        if _BASE_KEY not in whole:
            return []
        out, before, key = [], self.scan.depth, 0
        while (key := whole.find(_BASE_KEY, key + 1)) > 0:
            m = _BASE.match(whole, key - 1)
            end = m.end() - len(sight) if m else -1
            if end >= 0:
                at = np.searchsorted(places, end) - 1
                if (depth[at] if at >= 0 else before) == 1:
                    out.append(int(m[1]))
        return out


def events(uri: str, part: int, start: int, stop: int | None, in_string: bool, depth: int, root: str, piece: int) -> Iterator[tuple]:
    """Rows of a range as kind, at, first, event, n and open."""
    f, size = opened(uri)
    with f:
        sight = before(f, start) if size is not None else b""
        if size is not None:
            f.seek(start)
        scan = Range(root, in_string, depth, sight)
        row = lambda at, first, text: ("event", at, first, text.decode("utf-8", "replace"), None, None)
        for got in pieces(f, start, stop, piece):
            found, bases, _ = scan.feed(got)
            yield from (row(*x) for x in found)
            yield from (("base", None, None, None, n, None) for n in bases)
        if scan.held is not None and stop is not None:
            for got in growing(f, min(piece, BEYOND), min(piece, 1 << 20)):
                found, _, done = scan.feed(got, owned=False)
                yield from (row(*x) for x in found)
                if done:
                    break
        yield "range", scan.first, None, None, scan.own, scan.wanted if scan.begun else None


def texts(text: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The parts of a text as an array; what isn't UTF-8 in them is replaced."""
    low, high = int(starts[0]), int(ends[-1])
    whole = text[low:high]
    try:
        whole.decode()
        near = bool((starts[1:] == ends[:-1] + 1).all())
    except UnicodeDecodeError:
        near = False
    if not near or high - low > np.iinfo(np.int32).max:
        return pa.array([text[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.string())
    # one byte stands between two parts
    kept = np.ones(len(whole), bool)
    kept[ends[:-1] - low] = False
    flat = np.frombuffer(whole, np.uint8)[kept]
    offsets = np.append(starts - low - np.arange(len(starts)), len(flat)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(flat))


def base_time(uri: str, piece: int) -> int | None:
    """The greatest base time of a compressed file; no more of it is scanned than holds the key."""
    f, _ = opened(uri)
    last, sight = -1, b""
    with f:
        for i, got in enumerate(pieces(f, 0, None, piece)):
            if _BASE_KEY in sight + got:
                last = i
            sight = (sight + got)[-SIGHT:]
    found: list[int] = []
    f, _ = opened(uri)
    with f:
        scan = None
        for _, got in zip(range(last + 1), pieces(f, 0, None, piece), strict=False):
            scan = scan or rooted(got)
            found += scan.runs(got)[1] if scan else []
    return max(found, default=None)


def rooted(got: bytes) -> Range | None:
    """The scan of a file that begins with a piece; None if that is blank."""
    root = got.removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode("latin-1")
    return Range(root, False, 0, b"") if root else None


def whole(uri: str, piece: int) -> Iterator[tuple[int, pa.Array]]:
    """(place of the first, texts) of runs of events of a compressed file."""
    f, _ = opened(uri)
    scan, root = None, ""
    with f:
        for got in pieces(f, 0, None, piece):
            if scan is None:
                root = got.removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode("latin-1")
                scan = rooted(got)
            if scan:
                yield from ((at, texts(*run)) for at, first, *run in scan.runs(got)[0] if not first)
    if scan and (root not in ("{", "[") or scan.scan.in_string or scan.scan.depth):
        raise ValueError(f"broken JSON in {uri}")


_KINDS = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def batch_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, _KINDS[kind]) for x, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])


def _facts(piece: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            yield batch_of([tuple(facts(r["file"], r["part"], r["start"], r["stop"], piece).values())], FACTS)


def _events(piece: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            held, n = [], 0
            for row in events(r["file"], r["part"], r["start"], r["stop"], r["in_string"], r["depth"], r["root"], piece):
                held.append((r["file"], r["part"], *row))
                n += len(row[3] or "")
                if len(held) >= ROWS_AT_ONCE or n >= PIECE:
                    yield batch_of(held, ROWS)
                    held, n = [], 0
            if held:
                yield batch_of(held, ROWS)


def _whole(piece: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            base = base_time(r["file"], piece)
            for at, found in whole(r["file"], piece):
                firsts = np.arange(0, len(found), TOGETHER)
                lists = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(found)).astype(np.int32)), found)
                fixed = lambda value, kind, n=len(firsts): pa.repeat(pa.scalar(value, kind), n)
                yield pa.RecordBatch.from_arrays([fixed(r["id"], pa.int32()), pa.array(firsts + at), lists, fixed(base, pa.int64())], ["id", "pos", "events", "base_ns"])


def range_count(uri: str, n: int, size: int) -> int:
    return 1 if uri.endswith(".gz") else max(1, -(-n // size))


def tasks(spark: SparkSession, files: list[tuple[str, int]], size: int) -> int:
    """A task for each RANGE bytes, or for each core where that is less, but not more than there are ranges."""
    return min(sum(range_count(f, n, size) for f, n in files), max(spark.sparkContext.defaultParallelism, -(-sum(n for _, n in files) // min(size, RANGE)) if size >= RANGE // 64 else 0))


def ranges(spark: SparkSession, files: list[tuple[str, int]], size: int = RANGE) -> DataFrame:
    """(file, part, start, stop, id) of the byte ranges of files (URI, bytes), dealt out to tasks.  stop is null for compressed files."""
    counts = [range_count(f, n, size) for f, n in files]
    firsts = np.cumsum([0, *counts])
    table = spark.createDataFrame([(f, n, c, int(at)) for (f, n), c, at in zip(files, counts, firsts, strict=False)], "file string, bytes bigint, n int, at bigint")
    parts = table.select("file", "bytes", "at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    start = F.col("part").cast("bigint") * size
    stop = F.when(~F.col("file").endswith(".gz"), F.least(start + size, F.col("bytes")))
    out = parts.select("file", "part", start.alias("start"), stop.alias("stop"), (F.col("at") + F.col("part")).alias("id"))
    return out.repartitionByRange(tasks(spark, files, size), "id")


def settled(spread: DataFrame, found: DataFrame) -> DataFrame:
    """The ranges with in_string, depth and root: the state that the facts of the ranges before them leave."""
    order = Window.partitionBy("file").orderBy("part")  # a row for each range of a file
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    state = found.withColumn("in_string", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1).withColumn("step", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    state = state.withColumn("depth", F.coalesce(F.sum("step").over(earlier), F.lit(0))).withColumn("end", F.col("depth") + F.col("step"))
    whole = Window.partitionBy("file")
    broken = (F.sum("quotes").over(whole) % 2 == 1) | (F.sum("step").over(whole) != 0) | (F.min("end").over(whole) < 0) | ~F.coalesce(F.first("root", True).over(whole).isin("{", "["), F.lit(True))
    state = state.withColumn("root", F.when(broken, F.raise_error(F.concat(F.lit("broken JSON in "), F.col("file")))).otherwise(F.coalesce(F.first("root", True).over(whole), F.lit("{"))))
    return spread.join(state.select("file", "part", "in_string", "depth", "root"), ["file", "part"])


def read_compressed(spark: SparkSession, files: list[tuple[str, int]], piece: int = PIECE) -> DataFrame:
    """(file, pos, events, base_ns) of compressed files: texts of up to TOGETHER events in a row, and the place of the first.

    A task reads whole files, and several only where these are small or very many.
    """
    table = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(files)], "id int, file string")
    n = min(len(files), max(4 * spark.sparkContext.defaultParallelism, -(-sum(n for _, n in files) * PACKED // RANGE)))
    rows = table.repartitionByRange(n, "id").mapInArrow(partial(_whole, piece), WHOLE)
    # a row a file; its name isn't sent with each row
    return rows.join(F.broadcast(table), "id").select("file", "pos", "events", "base_ns")


def read_events(spark: SparkSession, files: list[tuple[str, int]], size: int = RANGE, piece: int = PIECE) -> DataFrame:
    """(file, pos, event, base_ns): the events' texts with their places in their files (URI, bytes)."""
    spread = ranges(spark, files, size)
    found = saved(spread.mapInArrow(partial(_facts, piece), FACTS), "range-facts")
    ready = settled(spread, found).repartitionByRange(tasks(spark, files, size), "id").drop("id")
    rows = saved(ready.mapInArrow(partial(_events, piece), ROWS), "range-events")
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    marks = rows.where("kind = 'range'").select("file", "part", F.col("at").alias("n_first"), F.col("n").alias("n_own"), "open")
    marks = marks.withColumn("mine", F.coalesce(F.last("open", True).over(earlier), F.lit(False)))
    total = F.col("n_own") + F.when(F.col("mine"), F.col("n_first")).otherwise(0)
    marks = marks.withColumn("total", total).withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0))).select("file", "part", "mine", "base", "n_first")
    marks = saved(marks, "range-marks")  # a row a range
    times = rows.where("kind = 'base'").groupBy("file").agg(F.max("n").alias("base_ns"))
    place = F.col("base") + F.col("at") + F.when(~F.col("first") & F.col("mine"), F.col("n_first")).otherwise(0)
    kept = rows.where("kind = 'event'").select("file", "part", "at", "first", "event").join(marks, ["file", "part"]).where("mine or not first")
    return kept.select("file", place.alias("pos"), "event").join(times, "file", "left")
