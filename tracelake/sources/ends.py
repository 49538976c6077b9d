"""When a trace begins and ends, from a few bytes at either end of its file.

The end of a file is a state that is known: outside strings and brackets.  So the quotes and brackets of the last bytes
tell how deep the place is at which they begin, and the events in them are found without reading what is before.  Both
ends are read in windows that double until an event with a time is in sight, so what is read doesn't grow with the file.
The base time is looked for in the bytes that are read for this.  A list behind the events' own that is longer than the last window and
whose entries have times of their own would be taken for events.  Compressed files are read whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import large

#: Bytes of the first window at each end.
WINDOW = 64 << 10
SCHEMA = "file string, base_ns bigint, first double, last double, bytes_read bigint"
#: Files in a task.
FILES = 256


def time_of(event: bytes, named: bool) -> float | None:
    """The time of an event; named: of one that has a category."""
    try:
        found = json.loads(event.decode("utf-8", "replace"))
    except ValueError:
        return None
    if not isinstance(found, dict) or (named and not found.get("cat")):
        return None
    ts = found.get("ts")
    return float(ts) if isinstance(ts, (int, float)) and not isinstance(ts, bool) else None


def head(got: Iterator[bytes], named: bool) -> tuple[float | None, list[int], int, str]:
    """(time of the first event that has one, base times, bytes read, first character) of a file's pieces."""
    scan, bases, n, root = None, [], 0, ""
    for piece in got:
        n += len(piece)
        root = root or piece.removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode("latin-1")
        scan = scan or (large.Range(root, False, 0, b"") if root else None)
        if scan is None:
            continue
        found, more, _ = scan.feed(piece)
        bases += more
        for _, _, event in found:
            if (ts := time_of(event, named)) is not None:
                return ts, bases, n, root
    return None, bases, n, root


def tail(f: IO[bytes], size: int, root: str, named: bool, window: int) -> tuple[float | None, list[int], int]:
    """(time of the last event that has one, base times, bytes read)."""
    total = 0
    while True:
        start = max(0, size - window)
        sight = large.before(f, start)
        f.seek(start)
        got = f.read(size - start)
        total += len(got) + len(sight)
        scan = large.Scan(sight)
        data = np.frombuffer(got, np.uint8)
        in_string = len(scan.quotes(data)) % 2 == 1
        _, _, depth = large.Scan(sight, in_string).marks(data)
        found, bases, _ = large.Range(root, in_string, -int(depth[-1]) if len(depth) else 0, sight).feed(got)
        for _, _, event in reversed(found):
            if (ts := time_of(event, named)) is not None:
                return ts, bases, total
        if not start:
            return None, bases, total
        window *= 2


def ends(uri: str, named: bool, window: int) -> tuple:
    """A row of SCHEMA."""
    f, size = large.opened(uri)
    with f:
        if size is None:
            times, bases, n = [], [], 0
            scan = None
            for piece in large.pieces(f, 0, None, large.PIECE):
                n += len(piece)
                root = piece.removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode("latin-1") if scan is None else ""
                scan = scan or (large.Range(root, False, 0, b"") if root else None)
                if scan is None:
                    continue
                found, more, _ = scan.feed(piece)
                bases += more
                here = [ts for _, _, event in found if (ts := time_of(event, named)) is not None]
                times = [*times[:1], *here][:1] + here[-1:] if here else times
            return uri, max(bases, default=None), *((times[0], times[-1]) if times else (None, None)), n
        first, bases, n, root = head(large.pieces(f, 0, size, window), named)
        last, more, m = tail(f, size, root, named, window) if first is not None else (None, [], 0)
    return uri, max([*bases, *more], default=None), first, last, n + m


def read_ends(spark: SparkSession, files: list[tuple[str, int]], named: bool = False, window: int = WINDOW) -> DataFrame:
    """(file, base_ns, first, last, bytes_read): times of the first and last event that has one (named: and a category)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield large.batch_of([ends(uri, named, window) for uri in batch.column("file").to_pylist()], SCHEMA)

    names = spark.createDataFrame([(f,) for f, _ in files], "file string").repartition(max(1, -(-len(files) // FILES), min(len(files), spark.sparkContext.defaultParallelism)))
    return names.mapInArrow(run, SCHEMA)
