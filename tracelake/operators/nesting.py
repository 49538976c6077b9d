"""Call nesting: which interval of a thread lies in which other."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import chunked, edges

THREAD = ("file", "pid", "tid")


def cut(valid: DataFrame, keys: Sequence[str], rows_per_chunk: int | None = None) -> DataFrame:
    """valid with _part, _own and _end: each row in its chunk (_own), and again in each later chunk that begins before it ends.

    Chunks are ranges of time of a thread; where they begin is a table of two rows a range at most.
    """
    parts = chunked(valid, keys, "ts", rows_per_chunk).withColumn("_end", (F.col("ts") + F.col("dur")).cast("double"))
    begin = edges(parts, keys, F.min("ts").cast("double").alias("_begin"))
    begin = begin.select(*(F.col(k).alias(f"_r_{k}") for k in keys), F.col("_chunk").alias("_part"), "_begin")
    on = (F.col("_part") > F.col("_chunk")) & (F.col("_begin") <= F.col("_end"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    later = parts.join(F.broadcast(begin), on).drop(*(f"_r_{k}" for k in keys), "_begin").withColumn("_own", F.lit(False))
    return parts.withColumn("_part", F.col("_chunk")).withColumn("_own", F.lit(True)).unionByName(later).drop("_chunk")


def last_not_less(values: np.ndarray) -> np.ndarray:
    """For each place the last one before it whose value is no smaller, -1 where there is none.

    All places climb a tree of maxima at once, until a left neighbour is large enough, and go down in that to its last place.
    """
    n = len(values)
    tree = [values]
    while len(tree[-1]) > 1:
        low = tree[-1] if len(tree[-1]) % 2 == 0 else np.append(tree[-1], -np.inf)
        tree.append(np.maximum(low[::2], low[1::2]))
    out = np.full(n, -1, np.int64)
    row, node, hits = np.arange(n), np.arange(n), []
    for level in range(len(tree)):
        left = np.maximum(node - 1, 0)
        hit = (node % 2 == 1) & (tree[level][left] >= values[row])
        hits.append((row[hit], left[hit]))
        row, node = row[~hit], node[~hit] // 2
    row, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for level in range(len(tree) - 1, -1, -1):
        row, node = np.append(row, hits[level][0]), np.append(node, hits[level][1])
        if level:
            right = np.minimum(2 * node + 1, len(tree[level - 1]) - 1)
            node = np.where(tree[level - 1][right] >= values[row], right, 2 * node)
    out[row] = node
    return out


def depths(parent: np.ndarray, known: np.ndarray) -> np.ndarray:
    """known where that isn't negative, else one more than the parent's, 0 without one; chains are halved in each turn."""
    up = np.where(known >= 0, -1, parent)
    out = np.where(known >= 0, known, (up >= 0).astype(np.int64))
    while (live := np.flatnonzero(up >= 0)).size:
        above = up[live]
        out[live] += out[above]
        up[live] = up[above]
    return out


class Sweep:
    """The rows of threads in order of time, batch by batch; of the last thread the rows that are still open stay (with paths: and those above them)."""

    def __init__(self, group: Sequence[str], paths: bool) -> None:
        self.group, self.paths = group, paths
        self.thread: tuple | None = None
        self.keep(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string()))

    def keep(self, end: np.ndarray, pos: np.ndarray, depth: np.ndarray, parent: np.ndarray, name: pa.Array) -> None:
        self.end, self.pos, self.depth, self.parent, self.name = end, pos, depth, parent, name

    def feed(self, batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, pa.Array | None]:
        """(pos of the parent, depth, path) of each row of a batch."""
        n = batch.num_rows
        new = np.zeros(n, bool)
        for k in self.group:
            code = batch.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        at = lambda i: tuple(batch.column(k)[i].as_py() for k in self.group)
        if at(0) != self.thread:
            self.keep(self.end[:0], self.pos[:0], self.depth[:0], self.parent[:0], self.name[:0])
        self.thread, held = at(n - 1), len(self.end)
        end = np.append(self.end, batch.column("_end").to_numpy())
        pos = np.append(self.pos, batch.column("pos").to_numpy())
        start = np.append(np.zeros(held, np.int64), np.maximum.accumulate(np.where(new, np.arange(n) + held, 0)))
        parent = last_not_less(end)
        parent[parent < start] = -1
        parent[:held] = self.parent
        depth = depths(parent, np.append(self.depth, np.full(n, -1)))
        name = pa.concat_arrays([self.name, batch.column("name").cast(pa.string())]) if self.paths else self.name
        path = self.path(parent, depth, pos, name, held) if self.paths else None
        # what may be above later rows: of the last thread, rows that no later one outlasts
        first = int(start[-1])
        later = np.append(np.maximum.accumulate(end[first:][::-1])[::-1][1:], -np.inf)
        open_ = first + np.flatnonzero(end[first:] > later)
        stays = np.zeros(len(end), bool)
        stays[open_] = True
        up = parent[open_] if self.paths else open_[:0]
        while len(up := up[up >= 0]):
            up = np.unique(up[~stays[up]])
            stays[up] = True
            up = parent[up]
        rows = np.flatnonzero(stays)
        above = np.where(parent[rows] >= 0, (np.cumsum(stays) - 1)[parent[rows]], -1) if self.paths else np.full(len(rows), -1)
        closed = np.ones(len(end), bool)
        closed[open_] = False
        self.keep(np.where(closed[rows], -np.inf, end[rows]), pos[rows], depth[rows], above, name.take(pa.array(rows)) if self.paths else name)
        up = pa.array(pos[parent[held:]], pa.int64(), mask=parent[held:] < 0)
        return up, pa.array(depth[held:], pa.int32()), path

    def path(self, parent: np.ndarray, depth: np.ndarray, pos: np.ndarray, name: pa.Array, held: int) -> pa.Array:
        """Of each row behind the held ones the rows above it, outermost first, and itself."""
        row = np.arange(held, len(pos))
        ends = np.cumsum(depth[row] + 1)
        flat = np.empty(int(ends[-1]), np.int64)
        place = ends - 1
        while len(row):
            flat[place] = row
            row, place = parent[row], place - 1
            live = row >= 0
            row, place = row[live], place[live]
        entries = pa.StructArray.from_arrays([pa.array(pos[flat], pa.int64()), name.take(pa.array(flat))], ["pos", "name"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), entries)


def nest(events: DataFrame, keys: Sequence[str] = THREAD, rows_per_chunk: int | None = None, paths: bool = True) -> DataFrame:
    """Adds parent_pos and depth, and with paths path (array of pos and name, root first, the row last) and call_stack.

    The parent is the latest earlier row (by ts, pos) of the thread that ends no earlier than the row does.  Rows
    without a positive dur or without a thread have no place and are left out; ties of ts go by pos.
    A thread of any size is cut by time into chunks, which sweep on their own: a row that is still open when a later
    chunk begins is also sent there.  A sweep takes a batch of rows at once and holds the open rows of those before.
    """
    valid = events.where("dur > 0")
    for k in keys:
        valid = valid.where(F.col(k).isNotNull())
    return _swept(cut(valid, keys, rows_per_chunk), [*keys, "_part"], paths)


def nest_small(events: DataFrame, keys: Sequence[str] = THREAD, paths: bool = True) -> DataFrame:
    """`nest` of threads that one task can sort: they are dealt out whole, in one shuffle, and not stored before."""
    valid = events.where("dur > 0")
    for k in keys:
        valid = valid.where(F.col(k).isNotNull())
    return _swept(valid.withColumn("_end", (F.col("ts") + F.col("dur")).cast("double")).withColumn("_own", F.lit(True)), list(keys), paths)


def _swept(parts: DataFrame, group: list[str], paths: bool) -> DataFrame:
    kept = [f for f in parts.schema.fields if f.name not in ("_part", "_own", "_end")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(group, paths)
        for batch in batches:
            if not batch.num_rows:
                continue
            up, depth, path = sweep.feed(batch)
            out = pa.RecordBatch.from_arrays([*batch.select(names).columns, up, depth, *([path] if paths else [])], [*names, "parent_pos", "depth", *(["path"] if paths else [])])
            yield out.filter(batch.column("_own"))

    path = T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("name", T.StringType())]))
    schema = T.StructType([*kept, T.StructField("parent_pos", T.LongType()), T.StructField("depth", T.IntegerType()), *([T.StructField("path", path)] if paths else [])])
    swept = parts.repartition(*group).sortWithinPartitions(*group, "ts", "pos").mapInArrow(run, schema)
    return swept.withColumn("call_stack", F.filter(F.transform("path", lambda p: p["name"]), lambda n: n != "ROOT")) if paths else swept


def nest_by_join(events: DataFrame, keys: Sequence[str] = THREAD) -> DataFrame:
    """parent_pos by a range join: plain, but quadratic in a thread; for tests and small traces."""
    valid = events.where("dur > 0").withColumn("_end", F.col("ts") + F.col("dur"))
    up = valid.select(*(F.col(k).alias(f"_up_{k}") for k in keys), F.col("pos").alias("_up_pos"), F.col("ts").alias("_up_ts"), F.col("_end").alias("_up_end"))
    on = (F.struct("_up_ts", "_up_pos") < F.struct("ts", "pos")) & (F.col("_up_end") >= F.col("_end"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_up_{k}"))
    return valid.join(up, on, "left").groupBy(*keys, "pos").agg(F.max(F.struct("_up_ts", "_up_pos"))["_up_pos"].alias("parent_pos"))
