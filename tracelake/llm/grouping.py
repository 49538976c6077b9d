"""Exact verification of rows that share buckets, whatever a bucket's size.

Candidates come as buckets: rows that share a table key.  A pair needs no comparison once both rows are known to
be connected, so work goes in two phases.  First each row is compared with one representative of its buckets, in a few
turns with other representatives: linear in the rows, and enough for groups of near copies of any size.  Then the
buckets that still hold rows of several components are compared whole: the rows of a bucket's largest component
against the others, and those among themselves, by pairs of blocks of bounded size.  No pair of rows is
ever emitted; what leaves a unit of work are the links it found between components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, ordered_by, saved

#: Turns of the first phase.
TURNS = 4


def per_unit(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str, keys: tuple[str, ...]) -> DataFrame:
    """Runs work on the rows of each unit; many units share a task, which holds one unit at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(k).to_numpy() for k in keys])
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                this = tuple(ids[:, a].tolist())
                if last is not None and this != last:
                    out = work(pa.Table.from_batches(held))
                    if out is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
                last = this
        if held and (out := work(pa.Table.from_batches(held))) is not None:
            yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, root) of a spanning forest of a symmetric boolean matrix, without isolated nodes."""
    n = len(link)
    left = np.ones(n, bool)
    out = []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(link[front].any(0) & left)
            left[front] = False
            out += [(int(x), root) for x in front]
    return out


def shared_buckets(buckets: DataFrame, name: str) -> DataFrame:
    """buckets: (key, node, weight).  Those with several nodes, each set of nodes once, with each node its own component.

    Sets are told apart by their size and two 64-bit sums of hashes, combined before the shuffle.
    """
    sets = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    keys = saved(sets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), f"{name}-buckets")
    # joined by shuffle at every size, so that the work grows as the input does
    return saved(buckets.join(keys.hint("merge"), "key").select("key", "node", "weight", F.col("node").alias("component")), f"{name}-open")


def blocks_of(weight: str, most_weight: int, most_rows: int, only: str = "true") -> F.Column:
    """Number of blocks of about most_weight and most_rows that the rows of a group fill."""
    w = F.sum(F.when(F.expr(only), F.col(weight)).otherwise(0))
    n = F.count_if(F.expr(only))
    return F.greatest(F.ceil(w / most_weight), F.ceil(n / most_rows), F.lit(1)).cast("int")


def still_open(rows: DataFrame, name: str) -> DataFrame:
    """The rows (key, ...) of buckets that hold several components."""
    keys = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return saved(rows.join(saved(keys, f"{name}-keys"), "key", "left_semi"), f"{name}-open")


def star_units(rows: DataFrame, turn: int, most_weight: int, most_rows: int) -> DataFrame:
    """(node, component, unit, block, center): each row of open buckets beside one representative of another component."""
    centers = saved(rows.groupBy("key").agg(F.min(F.struct(ordered_by("node", turn).alias("o"), "component")).alias("c")).select("key", F.col("c.o.v").alias("unit"), F.col("c.component").alias("other")), "centers")
    nearest = rows.join(centers, "key").where("component <> other").groupBy("node").agg(F.min(F.struct(ordered_by("unit", turn).alias("o"), "other")).alias("c"), F.first("component").alias("component"), F.first("weight").alias("weight"))
    nearest = saved(nearest.select("node", "component", "weight", F.col("c.o.v").alias("unit"), F.col("c.other").alias("other")), "nearest")
    sizes = saved(nearest.groupBy("unit").agg(blocks_of("weight", most_weight, most_rows).alias("n_blocks"), F.first("other").alias("other")), "sizes")
    members = nearest.join(sizes.select("unit", "n_blocks"), "unit").select("node", "component", "unit", F.pmod(F.xxhash64("node"), "n_blocks").cast("int").alias("block"), F.lit(False).alias("center"))
    return members.unionAll(sizes.select(F.col("unit").alias("node"), F.col("other").alias("component"), "unit", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), F.lit(True).alias("center")))


def whole_units(rows: DataFrame, most_weight: int, most_rows: int) -> DataFrame:
    """(node, component, unit, block, other): the blocks of each open bucket, paired.

    Unit (key, i, j) compares block i of the largest component with block j of the rest, unit (key, -1 - i, j) two
    blocks of the rest.
    """
    counts = saved(rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")), "counts")
    largest = saved(counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m")).select("key", F.col("m.component").alias("main")), "largest")
    told = rows.join(largest, "key").withColumn("in_main", F.col("component") == F.col("main"))
    sizes = saved(told.groupBy("key").agg(blocks_of("weight", most_weight, most_rows, "in_main").alias("n_main"), blocks_of("weight", most_weight, most_rows, "not in_main").alias("n_rest")), "sizes")
    placed = told.join(sizes, "key").withColumn("at", F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))
    against = F.transform(F.sequence(F.lit(0), F.col("n_rest") - 1), lambda j: F.struct(F.col("at").alias("block"), j.alias("other")))
    main = F.transform(F.sequence(F.lit(0), F.col("n_main") - 1), lambda i: F.struct(i.alias("block"), F.col("at").alias("other")))
    rest = F.transform(F.sequence(F.lit(0), F.col("n_rest") - 1), lambda j: F.struct((-1 - F.least(j, F.col("at"))).alias("block"), F.greatest(j, F.col("at")).alias("other")))
    unit = F.explode(F.when(F.col("in_main"), against).otherwise(F.concat(main, rest))).alias("u")
    return placed.select("node", "component", F.col("key").alias("unit"), unit).select("node", "component", "unit", "u.block", "u.other")


def linked(buckets: DataFrame, load: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame, DataFrame, bool], DataFrame], name: str, star: tuple[int, int], block: tuple[int, int], turns: int = TURNS) -> DataFrame:
    """(node, component) of the nodes of buckets (key, node, weight) that share one with another node.

    load(nodes) gives the contents to compare, and compare(units, contents, whole) the links (a, b) between components
    that the units hold; star and block are the most weight and rows of a block in the first phase and in the second.
    """
    rows = shared_buckets(buckets, name)
    state = saved(rows.select("node").distinct().select("node", F.col("node").alias("component")), f"{name}-state")
    contents = load(state.select("node"))
    for turn in range(turns + 1):
        if turn:
            rows = still_open(rows, name)
        if rows.isEmpty():
            break
        whole = turn == turns
        units = whole_units(rows, *block) if whole else star_units(rows, turn, *star)
        edges = saved(compare(units, contents, whole), f"{name}-links")
        if edges.isEmpty():
            continue
        moved = saved(components(edges, name).select(F.col("node").alias("component"), F.col("component").alias("to")), f"{name}-moved")
        renamed = lambda df: df.join(moved, "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")
        state = saved(renamed(state).select("node", "component"), f"{name}-state")
        if not whole:
            rows = saved(renamed(rows).select("key", "node", "weight", "component"), f"{name}-open")
    return state
