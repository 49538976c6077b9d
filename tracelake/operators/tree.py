"""Call trees as nested JSON, of threads of any size.

A node is {"event": {...}, "depth": d, "call_stack": [...], "children": [...]}.  Rows of a thread in order of time are its
tree in preorder, so a node's text is known from its own row and the depth of the row before: what that row leaves open is closed, then
the node is opened.  No parent gathers its children, however many it has: a tree is a sequence of pieces, which
can be cut anywhere, and the depth before each row comes from `ordering`, which cuts threads into ranges of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from .nesting import THREAD
from .ordering import previous_max

EVENT = ("name", "cat", "ts", "dur", "pid", "tid")


def _closed(levels: Column) -> Column:
    return F.repeat(F.lit("]}"), F.greatest(levels, F.lit(0)))


def pieces(nested: DataFrame, keys: Sequence[str] = THREAD, event: Sequence[str] = EVENT, rows_per_chunk: int | None = None) -> DataFrame:
    """(keys, ts, pos, depth, root_pos, closing, opening) of nested rows (see `nesting.nest`).

    opening begins a node; closing ends what the row before has left open and parts it from the node, and is null for a thread's
    first row.  root_pos is the outermost row that a node lies in.  Nodes have a call_stack where rows have one.
    """
    place = F.struct("ts", "pos")
    about = [F.struct(*event).alias("event"), "depth", *(["call_stack"] if "call_stack" in nested.columns else [])]
    opening = F.regexp_replace(F.to_json(F.struct(*about), {"ignoreNullFields": "false"}), r"\}\z", ',"children":[')
    rows = nested.select(*keys, "ts", "pos", "depth", opening.alias("opening"))
    # of the rows before each: the last one, and the last outermost one
    seen = F.struct(place.alias("at"), F.col("depth").alias("depth"))
    rows = previous_max(rows, keys, ["ts", "pos"], seen, "_last", rows_per_chunk=rows_per_chunk)
    rows = previous_max(rows, keys, ["ts", "pos"], F.when(F.col("depth") == 0, place), "_root", rows_per_chunk=rows_per_chunk)
    left = F.col("_last.depth")
    closing = F.when(left.isNotNull(), F.concat(_closed(left - F.col("depth") + 1), F.when(left >= F.col("depth"), ",").otherwise("")))
    root = F.when(F.col("depth") == 0, F.col("pos")).otherwise(F.col("_root.pos"))
    return rows.select(*keys, "ts", "pos", "depth", root.alias("root_pos"), closing.alias("closing"), "opening")


def trees(nested: DataFrame, keys: Sequence[str] = THREAD, **options: object) -> DataFrame:
    """(keys, root_pos, nodes, tree): each root's JSON as one value, for trees that fit one; `write_trees` has no such limit."""
    text = F.when(F.col("depth") == 0, F.col("opening")).otherwise(F.concat("closing", "opening"))
    whole = pieces(nested, keys, **options).groupBy(*keys, "root_pos").agg(
        F.count(F.lit(1)).alias("nodes"), F.array_sort(F.collect_list(F.struct("ts", "pos", text.alias("text")))).alias("parts"), F.max_by("depth", F.struct("ts", "pos")).alias("left")
    )
    tree = F.concat(F.array_join(F.transform("parts", lambda p: p["text"]), ""), _closed(F.col("left") + 1))
    return whole.select(*keys, "root_pos", "nodes", tree.alias("tree"))


def write_trees(nested: DataFrame, folder: str, keys: Sequence[str] = THREAD, **options: object) -> None:
    """Writes the trees of each thread below folder, in a folder named after the thread: its part files in order of their names are a JSON array of roots.

    Parts are ranges of rows, so a thread is written by as many tasks as its rows need.
    """
    rows = saved(pieces(nested, keys, **options), "pieces")
    body = rows.select(*keys, "ts", "pos", F.lit(0).alias("last"), F.concat(F.coalesce("closing", F.lit("[")), "opening").alias("value"))
    end = rows.groupBy(*keys).agg(F.max(F.struct("ts", "pos", "depth")).alias("z"))
    end = end.select(*keys, "z.ts", "z.pos", F.lit(1).alias("last"), F.concat(_closed(F.col("z.depth") + 1), F.lit("]")).alias("value"))
    order = [*keys, "ts", "pos", "last"]
    body.unionAll(end).repartitionByRange(*order).sortWithinPartitions(*order).select(*keys, "value").write.partitionBy(*keys).text(folder)
