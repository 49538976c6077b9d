"""Spark helpers shared by the operators: row keys, row structs and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .. import storage
from ..storage import saved_alone, scratch_dir

__all__ = ["as_text", "components", "keyed", "restored", "saved", "saved_alone", "scratch_dir"]


def saved(df: DataFrame, name: str) -> DataFrame:
    """storage.saved; the shuffle files of the finished steps go then, so that disk use follows the largest step."""
    out = storage.saved(df, name)
    storage.release(out.sparkSession)
    return out


def keyed(docs: DataFrame, *columns: str, key: str = "doc_id") -> DataFrame:
    """(_rid, the named columns, _row) of docs: a unique, non-null long key, and all columns as one struct.

    Columns of docs stay in the struct, so none can clash with a column of an operator (`restored` gives them
    back).  The key is doc_id itself where that is a number, unique and never null, else a number stored with the rows;
    rows that repeat a doc_id (or have none) stay rows of their own.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    own = [F.col(f"`{c}`") for c in dict.fromkeys((key, *columns))]
    total, ids, distinct = docs.agg(F.count(F.lit(1)), F.count(f"`{key}`"), F.countDistinct(f"`{key}`")).first()
    if total == ids == distinct and dict(docs.dtypes)[key] in ("bigint", "int", "smallint", "tinyint"):
        return docs.select(F.col(f"`{key}`").cast("long").alias("_rid"), *own, row)
    return saved(docs.select(F.monotonically_increasing_id().alias("_rid"), *own, row), "rows")


def restored(rows: DataFrame) -> DataFrame:
    """The columns that a table had before `keyed`."""
    return rows.select("_row.*")


def ordered_by(node: str, turn: int) -> Column:
    """An order of nodes: their own in the first two turns, then a random one for each turn."""
    return F.struct((F.lit(0).cast("long") if turn < 2 else F.xxhash64(F.col(node), F.lit(turn))).alias("h"), F.col(node).alias("v"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node of an edge; component is one of its nodes.

    In each turn every node joins its least neighbour (or stays, if it is the least itself) and the edges are
    contracted; edges that then lie inside a node are dropped and repeated ones combined, so the work shrinks from turn
    to turn: with random orders by a constant factor for any graph, and a star around its least node ends in one
    turn.  The turns' maps are composed at the end.  Joins are by shuffle between stored tables, so that adaptive
    execution can split a node with very many edges; nothing is gathered on the driver.
    """
    left = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        turn = len(maps)
        both = left.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")
        least = both.groupBy("v").agg(F.min(ordered_by("w", turn)).alias("m"))
        own = ordered_by("v", turn)
        maps.append(saved(least.select("v", F.when(own < F.col("m"), F.col("v")).otherwise(F.col("m.v")).alias("to")), f"{name}-map"))
        ends = [maps[-1].select(F.col("v").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b")]
        half = left.join(ends[0], "a").select(F.col("to_a").alias("a"), "b")
        moved = half.join(ends[1], "b").select("a", F.col("to_b").alias("b"))
        left = saved(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    if not maps:
        return left.selectExpr("a as node", "b as component")
    found = maps.pop()
    while maps:
        last = found.select(F.col("v").alias("to"), F.col("to").alias("further"))
        found = saved(maps.pop().join(last, "to", "left").select("v", F.coalesce("further", "to").alias("to")), f"{name}-found")
    return found.selectExpr("v as node", "to as component")


def as_text(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs whose text column is surely a string."""
    if column not in docs.columns:
        raise AnalysisException(f"column {column} is missing")
    return docs if dict(docs.dtypes)[column] == "string" else docs.withColumn(column, F.col(column).cast("string"))
