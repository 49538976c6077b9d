"""Filtering the nodes of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import millis_of

#: Fixed value: a node's name ends in its id and its attempt.
NAME = r"executor_[\w-]+_(\d+)_(\d+)"


def node_id(name: Column) -> Column:
    return F.regexp_extract(name, NAME, 1).try_cast("int")


def attempt(name: Column) -> Column:
    return F.regexp_extract(name, NAME, 2).try_cast("int")


def filter_nodes(nodes: DataFrame, state: str | None = None, node: int | None = None, attempts: int | None = None,
                 launched: tuple[object, object] = (None, None), released: tuple[object, object] = (None, None)) -> DataFrame:
    """Nodes of a state (any case), id, attempt and of launch and release times within closed bounds.

    Bounds are milliseconds or ISO-8601 times; a node without the time fails any bound on it.
    """
    out = nodes
    if state is not None:
        out = out.where(F.upper("state") == state.upper())
    if node is not None:
        out = out.where(node_id(F.col("node")) == node)
    if attempts is not None:
        out = out.where(attempt(F.col("node")) == attempts)
    for column, (low, high) in (("launchTime", launched), ("releaseTime", released)):
        if low is not None:
            out = out.where(F.col(column) >= millis_of(F.lit(low)))
        if high is not None:
            out = out.where(F.col(column) <= millis_of(F.lit(high)))
    return out


def wanted_file(name: Column, include: str | None = None, exclude: str | None = None) -> Column:
    """Whether a file's name matches include and not exclude; a broken include matches nothing, a broken exclude either."""
    from ..functions.patterns import _valid

    keep = F.lit(True) if include is None else name.rlike(include) if _valid(include) else F.lit(False)
    return keep & ~name.rlike(exclude) if exclude is not None and _valid(exclude) else keep
