"""Writing reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from . import workbooks

FORMATS = ("csv", "json", "parquet", "xlsx")
#: Short words in the names of reports.
SHORT = {"dtype": "dtype", "shape": "shape", "kernel_names": "kernel", "kernel_duration": "duration", "timestamp": "ts", "name": "name", "call_stack": "stack", "stream": "stream"}
COUNTED = {"include_op": "inc_op", "exclude_op": "exc_op", "include_kernel": "inc_ker", "exclude_kernel": "exc_ker"}


def base_name(fields: Sequence[str], show: Sequence[str], labels: Sequence[str] = (), filters: dict[str, Sequence[str]] | None = None, label: str | None = None) -> str:
    """The name of a report from what it holds."""
    parts = [label] if label else []
    parts.append("comparison")
    if labels:
        parts.append("_vs_".join(labels))
    parts.append("by_" + "_".join(fields))
    parts += [s for c, s in SHORT.items() if c in show]
    parts += [f"{s}_{len(filters[c])}" for c, s in COUNTED.items() if filters and filters.get(c)]
    return "_".join(parts)


def write(df: DataFrame, folder: str, name: str, formats: Sequence[str] = ("csv", "json"), partition: str | None = None) -> list[str]:
    """Writes df in each format below folder and returns the paths.

    A sorted report keeps its order over the part files.  xlsx gives a folder of workbooks, one a task (`workbooks`), with a
    sheet for each value of partition.
    """
    out = []
    for f in formats:
        path = f"{folder.rstrip('/')}/{name}.{f}"
        if f == "xlsx":
            workbooks.write(df, path, partition)
        elif f in FORMATS:
            writer = df.write.mode("overwrite").format(f)
            writer = writer.option("header", True) if f == "csv" else writer
            (writer.partitionBy(partition) if partition else writer).save(path)
        else:
            raise ValueError(f"unknown format {f}; known: {', '.join(FORMATS)}")
        out.append(path)
    return out
