"""Workbooks that tasks write: read back, in order, with nothing left of failed tasks."""

import re
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tracelake import sinks, workbooks

NS = {"m": workbooks._MAIN}


def read(path):
    """{sheet: rows} of a workbook."""
    out = {}
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", NS)]
        for i, name in enumerate(names, 1):
            assert f"/xl/worksheets/sheet{i}.xml" in z.read("[Content_Types].xml").decode()
            rows = []
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{{{workbooks._MAIN}}}row"):
                values = []
                for c in row:
                    v, t = c.find("m:v", NS), c.find("m:is/m:t", NS)
                    values.append(t.text or "" if t is not None else None if v is None else bool(int(v.text)) if c.get("t") == "b" else float(v.text))
                rows.append(values)
            out[name] = rows
    return out


def books(folder):
    files = sorted(folder.glob("part-*.xlsx"))
    assert sorted(p.name for p in folder.iterdir()) == [f.name for f in files]
    return [read(f) for f in files]


def test_rows_come_back_in_order(spark, tmp_path):
    texts = ["plain", "a <b> & \"c\"", " edge ", "", None, "line\nbreak\rand tab\t", "\x01\x0b", "日本 🦊", "=1+1"]
    rows = [(i, texts[i % len(texts)], i / 3, i % 2 == 0, None) for i in range(200)] + [(200, "nan", float("nan"), None, None)]
    df = spark.createDataFrame(rows, "n long, t string, x double, b boolean, z string").orderBy("n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        (path,) = sinks.write(df, str(tmp_path), "report", ["xlsx"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = books(tmp_path / "report.xlsx")
    assert path.endswith("report.xlsx") and len(found) > 1
    got = []
    for book in found:
        for sheet in book.values():
            assert sheet[0] == ["n", "t", "x", "b", "z"]
            got += sheet[1:]
    plain = lambda t: None if t is None else t.replace("\x01", "_x0001_").replace("\x0b", "_x000B_")
    assert got == [[n, plain(t), x if x == x else "nan", b, None] for n, t, x, b, _ in rows]
    sinks.write(df.limit(3), str(tmp_path), "report", ["xlsx"])  # in place of what was there
    assert sum(len(s) - 1 for b in books(tmp_path / "report.xlsx") for s in b.values()) == 3


def test_a_sheet_for_each_step_and_full_sheets(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 3).alias("step"), "id")
    workbooks.write(df, str(tmp_path / "w"), "step", sheet_rows=9)
    sheets = [(name, rows) for book in books(tmp_path / "w") for name, rows in book.items()]
    assert all(len(rows) <= 9 for _, rows in sheets) and {re.split("_", n)[0] for n, _ in sheets} == {"0", "1", "2"}
    assert sorted(r[1] for n, rows in sheets for r in rows[1:]) == list(range(60)) and all(r[0] == float(n[0]) for n, rows in sheets for r in rows[1:])


def test_failed_tasks_leave_nothing(spark, tmp_path):
    spark.dataSource.register(workbooks.WorkbookSink)
    broken = F.udf(lambda i: i if i != 37 else 1 / 0, "long")
    with pytest.raises(Exception, match="ZeroDivision"):
        workbooks.write(spark.range(0, 40, 1, 4).select(broken("id").alias("n")), str(tmp_path / "w"))
    assert not list((tmp_path / "w").glob("*.xlsx")) and not (tmp_path / "w" / "_temporary").exists()
    # what a first attempt of a task has left goes with the commit
    writer = workbooks.WorkbookWriter(str(tmp_path / "v"), ["n"], None, 100, False)
    TaskContext._getOrCreate()._partitionId = 4
    try:
        lost, kept = writer.write(iter([(1,), (2,)])), writer.write(iter([(1,), (2,)]))
        assert len(list((tmp_path / "v" / "_temporary").iterdir())) == 2 and lost.name != kept.name
        writer.commit([kept, None, workbooks.Written(None, 5)])
    finally:
        TaskContext._taskContext = None
    assert books(tmp_path / "v") == [{"Sheet": [["n"], [1.0], [2.0]]}]
