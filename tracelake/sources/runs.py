"""Run folders as a source: <run>/<executor folder>/<card>_<step>.json, of which conditions on step and card open no more files than they name.

    spark.read.format("run_events").load(folder).where("step = 3 and card in (0, 1)")

Spark hands such conditions to the reader, which drops files by their names before they become partitions.  Rows
are events as JSON texts with their places, and per file with a base time a row of pos -1.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import large

#: How the folders of a run and their files are named.
FOLDERS = "executor_trainer-runner_"
CARD_AND_STEP, STEP_ALONE = re.compile(r"([0-9]+)_([0-9]+)\.json", re.I), re.compile(r"step([0-9]+)\.json", re.I)
SCHEMA = "file string, step int, card int, pos bigint, event string, base_ns bigint"
_TESTS: dict[type, Callable] = {D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le}


def step_and_card(name: str) -> tuple[int, int] | None:
    """Of a file's name: <card>_<step>.json, else step<step>.json with card 0."""
    if m := CARD_AND_STEP.search(name):
        return int(m[2]), int(m[1])
    m = STEP_ALONE.search(name)
    return (int(m[1]), 0) if m else None


class RunFile(D.InputPartition):
    def __init__(self, uri: str, step: int, card: int) -> None:
        self.uri, self.step, self.card = uri, step, card


class RunReader(D.DataSourceReader):
    def __init__(self, folder: str, piece: int) -> None:
        self.folder, self.piece = folder, piece
        self.tests: list[Callable[[dict], bool]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        """Takes conditions on step and card, which the files' names decide; the others are Spark's."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column not in ("step", "card"):
                yield f
            elif type(f) in _TESTS:
                self.tests.append(lambda names, c=column, test=_TESTS[type(f)], value=f.value: test(names[c], value))
            elif isinstance(f, D.In):
                self.tests.append(lambda names, c=column, values=frozenset(f.value): names[c] in values)
            elif not isinstance(f, D.IsNotNull):  # they are never null
                yield f

    def partitions(self) -> list[RunFile]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.folder)
        found = []
        for folder in system.get_file_info(fs.FileSelector(path)):
            if folder.type != fs.FileType.Directory or not folder.base_name.startswith(FOLDERS):
                continue
            for file in system.get_file_info(fs.FileSelector(folder.path)):
                names = step_and_card(file.base_name) if file.type == fs.FileType.File and file.base_name.lower().endswith(".json") else None
                if names and all(test({"step": names[0], "card": names[1]}) for test in self.tests):
                    found.append(RunFile(f"{self.folder.rstrip('/')}/{folder.base_name}/{file.base_name}", *names))
        return sorted(found, key=lambda f: f.uri)

    def read(self, partition: RunFile) -> Iterator[pa.RecordBatch]:
        """The rows of a file; of a broken one none."""
        whole = large.facts(partition.uri, 0, 0, None, self.piece)
        if whole["quotes"] % 2 or whole["outside"] or whole["root"] not in ("{", "["):
            return
        held: list[tuple] = []
        for pos, event, base in events(partition.uri, self.piece):
            held.append((partition.uri, partition.step, partition.card, pos, event, base))
            if len(held) >= large.ROWS_AT_ONCE:
                yield large.batch_of(held, SCHEMA)
                held = []
        if held:
            yield large.batch_of(held, SCHEMA)


def events(uri: str, piece: int) -> Iterator[tuple[int, str | None, int | None]]:
    """(pos, event, None) of each event of a whole file, and (-1, None, base time)."""
    f, _ = large.opened(uri)
    scan = None
    with f:
        for got in large.pieces(f, 0, None, piece):
            if scan is None:
                root = got.removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode("latin-1")
                if not root:
                    continue
                scan = large.Range(root, False, 0, b"")
            found, bases, _ = scan.feed(got)
            yield from ((at, text.decode("utf-8", "replace"), None) for at, _, text in found)
            yield from ((-1, None, n) for n in bases)


def uri_of(folder: str) -> str:
    return folder if re.match("[a-z0-9]+:", folder) else f"file://{folder}"


class RunSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RunReader:
        return RunReader(uri_of(self.options["path"]), int(self.options.get("piece", large.PIECE)))


def run_events(spark: SparkSession, folder: str, step: int | None = None) -> DataFrame:
    """The events of a run's folder (or of one step), with step and card.  Turns on the session's setting for conditions in Python sources."""
    listed = RunReader(uri_of(folder), large.PIECE)
    listed.tests = [lambda names: step is None or names["step"] == step]
    if not listed.partitions():
        raise FileNotFoundError(f"no files of step {step}: {folder}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunSource)
    out = spark.read.format("run_events").load(folder)
    return out if step is None else out.where(F.col("step") == step)
