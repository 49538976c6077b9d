"""Workbooks (xlsx) as a sink that tasks write to.

    df.write.format("workbooks").option("path", folder).option("sheet", "step").mode("append").save()

Each task writes one workbook, row by row, under a name of its own in a folder `_temporary`; the commit names the
workbooks after their partitions, so that part-00000.xlsx, part-00001.xlsx, ... hold the rows in order, and removes what failed
or repeated tasks have left.  An aborted write leaves nothing.  A sheet begins where the column `sheet` changes, and where
a sheet is full.  Numbers and truth values are stored as such, other values as text; nulls are empty cells.
"""

from __future__ import annotations

import math
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO
from xml.sax.saxutils import escape

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a sheet, its header included, and characters of its name (limits of the format).
SHEET_ROWS, NAME_LENGTH = 1_048_576, 31
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]")


def cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) or (isinstance(value, float) and math.isfinite(value)):
        return f"<c><v>{value!r}</v></c>"
    text = _FORBIDDEN.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text, {chr(13): "&#13;"})}</t></is></c>'


class Workbook:
    """A workbook that is written sheet by sheet."""

    def __init__(self, out: IO[bytes], header: list[str]) -> None:
        self.zip, self.header = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), header
        self.names: list[str] = []
        self.sheet: IO[bytes] | None = None
        self.rows = 0

    def begin(self, name: str) -> None:
        self.end()
        plain = re.sub(r"[\[\]:*?/\\]", "_", name)[:NAME_LENGTH].strip("'") or "Sheet"
        known, n, unique = {x.lower() for x in self.names}, 1, plain
        while unique.lower() in known:
            n += 1
            unique = f"{plain[: NAME_LENGTH - 1 - len(str(n))]}_{n}"
        self.names.append(unique)
        self.sheet = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
        self.sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self.rows = 0
        self.add(self.header)

    def add(self, values: list) -> None:
        self.sheet.write(f"<row>{''.join(map(cell, values))}</row>".encode())
        self.rows += 1

    def end(self) -> None:
        if self.sheet:
            self.sheet.write(b"</sheetData></worksheet>")
            self.sheet.close()
            self.sheet = None

    def close(self) -> None:
        self.end()
        count = range(1, len(self.names) + 1)
        quoted = [escape(n, {'"': "&quot;"}) for n in self.names]
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in count) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(count, quoted, strict=True)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in count) + "</Relationships>",
        }
        for name, body in parts.items():
            self.zip.writestr(name, _HEAD + body)
        self.zip.close()


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    partition: int


class WorkbookWriter(DataSourceWriter):
    def __init__(self, folder: str, columns: list[str], sheet: str | None, sheet_rows: int, overwrite: bool) -> None:
        self.folder, self.columns, self.sheet, self.sheet_rows, self.overwrite = folder.rstrip("/"), columns, sheet, sheet_rows, overwrite

    def _at(self) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder if re.match("[a-z0-9]+:", self.folder) else f"file://{self.folder}")

    def write(self, iterator: Iterator[Row]) -> Written:
        partition, book, last = TaskContext.get().partitionId(), None, None
        system, path = self._at()
        name = f"{uuid.uuid4().hex}.xlsx"
        out = None
        for row in iterator:
            if book is None:
                system.create_dir(f"{path}/_temporary")
                out = system.open_output_stream(f"{path}/_temporary/{name}")
                book = Workbook(out, self.columns)
            this = str(row[self.sheet]) if self.sheet else "Sheet"
            if this != last or book.rows >= self.sheet_rows:
                book.begin(this)
                last = this
            book.add(list(row))
        if book is None:
            return Written(None, partition)
        book.close()
        out.close()
        return Written(name, partition)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, path = self._at()
        system.create_dir(path)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(path)):
                if old.base_name.endswith(".xlsx"):
                    system.delete_file(old.path)
        taken = {f.base_name for f in system.get_file_info(fs.FileSelector(path))}
        for m in sorted((m for m in messages if m and m.name), key=lambda m: m.partition):
            n = m.partition
            while (final := f"part-{n:05d}.xlsx") in taken:
                n += 1
            taken.add(final)
            system.move(f"{path}/_temporary/{m.name}", f"{path}/{final}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Removes what isn't committed."""
        from pyarrow import fs

        system, path = self._at()
        if system.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_temporary")


class WorkbookSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], schema.fieldNames(), self.options.get("sheet"), int(self.options.get("sheet_rows", SHEET_ROWS)), overwrite)


def write(df: DataFrame, folder: str, sheet: str | None = None, sheet_rows: int = SHEET_ROWS) -> None:
    """Writes df as workbooks below folder, in place of those there; with sheet its rows are dealt out and sorted by that column."""
    df.sparkSession.dataSource.register(WorkbookSink)
    out = df.repartitionByRange(sheet).sortWithinPartitions(sheet) if sheet else df
    writer = out.write.format("workbooks").mode("overwrite").option("path", folder).option("sheet_rows", str(sheet_rows))
    (writer.option("sheet", sheet) if sheet else writer).save()
