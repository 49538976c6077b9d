"""Reports that don't fit a sheet, and unknown formats."""

import zipfile

import pytest

from tracelake import sinks


def test_a_report_beyond_a_sheet_takes_several(spark, tmp_path):
    sinks.write(spark.range(1_048_576).coalesce(1), str(tmp_path), "report", ["xlsx"])
    (book,) = (tmp_path / "report.xlsx").glob("*.xlsx")
    with zipfile.ZipFile(book) as z:
        assert [z.read(f"xl/worksheets/sheet{i}.xml").count(b"<row>") for i in (1, 2)] == [1_048_576, 2]


def test_unknown_formats_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown format"):
        sinks.write(spark.range(1), str(tmp_path), "report", ["doc"])
