"""WARC archives: a writer and a Spark data source.

`write_archives` gives each page a record: the first one (smallest page_id) of equal payloads is a response,
the others are revisits that refer to it and carry no payload.  Payloads shorter than `least` bytes are
always responses.  `WarcSource` reads archives as a table: a partition per file, filters on record type and
headers pushed down, headers parsed first, and the payloads of records that a filter rejects, or whose content
no one asks for, stepped over (by a seek in plain archives).

Null payloads are empty ones.  A null page_id is written as an empty id and never is the first of others; repeated
rows are records of their own, of which one is the response.  A row whose url is null has an empty target.  Other
columns aren't written.  A broken or cut off record ends its partition with an error that names file and offset.  No files give no rows.
A task begins a new archive after ROLL_BYTES, since an archive is read by one task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.types import StructType

from .common import keyed, saved, scratch_dir
from .token_output import open_dir

SCHEMA = "path string, offset long, record_type string, record_id string, target_uri string, page_id string, payload_digest string, payload_length long, refers_to string, content_length long, content binary"
#: column -> header
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "page_id": "x-page-id",
    "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length", "refers_to": "x-refers-to-page",
}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MAGIC = b"WARC/1.1\r\n"
#: Bytes after which a writing task begins a new archive.
ROLL_BYTES = 1 << 30


# ---- writing --------------------------------------------------------------------------------------

def record(kind: str, page_id: str, url: str, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit has the HTTP head only."""
    body = HTTP + payload if kind == "response" else HTTP
    lines = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(body)}")
    return MAGIC + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, least: int = 0, compress: bool = False, folder: str | None = None, roll: int = ROLL_BYTES) -> str:
    """Writes the archives and returns their folder.  Files get their final name once they are whole."""
    spark = pages.sparkSession
    folder = folder or f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = keyed(pages.select(F.col("page_id").alias("doc_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload")), "url", "payload").drop("_row")
    named = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    digests = saved(named.select("_rid", "doc_id", "sha1", "size"), "digests")
    firsts = saved(digests.where(F.col("size") >= least).groupBy("sha1").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rid")).alias("f")).select("sha1", F.col("f.doc_id").alias("first_id"), F.col("f._rid").alias("first")), "firsts")
    origin = saved(digests.join(firsts, "sha1").where("_rid <> first").select("_rid", F.coalesce(F.col("first_id").cast("string"), F.lit("")).alias("refers_to")), "revisits")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_dir(folder)
        system.create_dir(path, recursive=True)
        name, sink, count, size = "", None, 0, 0
        done = lambda: pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([count], pa.int64())})
        for batch in batches:
            columns = [batch.column(c) for c in ("doc_id", "url", "payload", "refers_to")]
            for page_id, url, payload, refers_to in zip(*columns, strict=True):
                if sink is not None and size >= roll:
                    sink.close()
                    yield done()
                    sink = None
                if sink is None:
                    name, count, size = f"{path}/{uuid.uuid4().hex}.warc" + ".gz" * compress, 0, 0
                    sink = system.open_output_stream(f"{name}.part", compression=None)
                data = payload.as_py()
                refers = refers_to.as_py()
                page = "" if page_id.as_py() is None else str(page_id.as_py())
                one = record("response" if refers is None else "revisit", page, url.as_py(), base32_sha1(data), data, refers)
                size += sink.write(gzip.compress(one, 6) if compress else one)
                count += 1
        if sink is not None:
            sink.close()
            yield done()

    done = saved(rows.join(origin, "_rid", "left").select("doc_id", "url", "payload", "refers_to").mapInArrow(write, "name string, records long"), "archives")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = open_dir(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                if system.get_file_info(name).type == fs.FileType.NotFound:  # else an earlier attempt has moved it
                    system.move(f"{name}.part", name)
            yield batch

    done.mapInArrow(finish, "name string, records long").write.format("noop").mode("overwrite").save()
    return folder


# ---- reading --------------------------------------------------------------------------------------

class Archive(InputPartition):
    """One archive file."""

    def __init__(self, path: str) -> None:
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names = [f.name for f in schema.fields]
        self.folder = options["path"]
        self.payload = str(options.get("content", "true")).lower() == "true" and "content" in self.names
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes filters on record type and headers; gives back the others."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and column != "payload_length" and isinstance(f, EqualTo):
                self.tests.append((HEADERS[column], "in", (f.value,)))
            elif column in HEADERS and column != "payload_length" and isinstance(f, In):
                self.tests.append((HEADERS[column], "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((HEADERS[column], "starts", f.value))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((HEADERS[column], "there", None))
                if column == "payload_length":
                    yield f
            else:
                yield f

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        system, path = open_dir(self.folder)
        found = [system.get_file_info(path)]
        if found[0].type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(f.path for f in found if f.is_file and re.search(r"\.warc(\.gz)?$", f.path))
        return [Archive(n) for n in names or [""]]

    def wanted(self, head: dict[str, str]) -> bool:
        for header, how, value in self.tests:
            have = head.get(header)
            if have is None or (how == "in" and have not in value) or (how == "starts" and not have.startswith(value)):
                return False
        return True

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = open_dir(self.folder)
        with system.open_input_file(partition.path) as raw:
            rows = self.records(gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else raw, partition.path)
            held, size = [], 0
            for row in rows:
                held.append(row)
                size += len(row[-1] or b"")
                if len(held) >= 1000 or size >= 8 << 20:
                    yield self.batch(held)
                    held, size = [], 0
            if held:
                yield self.batch(held)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"offset": pa.int64(), "payload_length": pa.int64(), "content_length": pa.int64(), "content": pa.binary()}
        order = ["path", "offset", *HEADERS, "content_length", "content"]
        columns = dict(zip(order, zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds.get(n, pa.string())) for n in self.names], self.names)

    def records(self, f, path: str) -> Iterator[tuple]:
        """Parses heads; reads a payload only if the head is wanted, else steps over it."""
        buffered, offset = Buffered(f), 0
        while True:
            head_bytes = buffered.until(b"\r\n\r\n")
            if not head_bytes:
                return
            if not head_bytes.startswith(b"WARC/") or not head_bytes.endswith(b"\r\n\r\n"):
                raise ValueError(f"no whole WARC head at {offset} of {path}")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head_bytes.decode("utf-8", "replace").split("\r\n")[1:]) if k}
            if not re.fullmatch(r"[0-9]+", head.get("content-length", "")):
                raise ValueError(f"no Content-Length in the WARC record at {offset} of {path}")
            length = int(head["content-length"])
            if self.wanted(head):
                body = None
                if self.payload:
                    body = buffered.take(length)
                    if len(body) < length:
                        raise ValueError(f"the WARC record at {offset} of {path} is cut off")
                    body = body[body.find(b"\r\n\r\n") + 4 :] if "application/http" in head.get("content-type", "") else body
                else:
                    buffered.skip(length)
                digest = head.get("warc-payload-digest")
                values = [head.get(h) for h in HEADERS.values()]
                names = list(HEADERS)
                values[names.index("payload_digest")] = digest.partition(":")[2] if digest else None
                size = values[names.index("payload_length")]
                values[names.index("payload_length")] = int(size) if size else None
                yield (path, offset, *values, length, body)
            else:
                buffered.skip(length)
            if buffered.take(4) != b"\r\n\r\n":
                raise ValueError(f"the WARC record at {offset} of {path} is cut off or longer than it says")
            offset += len(head_bytes) + length + 4


class Buffered:
    """Reads ahead in chunks; skips by seeking where the file can."""

    def __init__(self, f, chunk: int = 1 << 18) -> None:
        self.f, self.chunk, self.data, self.at = f, chunk, b"", 0

    def _more(self, n: int) -> bool:
        got = self.f.read(max(n, self.chunk))
        self.data, self.at = self.data[self.at :] + got, 0
        return bool(got)

    def until(self, mark: bytes) -> bytes:
        """All bytes up to and with the mark; all that is left where there is none."""
        while (k := self.data.find(mark, self.at)) < 0:
            if not self._more(self.chunk):
                k = len(self.data)
                break
        out = self.data[self.at : k + len(mark)]
        self.at = k + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) - self.at < n and self._more(n - (len(self.data) - self.at)):
            pass
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        have = len(self.data) - self.at
        if n <= have:
            self.at += n
            return
        self.data, self.at = b"", 0
        if self.f.seekable():
            self.f.seek(n - have, 1)
        else:
            self.take(n - have)


class WarcSource(DataSource):
    """spark.read.format("warc").option("content", "false").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))


def read_archives(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("content", str(content).lower()).load(folder)
