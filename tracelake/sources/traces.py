"""Reading profiler traces (JSON, also compressed), collectives of a run and time ranges of run folders."""

from __future__ import annotations

import random
import re
import warnings
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ends, large, runs

#: Bytes from which a file is read by ranges.
LARGE = 128 << 20
_FILE = "baseTimeNanoseconds bigint, traceEvents array<variant>"
_EVENT = "name variant, cat variant, ph variant, pid variant, tid variant, ts variant, dur variant, args variant, id variant, stream variant"
#: The types that entries have as a rule, and a column for texts in which they have others.
_BAD = "_not_as_typed"
_TEXTS = ("name", "cat", "ph", "pid", "tid", "id")
_TYPED = (
    f"{', '.join(f'{c} string' for c in _TEXTS)}, ts double, dur double, stream bigint, args struct<`External id` variant, `Input type` string, `Input Dims` variant, stream bigint, "
    "`In msg nelems` bigint, `Out msg nelems` bigint, `Group size` bigint, dtype string, `Process Group Ranks` string>"
)
_FIELDS = re.sub(r"(`[^`]+`|\w+) (?=\w)", r"\1: ", _TYPED)
#: Texts that may come from a number or from brackets, and may be written otherwise there; whole numbers are written alike.
_NO_TEXT = r"(?m)^(?:[\[{\"]|-0$|-?\d{19,}$|-?\d+\.\d+(?:[eE][+-]?\d+)?$|-?\d+[eE][+-]?\d+$)"
#: Fixed value: how trace files in run folders are named.
RUN_FILES = "trace_*.json"


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """The JSON files that a path, folder or glob names, sorted; works on any store that Spark reads.

    A file that is named itself is read whatever its ending; other files are left out.  Both give a warning.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(path) or []
    names: list[str] = []
    for status in found:
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        names += [s.getPath().toString() for s in inner if s.isFile()]
    alone = len(found) == 1 and found[0].isFile()
    odd = [n for n in names if not n.lower().endswith((".json", ".json.gz"))]
    if odd:
        warnings.warn(f"{'may not be JSON' if alone else 'left out, not JSON'}: {', '.join(odd[:3])}{' ...' if len(odd) > 3 else ''}", stacklevel=2)
    out = sorted(names if alone else set(names) - set(odd))
    if not out:
        raise FileNotFoundError(f"no JSON files: {pattern}")
    return out


def labelled_files(spark: SparkSession, spec: str, most: int | None = None, seed: int = 42) -> tuple[str, list[str]]:
    """(label, files) of "paths:label", where paths is a file, a folder, a glob or a comma-separated list.

    Without a label the first file's stem is it.  most files are drawn with the seed.
    """
    paths, colon, label = spec.rpartition(":")
    if not colon or "/" in label:
        paths, label = spec, spec.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
    files = [f for p in paths.split(",") if p.strip() for f in list_files(spark, p.strip())]
    if most is not None and len(files) > most:
        files = random.Random(seed).sample(files, most)
    return label, files


def sized_files(spark: SparkSession, paths: Sequence[str] | str, more_than: int = -1) -> list[tuple[str, int]]:
    """(URI, bytes) of the files that paths, folders or globs name; of those with more bytes alone (compressed ones count with what they hold, about)."""
    names = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("n"))
    return [(r.file, r.n) for r in names.where(weight("file", "n") > more_than).collect()]


def weight(file: str, size: str) -> Column:
    """Bytes of a file when it is read, about."""
    return F.when(F.col(file).endswith(".gz"), F.col(size) * large.PACKED).otherwise(F.col(size))


def read_traces(spark: SparkSession, paths: Sequence[str] | str, label: str | None = None, most: int = LARGE) -> DataFrame:
    """Events of trace files: one row per entry of traceEvents (or of a bare top-level array).

    A file of up to `most` bytes is parsed whole; larger ones are scanned by ranges (`read_large_traces`).  pos is the entry's place in its file (for bare arrays a number that ascends in the file's order).  A missing name, category or phase is an empty text, a missing ts 0, a
    missing dur null.  Malformed files give no rows; entries that aren't objects give rows of defaults.
    ext_id keeps numbers and texts apart ("1" and 1 differ).
    """
    raw = spark.read.schema(f"{_FILE}, {_EVENT}").option("multiLine", True).json(paths if isinstance(paths, str) else list(paths))
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    big = sized_files(spark, paths, most)
    if big:
        raw = raw.where(weight("file", "size") <= most)  # on metadata alone: Spark doesn't open the others
    event = [c.split()[0] for c in _EVENT.split(", ")]
    objects = raw.where("traceEvents is not null").select("file", F.col("baseTimeNanoseconds").alias("base_ns"), F.posexplode("traceEvents").alias("pos", "e"))
    objects = objects.select("file", "base_ns", F.col("pos").cast("bigint").alias("pos"), *(F.try_variant_get("e", f"$.{c}", "variant").alias(c) for c in event))
    present = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in event))
    bare = raw.where(F.col("traceEvents").isNull() & present).select("file", F.lit(None).cast("bigint").alias("base_ns"), F.monotonically_increasing_id().alias("pos"), *event)
    out = parsed_events(objects.unionByName(bare), label)
    return out.unionByName(_scanned(spark, big, label)) if big else out


def read_large_traces(spark: SparkSession, paths: Sequence[str] | str, label: str | None = None, size: int = large.RANGE) -> DataFrame:
    """read_traces for files of any size, each read by as many tasks as it has ranges of `size` bytes.  A broken file raises."""
    return _scanned(spark, sized_files(spark, paths), label, size)


def _scanned(spark: SparkSession, files: list[tuple[str, int]], label: str | None, size: int = large.RANGE) -> DataFrame:
    packed, plain = ([x for x in files if x[0].endswith(".gz") == gz] for gz in (True, False))
    parts = [events_of(large.read_events(spark, plain, size), label)] if plain or not packed else []
    return reduce(DataFrame.unionByName, [*parts, *([events_of_lists(large.read_compressed(spark, packed), label)] if packed else [])])


#: What typed texts must not have: other quotes and numbers than JSON has.
_STRICT = {"columnNameOfCorruptRecord": _BAD, "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def events_of(rows: DataFrame, label: str | None = None) -> DataFrame:
    """The event schema from texts (file, base_ns, pos, event).

    Texts are read with the types that entries have as a rule.  Those that have others (a text for a time, a pid with a fraction), or that
    aren't objects, are read again as variants, so that the rows are those of `parsed_events`, but for an entry of two equal keys: here the last one counts.
    """
    read = rows.withColumn("_t", F.from_json("event", f"{_TYPED}, {_BAD} string", _STRICT))
    return _events_of(read.withColumn("_t", F.when(F.col(f"_t.{_BAD}").isNull(), F.col("_t"))), label)


def events_of_lists(rows: DataFrame, label: str | None = None) -> DataFrame:
    """`events_of` texts that stand in lists (file, base_ns, pos of the first, events), of which a parser reads one at once."""
    text = F.concat(F.lit('{"v":['), F.array_join("events", ",", "null"), F.lit("]}"))
    read = rows.withColumn("_l", F.from_json(text, f"v array<struct<{_FIELDS}>>, {_BAD} string", _STRICT))
    # where one doesn't fit, each is read by itself
    fits = F.col(f"_l.{_BAD}").isNull() & (F.size("_l.v") == F.size("events"))
    typed = F.when(fits, F.col("_l.v")).otherwise(F.array_repeat(F.lit(None).cast(f"struct<{_FIELDS}>"), F.size("events")))
    each = read.select("file", "base_ns", "pos", F.posexplode(F.arrays_zip(F.col("events").alias("event"), typed.alias("t"))).alias("_i", "_z"))
    return _events_of(each.select("file", "base_ns", (F.col("pos") + F.col("_i")).alias("pos"), F.col("_z.event").alias("event"), F.col("_z.t").alias("_t")), label)


def _events_of(read: DataFrame, label: str | None) -> DataFrame:
    """Events from texts and what typed reading makes of them, null where the types don't fit."""
    texts = F.concat_ws("\n", *(F.col(f"_t.{c}") for c in (*_TEXTS, "args.`Input type`", "args.dtype", "args.`Process Group Ranks`")))
    read = read.withColumn("_odd", F.col("_t").isNull() | texts.rlike(_NO_TEXT))
    # variants know no negative zero
    typed = _columns(lambda c, kind: F.col(f"_t.{c}") + 0.0 if kind == "double" else F.col(f"_t.{c}"), lambda key, kind: F.col(f"_t.args.`{key}`"))
    again = lambda e: _columns(lambda c, kind: F.try_variant_get(e, f"$.{c}", kind), lambda key, kind: F.try_variant_get(e, f"$.args['{key}']", kind))
    # inside a transform, of which no code is made: with that for rare texts the code for all others would be too long for the JVM to compile
    other = F.transform(F.array(F.try_parse_json("event")), lambda e: F.struct(*(v.alias(k) for k, v in again(e).items())))[0]
    read = read.withColumn("_o", F.when(F.col("_odd"), other))
    args = F.try_variant_get(F.try_parse_json("event"), "$.args", "variant").alias("args")
    return read.select("file", F.lit(label).cast("string").alias("label"), "base_ns", "pos", *(F.when(F.col("_odd"), F.col(f"_o.{c}")).otherwise(v).alias(c) for c, v in typed.items()), args)


def _get(column: str, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(column, path, kind)


def parsed_events(rows: DataFrame, label: str | None = None, also: Sequence[str] = ()) -> DataFrame:
    """The event schema from columns of variants, and columns that are kept."""
    columns = _columns(lambda c, kind: _get(c, kind), lambda key, kind: _get("args", kind, f"$['{key}']"))
    return rows.select("file", F.lit(label).cast("string").alias("label"), "base_ns", "pos", *(v.alias(k) for k, v in columns.items()), "args", *also)


def _columns(field: Callable[[str, str], Column], arg: Callable[[str, str], Column]) -> dict[str, Column]:
    """What an event's entries make of its columns; field and arg give an entry, or one of args, as a type."""
    return {
        **{c: F.coalesce(field(c, "string"), F.lit("")) for c in ("name", "cat", "ph")},
        **{c: F.coalesce(field(c, "string"), F.lit("0")) for c in ("pid", "tid")},
        "ts": F.coalesce(field("ts", "double"), F.lit(0.0)), "dur": field("dur", "double"),
        "flow_id": field("id", "string"),
        "stream_id": F.coalesce(field("stream", "bigint"), arg("stream", "bigint")),
        "ext_id": F.to_json(arg("External id", "variant")), "dtype": arg("Input type", "string"),
        "shape": F.to_json(arg("Input Dims", "variant")),
        "in_msg_nelems": arg("In msg nelems", "bigint"), "out_msg_nelems": arg("Out msg nelems", "bigint"), "group_size": arg("Group size", "bigint"),
        "comm_dtype": arg("dtype", "string"), "process_group_ranks": arg("Process Group Ranks", "string"),
    }


def argument(key: str, kind: str = "string") -> Column:
    """A further entry of args, null if it is missing or of another kind."""
    return _get("args", kind, f"$['{key}']")


def step_and_card(file: Column) -> tuple[Column, Column]:
    """(step, card) of a file's name: <card>_<step>.json, else step<step>.json with card 0, else nulls."""
    name = F.element_at(F.split(file, "/"), -1)
    both = [F.regexp_extract(name, r"(?i)(\d+)_(\d+)\.json", i).try_cast("int") for i in (1, 2)]
    alone = F.regexp_extract(name, r"(?i)step(\d+)\.json", 1).try_cast("int")
    return F.coalesce(both[1], alone), F.coalesce(both[0], F.when(alone.isNotNull(), F.lit(0)))


def read_collectives(spark: SparkSession, run_folder: str, step: int | None = None) -> DataFrame:
    """Events of a run's executors with step and card; conditions on these keep files of others from being opened."""
    rows = runs.run_events(spark, run_folder.rstrip("/"), step)
    base = rows.where("pos < 0").groupBy("file", "step", "card").agg(F.max("base_ns").alias("base_ns"))
    parsed = rows.where("pos >= 0").drop("base_ns").join(base, ["file", "step", "card"], "left")
    parsed = parsed.select("step", "card", F.col("file"), "base_ns", "pos", F.try_parse_json("event").alias("e"))
    event = [c.split()[0] for c in _EVENT.split(", ")]
    out = parsed_events(parsed.select("step", "card", "file", "base_ns", "pos", *(F.try_variant_get("e", f"$.{c}", "variant").alias(c) for c in event)), also=("step", "card"))
    return out.withColumn("dtype", F.col("comm_dtype"))


def time_range(events: DataFrame) -> DataFrame:
    """Per file: start and end in nanoseconds since the epoch, of its first and last entry that has a time."""
    ns = lambda ts: F.col("base_ns") + (ts * 1000).cast("bigint")
    ends = events.groupBy("file", "base_ns").agg(F.min_by("ts", "pos").alias("_a"), F.max_by("ts", "pos").alias("_b"))
    return ends.select("file", ns(F.col("_a")).alias("start"), ns(F.col("_b")).alias("end"))


def time_ends(spark: SparkSession, paths: Sequence[str] | str, named: bool = False) -> DataFrame:
    """`time_range` of files of any size, from their first and last bytes (named: of entries that have a category)."""
    ns = lambda ts: (F.col("base_ns") + (F.col(ts) * 1000).cast("bigint")).alias
    found = ends.read_ends(spark, sized_files(spark, paths), named).where("first is not null")
    return found.select("file", ns("first")("start"), ns("last")("end"))


def run_folder_ranges(spark: SparkSession, root: str) -> DataFrame:
    """(path, start, end) of each folder under root, from the ends of the first of its trace files."""
    first: dict[str, str] = {}
    for f in list_files(spark, f"{root.rstrip('/')}/*/{RUN_FILES}"):
        first.setdefault(f.rsplit("/", 1)[0], f)
    return time_ends(spark, sorted(first.values())).select(F.regexp_replace("file", "/[^/]*$", "").alias("path"), "start", "end")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Saved node lists (JSON arrays)."""
    return spark.read.schema("node string, state string, launchTime bigint, releaseTime bigint, podName string, logUrl string, id string").option("multiLine", True).json(path)
