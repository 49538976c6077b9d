"""The three analyses over trace files: costs per group of operations, comparison of labels, collectives across ranks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.text import normalize_stack, phase, stack_text, strip_kernel_suffix, two_decimals
from ..functions.time import readable
from ..operators import aggregate, comm, compare, correlate, flow
from ..operators.nesting import THREAD, nest, nest_small
from ..sources import traces
from ..storage import saved

#: What a report can show of a group.
SHOWN = ("dtype", "shape", "kernel_names", "kernel_duration", "timestamp", "readable_timestamp", "kernel_timestamp", "name", "call_stack", "stream", "pid", "tid", "fwd_bwd_type", "op_index")
COMPARED = ("dtype", "shape", "name", "kernel_name")


@dataclass(frozen=True)
class Filters:
    include_op: Sequence[str] = ()
    exclude_op: Sequence[str] = ()
    include_kernel: Sequence[str] = ()
    exclude_kernel: Sequence[str] = ()


class Counts:
    """Rows at the steps of an analysis, counted while the steps' tables are written: no job of their own."""

    def __init__(self) -> None:
        self.seen: list[tuple[str, Observation]] = []

    def __call__(self, df: DataFrame, step: str) -> DataFrame:
        seen = Observation()
        self.seen.append((step, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def rows(self) -> dict[str, int]:
        """The counts by step, once the report is written."""
        return {step: seen.get["rows"] for step, seen in self.seen}


#: What `prepared` keeps of events: not the entries that collectives alone have.
_KEPT = ("file", "label", "base_ns", "pos", "name", "cat", "ph", "pid", "tid", "ts", "dur", "flow_id", "stream_id", "ext_id", "dtype", "shape")
#: The columns of an operation's kernel, and their names beside the operation's.
_KERNEL = {"name": "k_name", "ts": "k_ts", "dur": "k_dur", "stream_id": "k_stream", "pos": "k_pos"}
#: Ids spread rows further than files do, so they come first where rows are sorted.
_BY_ID = ["ext_id", "file"]
#: Threads of a file go into BUCKETS; those of a bucket of up to SMALL operations are nested without being cut.
BUCKETS, SMALL = 64, 1_000_000


def _timed(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(events, files, others, buckets) of stored events.

    Events have times that count from their file's first event, readable ones, and as file its number in the order of names,
    which is shorter; files hold the names.  others are the threads that hold more than operations, buckets (file, bucket) those
    with too many operations to be small.
    """
    placed, cpu = F.coalesce(F.col("dur") > 0, F.lit(False)), F.col("cat") == "cpu_op"
    keys = {"bucket": F.when(placed & cpu, _bucket())} | {c: F.when(placed & ~cpu, F.col(c).try_cast("bigint")) for c in ("pid", "tid")}
    found = events.groupBy("file", *(v.alias(k) for k, v in keys.items())).agg(F.min("ts").alias("_first"), F.count(F.lit(1)).alias("_n"))
    found = saved(found, "found")  # few rows: of all threads those alone that hold more than operations
    files = found.groupBy("file").agg(F.min("_first").alias("_first"))
    files = saved(files.withColumn("_file", F.row_number().over(W.orderBy("file"))), "first")  # a row a file
    timed = events.join(files, "file").withColumn("readable_timestamp", readable(F.col("base_ns"), F.col("ts"))).withColumn("ts", F.col("ts") - F.col("_first"))
    found = found.join(files.select("file", "_file"), "file").withColumn("file", F.col("_file"))
    others = saved(found.where("pid is not null and tid is not null").select(*THREAD), "others")
    large = found.where((F.col("_n") > SMALL) & F.col("bucket").isNotNull()).select("file", "bucket")
    return timed.withColumn("file", F.col("_file")).drop("_first", "_file"), files.select(F.col("_file").alias("file"), F.col("file").alias("_name")), others, large


def _bucket() -> Column:
    return F.pmod(F.xxhash64(F.col("pid").try_cast("bigint"), F.col("tid").try_cast("bigint")), F.lit(BUCKETS))


def _named(df: DataFrame, files: DataFrame) -> DataFrame:
    """df with the names of its files instead of their numbers."""
    return df.join(files, "file").withColumn("file", F.col("_name")).drop("_name")


def _placed(timed: DataFrame, others: DataFrame, buckets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows on threads that hold operations, with columns, call_stack and fwd_bwd_type: no others have a stack or a phase.

    The pid and tid of columns are called _pid and _tid, since those of threads are numbers.
    """
    texts = {c: f"_{c}" for c in ("pid", "tid")}
    needed = ("file", "pos", "name", "cat", "ts", "dur")
    rest = [F.col(c).alias(texts.get(c, c)) for c in columns if c not in needed]
    numbers = [F.col(c).try_cast("bigint").alias(c) for c in texts]
    threads = timed.where("dur > 0").select(*needed, *numbers, *rest)
    cpu, other = threads.where("cat = 'cpu_op'"), threads.where("cat <> 'cpu_op'")
    # others are few as a rule, which Spark knows since they are stored
    mixed = saved(cpu.select(*THREAD).join(others, list(THREAD), "left_semi").distinct(), "mixed")
    rows = nest_small(cpu)
    if not (buckets.isEmpty() and mixed.isEmpty()):
        large = cpu.select(*THREAD, _bucket().alias("bucket")).join(buckets, ["file", "bucket"], "left_semi").select(*THREAD)
        large = saved(large.unionByName(mixed).distinct(), "large")
        by_time = nest(cpu.join(large, list(THREAD), "left_semi").unionAll(other.join(mixed, list(THREAD), "left_semi")))
        rows = nest_small(cpu.join(large, list(THREAD), "left_anti")).unionByName(by_time)
    placed = saved(rows.drop("call_stack", "parent_pos", "depth"), "nested")
    stack = F.filter(F.transform("path", lambda p: p["name"]), lambda n: n != "ROOT")
    placed = placed.withColumn("call_stack", F.when(F.col("cat") == "cpu_op", stack))
    placed = placed.withColumn("phase", F.when(F.col("cat") == "cpu_op", phase(F.col("call_stack"))).otherwise("none"))
    flows = timed.where("cat = 'fwdbwd'").select("file", "pos", "ph", "ts", "flow_id")
    paired = saved(flow.paired_operations(placed, saved(flow.flow_pairs(flows), "pairs")), "paired")
    out = flow.propagate(placed, paired).withColumnRenamed("phase", "fwd_bwd_type")
    return out.select(*(F.col(texts.get(c, c)).alias(c) for c in columns), "call_stack", "fwd_bwd_type")


def _operations(timed: DataFrame, placed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All operations: those that have a place, and the others without stack."""
    on_thread = (F.col("dur") > 0) & F.col("pid").try_cast("bigint").isNotNull() & F.col("tid").try_cast("bigint").isNotNull()
    others = timed.where((F.col("cat") == "cpu_op") & ~F.coalesce(on_thread, F.lit(False)))
    others = others.select(*columns, F.lit(None).cast("array<string>").alias("call_stack"), F.lit("none").alias("fwd_bwd_type"))
    return placed.where("cat = 'cpu_op'").unionByName(others)


def enriched(events: DataFrame) -> DataFrame:
    """Events with readable and normalised times, call stacks and phases.

    Times count from the file's first event.  Operations outside any thread or without dur have no stack.
    """
    timed, files, others, buckets = _timed(saved(events.drop("args"), "events"))
    placed = _placed(timed, others, buckets, timed.columns)
    below = saved(placed.where("cat <> 'cpu_op' and fwd_bwd_type <> 'none'").select("file", "pos", "call_stack", "fwd_bwd_type"), "below")  # of backward operations
    rest = timed.where("cat <> 'cpu_op'").join(below, ["file", "pos"], "left").fillna("none", ["fwd_bwd_type"])
    return _named(_operations(timed, placed, timed.columns).unionByName(rest), files)


def prepared(events: DataFrame, filters: Filters = Filters(), coarse: bool = False, counts: Counts | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(operations, kernels) that launched one another, filtered, with representatives alone and op_index."""
    cpu, kernels, files = _prepared(events, filters, coarse, counts)
    return _named(cpu.drop(*_KERNEL.values()), files), _named(kernels, files)


def _prepared(events: DataFrame, filters: Filters, coarse: bool, counts: Counts | None, unread: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`prepared` with numbers as files, the columns of their kernel beside those of operations, and the files' names.

    Kernels need neither stacks nor phases, so they are reduced to one an id before they meet the operations, which is where both are
    stored: once.  unread: which of op_index and readable_timestamp needn't be made.
    """
    counted = counts or (lambda df, step: df)
    timed, files, others, buckets = _timed(saved(counted(events.select(*_KEPT), "events"), "events"))
    columns = [c for c in ("file", "label", "pos", "name", "cat", "pid", "tid", "ts", "dur", "ext_id", "dtype", "shape", "readable_timestamp") if c not in unread]
    name = strip_kernel_suffix(F.col("name"))
    cpu = _operations(timed, _placed(timed, others, buckets, columns), columns).where("ext_id is not null").withColumn("name", name)
    every = timed.where("cat = 'kernel' and ext_id is not null").select(*_BY_ID, name.alias("name"), "ts", "dur", "stream_id", "pos")
    best = correlate.best_kernels(every, list(_KERNEL), patterns.chosen(F.col("name"), filters.include_kernel, filters.exclude_kernel), _BY_ID)
    linked = counted(cpu.join(best.hint("merge"), _BY_ID), "linked operations")
    # counted where rows of an id are together anyway
    linked = linked.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*_BY_ID, "name")))
    cpu = saved(linked, "linked")
    if "op_index" not in unread:
        cpu = saved(correlate.with_op_index(cpu), "operations")
    cpu = correlate.filter_names(cpu.where("k is not null"), filters.include_op, filters.exclude_op)
    cpu = cpu.select("*", *(F.col(f"k.{c}").alias(x) for c, x in _KERNEL.items())).drop("k").withColumn("call_stack", F.when(F.col("call_stack").isNotNull(), normalize_stack(F.col("call_stack"), coarse)))
    kernels = cpu.dropDuplicates(_BY_ID).select(*correlate.LINK, "label", F.lit("kernel").alias("cat"), *(F.col(x).alias(c) for c, x in _KERNEL.items()))
    # an operation that is the only one of its id and name stays
    several = saved(cpu.where("_n > 1"), "alike")
    cpu = cpu.where("_n = 1").unionByName(correlate.representative_operations(several, coarse)).drop("_n")
    if counts:
        cpu, kernels = saved(counts(cpu, "operations"), "operations"), saved(counts(kernels, "kernels"), "kernels")
    return cpu, kernels, files


def grouped(cpu: DataFrame, fields: Sequence[str], show: Sequence[str] = ()) -> DataFrame:
    """One row per label and group of operations (with their kernel's columns) with the shown columns; totals and shares are per label."""
    keys = ["label", *aggregate.checked_fields(fields)]
    cpu = named_values(cpu, fields)
    if "call_stack" in fields:
        cpu = saved(aggregate.with_merged_stacks(cpu, [k for k in keys if k != "call_stack"]), "merged")
    shown = ["name", "dtype", "shape", "pid", "tid", "fwd_bwd_type", "op_index", "call_stack", "ts", "readable_timestamp"]
    groups = aggregate.first_rows(cpu, keys, [c for c in shown if c in ("name", "ts", *show) and c in cpu.columns])
    links = cpu.select(*keys, *_KERNEL.values())
    totals = aggregate.kernel_totals(aggregate.kernel_statistics(links, keys), keys)
    totals = aggregate.with_share(totals if "kernel_names" in show else totals.drop("kernels"), ["label"])
    parts = [groups.alias("g"), totals.alias("t")]
    if "stream" in show:
        parts.append(aggregate.streams(links, keys).alias("s"))
    if "kernel_timestamp" in show:
        parts.append(aggregate.kernel_span(links, keys, starts=True).alias("k"))
    return reduce(lambda a, b: _left(a, b, keys), parts)


def named_values(cpu: DataFrame, fields: Sequence[str]) -> DataFrame:
    """cpu with a name for a missing dtype or shape that it is grouped by; elsewhere what is missing stays missing."""
    names = {"dtype": "unknown", "shape": "[]"}
    return cpu.withColumns({c: F.coalesce(c, F.lit(names[c])) for c in names if c in fields})


def _left(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    b = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return a.join(b, on, "left").drop(*(f"_r_{k}" for k in keys))


def _shown(show: Sequence[str], fields: Sequence[str]) -> dict[str, Column]:
    """The columns of a report by name, besides the kernels'."""
    first = {c: F.col(f"first.{c}") for c in ("name", "dtype", "shape", "fwd_bwd_type", "pid", "tid", "op_index")}
    first["dtype"], first["shape"] = F.coalesce(first["dtype"], F.lit("")), F.coalesce(first["shape"], F.lit("[]"))
    first["call_stack"] = F.coalesce(stack_text(F.col("first.call_stack")), F.lit(""))
    first["stream"] = F.coalesce(F.col("stream"), F.lit("")) if "stream" in show else F.lit("")
    out = {c: first[c] for c in first if c in show and c not in fields}
    if "timestamp" in show:
        text = two_decimals(F.col("first.ts"))
        out["timestamp"] = F.coalesce(F.col("first.readable_timestamp"), text) if "readable_timestamp" in show else text
    return out


def _kernel_columns(show: Sequence[str], counted: bool) -> dict[str, Column]:
    if not {"kernel_names", "kernel_duration", "kernel_timestamp"} & set(show) and not counted:
        return {}
    out = {"kernel_count": F.coalesce("kernel_count", F.lit(0))}
    if "kernel_names" in show:
        text = F.transform("kernels", lambda k: F.concat(k["name"], F.lit(" ("), k["n"].cast("string"), F.lit(")")) if counted else k["name"])
        out["kernel_names"] = F.coalesce(F.array_join(text, "\n"), F.lit(""))
    if "kernel_duration" in show:
        for c in ("mean_duration", "min_duration", "max_duration", "total_duration", "duration_ratio"):
            out[f"kernel_{c}"] = F.coalesce(f"kernel_{c}", F.lit(0.0))
    return out


def report(rows: DataFrame, fields: Sequence[str], show: Sequence[str] = ()) -> DataFrame:
    """The report of one label: by start if grouped by op_index, else by the plain sum of kernel times, largest first."""
    columns = {f: stack_text(F.col(f)) if f == "call_stack" else F.col(f) for f in fields}
    if "op_index" in fields:
        columns["name"] = F.col("first.name")
    columns |= {k: v for k, v in _shown(show, fields).items() if k not in columns}
    columns |= _kernel_columns(show, counted=False)
    if "kernel_timestamp" in show:
        for c in ("kernel_timestamp_start", "kernel_timestamp_end"):
            columns[c] = F.coalesce(two_decimals(F.col(c)), F.lit(""))
        columns["kernel_timestamps"] = F.coalesce(F.array_join(F.col("kernel_timestamps").cast("array<string>"), "\n"), F.lit(""))
    order = [F.col("first.ts")] if "op_index" in fields else [F.coalesce("kernel_sum_duration", F.lit(0.0)).desc()]
    return rows.orderBy(*order, *fields).select(*(v.alias(k) for k, v in columns.items()))


def comparison(rows: DataFrame, cpu: DataFrame, fields: Sequence[str], labels: Sequence[str], show: Sequence[str] = (), equal: Sequence[str] = ()) -> DataFrame:
    """One row per group with the columns of each label; what a label lacks shows as N/A and 0."""
    columns = {k: v for k, v in _shown(show, fields).items() if k != "timestamp" and not (k == "name" and k not in fields)}
    columns |= _kernel_columns(show, counted=True)
    flat = rows.select("label", *fields, F.col("first.name").alias("_name"), *(v.alias(k) for k, v in columns.items()))
    wide = compare.side_by_side(flat, fields, labels, [*columns, "_name"])
    if "kernel_duration" in show and len(labels) > 1:
        wide = compare.mean_ratio(wide.fillna(0.0, [f"{x}_kernel_mean_duration" for x in labels]), labels)
    if equal and len(labels) > 1:
        of = {"kernel_name": "_kernel_name", "dtype": "_dtype", "shape": "_shape"}
        sets = compare.set_equality(compare.value_sets(cpu, fields, [of.get(c, c) for c in equal]), fields, labels, [of.get(c, c) for c in equal])
        sets = sets.withColumnsRenamed({f"{v}_equal": f"{k}_equal" for k, v in of.items()}).drop(*(f"has_{x}" for x in labels))
        wide = _left(wide, sets, fields)
    out = {f: stack_text(F.col(f)) if f == "call_stack" else F.col(f) for f in fields}
    if "name" in show and "name" not in fields:
        out["name"] = F.coalesce(*(F.col(f"{x}__name") for x in labels))
    for x in labels:
        for c in columns:
            col = F.col(f"{x}_{c}")
            number = c.startswith("kernel_") and c != "kernel_names"
            out[f"{x}_{c}"] = F.coalesce(col, F.lit(0).cast(wide.schema[f"{x}_{c}"].dataType)) if number else F.when(F.col(f"has_{x}"), F.coalesce(col.cast("string"), F.lit(""))).otherwise("N/A")
    rest = [c for c in wide.columns if c.endswith(("_equal", "_ratio", "_improvement")) and c not in out and c not in fields]
    return wide.select(*(v.alias(k) for k, v in out.items()), *rest).orderBy(*fields)


def _unread(fields: Sequence[str], show: Sequence[str]) -> list[str]:
    """The columns of operations that cost a step of their own and that a report neither groups by nor shows."""
    return [c for c in ("op_index", "readable_timestamp") if c not in (*fields, *show)]


def analyse(spark: SparkSession, paths: Sequence[str] | str, fields: Sequence[str], show: Sequence[str] = (), filters: Filters = Filters(), coarse: bool = False, label: str = "single_file", large: bool = False, counts: Counts | None = None) -> DataFrame:  # noqa: B008
    """Which operations cost the most kernel time, per group.  large: all files by ranges, small ones too."""
    read = traces.read_large_traces if large else traces.read_traces
    cpu, _, _ = _prepared(read(spark, paths, label), filters, coarse, counts, _unread(fields, show))
    out = report(grouped(cpu, fields, show), fields, show)
    return counts(out, "groups") if counts else out


def compare_sets(spark: SparkSession, sets: dict[str, Sequence[str]], fields: Sequence[str], show: Sequence[str] = (), equal: Sequence[str] = (), filters: Filters = Filters(), coarse: bool = False, large: bool = False, counts: Counts | None = None) -> DataFrame:  # noqa: B008
    """How labelled sets of traces differ per group; equality and ratio are of the first two labels."""
    if len(sets) < 2:
        raise ValueError("a comparison takes two labels at least")
    read = traces.read_large_traces if large else traces.read_traces
    events = reduce(DataFrame.unionByName, (read(spark, files, label) for label, files in sets.items()))
    cpu, _, _ = _prepared(events, filters, coarse, counts, _unread(fields, show))
    rows = grouped(cpu, fields, show)
    cpu = cpu.withColumns({f"_{c}": F.when(~F.col(c).isin("", "[]"), F.col(c)) for c in ("dtype", "shape")})
    cpu = named_values(cpu, fields)
    if "call_stack" in fields:
        cpu = saved(aggregate.with_merged_stacks(cpu, ["label", *(f for f in fields if f != "call_stack")]), "merged")
    if "kernel_name" in equal:
        cpu = cpu.withColumn("_kernel_name", F.col("k_name"))
    out = comparison(rows, cpu, fields, list(sets), show, equal)
    return counts(out, "groups") if counts else out


def observed(cpu: DataFrame, kernels: DataFrame) -> DataFrame:
    """(kind, rows, ids): how many operations and kernels there are and how many ids link them."""
    one = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"), F.count_distinct("file", "ext_id").alias("ids"))
    return one(cpu, "cpu_op").unionAll(one(kernels, "kernel"))


def compared_ranks(spark: SparkSession, fast: str, slow: str, prefix: str = "TCDP_") -> tuple[DataFrame, DataFrame]:
    """(collectives of two ranks' trace files side by side, one row that says whether the ranks agree)."""
    ranks = [saved(comm.collective_kernels(traces.read_traces(spark, f).drop("args"), prefix), "rank") for f in (fast, slow)]
    verdict = comm.consistent(*ranks, n=0).join(comm.same_sequence(*ranks), F.lit(True))  # one row each
    return comm.pair_report(*ranks).orderBy("number"), verdict


def collectives(spark: SparkSession, run_folder: str, prefix: str = "TCDP_", step: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(first collectives of each step and card, fastest and slowest card of each step and collective)."""
    rows = comm.last_file_wins(comm.first_collectives(traces.read_collectives(spark, run_folder, step), prefix))
    raw = rows.select("step", "card", "comm_idx", "name", "ts", "dur", "in_msg_nelems", "out_msg_nelems", "group_size", "dtype", "process_group_ranks")
    return raw.orderBy("step", "card", "comm_idx"), comm.fastest_and_slowest(rows).orderBy("step", "comm_idx")
