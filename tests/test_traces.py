"""Trace files end to end, and cases derived by hand."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake import cli, sinks
from tracelake.functions import patterns, text, time
from tracelake.operators import aggregate, comm, compare, correlate, flow, islands, nesting, nodes, ordering, overlap, states, tree
from tracelake.plans import analysis
from tracelake.sources import traces
from tracelake.streaming import traces as streaming


def op(name, ts, dur, ext=None, pid=1, tid=1, cat="cpu_op", **more):
    args = more.pop("args", {}) | ({"External id": ext} if ext is not None else {})
    return {"name": name, "cat": cat, "ph": "X", "pid": pid, "tid": tid, "ts": ts, "dur": dur, "args": args} | more


def write(path, events, base=1_700_000_000_000_000_000, bare=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    body = json.dumps(events if bare else {"schemaVersion": 1, "baseTimeNanoseconds": base, "traceEvents": events}, indent=1)
    path.write_bytes(gzip.compress(body.encode()) if path.suffix == ".gz" else body.encode())
    return str(path)


TRACE = [
    op("nn.Module: Net_0", 0, 100, cat="python_function"),
    op("aten::mm", 10, 30, 1, args={"Input type": "float", "Input Dims": [[2, 3], [3, 4]]}),
    op("aten::add", 50, 20, 2, args={"Input type": "int", "Input Dims": [[2]]}),
    op("aten::idle", 80, 5, 3),
    op("mm_kernel", 12, 20, 1, pid=0, tid=7, cat="kernel", args={"stream": 7}),
    op("small", 33, 2, 1, pid=0, tid=7, cat="kernel", args={"stream": 8}),
    op("triton_poi_fused_add_12", 55, 10, 2, pid=0, tid=9, cat="kernel", args={"stream": 9}),
]


@pytest.mark.parametrize("suffix", [".json", ".json.gz"])
def test_analysis_of_a_file(spark, tmp_path, suffix):
    path = write(tmp_path / f"t{suffix}", TRACE)
    show = ["dtype", "shape", "kernel_names", "kernel_duration", "stream", "call_stack", "kernel_timestamp", "timestamp", "readable_timestamp"]
    rows = analysis.analyse(spark, [path], ["name"], show).collect()
    assert [r.name for r in rows] == ["aten::mm", "aten::add"]
    mm, add = rows
    assert (mm.dtype, mm["shape"], mm.kernel_names, mm.kernel_count, mm.kernel_total_duration) == ("float", "[[2,3],[3,4]]", "mm_kernel", 1, 20.0)
    assert (mm.stream, mm.call_stack, mm.kernel_timestamp_start, mm.kernel_timestamp_end) == ("7", "Net_0", "12.00", "32.00")
    assert mm.timestamp == "2023-11-14 22:13:20.000010"
    assert add.kernel_names == "triton_poi_fused_add"
    assert round(mm.kernel_duration_ratio, 4) == round(20 / 30 * 100, 4)


def test_grouping_by_several_fields_stack_and_index(spark, tmp_path):
    path = write(tmp_path / "t.json", TRACE)
    assert {(r.name, r.dtype) for r in analysis.analyse(spark, path, ["name", "dtype"]).collect()} == {("aten::mm", "float"), ("aten::add", "int")}
    by_stack = analysis.analyse(spark, path, ["call_stack"], ["kernel_duration"]).collect()
    assert [(r.call_stack, r.kernel_total_duration) for r in by_stack] == [("Net_0", 30.0)]
    by_index = analysis.analyse(spark, path, ["op_index"], ["kernel_duration"]).collect()
    assert [(r.op_index, r.name) for r in by_index] == [(0, "aten::mm"), (1, "aten::add")]


def test_filters(spark, tmp_path):
    path = write(tmp_path / "t.json", TRACE)
    assert [r.name for r in analysis.analyse(spark, path, ["name"], filters=analysis.Filters(include_op=["*mm"])).collect()] == ["aten::mm"]
    assert [r.name for r in analysis.analyse(spark, path, ["name"], filters=analysis.Filters(exclude_kernel=["mm_kernel", "small"])).collect()] == ["aten::add"]


def test_comparison(spark, tmp_path):
    a = write(tmp_path / "a.json", TRACE)
    slower = [e | {"dur": e["dur"] * 2} if e["cat"] == "kernel" else e for e in TRACE if e["name"] != "aten::add"]
    b = write(tmp_path / "b.json", slower)
    out = analysis.compare_sets(spark, {"x": [a], "y": [b]}, ["name"], ["kernel_duration", "dtype"], ["dtype", "kernel_name"])
    rows = {r.name: r for r in out.collect()}
    mm, add = rows["aten::mm"], rows["aten::add"]
    assert (mm.x_kernel_mean_duration, mm.y_kernel_mean_duration, mm["y_vs_x_mean_duration_ratio"], mm["y_vs_x_performance_improvement"]) == (20.0, 40.0, 2.0, "-100.0%")
    assert (mm.dtype_equal, mm.kernel_name_equal) == (True, True)
    assert (add.y_dtype, add.y_kernel_count, add.dtype_equal, add["y_vs_x_mean_duration_ratio"]) == ("N/A", 0, False, None)
    with pytest.raises(ValueError):
        analysis.compare_sets(spark, {"x": [a]}, ["name"])


def test_flow_reaches_what_the_backward_operation_encloses(spark, tmp_path):
    events = [
        op("nn.Module: M", 0, 20, cat="python_function"),
        op("f", 2, 5, 1),
        op("b", 50, 10, 2, tid=2),
        op("c", 52, 2, 3, tid=2),
        {"name": "fl", "cat": "fwdbwd", "ph": "s", "id": 7, "ts": 2, "pid": 1, "tid": 1},
        {"name": "fl", "cat": "fwdbwd", "ph": "f", "id": 7, "ts": 50, "pid": 1, "tid": 2},
    ]
    rows = {r.name: r for r in analysis.enriched(traces.read_traces(spark, write(tmp_path / "t.json", events))).collect()}
    assert rows["b"].call_stack == rows["c"].call_stack == rows["f"].call_stack == ["nn.Module: M", "f"]
    assert (rows["b"].fwd_bwd_type, rows["c"].fwd_bwd_type, rows["f"].fwd_bwd_type) == ("bwd", "bwd", "none")


def test_collectives(spark, tmp_path):
    pod = tmp_path / "pod"
    for card, dur in ((0, 4), (1, 8), (2, 8)):
        events = [op("TCDP_all2all", 10 + i, dur, cat="kernel", args={"Group size": 3, "dtype": "bf16"}) for i in range(8)]
        write(pod / f"executor_trainer-runner_{card}" / f"x{card}_0.json", [op("other", 0, 1), *events], bare=card == 1)
    (pod / "executor_trainer-runner_0" / "notes.json").write_text("{broken")
    raw, stats = analysis.collectives(spark, str(pod))
    assert raw.count() == 18
    first = stats.collect()[0]
    assert (first.fastest_card, first.slowest_card, first.duration_ratio, first.total_cards, first.group_size, first.dtype) == (0, 1, 2.0, 3, 3, "bf16")
    with pytest.raises(FileNotFoundError):
        analysis.collectives(spark, str(pod), step=5)
    out = cli.main(["comm", str(pod), "--output-dir", str(tmp_path / "out"), "--output-format", "csv"], spark)
    assert (tmp_path / "out" / "communication_raw_data.csv" / "step=0").is_dir() and len(out) == 2


def test_ranks_side_by_side(spark, tmp_path):
    base = 1_700_000_000_000_000_000
    fast = write(tmp_path / "fast.json", [op(f"TCDP_{i}", 10 * i, 5, cat="kernel", args={"Group size": 2, "In msg nelems": 7}) for i in range(3)], base)
    slow = write(tmp_path / "slow.json", [op(f"TCDP_{min(i, 1)}", 10 * i, 5 + 9000 * (i == 1), cat="kernel", args={"Group size": 2 + i}) for i in range(4)], base + 1_000_000)
    out = cli.main(["ranks", fast, slow, "--output-dir", str(tmp_path / "out"), "--output-format", "parquet"], spark)
    rows = spark.read.parquet(out[0]).orderBy("number").collect()
    assert len(rows) == 3 and len(rows[0]) == 17
    assert [(r.same_name, r.apart, r.start_diff_us, r.end_diff_us) for r in rows] == [(True, False, 1000.0, 1000.0), (True, True, 1000.0, 10000.0), (False, False, 1000.0, 1000.0)]
    assert (rows[0].fast_start, rows[0].fast_end) == ("2023-11-14 22:13:20.000000", "2023-11-14 22:13:20.000005")
    assert (rows[0].fast_in_msg_nelems, rows[0].slow_in_msg_nelems, rows[0].same_in_msg_nelems, rows[1].same_group_size) == ("7", "N/A", False, False)
    verdict = spark.read.parquet(out[1]).first()
    assert (verdict.consistent, verdict.equal, verdict.n_a, verdict.n_b) == (False, False, 3, 4)


def test_missing_values_of_reports(spark, tmp_path):
    """A missing dtype has a name as a group, shows as an empty text, and is no value where labels are compared."""
    with_type = write(tmp_path / "a.json", [op("mm", 0, 5, 1, args={"Input type": "float"}), op("mm", 9, 5, 2), op("k", 1, 3, 1, cat="kernel"), op("k", 10, 3, 2, cat="kernel")])
    without = write(tmp_path / "b.json", [op("mm", 0, 5, 1), op("mm", 9, 5, 2, args={"Input type": "float", "Input Dims": []}), op("k", 1, 3, 1, cat="kernel"), op("k", 10, 3, 2, cat="kernel")])
    assert {r.dtype for r in analysis.analyse(spark, with_type, ["name", "dtype"]).collect()} == {"float", "unknown"}
    assert [(r.dtype, r["shape"]) for r in analysis.analyse(spark, without, ["name"], ["dtype", "shape"]).collect()] == [("", "[]")]
    r = analysis.compare_sets(spark, {"a": [with_type], "b": [without]}, ["name"], equal=["dtype", "shape"]).first()
    assert (r.dtype_equal, r.shape_equal) == (True, True)


def test_reports_order_by_plain_sums(spark, tmp_path):
    """Of two kernels with a mean of 10 one has rows without dur: its total is larger, its plain sum isn't."""
    rows = [op("a", 10 * i, 5, i) for i in range(3)] + [op("b", 100 + 10 * i, 5, 10 + i) for i in range(2)]
    rows += [op("k", 10 * i, d, i, cat="kernel") for i, d in enumerate((10, None, None))] + [op("l", 100 + 10 * i, 7, 10 + i, cat="kernel") for i in range(2)]
    out = analysis.analyse(spark, write(tmp_path / "t.json", rows), ["name"], ["kernel_duration"]).collect()
    assert [(r.name, r.kernel_total_duration) for r in out] == [("b", 14.0), ("a", 30.0)]


def test_observed_counts(spark, tmp_path):
    cpu, kernels = analysis.prepared(traces.read_traces(spark, write(tmp_path / "t.json", TRACE), "x"))
    assert {tuple(r) for r in analysis.observed(cpu, kernels).collect()} == {("cpu_op", 2, 2), ("kernel", 2, 2)}


def test_counts_need_no_further_job(spark, tmp_path, capsys):
    """Counted while the tables are written, and printed by the command."""
    counts = analysis.Counts()
    path = write(tmp_path / "t.json", TRACE)
    out = analysis.analyse(spark, path, ["name"], counts=counts)
    out.write.parquet(f"{tmp_path}/out")
    known = {"events": len(TRACE), "linked operations": 2, "operations": 2, "kernels": 2, "groups": 2}
    assert counts.rows() == known
    cli.main(["analysis", path, "--output-dir", str(tmp_path / "cli"), "--output-format", "csv"], spark)
    assert capsys.readouterr().out.strip().endswith(", ".join(f"{n} {k}" for k, n in known.items()))


def test_states_merge_in_any_order(spark, tmp_path):
    """Files in any order, one at a time or together, some again and changed; equal to a full run over the last versions."""
    rng = random.Random(8)
    schema = "file string, name string, k_name string, k_ts double, k_dur double, k_stream bigint, k_pos bigint"
    make = lambda f: [(f, rng.choice(["a", "b", None]), rng.choice(["k", "l", "m"]), float(i), rng.choice([None, 1e9 + rng.random(), rng.random()]), 1, i) for i in range(30)]
    files = {f"f{i}": make(f"f{i}") for i in range(6)} | {"alone": [("alone", "a", "only null", 1.0, None, 1, 1), ("alone", "a", "one", 1.0, 2.0, 1, 1)]}
    for turn, groups in enumerate(([["f3"], ["f1", "f0"], ["alone", "f2"], ["f5", "f4"]], [["f5", "f4", "f3", "f2"], ["f0", "alone", "f1"]])):
        path = f"{tmp_path}/s{turn}"
        states.update(spark, path, spark.createDataFrame(make("f3") + make("f0"), schema), ["name"], 4)
        for group in groups:
            got = states.update(spark, path, spark.createDataFrame([r for f in group for r in files[f]], schema), ["name"], 4)
        want = aggregate.kernel_statistics(spark.createDataFrame([r for f in files.values() for r in f], schema), ["name"])
        key = lambda df: sorted(((str(r.name), r.k_name, r.n, tuple(r.first_seen)), (r.mean_dur, r.min_dur, r.max_dur, r.var_dur, r.sum_dur)) for r in df.collect())
        for (a, x), (b, y) in zip(key(got), key(want), strict=True):
            assert a == b and x == pytest.approx(y, rel=1e-6)


def test_ranges_follow_the_tables_size(spark, tmp_path, monkeypatch):
    """More ranges than the session's partitions where the tables are large; the same numbers."""
    spark.range(20_000).selectExpr("id", "id * 7919 % 20011 as ts").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert 0 < ordering.bytes_read(table) == ordering.bytes_read(table.where("id > 3").select("ts")) and ordering.bytes_read(spark.range(3)) < 1 << 20
    want = {r.id: r.n for r in ordering.numbered(table, [], ["ts"], "n").collect()}
    monkeypatch.setattr(ordering, "RANGE_BYTES", ordering.bytes_read(table) // 20)
    parts = ordering.chunked(table, [], "ts")
    assert parts.select("_chunk").distinct().count() >= 19
    assert {r.id: r.n for r in ordering.numbered(table, [], ["ts"], "n").collect()} == want


@pytest.mark.parametrize("paths", [True, False])
def test_sweeps_in_batches_of_any_size(paths):
    """Without Spark: parents, depths and paths of random threads, with ties and equal ends, however rows are cut into batches."""
    import pyarrow as pa

    for seed in range(60):
        rng = random.Random(seed)
        rows = sorted((rng.choice("abb"), rng.randrange(2), float(rng.randrange(30)), i, float(rng.choice([1, 2, 5, 20, 20, 60]))) for i in range(rng.randrange(1, 60)))
        up = {}
        for i, (thread, part, ts, pos, dur) in enumerate(rows):
            found = [j for j in range(i) if rows[j][:2] == (thread, part) and rows[j][2] + rows[j][4] >= ts + dur]
            up[pos] = rows[found[-1]][3] if found else None
        path = lambda p: [*path(up[p]), p] if p is not None else []  # noqa: B023, E731
        sweep, at = nesting.Sweep(["k", "_part"], paths), 0
        while at < len(rows):
            batch = rows[at : at + rng.randrange(1, 9)]
            at += len(batch)
            k, part, ts, pos, dur = zip(*batch, strict=True)
            columns = [pa.array(k), pa.array(part), pa.array(pos), pa.array([f"n{p}" for p in pos]), pa.array([a + b for a, b in zip(ts, dur, strict=True)])]
            got = sweep.feed(pa.RecordBatch.from_arrays(columns, ["k", "_part", "pos", "name", "_end"]))
            assert got[0].to_pylist() == [up[p] for p in pos] and got[1].to_pylist() == [len(path(p)) - 1 for p in pos]
            if paths:
                assert got[2].to_pylist() == [[{"pos": q, "name": f"n{q}"} for q in path(p)] for p in pos]


@pytest.mark.parametrize("seed", range(3))
def test_random_threads_nest_as_by_self_join(spark, seed):
    rng = random.Random(seed)
    rows = [(str(rng.randrange(2)), 1, rng.randrange(3), i, float(rng.randrange(60)), float(rng.choice([0, 1, 2, 5, 20, 50]))) for i in range(150)]
    df = spark.createDataFrame(rows, "file string, pid int, tid int, pos bigint, ts double, dur double").withColumn("name", F.lit("x"))
    want = {r.pos: r.parent_pos for r in nesting.nest_by_join(df).collect()}
    for per_chunk in (7, None):
        got = nesting.nest(df, rows_per_chunk=per_chunk)
        assert {r.pos: r.parent_pos for r in got.collect()} == want
        assert {(r.pos, r.parent_pos) for r in nesting.nest(df, rows_per_chunk=per_chunk, paths=False).collect()} == set(want.items())
        assert all(len(r.path) == r.depth + 1 for r in got.collect())


@pytest.mark.parametrize("seed", range(3))
def test_random_stacks_merge_as_by_comparing_all(spark, seed):
    rng = random.Random(seed)
    stacks = [[rng.choice("ab") for _ in range(rng.randrange(5))] for _ in range(40)]
    df = spark.createDataFrame([(s,) for s in stacks], "call_stack array<string>").withColumn("k", F.lit(1))
    begins = lambda s, t: s != t and t[: len(s)] == s
    longest = [s for s in stacks if not any(begins(s, t) for t in stacks)]
    for r in aggregate.merged_stacks(df, ["k"]).collect():
        fits = [t for t in longest if t[: len(r.call_stack)] == r.call_stack]
        assert r.merged_stack in fits


def test_file_names_of_steps_and_cards(spark):
    names = ["3_100.json", "trace_step7.json", "x_rank_0_0_0.json", "trace_step_7.json", "foo.json"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert [tuple(r) for r in df.select(*traces.step_and_card(F.col("f"))).collect()] == [(100, 3), (7, 0), (0, 0), (None, None), (None, None)]


def events(spark, rows, columns="file string, pid bigint, tid bigint, pos bigint, name string, ts bigint, dur bigint"):
    return spark.createDataFrame(rows, columns)


def test_equal_starts_nest_only_in_longer_earlier_rows(spark):
    df = events(spark, [("f", 1, 1, 0, "a", 0, 5), ("f", 1, 1, 1, "b", 0, 10), ("f", 1, 1, 2, "c", 1, 2), ("f", 1, 1, 3, "x", 5, None), ("f", None, 1, 4, "y", 5, 2)])
    assert {r.name: r.parent_pos for r in nesting.nest(df).collect()} == {"a": None, "b": None, "c": 1}


@pytest.mark.parametrize("per_chunk", [10, 100_000])
def test_chunks_do_not_change_nesting(spark, per_chunk):
    import random

    rng = random.Random(5)
    rows = [("f", 1, rng.choice([1, 1, 1, 2]), i, f"n{i}", rng.randint(0, 300), rng.randint(0, 60)) for i in range(600)]
    df = events(spark, rows)
    got = {r.pos: r.parent_pos for r in nesting.nest(df, rows_per_chunk=per_chunk).collect()}
    assert got == {r.pos: r.parent_pos for r in nesting.nest_by_join(df).collect()}


@pytest.mark.parametrize("per_chunk", [7, 100_000])
def test_chunks_do_not_change_numbers_and_maxima(spark, per_chunk):
    import random

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 40), i, rng.randint(0, 1000)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, i int, v int")
    num = {r.i: r.n for r in ordering.numbered(df, ["k"], ["o", "i"], "n", rows_per_chunk=per_chunk).collect()}
    run = {r.i: r.s for r in ordering.running_sum(df, ["k"], ["o", "i"], F.col("v"), "s", per_chunk).collect()}
    most = {r.i: r.m for r in ordering.previous_max(df, ["k"], ["o", "i"], F.col("v"), "m", rows_per_chunk=per_chunk).collect()}
    strict = {r.i: r.m for r in ordering.previous_max(df, ["k"], ["o", "i"], F.col("v"), "m", strictly=True, rows_per_chunk=per_chunk).collect()}
    for key in ("a", "b", None):
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for n, r in enumerate(group):
            assert num[r[2]] == n
            assert run[r[2]] == sum(x[3] for x in group[: n + 1])
            assert most[r[2]] == max((x[3] for x in group[:n]), default=None)
            assert strict[r[2]] == max((x[3] for x in group if x[1] < r[1]), default=None)


def test_islands_that_touch_stay_apart(spark):
    rows = [("1", 0, 10), ("2", 5, 8), ("3", 10, 12), ("4", 20, 30), ("5", 25, 40), ("6", None, 5)]
    df = spark.createDataFrame(rows, "path string, start bigint, end bigint")
    for per_chunk in (2, 1000):
        assert {r.path: r.island for r in islands.islands(df, per_chunk).collect()} == {"1": 1, "2": 1, "3": 2, "4": 3, "5": 3}


def test_patterns():
    assert [patterns.compiled(p) for p in ("Conv.*", "add", "[", "*[")] == ["Conv..*", "add", r"\[", r"\*\["]
    assert patterns.parsed(" a, ,b") == ["a", "b"]
    assert patterns.compiled("(?P<x>a)") == "(.P<x>a)"  # wildcards also count inside regular expressions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names_and_stacks(spark):
    names = ["triton_poi_fused_add_12", "triton_add_3", "triton_poi_fused_add", "mm_3"]
    assert [one(spark, text.strip_kernel_suffix(F.lit(n))) for n in names] == ["triton_poi_fused_add", "triton_add_3", "triton_poi_fused_add", "mm_3"]

    def stack(*frames):
        return F.array(*map(F.lit, frames)) if frames else F.array().cast("array<string>")

    assert one(spark, text.normalize_stack(stack("nn.Module: Dense_10", "x"), True)) == ["Dense"]
    assert one(spark, text.normalize_stack(stack("f_3 object at 0xab"), True)) == ["f_3"]
    assert one(spark, text.normalize_stack(F.lit(None).cast("array<string>"))) == []
    phases = [stack("m: forward", "GradX"), stack("MulBackward0"), stack("GradX"), stack("x"), stack()]
    assert [one(spark, text.phase(s)) for s in phases] == ["fwd", "bwd", "grad", "none", "none"]
    assert [one(spark, text.change_text(F.lit(x))) for x in (0.8, 1.2)] == ["20.0%", "-20.0%"]
    assert one(spark, text.url_last_part(F.lit("http://h/a/b%2Fc.json"))) == "c.json"


def test_clocks(spark):
    assert one(spark, time.micros_of(F.lit("not a time"))) == 0.0
    assert one(spark, time.readable(F.lit(None).cast("bigint"), F.lit(1.0))) is None
    assert [one(spark, time.millis_of(F.lit(v))) for v in (5, "17", "1970-01-01T00:00:01Z", "x")] == [5, 17, 1000, None]


def test_statistics_count_rows_without_dur(spark):
    links = spark.createDataFrame([("p", "k", 1.0, d, i) for i, d in enumerate([10.0, 20.0, None])], "name string, k_name string, k_ts double, k_dur double, k_pos bigint")
    s = aggregate.kernel_statistics(links, ["name"]).first()
    assert (s.mean_dur, s.min_dur, s.max_dur, s.var_dur, s.n) == (15.0, 10.0, 20.0, 50.0, 3)
    assert aggregate.kernel_totals(aggregate.kernel_statistics(links, ["name"]), ["name"]).first().kernel_total_duration == 45.0


def test_stacks_that_begin_others_merge(spark):
    rows = [("n", s.split()) for s in ("A", "A B", "A C", "A B D")]
    got = {" ".join(r.call_stack): " ".join(r.merged_stack) for r in aggregate.merged_stacks(spark.createDataFrame(rows, "name string, call_stack array<string>"), ["name"]).collect()}
    assert got == {"A": "A B D", "A B": "A B D", "A C": "A C", "A B D": "A B D"}


def test_operations_of_one_id_keep_the_longest_stacks(spark):
    rows = [("f", 1, "o", p, s) for p, s in enumerate([["A"], ["A", "B"], ["A", "BC"], ["A", "B"], ["Z"]])] + [("f", 2, "o", 9, None), ("f", 2, "o", 10, None), ("f", 3, "o", 11, ["Q"]), ("f", 3, "o", 12, None)]
    df = spark.createDataFrame(rows, "file string, ext_id bigint, name string, pos bigint, call_stack array<string>")
    assert {r.pos for r in correlate.representative_operations(df).collect()} == {2, 4, 9, 10, 11}
    with pytest.raises(Exception, match="with and without"):
        correlate.representative_operations(df, strict=True).collect()


def test_fields():
    for bad in ([], ["x"], ["name", "name"], ["op_index", "name"], [""]):
        with pytest.raises(ValueError):
            aggregate.checked_fields(bad)


def test_sequences(spark):
    a = spark.createDataFrame([(0, "x", 0.0, 5.0, 0), (1, "y", 10.0, 5.0, 1)], "comm_idx int, name string, ts double, dur double, pos bigint")
    b = spark.createDataFrame([(0, "x", 1.0, 5.0, 0)], a.schema)
    assert comm.same_sequence(a, a).first().equal and not comm.same_sequence(a, b).first().equal
    assert comm.zipped(a, b).collect()[0].start_diff == 1.0
    assert comm.consistent(a, b, 0).first().consistent and not comm.consistent(a, b, 1).first().consistent
    assert not comm.consistent(a, b, 0, limit=0.5).first().consistent


def test_nodes(spark):
    df = spark.createDataFrame([("executor_a-b_3_1", "Done", 5, None), ("executor_a_4_0", "FAILED", 9, 10)], "node string, state string, launchTime bigint, releaseTime bigint")
    assert nodes.filter_nodes(df, state="done", node=3).count() == 1
    assert nodes.filter_nodes(df, released=(0, 99)).count() == 1
    assert one(spark, nodes.wanted_file(F.lit("a.json"), "[")) is False
    assert one(spark, nodes.wanted_file(F.lit("a.json"), r"json$", "[")) is True


def test_empty_tables(spark):
    df = events(spark, []).withColumn("cat", F.lit("cpu_op"))
    assert nesting.nest(df).count() == 0
    assert ordering.numbered(df, [], ["ts"], "n").count() == 0
    assert islands.islands(spark.createDataFrame([], "path string, start bigint, end bigint")).count() == 0
    assert compare.side_by_side(spark.createDataFrame([], "label string, k int, v int"), ["k"], ["a", "b"], ["v"]).count() == 0
    assert flow.flow_pairs(spark.createDataFrame([], "file string, flow_id string, ph string, ts double, pos bigint")).count() == 0


def test_command_line(spark, tmp_path):
    a, b = write(tmp_path / "a.json", TRACE), write(tmp_path / "b.json", TRACE)
    out = cli.main(["analysis", a, "--aggregation", "name,dtype", "--show", "kernel-duration", "--large-files", "--output-dir", str(tmp_path / "out")], spark)
    assert [p.rsplit("/", 1)[1] for p in out] == [f"single_file_comparison_by_name_dtype_duration.{f}" for f in ("csv", "json")]
    assert spark.read.option("header", True).csv(out[0]).count() == 2
    out = cli.main(["compare", f"{a}:x", f"{b}:y", "--show", "kernel-duration", "--include-op", "mm,add", "--output-dir", str(tmp_path / "out"), "--output-format", "parquet"], spark)
    assert out[0].endswith("comparison_x_vs_y_by_name_duration_inc_op_2.parquet") and spark.read.parquet(out[0]).count() == 2
    write(tmp_path / "runs" / "r1" / "trace_0.json", TRACE)
    write(tmp_path / "runs" / "r2" / "trace_0.json", TRACE)
    assert spark.read.json(cli.main(["group", str(tmp_path / "runs"), "--output-dir", str(tmp_path / "out")], spark)[-1]).first().runs == 2
    (tmp_path / "n.json").write_text(json.dumps([{"node": "executor_a_3_1", "state": "Done", "launchTime": 5}, {"node": "executor_a_4_0", "state": "FAILED", "launchTime": 9}]))
    out = cli.main(["nodes", str(tmp_path / "n.json"), "--state", "failed", "--launched-from", "6", "--output-dir", str(tmp_path / "out"), "--output-format", "json"], spark)
    assert [r.node for r in spark.read.json(out[0]).collect()] == ["executor_a_4_0"]
    with pytest.raises(ValueError):
        cli.main(["analysis", a, "--include-op", "x", "--exclude-op", "y"], spark)
    with pytest.raises(ValueError):
        sinks.write(spark.range(1), str(tmp_path), "x", ["pdf"])


def test_labels_and_samples(spark, tmp_path):
    for i in range(5):
        write(tmp_path / "d" / f"t{i}.json", TRACE)
    assert len(traces.labelled_files(spark, f"{tmp_path}/d:base")[1]) == 5
    label, files = traces.labelled_files(spark, f"{tmp_path}/d/*.json:base", most=2)
    assert (label, len(files)) == ("base", 2) and files == traces.labelled_files(spark, f"{tmp_path}/d/*.json:base", most=2)[1]
    assert traces.labelled_files(spark, f"{tmp_path}/d/t1.json")[0] == "t1"
    write(tmp_path / "d" / "odd.txt", TRACE)
    with pytest.warns(UserWarning, match="left out"):
        assert len(traces.list_files(spark, f"{tmp_path}/d")) == 5
    with pytest.warns(UserWarning, match="may not be JSON"):
        assert len(traces.list_files(spark, f"{tmp_path}/d/odd.txt")) == 1


@pytest.mark.parametrize(("size", "piece"), [(1 << 20, 7), (173, 1 << 20), (41, 5)])
def test_large_files_give_the_same_events(spark, tmp_path, monkeypatch, size, piece):
    from tracelake.sources import large

    monkeypatch.setattr(large.read_events, "__defaults__", (size, piece))
    odd = [*TRACE, op("\u00e9 \U0001f600 \"quoted\" {[,:", 3.5, 1, "9"), {"ph": "M"}, 12, "text", None, op("n", 1, 2, args={"nested": {"a": [1, {"b": "]"}]}})]
    write(tmp_path / "d" / "a.json", odd)
    write(tmp_path / "d" / "b.json.gz", odd, base=5)
    write(tmp_path / "d" / "c.json", TRACE, bare=True)
    (tmp_path / "d" / "d.json").write_text(json.dumps({"traceEvents": TRACE, "more": [{"traceEvents": 1}], "baseTimeNanoseconds": 17}))
    (tmp_path / "d" / "e.json").write_text("{}")
    plain = lambda df: sorted((r.file.rsplit("/", 1)[1], r.base_ns, r.pos, r.name, r.cat, r.pid, r.ts, r.dur, r.ext_id, r["shape"], r.stream_id) for r in df.drop("args").collect() if not r.file.endswith("c.json"))
    got, want = traces.read_large_traces(spark, f"{tmp_path}/d", "x", size), traces.read_traces(spark, f"{tmp_path}/d", "x")
    assert repr(plain(got)) == repr(plain(want)) and got.columns == want.columns
    assert [r.name for r in got.where("file like '%c.json'").orderBy("pos").collect()] == [e["name"] for e in TRACE]
    (tmp_path / "broken.json").write_text(json.dumps({"traceEvents": TRACE})[:-30])
    with pytest.raises(Exception, match=r"broken\.json"):
        traces.read_large_traces(spark, f"{tmp_path}/broken.json").collect()


@pytest.mark.parametrize("seed", range(4))
def test_any_ranges_and_pieces_give_the_same_events(tmp_path, seed):
    """Without Spark: ranges down to a byte, chained as `settled` and `read_events` chain them."""
    from tracelake.sources import large

    odd = [{"name": 'a"b\\', "args": {"x": [1, 2, {"k": "]}"}]}}, {"ph": "M"}, 12, "te,x[t", None, {"n": "\u00e9\U0001f600{[,:\\\\"}, {}, [1, [2]]] * 4
    for trial in range(40):
        rng = random.Random(100 * seed + trial)
        events = [rng.choice(odd) for _ in range(rng.randrange(12))]
        items = [("baseTimeNanoseconds", rng.randrange(10**18)), ("traceEvents", events), ("more", [{"traceEvents": 1, "q": [1, 2]}, 2]), ("device", {"a": 1, "b": [1], "c": {"traceEvents": [1]}})]
        rng.shuffle(items)
        bare = trial % 5 == 4
        text = json.dumps(events if bare else dict(items), indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5).encode()
        (tmp_path / "t.json").write_bytes(text)
        uri, size, piece = f"file://{tmp_path}/t.json", rng.choice([1, 3, 17, 173, 10**6]), rng.choice([1, 2, 7, 10**6])
        cuts = [(a, min(len(text), a + size)) for a in range(0, len(text), size)]
        quotes = depth = 0
        base, got, mine = None, [], False
        facts = [large.facts(uri, i, *c, piece) for i, c in enumerate(cuts)]
        for i, f in enumerate(facts):
            rows = list(large.events(uri, i, *cuts[i], quotes % 2 == 1, depth, facts[0]["root"], piece))
            depth += f["inside"] if quotes % 2 else f["outside"]
            quotes += f["quotes"]
            for kind, _, first, event, n, _ in rows[:-1]:
                if kind == "base":
                    base = n
                elif mine or not first:
                    got.append(json.loads(event))
            mine = mine if rows[-1][5] is None else rows[-1][5]
        assert got == events and (bare or base == dict(items)["baseTimeNanoseconds"]) and depth == quotes % 2 == 0


def test_large_files_are_spread_without_a_flag(spark, tmp_path):
    from tracelake.sources import large

    many = [op(f"n{i}", i, 1, i) for i in range(3000)]
    path = write(tmp_path / "big.json", many)
    write(tmp_path / "small.json", TRACE)
    files = traces.sized_files(spark, path)
    spread = large.ranges(spark, files, files[0][1] // 8 + 1)
    assert spread.count() == 8 == spread.select(F.spark_partition_id()).distinct().count()
    got = traces.read_traces(spark, str(tmp_path), most=files[0][1] - 1)
    assert "range-events" in got._jdf.queryExecution().toString()
    want = traces.read_traces(spark, str(tmp_path))
    assert "range-events" not in want._jdf.queryExecution().toString()
    key = lambda df: sorted((r.file, r.pos, r.name, r.ts, r.ext_id, r.base_ns) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == len(many) + len(TRACE)


@pytest.mark.parametrize("hot", [overlap.HOT, 3])
def test_overlap_of_many_ranges(spark, hot):
    """Intervals of lengths from nothing to all of time, touching ones, negative times, null keys, repeated rows."""
    rng = random.Random(6)
    make = lambda n, side: [(rng.choice(["a", "a", "a", "b", None]), s := rng.randrange(-500, 500) * 8, s + rng.choice([0, 0, 1, 7, 8, 9, 64, 5000, 10**12]), f"{side}{i}") for i in range(n)]
    left, right = make(150, "l"), make(90, "r")
    left += left[:5] + [("a", None, 5, "no start"), ("a", 9, 2, "backwards"), ("a", -(10**15), 10**15, "all")]
    right += [("b", -(10**15), 10**15, "every"), ("a", 8, 8, "touching")]
    tables = [spark.createDataFrame(rows, f"k string, start bigint, end bigint, {n} string") for rows, n in ((left, "l"), (right, "r"))]
    out = overlap.overlapping(*tables, ["k"], ["l"], ["r"], hot)
    want = [(x[0], x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] is not None and x[1] <= x[2] and x[1] <= y[2] and x[2] >= y[1]]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))
    assert not any(w in out._jdf.queryExecution().executedPlan().toString() for w in ("Cartesian", "NestedLoop"))
    empty = spark.createDataFrame([], tables[1].schema)
    assert overlap.overlapping(tables[0], empty, ["k"], ["l"], ["r"]).count() == 0


@pytest.mark.parametrize("rows", [None, 7])
def test_call_trees(spark, tmp_path, rows):
    """Nested JSON of threads, one with a parent of many children, as values and as files."""
    rng = random.Random(3)
    events = [("f", 0, 1, 0, "all \"of\" it", "c", 0.0, 1000.0)] + [("f", 0, 1, i, f"n{i}", "c", float(rng.randrange(1000)), float(rng.randrange(1, 30))) for i in range(1, 300)]
    events += [("f", 0, 2, 1000 + i, f"m{i}", None, float(i * 10 % 70), float(rng.randrange(1, 90))) for i in range(40)]
    table = spark.createDataFrame(events, "file string, pid int, tid int, pos long, name string, cat string, ts double, dur double")
    parent = {r.pos: (r.parent_pos, r.depth) for r in nesting.nest(table, paths=False).collect()}

    def node(e, stack=()):
        below = sorted((x for x in events if parent[x[3]][0] == e[3]), key=lambda x: (x[6], x[3]))
        stack = (*stack, e[4])
        return {"event": dict(zip(tree.EVENT, (e[4], e[5], e[6], e[7], e[1], e[2]), strict=True)), "depth": parent[e[3]][1], "call_stack": list(stack), "children": [node(x, stack) for x in below]}

    want = {tid: [node(e) for e in sorted((x for x in events if x[2] == tid and parent[x[3]][0] is None), key=lambda x: (x[6], x[3]))] for tid in (1, 2)}
    nested = nesting.nest(table, rows_per_chunk=rows)
    got = tree.trees(nested, rows_per_chunk=rows).collect()
    assert {(r.tid, r.root_pos): json.loads(r.tree) for r in got} == {(tid, next(e[3] for e in events if e[4] == t["event"]["name"])): t for tid, ts in want.items() for t in ts}
    assert sum(r.nodes for r in got) == len(events)
    tree.write_trees(nested, str(tmp_path / "trees"), rows_per_chunk=rows)
    for tid in (1, 2):
        files = sorted((tmp_path / "trees" / "file=f" / "pid=0" / f"tid={tid}").glob("part-*"))
        assert json.loads("".join(f.read_text() for f in files)) == want[tid]


def test_times_from_the_ends_of_files(spark, tmp_path):
    """What is read doesn't grow with the file; entries without a time or a category, and odd layouts."""
    from tracelake.sources import ends

    read = {}
    for n in (500, 50_000):
        path = write(tmp_path / f"n{n}.json", [{"ph": "M"}, *(op(f"n{i}", 7 + i, 1, i) for i in range(n)), {"ph": "M", "args": {"a": "]}\\"}}])
        row = ends.read_ends(spark, traces.sized_files(spark, path), window=4096).first()
        assert (row.first, row.last, row.base_ns) == (7, 6 + n, 1_700_000_000_000_000_000)
        read[n] = row.bytes_read
    assert read[50_000] <= read[500] + 8192 < 40_000
    for layout in ({"traceEvents": TRACE, "more": [{"ts": "none"}, 3], "baseTimeNanoseconds": 17}, {"baseTimeNanoseconds": 17, "traceEvents": [{"ts": 5, "ph": "M"}, *TRACE, {"ts": 9e9}], "x": {"a": [{"ts": 1}]}}):
        (tmp_path / "t.json").write_text(json.dumps(layout))
        for window in (1, 9, 64, 1 << 20):
            files = traces.sized_files(spark, str(tmp_path / "t.json"))
            row, named = (ends.read_ends(spark, files, named, window).first() for named in (False, True))
            events = layout["traceEvents"]
            times = [e["ts"] for e in events]
            known = [e["ts"] for e in events if e.get("cat")]
            assert (row.first, row.last) == (times[0], times[-1]) and (named.first, named.last) == (known[0], known[-1])
    for body in ("{}", " ", "[]", '{"traceEvents": [{"ph": "M"}]}'):
        (tmp_path / "e.json").write_text(body)
        assert ends.read_ends(spark, traces.sized_files(spark, str(tmp_path / "e.json"))).first().first is None
    write(tmp_path / "z.json.gz", TRACE)
    assert ends.read_ends(spark, traces.sized_files(spark, str(tmp_path / "z.json.gz"))).first().first == TRACE[0]["ts"]


def test_run_folder_opens_wanted_files_alone(spark, tmp_path):
    from tracelake.sources import runs

    for card in range(3):
        for step in range(4):
            write(tmp_path / f"executor_trainer-runner_{card}" / f"{card}_{step}.json", [op(f"c{card}s{step}", 1, 2)])
    (tmp_path / "executor_trainer-runner_0" / "step9.json").write_text("[]")
    (tmp_path / "executor_trainer-runner_1" / "7_1.json").write_text('{"traceEvents": [{"name": "cut off"}, {"na')
    (tmp_path / "other").mkdir()
    rows = runs.run_events(spark, str(tmp_path))

    def wanted(condition):
        kept = rows.where(condition)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        return {(r.step, r.card) for r in kept.where("pos >= 0").collect()}, plan

    assert wanted("step = 3")[0] == {(3, 0), (3, 1), (3, 2)}
    assert wanted("step > 1 and card in (0, 2) and step <= 2")[0] == {(2, 0), (2, 2)}
    assert wanted("step = 1")[0] == {(1, 0), (1, 1), (1, 2)}  # the broken file gives no rows
    assert "Filter (step" not in wanted("step = 3")[1]
    # what isn't a partition isn't opened
    reader = runs.RunReader(f"file://{tmp_path}", 1 << 20)
    left = list(reader.pushFilters([runs.D.EqualTo(("step",), 3), runs.D.IsNotNull(("card",)), runs.D.EqualTo(("pos",), 0)]))
    assert left == [runs.D.EqualTo(("pos",), 0)] and [p.step for p in reader.partitions()] == [3, 3, 3]


def test_stream_of_traces(spark, tmp_path):
    write(tmp_path / "s" / "a.json", TRACE)
    stream = streaming.running_kernel_time(streaming.stream_traces(spark, str(tmp_path / "s")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("kernel_time").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.name: r.total_dur for r in spark.table("kernel_time").collect()} == {"mm_kernel": 20.0, "small": 2.0, "triton_poi_fused_add_12": 10.0}


def wide_tables(spark, folder, n=6000):
    """Orders of one month whose times add up to more than a bigint holds, and a line item for each."""
    at = "timestamp '2020-03-01' + make_interval(0, 0, 0, cast(id % 28 as int))"
    spark.range(n).selectExpr("id as o_orderkey", "id % 9 as o_custkey", "'F' as o_orderstatus", "1.0D as o_totalprice", f"{at} as o_orderdate", "'1-URGENT' as o_orderpriority").write.parquet(f"{folder}/orders.parquet")
    spark.range(n).selectExpr("id as l_orderkey", "id as l_partkey", "id % 7 as l_suppkey", "1 as l_linenumber", "1.0D as l_quantity", "2.0D as l_extendedprice", "'N' as l_returnflag", "'O' as l_linestatus", f"{at} as l_shipdate").write.parquet(f"{folder}/lineitem.parquet")
    return n * 1583020800000000 + 86400000000 * sum(i % 28 for i in range(n))


def test_sums_of_times_beyond_bigint(spark, tmp_path):
    from tracelake.plans import registry

    total = wide_tables(spark, str(tmp_path))
    assert total > 1 << 63
    found = {r["cat"]: (r["n"], int(r["ts"])) for r in registry.queries()["trace_scan"](spark, str(tmp_path)).collect()}
    assert found == {"cpu_op": (6000, total), "kernel": (6000, total)}
    row = registry.queries()["trace_scan_ranges"](spark, str(tmp_path)).collect()
    assert [(r["n"], int(r["ts"])) for r in row] == [(12000, 2 * total)]


def test_little_is_read_behind_a_range(tmp_path):
    from tracelake.sources import large

    path = tmp_path / "a.json"
    path.write_text('{"traceEvents": [' + ",".join('{"name": "x", "cat": "c", "ts": %d}' % i for i in range(100_000)) + "]}")
    read = []
    with open(path, "rb") as f:
        for got in large.growing(f, large.BEYOND, 1 << 20):
            read.append(len(got))
    assert sum(read) == path.stat().st_size and read[0] == large.BEYOND and read[1] == 2 * read[0] and max(read) <= 1 << 20


def test_first_of_the_longest_kernels(spark, tmp_path):
    """Of kernels of equal dur the one that stands first in the table, as the SQL's arg_max does with one thread."""
    import duckdb

    from tracelake.plans import registry

    items = "hash(i) % 500 AS l_orderkey, i AS l_partkey, hash(i, 1) % 90 AS l_suppkey, i % 7 AS l_linenumber, 1.0::DOUBLE AS l_quantity, (i % 3)::DOUBLE AS l_extendedprice, 'N' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '2020-01-01' AS l_shipdate"
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE TABLE lineitem AS SELECT * REPLACE (l_orderkey::BIGINT AS l_orderkey, l_suppkey::BIGINT AS l_suppkey) FROM (SELECT {items} FROM range(5000) r(i))")
    c.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    wanted = sorted(c.execute(registry.oracle_sql()["representative_kernel"]).fetchall())
    assert sorted(map(tuple, registry.queries()["representative_kernel"](spark, str(tmp_path)).collect())) == wanted


def test_links_of_states_are_joined_once(spark, tmp_path, monkeypatch):
    """The three turns read stored links: the tables are read for one join alone."""
    from tracelake.plans import adapters, registry

    seen, update = [], states.update
    monkeypatch.setattr(states, "update", lambda s, p, links, *more: (seen.append(links), update(s, p, links, *more))[1])
    registry.queries()["kernel_states"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 3 and all("Join" not in x._jdf.queryExecution().optimizedPlan().toString() for x in seen)
    cpu = adapters.operations(spark, "/root/testdata/sf0.001")
    both = correlate.linked(cpu, adapters.kernels(spark, "/root/testdata/sf0.001", cpu), ["name"])
    once = correlate.linked(cpu, adapters.kernels(spark, "/root/testdata/sf0.001"), ["name"], ["ext_id"])
    assert once.select(both.columns).exceptAll(both).isEmpty() and both.exceptAll(once.select(both.columns)).isEmpty()


def test_kernels_are_not_nested_for_an_analysis(spark, tmp_path, monkeypatch):
    """Only threads that hold operations are nested; kernels of other threads have no stack to give or to take."""
    seen, nest = [], analysis.nest
    monkeypatch.setattr(analysis, "nest", lambda rows: (seen.append(rows), nest(rows))[1])
    rows = [*TRACE, op("inside", 12, 3, 1, cat="kernel"), op("python", 11, 9, cat="python_function")]
    cpu, kernels = analysis.prepared(traces.read_traces(spark, write(tmp_path / "t.json", rows), "x"))
    assert {r.name for r in seen[0].collect()} == {"nn.Module: Net_0", "aten::mm", "aten::add", "aten::idle", "inside", "python"}
    assert sorted(r.name for r in kernels.collect()) == ["mm_kernel", "triton_poi_fused_add"]
    assert sorted((r.name, tuple(r.call_stack)) for r in cpu.collect()) == [("aten::add", ("Net_0",)), ("aten::mm", ("Net_0",))]
