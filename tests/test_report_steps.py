"""The steps of a report on large compressed files: each is done once, and what they leave out changes no row."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import correlate
from tracelake.plans import analysis
from tracelake.sources import large, traces


def op(name, ts, dur, ext=None, pid=1, tid=1, cat="cpu_op", **args):
    return {"name": name, "cat": cat, "ph": "X", "pid": pid, "tid": tid, "ts": ts, "dur": dur, "args": args | ({"External id": ext} if ext is not None else {})}


def flat(df):
    return sorted(tuple(str(x) for x in r) for r in df.withColumn("args", F.to_json("args")).collect())


ODD = ['"a"', '"1-URGENT"', '"1.50"', "1.50", "1.0", "100", "-0", "-0.0", "1e5", "12345678901234567890", "1" * 42, "1e400", "true", "null", "{}", '{"b":1,"a":2}', "[1,[3.0]]", '""', '" 12 "', '"NaN"', "NaN", "'x'",
       '"\\u00e9\\n\\"q"', '"{x"', "0.1", "9007199254740993", "9223372036854775808", "7.9", '"7"', '"7.0"', '"tr\\u0000x"', '"-inf"', '"2.50E3"']


def test_typed_entries_are_those_of_variants(spark):
    """Texts are read with usual types; rows are those that variants give, whatever the entries are."""
    texts = [f'{{"{k}": {v}, "ts": 5}}' if k != "ts" else f'{{"ts": {v}}}' for k in ("name", "cat", "ph", "pid", "tid", "ts", "dur", "id", "stream", "args") for v in ODD]
    texts += [f'{{"args": {{"{k}": {v}, "q": {{"stream": 1}}}}, "name": "n"}}' for k in ("External id", "Input type", "Input Dims", "stream", "Group size", "dtype", "Process Group Ranks") for v in ODD]
    texts += ["5", '"text"', '[{"name": "in a list"}]', "{}", "null", '{"name": "cut', "", '{"NAME": "upper"}', '\n {\n "name" : "spaced" } ', '{"args": [1], "name": "l"}', '{"_not_as_typed": "x", "name": "y"}', '{"name": "x",}']
    rows = spark.createDataFrame([("f", i, 7, t) for i, t in enumerate(texts)], "file string, pos bigint, base_ns bigint, event string")
    fields = [c.split()[0] for c in traces._EVENT.split(", ")]
    parsed = rows.withColumn("e", F.try_parse_json("event")).select("file", "base_ns", "pos", *(F.try_variant_get("e", f"$.{c}", "variant").alias(c) for c in fields))
    want = flat(traces.parsed_events(parsed, "x"))
    assert flat(traces.events_of(rows, "x")) == want
    # in lists: odd ones alone and among usual ones, which are then read by themselves too
    usual = '{"name": "n", "ph": "X", "pid": 1, "tid": 2, "ts": 1.5, "dur": 2, "args": {"External id": 3, "Input Dims": [[1], []]}}'
    between = [("f", 3 * i, 7, [usual, t, usual] if i % 2 else [t]) for i, t in enumerate(texts)]
    lists = traces.events_of_lists(spark.createDataFrame(between, "file string, pos bigint, base_ns bigint, events array<string>"), "x")
    places = F.when((F.col("pos") % 6 == 0), F.col("pos") / 3).when(F.col("pos") % 6 == 4, (F.col("pos") - 1) / 3).cast("bigint")
    assert flat(lists.withColumn("pos", places).where("pos is not null")) == want
    others = lists.where("pos % 6 in (3, 5)").drop("pos", "args").distinct().collect()
    assert len(others) == 1 and (others[0].ts, others[0].ext_id, others[0]["shape"]) == (1.5, "3", "[[1],[]]")
    assert flat(traces.events_of_lists(rows.groupBy("file", "base_ns").agg(F.lit(0).cast("bigint").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "event")))["event"].alias("events")), "x")) == want


def test_compressed_files_are_scanned_once(spark, tmp_path, monkeypatch):
    """No pass before the events, and none of them stored, whatever lies where: the rows are those of files that are parsed whole."""
    rng = random.Random(3)
    events = [op(rng.choice(["a", "b,]}", 'q"', "back\\", "é"]), i, 2, i, pid="p", more=[{"x": [1, 2]}, "]["]) for i in range(40)] + [5, {}, op('"baseTimeNanoseconds": 9,', 1, 1)]
    bodies = {
        "end": {"other": [{"name": "no event"}], "traceEvents": events, "inner": {"baseTimeNanoseconds": 4}, "baseTimeNanoseconds": 11},
        "begin": {"baseTimeNanoseconds": 12, "traceEvents": events}, "none": {"traceEvents": events}, "empty": {"traceEvents": []},
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.json.gz").write_bytes(gzip.compress(json.dumps(body, indent=rng.choice([None, 1]), ensure_ascii=False).encode()))
    want = flat(traces.read_traces(spark, f"{tmp_path}/*.gz", "x"))
    monkeypatch.setattr(large, "saved", lambda *_: pytest.fail("stored"))
    monkeypatch.setattr(large, "TOGETHER", 9)
    for piece in (7, 300, large.PIECE):
        monkeypatch.setattr(large.read_compressed, "__defaults__", (piece,))
        assert flat(traces.read_traces(spark, f"{tmp_path}/*.gz", "x", most=0)) == want
    (tmp_path / "cut.json.gz").write_bytes(gzip.compress(json.dumps(bodies["none"]).encode()[:-30]))
    with pytest.raises(Exception, match=r"broken JSON in .*cut\.json"):
        traces.read_traces(spark, f"{tmp_path}/cut.json.gz", most=0).collect()


def test_bytes_that_are_no_text_are_replaced():
    import numpy as np

    text = b'{"a": "\xc3"},{"b": "\xc3\xa9"},{"c": 1}'
    places = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x2C)
    starts, ends = np.append(0, places + 1), np.append(places, len(text))
    assert large.texts(text, starts, ends).to_pylist() == [x.decode("utf-8", "replace") for x in text.split(b",")]
    assert large.texts(text, starts[1:], ends[1:]).to_pylist() == ['{"b": "é"}', '{"c": 1}']


def test_a_report_makes_what_it_shows(spark, tmp_path, monkeypatch):
    """Operations are numbered for reports that show numbers alone; they and their kernels are stored once."""
    rows = [op("nn.Module: Net_0", 0, 90, cat="python_function"), *(op("mm", 10 * i, 5, i, tid=1 + i % 3) for i in range(6)), *(op("k", 10 * i + 1, 3 + i, i, pid=0, cat="kernel") for i in range(5))]
    path = tmp_path / "t.json.gz"
    path.write_bytes(gzip.compress(json.dumps({"baseTimeNanoseconds": 5, "traceEvents": rows}).encode()))
    shown = ["dtype", "fwd_bwd_type", "timestamp", "kernel_duration", "kernel_names"]
    with_index = analysis.analyse(spark, str(path), ["name"], [*shown, "op_index", "readable_timestamp"]).first()
    stored, saved = [], analysis.saved
    monkeypatch.setattr(analysis, "saved", lambda df, name: (stored.append(name), saved(df, name))[1])
    monkeypatch.setattr(correlate, "with_op_index", lambda _: pytest.fail("numbered"))
    out = analysis.analyse(spark, str(path), ["name"], shown).collect()
    assert [(r.name, r.kernel_count, r.kernel_total_duration, r.kernel_names, r.timestamp) for r in out] == [("mm", 5, 25.0, "k", "0.00")]
    assert (with_index.op_index, with_index.readable_timestamp if "readable_timestamp" in with_index else with_index.timestamp) == (0, "1970-01-01 00:00:00.000000")
    assert not {"links", "operations", "kernels", "representatives"} & set(stored) and stored.count("linked") == 1


def test_threads_are_cut_where_they_are_large(spark, tmp_path, monkeypatch):
    """Stacks are the same whether threads are dealt out whole or cut by time."""
    rng = random.Random(5)
    rows = [op(f"f{i % 7}", rng.randrange(60), rng.randrange(1, 30), i % 9 if i % 4 else None, pid=rng.choice([1, "1", "x", 2]), tid=rng.randrange(3), cat="cpu_op" if i % 11 else "python_function") for i in range(120)]
    rows += [op("k", i, 5, i, pid=9, tid=9, cat="kernel") for i in range(9)]
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"traceEvents": rows}))
    events = lambda: traces.read_traces(spark, str(path), "x")
    result = lambda df: sorted(str(r) for r in df.select(sorted(df.columns)).collect())
    runs = []
    for small in (0, 15, 10**6):
        monkeypatch.setattr(analysis, "SMALL", small)
        cpu, kernels = analysis.prepared(events())
        runs.append((result(analysis.enriched(events())), result(cpu), result(kernels)))
    assert runs[0] == runs[1] == runs[2] and any("call_stack=['f" in r for r in runs[0][0])


def test_compressed_files_count_with_what_they_hold(spark, tmp_path):
    """Traces shrink to a twentieth and less: a file whose text is above the limit isn't parsed as one row."""
    text = json.dumps({"traceEvents": [op("k", i // 9, 1.5, i // 4, pid=0, cat="kernel", stream=i % 7) for i in range(20_000)]}, indent=1).encode()
    (tmp_path / "t.json.gz").write_bytes(gzip.compress(text))
    size = (tmp_path / "t.json.gz").stat().st_size
    assert len(text) > 20 * size
    assert len(traces.sized_files(spark, str(tmp_path), 20 * size)) == 1
