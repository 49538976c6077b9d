"""DuckDB SQL twins of the registered queries."""

CPU = """cpu AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS file, CAST(year(o_orderdate) AS VARCHAR) AS label, o_orderkey AS ext_id, o_orderpriority AS name,
  o_orderstatus AS dtype, CAST(o_custkey AS VARCHAR) AS shape, epoch_us(o_orderdate) AS ts, o_custkey % 8 AS pid, o_custkey AS tid FROM orders)"""
KERN = """kern AS (SELECT l_orderkey AS ext_id, l_returnflag || l_linestatus AS name, epoch_us(l_shipdate) AS ts, l_extendedprice AS dur, l_suppkey AS stream_id FROM lineitem)"""
REP = """rep AS (SELECT ext_id, max(dur) AS dur, arg_max(name, dur) AS k_name, arg_max(stream_id, dur) AS stream_id FROM kern GROUP BY ext_id)"""
SLICES = """ev AS (SELECT event_id AS pos, user_id AS tid, event_type AS name, epoch_us(ts) AS ts, CAST(trunc(value * 600000000) AS BIGINT) AS dur, props FROM events)"""
NESTED = f"""{SLICES}, ok AS (SELECT * FROM ev WHERE dur > 0),
up AS (SELECT c.pos, c.tid, c.name, c.ts, c.dur, c.props, max(a.pos) AS parent_pos FROM ok c LEFT JOIN ok a ON a.tid = c.tid AND (a.ts, a.pos) < (c.ts, c.pos) AND a.ts + a.dur >= c.ts + c.dur GROUP BY ALL),
path AS (SELECT pos, tid, name, ts, dur, 0 AS depth, [name] AS stack, [pos] AS ids FROM up WHERE parent_pos IS NULL
  UNION ALL SELECT u.pos, u.tid, u.name, u.ts, u.dur, p.depth + 1, list_append(p.stack, u.name), list_append(p.ids, u.pos) FROM up u JOIN path p ON u.parent_pos = p.pos)"""
FLOWS = """fl AS (SELECT pos, ts, CAST(tid AS VARCHAR) || ':' || json_extract_string(props, '$.k') AS flow_id, name FROM ev WHERE name IN ('click', 'purchase')),
pairs AS (SELECT flow_id, arg_max(ts, pos) FILTER (name = 'click') AS fwd_ts, arg_max(ts, pos) FILTER (name = 'purchase') AS bwd_ts, max(pos) AS flow_pos FROM fl GROUP BY flow_id
  HAVING fwd_ts IS NOT NULL AND bwd_ts IS NOT NULL)"""
FRAMES = """fr AS (SELECT c_custkey, CASE c_custkey % 5
  WHEN 0 THEN [c_name || ' object at 0x' || lower(to_hex(c_custkey)), 'nn.Module: ' || c_mktsegment || '_' || c_custkey % 7, 'run: forward']
  WHEN 1 THEN [c_name || ' object at 0x' || lower(to_hex(c_custkey)), 'MulBackward0', 'x: forward']
  WHEN 2 THEN [c_name || ' object at 0x' || lower(to_hex(c_custkey)), 'AccumulateGrad']
  WHEN 3 THEN [c_name || ' object at 0x' || lower(to_hex(c_custkey))] END AS stack FROM customer)"""
_STATS = "count(*) AS kernel_count, round(sum(dur), 2) / count(*) AS mean_dur, round(min(dur), 2) AS min_dur, round(max(dur), 2) AS max_dur, round(sum(dur), 2) AS total_dur"
COLLECTIVES = """six AS (SELECT * FROM (SELECT month(l_shipdate) AS step, CAST(l_suppkey AS INTEGER) AS card, l_orderkey, l_extendedprice AS dur,
  row_number() OVER (PARTITION BY l_suppkey, month(l_shipdate) ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1 AS comm_idx
  FROM lineitem WHERE l_returnflag = 'R') WHERE comm_idx < 6)"""
RANKS = f"""{SLICES}, a AS (SELECT row_number() OVER (ORDER BY ts, pos) - 1 AS comm_idx, * FROM ev WHERE name = 'click'),
b AS (SELECT row_number() OVER (ORDER BY ts, pos) - 1 AS comm_idx, * FROM ev WHERE name = 'view')"""


def _normal(coarse: bool) -> str:
    module = "replace(f, 'nn.Module: ', '')"
    module = f"regexp_replace({module}, '^(.+)_\\d+$', '\\1')" if coarse else module
    return f"""WITH {FRAMES} SELECT c_custkey, coalesce(array_to_string(CASE WHEN len(list_filter(stack, lambda f: contains(f, 'nn.Module:'))) > 0
  THEN list_transform(list_filter(stack, lambda f: contains(f, 'nn.Module:')), lambda f: {module})
  ELSE list_transform(stack, lambda f: regexp_replace(f, ' object at 0x[0-9a-fA-F]+', '', 'g')) END, ' -> '), '') AS stack FROM fr"""


def _islands(end: str, unit: int = 1) -> str:
    return f"""{SLICES}, r AS (SELECT pos, ts * {unit} AS s, ts * {unit} + {end} AS e FROM ev),
p AS (SELECT *, max(e) OVER (ORDER BY s, e, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r),
g AS (SELECT *, CAST(sum(CASE WHEN b IS NULL OR s >= b THEN 1 ELSE 0 END) OVER (ORDER BY s, e, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM p)"""


#: The trace files of the adapters: operations and kernels by month of the order; `rep` is the longest kernel of an operation.
TRACES = """op AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS id, o_orderpriority AS name, o_custkey % 8 AS pid, o_custkey AS tid, epoch_us(o_orderdate) AS ts,
  CASE WHEN o_custkey % 3 > 0 THEN o_orderstatus END AS dtype, '[' || o_custkey % 5 || ']' AS shape FROM orders),
kr AS (SELECT month, l_orderkey AS id, l_returnflag || l_linestatus AS name, epoch_us(l_shipdate) AS ts, CASE WHEN l_linenumber < 7 THEN l_extendedprice END AS dur, l_suppkey AS stream, l_linenumber AS line FROM lineitem JOIN op ON op.id = l_orderkey),
pick AS (SELECT id, first(dur ORDER BY coalesce(dur, 0) DESC, ts, line) AS dur, first(name ORDER BY coalesce(dur, 0) DESC, ts, line) AS k_name FROM kr GROUP BY id),
begun AS (SELECT month, min(ts) AS first_ts FROM (SELECT month, ts FROM op UNION ALL SELECT month, ts FROM kr) GROUP BY month)"""


def _totals(keys: str) -> str:
    """Kernel columns of the groups of `own` (keys, k_name, dur): a kernel's rows without dur count with its mean."""
    return f"""st AS (SELECT {keys}, k_name, avg(dur) AS mean, count(*) AS n, min(dur) AS low, max(dur) AS high FROM own GROUP BY ALL HAVING avg(dur) IS NOT NULL),
tot AS (SELECT {keys}, CAST(sum(n) AS BIGINT) AS kernel_count, round(sum(mean * n) / sum(n), 4) AS kernel_mean_duration, round(min(low), 4) AS kernel_min_duration, round(max(high), 4) AS kernel_max_duration, round(sum(mean * n), 4) AS kernel_total_duration FROM st GROUP BY ALL)"""


_KERNEL = ", ".join(f"coalesce(kernel_{c}_duration, 0) AS kernel_{c}_duration" for c in ("mean", "min", "max", "total"))

ORACLES: dict[str, str] = {
    "trace_scan": f"""WITH {TRACES} SELECT month, 'cpu_op' AS cat, count(*) AS n, CAST(sum(ts) AS BIGINT) AS ts, count(*) AS with_dur, CAST(sum(id) AS BIGINT) AS ext_ids, count(dtype) AS with_dtype,
  CAST(NULL AS BIGINT) AS streams, count(DISTINCT (pid, tid)) AS threads, min(shape) AS shape FROM op GROUP BY month
UNION ALL SELECT month, 'kernel', count(*), CAST(sum(ts) AS BIGINT), count(dur), CAST(sum(id) AS BIGINT), 0, CAST(sum(stream) AS BIGINT), 1, NULL FROM kr GROUP BY month""",
    "trace_ranges": f"""WITH {TRACES}, e AS (SELECT month, ts FROM op UNION ALL SELECT month, ts FROM kr) SELECT month, min(ts) * 1000 AS start, max(ts) * 1000 AS "end" FROM e GROUP BY month""",
    "trace_scan_ranges": f"""WITH {TRACES}, e AS (SELECT month, ts, id, 0 AS kind, 0 AS line, 1 AS with_dur FROM op UNION ALL SELECT month, ts, id, 1, line, (dur IS NOT NULL)::INT FROM kr),
p AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY ts, kind, id, line) - 1 AS pos FROM e)
SELECT month, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos, sum(pos)::BIGINT AS places, sum(ts)::BIGINT AS ts, sum(id)::BIGINT AS ext_ids, sum(with_dur)::BIGINT AS with_dur, 0::BIGINT AS base_ns FROM p GROUP BY month""",
    "trace_end_times": f"""WITH {TRACES}, e AS (SELECT month, ts FROM op UNION ALL SELECT month, ts FROM kr) SELECT month, min(ts) * 1000 AS start, max(ts) * 1000 AS "end" FROM e GROUP BY month""",
    "run_fast_slow": """WITH six AS (
  SELECT * FROM (
    SELECT month(l_shipdate)::INT AS step, (l_suppkey % 4)::INT AS card, l_extendedprice AS dur, l_quantity::BIGINT AS nelems,
      row_number() OVER (PARTITION BY l_suppkey % 4, month(l_shipdate) ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1 AS comm_idx
    FROM lineitem WHERE l_returnflag = 'R') WHERE comm_idx < 6 AND step BETWEEN 3 AND 7 AND card IN (0, 1, 3)),
m AS (SELECT step, comm_idx, min(dur) AS f, max(dur) AS s, count(*) AS n FROM six GROUP BY ALL)
SELECT step, comm_idx::INT AS comm_idx, arg_min(nelems, card) AS in_msg_nelems, 'bf16' AS dtype, min(card) FILTER (dur = f) AS fastest_card, f AS fastest_duration_us, min(card) FILTER (dur = s) AS slowest_card, s AS slowest_duration_us,
  round(s / f, 6) AS duration_ratio, n AS total_cards FROM six JOIN m USING (step, comm_idx) GROUP BY step, comm_idx, f, s, n""",
    "trace_report": f"""WITH {TRACES}, own AS (SELECT * FROM op JOIN pick USING (id) JOIN begun USING (month)), {_totals("name")},
t AS (SELECT name, first({{'dtype': coalesce(dtype, ''), 'shape': shape, 'pid': pid, 'tid': tid, 'ts': ts - first_ts}} ORDER BY month, ts, id) AS f FROM own GROUP BY name)
SELECT name, f.dtype AS dtype, f.shape AS shape, CAST(f.pid AS VARCHAR) AS pid, CAST(f.tid AS VARCHAR) AS tid, 'none' AS fwd_bwd_type, printf('%.2f', CAST(f.ts AS DOUBLE)) AS timestamp,
  coalesce(kernel_count, 0) AS kernel_count, {_KERNEL}, round(kernel_total_duration / sum(kernel_total_duration) OVER () * 100, 6) AS kernel_duration_ratio FROM t LEFT JOIN tot USING (name)""",
    "trace_report_by_dtype": f"""WITH {TRACES}, chosen AS (SELECT id, first(dur ORDER BY coalesce(dur, 0) DESC, ts, line) AS dur, first(name ORDER BY coalesce(dur, 0) DESC, ts, line) AS k_name FROM kr WHERE name LIKE '%_O%' GROUP BY id),
own AS (SELECT coalesce(dtype, 'unknown') AS dtype, CAST(pid AS VARCHAR) AS pid, k_name, dur FROM op JOIN chosen USING (id) WHERE month BETWEEN '1993-01' AND '1995-12' AND name NOT LIKE '%LOW%'), {_totals("dtype, pid")}
SELECT dtype, pid, coalesce(kernel_count, 0) AS kernel_count, {_KERNEL} FROM (SELECT DISTINCT dtype, pid FROM own) LEFT JOIN tot USING (dtype, pid)""",
    "trace_comparison": f"""WITH {TRACES}, own AS (SELECT *, month[1:4] AS year FROM op JOIN pick USING (id) WHERE month[1:4] IN ('1996', '1997')), {_totals("tid, year")},
s AS (SELECT tid, year, first(coalesce(dtype, '') ORDER BY month, ts, id) AS dtype, list_sort(list(DISTINCT dtype) FILTER (dtype IS NOT NULL)) AS dtypes,
  list_sort(list(DISTINCT shape)) AS shapes, list_sort(list(DISTINCT name)) AS names FROM own GROUP BY tid, year),
u AS (SELECT s.*, coalesce(kernel_count, 0) AS n, coalesce(kernel_mean_duration, 0) AS mean, st_mean AS exact FROM s LEFT JOIN tot USING (tid, year) LEFT JOIN (SELECT tid, year, sum(mean * n) / sum(n) AS st_mean FROM st GROUP BY ALL) USING (tid, year)),
a AS (SELECT * FROM u WHERE year = '1996'), b AS (SELECT * FROM u WHERE year = '1997')
SELECT CAST(tid AS VARCHAR) AS tid, coalesce(a.dtype, 'N/A') AS "1996_dtype", coalesce(b.dtype, 'N/A') AS "1997_dtype", coalesce(a.n, 0) AS "1996_kernel_count", coalesce(b.n, 0) AS "1997_kernel_count",
  coalesce(a.mean, 0) AS "1996_kernel_mean_duration", coalesce(b.mean, 0) AS "1997_kernel_mean_duration",
  round(CASE WHEN a.exact > 0 AND b.exact > 0 THEN b.exact / a.exact END, 6) AS "1997_vs_1996_mean_duration_ratio",
  coalesce(a.dtypes, []) = coalesce(b.dtypes, []) AS dtype_equal, coalesce(a.shapes, []) = coalesce(b.shapes, []) AS shape_equal, coalesce(a.names, []) = coalesce(b.names, []) AS name_equal
FROM a FULL JOIN b USING (tid)""",
    "kernel_starts": f"WITH {CPU}, {KERN} SELECT cpu.name, count(*) - 1 AS last_place, CAST(min(kern.ts) AS DOUBLE) AS first_ts, CAST(max(kern.ts) AS DOUBLE) AS last_ts FROM cpu JOIN kern USING (ext_id) GROUP BY cpu.name",
    "op_kernel_time_by_name": f"""WITH {CPU}, {KERN}, {REP} SELECT name, round(sum(dur) / sum(sum(dur)) OVER () * 100, 6) AS share, {_STATS} FROM cpu JOIN rep USING (ext_id) GROUP BY name""",
    "agg_multi_key": f"WITH {CPU}, {KERN}, {REP} SELECT name, dtype, pid, {_STATS} FROM cpu JOIN rep USING (ext_id) GROUP BY name, dtype, pid",
    "kernel_stats": f"""WITH {CPU}, {KERN} SELECT cpu.name, kern.name AS k_name, count(*) AS n, round(sum(dur), 2) / count(*) AS mean_dur, round(min(dur), 2) AS min_dur, round(max(dur), 2) AS max_dur,
  round(sqrt(coalesce(var_samp(dur), 0)), 3) AS std_dur FROM cpu JOIN kern USING (ext_id) GROUP BY cpu.name, kern.name""",
    "kernel_share_of_total": f"""WITH {CPU}, {KERN}, {REP} SELECT label, dtype, round(sum(dur) / sum(sum(dur)) OVER (PARTITION BY label) * 100, 6) AS share FROM cpu JOIN rep USING (ext_id) GROUP BY label, dtype""",
    "common_external_ids": f"""WITH {CPU}, {KERN}, k AS (SELECT file, count(*) AS kernels FROM cpu JOIN kern USING (ext_id) GROUP BY file)
SELECT file, name, count(*) AS operations, kernels FROM cpu JOIN k USING (file) WHERE ext_id IN (SELECT ext_id FROM kern) GROUP BY file, name, kernels""",
    "include_exclude_patterns": f"""WITH {CPU}, {KERN}, c AS (SELECT * FROM cpu WHERE contains(name, '-') AND NOT contains(name, 'LOW')),
k AS (SELECT * FROM kern WHERE (regexp_matches(name, '.F') OR name LIKE 'N%') AND name NOT LIKE 'R%')
SELECT c.name, count(DISTINCT ext_id) AS operations, count(*) AS links FROM c JOIN k USING (ext_id) GROUP BY c.name""",
    "filter_ids_either_side": f"""WITH {CPU}, {KERN}, ids AS (SELECT ext_id FROM cpu WHERE NOT regexp_matches(name, 'URGENT|LOW') UNION SELECT ext_id FROM kern JOIN cpu USING (ext_id) WHERE kern.name IN ('AF', 'NO'))
SELECT 'cpu_op' AS cat, name, count(*) AS n FROM cpu WHERE ext_id IN (FROM ids) AND NOT regexp_matches(name, 'URGENT|LOW') GROUP BY name
UNION ALL SELECT 'kernel', name, count(*) FROM kern WHERE ext_id IN (FROM ids) AND name IN ('AF', 'NO') GROUP BY name""",
    "representative_kernel": f"WITH {KERN}, {REP} SELECT ext_id, dur, stream_id AS stream FROM rep",
    "op_index": f"WITH {CPU} SELECT file, ext_id, row_number() OVER (PARTITION BY file ORDER BY ts, ext_id) - 1 AS op_index FROM cpu",
    "normalize_ts": f"WITH {CPU} SELECT ext_id, CAST(ts - min(ts) OVER (PARTITION BY file) AS DOUBLE) AS ts FROM cpu",
    "readable_ts": f"""WITH {SLICES} SELECT pos, strftime(make_timestamp(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(make_timestamp(ts + dur), '%Y-%m-%d %H:%M:%S.%f') AS "end", ts AS micros,
  strftime(make_timestamp(ts), '%Y-%m-%d_%H-%M-%S') AS folder FROM ev""",
    "strip_suffixes": """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'triton_poi_fused' WHEN 1 THEN 'triton_poi_' || s_suppkey ELSE 'mm_' || s_suppkey END AS kernel, 'Dense' AS module FROM supplier""",
    "args_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.\"Input Dims\"') AS missing FROM events",
    "phase_from_stack": f"""WITH {FRAMES}, hits AS (SELECT c_custkey, list_filter(list_transform(stack, lambda f: CASE WHEN contains(f, ': forward') THEN 'fwd'
  WHEN contains(f, ': backward') OR contains(f, 'Backward') THEN 'bwd' WHEN contains(f, 'Grad') THEN 'grad' END), lambda x: x IS NOT NULL) AS h FROM fr) SELECT c_custkey, coalesce(h[1], 'none') AS phase FROM hits""",
    "normalize_stack": _normal(False),
    "normalize_stack_coarse": _normal(True),
    "nesting_parent": f"WITH RECURSIVE {NESTED} SELECT pos, parent_pos FROM up",
    "call_stack_path": f"WITH RECURSIVE {NESTED} SELECT pos, depth, array_to_string(stack, ' -> ') AS stack FROM path",
    "call_tree": f"""WITH RECURSIVE {NESTED},
n AS (SELECT *, ids[1] AS root, coalesce(lag(depth) OVER (PARTITION BY ids[1] ORDER BY ts, pos), -1) AS before, row_number() OVER (PARTITION BY ids[1] ORDER BY ts, pos) AS place FROM path),
t AS (SELECT root, ts, pos, place, depth, repeat(']}}', greatest(before - depth + 1, 0)) || CASE WHEN before >= depth THEN ',' ELSE '' END || '{{"event":{{"name":"' || name || '","cat":"cpu_op","ts":' || ts || ',"dur":' || dur || ',"pid":0,"tid":' || tid
  || '}},"depth":' || depth || ',"call_stack":["' || array_to_string(stack, '","') || '"],"children":[' AS piece FROM n)
SELECT root AS root_pos, count(*) AS nodes, string_agg(piece, '' ORDER BY ts, pos) || repeat(']}}', arg_max(depth, place) + 1) AS tree FROM t GROUP BY root""",
    "flow_pairs": f"WITH {SLICES}, {FLOWS} SELECT flow_id, fwd_ts, bwd_ts FROM pairs",
    "flow_propagate": f"""WITH RECURSIVE {NESTED}, {FLOWS}, at_ts AS (SELECT ts, max(pos) AS pos FROM ok GROUP BY ts),
paired AS (SELECT b.pos, arg_max(p.stack, flow_pos) AS stack FROM pairs JOIN at_ts b ON b.ts = bwd_ts JOIN at_ts f ON f.ts = fwd_ts JOIN path p ON p.pos = f.pos GROUP BY b.pos),
above AS (SELECT pos, unnest(ids) AS up, generate_subscripts(ids, 1) AS level FROM path),
won AS (SELECT above.pos, arg_min(paired.stack, level) AS stack FROM above JOIN paired ON paired.pos = above.up GROUP BY above.pos)
SELECT path.pos, CASE WHEN won.pos IS NULL THEN 'none' ELSE 'bwd' END AS phase, array_to_string(coalesce(won.stack, path.stack), ' -> ') AS stack FROM path LEFT JOIN won ON won.pos = path.pos""",
    "stack_prefix_dedup": f"""WITH RECURSIVE {NESTED}, t AS (SELECT tid AS ext_id, name, pos, array_to_string(stack, ' -> ') AS s FROM path)
SELECT ext_id, name, pos FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.ext_id = t.ext_id AND u.name = t.name AND u.pos <> t.pos AND starts_with(u.s, t.s) AND (length(u.s) > length(t.s) OR u.pos < t.pos))""",
    "stack_prefix_merge": f"""WITH RECURSIVE {NESTED}, t AS (SELECT DISTINCT pos % 50 AS k, stack FROM path),
longest AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.k = t.k AND len(u.stack) > len(t.stack) AND u.stack[1:len(t.stack)] = t.stack))
SELECT t.k, array_to_string(t.stack, ' -> ') AS stack, array_to_string(arg_min(l.stack, '(''' || array_to_string(l.stack, ''', ''') || '''' || CASE WHEN len(l.stack) = 1 THEN ',)' ELSE ')' END), ' -> ') AS merged
FROM t JOIN longest l ON l.k = t.k AND l.stack[1:len(t.stack)] = t.stack GROUP BY t.k, t.stack""",
    "same_label_union": f"""WITH {CPU}, {KERN}, {REP} SELECT CASE WHEN CAST(file AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END AS label, name, {_STATS} FROM cpu JOIN rep USING (ext_id) GROUP BY 1, 2""",
    "compare_labels": f"""WITH {CPU}, {KERN}, {REP}, s AS (SELECT shape, label, count(*) AS n, round(sum(dur), 2) / count(*) AS mean FROM cpu JOIN rep USING (ext_id) GROUP BY shape, label),
a AS (SELECT * FROM s WHERE label = '1996'), b AS (SELECT * FROM s WHERE label = '1997')
SELECT coalesce(a.shape, b.shape) AS shape, coalesce(a.n, 0) AS count_1996, coalesce(b.n, 0) AS count_1997, coalesce(a.mean, 0) AS mean_1996, coalesce(b.mean, 0) AS mean_1997,
  b.mean / a.mean AS ratio FROM a FULL JOIN b ON a.shape = b.shape""",
    "compare_set_equality": f"""WITH {CPU}, s AS (SELECT shape, coalesce(list_sort(list(DISTINCT dtype) FILTER (label = '1996')), []) AS d1, coalesce(list_sort(list(DISTINCT dtype) FILTER (label = '1997')), []) AS d2,
  coalesce(list_sort(list(DISTINCT name) FILTER (label = '1996')), []) AS n1, coalesce(list_sort(list(DISTINCT name) FILTER (label = '1997')), []) AS n2
  FROM cpu WHERE label IN ('1996', '1997') GROUP BY shape) SELECT shape, d1 = d2 AS dtype_equal, n1 = n2 AS name_equal FROM s""",
    "stream_sets": f"WITH {CPU}, {KERN}, {REP} SELECT name, dtype, array_to_string(list_sort(list(DISTINCT stream_id)), ',') AS stream FROM cpu JOIN rep USING (ext_id) GROUP BY name, dtype",
    "kernel_span": f"WITH {CPU}, {KERN} SELECT shape, CAST(min(kern.ts) AS DOUBLE) AS span_start, CAST(floor(max(kern.ts + dur)) AS BIGINT) AS span_end, CAST(count(*) AS INTEGER) AS n FROM cpu JOIN kern USING (ext_id) GROUP BY shape",
    "comm_first_six": f"WITH {COLLECTIVES} SELECT CAST(step AS INTEGER) AS step, card, CAST(comm_idx AS INTEGER) AS comm_idx, l_orderkey, dur FROM six",
    "comm_fast_slow": f"""WITH {COLLECTIVES}, m AS (SELECT step, comm_idx, min(dur) AS f, max(dur) AS s, count(*) AS n FROM six GROUP BY step, comm_idx)
SELECT CAST(step AS INTEGER) AS step, CAST(comm_idx AS INTEGER) AS comm_idx, arg_min(card, CAST(card AS VARCHAR)) FILTER (dur = f) AS fastest_card, f AS fastest_duration_us,
  arg_min(card, CAST(card AS VARCHAR)) FILTER (dur = s) AS slowest_card, s AS slowest_duration_us, round(s / f, 6) AS duration_ratio, n AS total_cards FROM six JOIN m USING (step, comm_idx) GROUP BY step, comm_idx, f, s, n""",
    "overlap_in_range": f"""WITH {SLICES}, r AS (SELECT * FROM ev WHERE ts <= epoch_us(TIMESTAMP '2024-01-11') AND ts + dur >= epoch_us(TIMESTAMP '2024-01-10'))
SELECT pos, tid FROM r WHERE tid IN (SELECT tid FROM r WHERE name = 'error')""",
    "overlap_many_ranges": f"""WITH {SLICES} SELECT r.tid, r.pos, count(*) AS n, min(e.pos) AS first, max(e.pos) AS last, sum(e.dur)::BIGINT AS dur
FROM ev r JOIN ev e ON e.tid = r.tid AND e.ts <= r.ts + r.dur AND e.ts + e.dur >= r.ts WHERE r.name = 'purchase' AND e.name IN ('view', 'click') AND r.dur >= 0 AND e.dur >= 0 GROUP BY ALL""",
    "prev_kernel_asof": f"""WITH {SLICES}, j AS (SELECT t.pos, t.ts, t.tid, max((k.ts + k.dur, k.pos, k.name)) AS p FROM ev t LEFT JOIN ev k ON k.tid = t.tid AND k.ts < t.ts AND k.name IN ('click', 'view') WHERE t.name = 'purchase' GROUP BY ALL)
SELECT pos, p[2] AS prev_pos, p[3] AS prev_name, coalesce(p[1], (SELECT min(ts) FROM ev WHERE ev.tid = j.tid)) AS window_start, ts AS window_end FROM j""",
    "sequence_zip_diff": f"""WITH {RANKS} SELECT comm_idx, abs(a.ts - b.ts) AS start_diff, abs(a.ts + a.dur - b.ts - b.dur) AS end_diff, abs(a.ts - b.ts) > 5000 OR abs(a.ts + a.dur - b.ts - b.dur) > 5000 AS apart, a.name = b.name AS same_name
FROM a JOIN b USING (comm_idx)""",
    "sequence_equal": f"WITH {RANKS} SELECT false AS equal, (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b",
    "sequence_consistent": f"WITH {RANKS} SELECT count(*) > 5 AS consistent, bool_and(a.name = b.name) AS same_names FROM a JOIN b USING (comm_idx)",
    "nth_collective": f"WITH {SLICES} SELECT CAST(tid AS VARCHAR) AS file, pos FROM ev QUALIFY row_number() OVER (PARTITION BY tid ORDER BY ts, pos) = 4",
    "time_islands": f"WITH {_islands('dur % 60000000')} SELECT pos AS path, island FROM g",
    "island_groups": f"""WITH {_islands('dur % 600000000 * 1000', 1000)} SELECT island, count(*) AS runs, min(s) AS start, max(e) AS "end",
  strftime(make_timestamp(min(s) // 1000), '%Y-%m-%d_%H-%M-%S') || '_group_' || island AS group_name FROM g GROUP BY island""",
    "node_filter": """SELECT o_orderkey, CAST(o_orderkey % 64 AS INTEGER) AS node_id FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 1 AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-01-01'""",
    "per_file_counts": f"""WITH {CPU}, {KERN}, c AS (SELECT file, count(*) AS operations FROM cpu GROUP BY file), k AS (SELECT file, count(*) AS kernels FROM cpu JOIN kern USING (ext_id) GROUP BY file),
u AS (SELECT file, operations, kernels FROM c JOIN k USING (file)) SELECT * FROM u UNION ALL SELECT 'all', CAST(sum(operations) AS BIGINT), CAST(sum(kernels) AS BIGINT) FROM u""",
    "running_order": """WITH n AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS place FROM lineitem)
SELECT l_orderkey, min(place) AS first_place, max(place) AS last_place, CAST(sum(place) AS BIGINT) AS places FROM n GROUP BY l_orderkey""",
}
ORACLES["kernel_states"] = ORACLES["kernel_stats"]  # the same rows, by another way
ORACLES["stream_nesting_parent"] = ORACLES["nesting_parent"]
