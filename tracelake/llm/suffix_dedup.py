"""Exact substring deduplication with per-shard suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the corpus.

1. Every window of `length` bytes has an anchor: the k-gram in it with the smallest hash.  Neighbouring
   windows share anchors, so a document falls into segments (runs of windows with one anchor), about one per
   75 bytes.  Equal windows have equal anchors at equal offsets, so they meet under the anchor's hash.
2. Segments with equal bytes (64-bit hashes of the anchor and of the whole segment, which has less than two
   windows' bytes) are combined before the shuffle; all windows of a segment that occurs twice are repeats.  Anchors whose
   segments all agree need no text.
3. The other anchors' distinct segments are gathered into shards.  Each shard builds a suffix array by
   prefix doubling that re-sorts only unsorted groups (Larsson-Sadakane) and the common prefixes of
   neighbours (Kasai, in the permuted form that needs comparisons at irreducible places only).
4. An anchor with more segments than a shard holds is salted over several shards, which are merged pair by
   pair: the windows of one are looked up in the suffix array of the other by binary search.  Pairs grow with the
   square of the shards, so an anchor of more than MOST_SHARDS of them (a line that very many texts hold) goes
   window by window instead: two 64-bit hashes of each window are counted, which is linear and finds the same.
5. The repeated windows travel back to their documents, where their union is cut out.

Null and empty texts have no bytes.  Texts shorter than `length` are left alone.  Repeated rows are documents
of their own, so copies of at least `length` bytes go entirely, the first one included (that is the contract
of the operator: strings are judged on the input).  Texts of any length are cut alike, in blocks of windows.
Other columns are left out, so their names don't matter.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import as_text, keyed, saved

LENGTH = 200
ANCHOR = 50
#: Segments of one anchor in one shard, bytes of a shard, and shards of an anchor that are merged.
SHARD_SEGMENTS, SHARD_BYTES, MOST_SHARDS = 3000, 1 << 20, 8
#: Bits of a place in `sliding_argmin`, so windows of one block at most.
PLACE_BITS = 24


# ---- segments -------------------------------------------------------------------------------------

def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value (leftmost of equals) in each window, from block-wise running minima.

    Values are told apart by their highest 64 - PLACE_BITS bits, in texts of any length.
    """
    n = len(values)
    step = (1 << PLACE_BITS) - width
    if n > 1 << PLACE_BITS:
        return np.concatenate([a + sliding_argmin(values[a : a + step + width - 1], width) for a in range(0, n - width + 1, step)])
    low = np.uint64((1 << PLACE_BITS) - 1)
    keyed_ = (values & ~low) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    grid = np.concatenate([keyed_, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & low).astype(np.int64)


def segments(prefix: np.ndarray, start: int, stop: int, grams: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of the text at [start, stop) of a block."""
    m = stop - start - length + 1
    anchor = sliding_argmin(grams[start : stop - k + 1], length - k + 1)
    head = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    return grams[start + anchor[head]], head, np.diff(np.append(head, m))


def anchored(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(_rid, anchors, digests, places): the segments of each document; place = first window << 16 | windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in B.text_blocks(batch, "text"):
                prefix = B.prefix_hash(data)
                grams, lanes = B.byte_grams(prefix, k), B.lane_prefix(data)
                parts, sizes = [], np.zeros(len(offs), np.int64)
                for i, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
                    if b - a >= length:
                        anchor, head, n = segments(prefix, a, b, grams, length, k)
                        parts.append((anchor, B.segment_digest(lanes, a + head, a + head + n + length - 1), head << 16 | n))
                        sizes[i + 1] = len(head)
                if not parts:
                    continue
                ptr = np.cumsum(sizes)
                flat = [np.concatenate(x) for x in zip(*parts, strict=True)]
                lists = [B.list_array(x.view(np.int64), ptr, pa.int64()) for x in flat]
                out = pa.RecordBatch.from_arrays([part.column("_rid"), *lists], ["_rid", "anchors", "digests", "places"])
                yield out.filter(pa.array(sizes[1:] > 0))

    return rows.select("_rid", "text").mapInArrow(cut, "_rid long, anchors array<long>, digests array<long>, places array<long>")


# ---- suffix arrays --------------------------------------------------------------------------------

def big_endian_words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number (zeros after the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | padded[j : j + len(text)]
    return out


def suffix_array(text: np.ndarray, stop: int) -> np.ndarray:
    """Suffixes in order of their first `stop` bytes at least; prefix doubling that re-sorts tied groups only."""
    n = len(text)
    key = big_endian_words(text)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.append(True, sorted_key[1:] != sorted_key[:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = first  # of a group: the place of its first suffix
    depth = 8
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))  # places in groups of two or more
    while len(tied) and depth < stop:
        suffix = order[tied]
        group, follow = rank[suffix], rank[np.minimum(suffix + depth, n)]
        by = np.lexsort((follow, group))
        suffix, group, follow = suffix[by], group[by], follow[by]
        order[tied] = suffix
        new = np.append(True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1]))
        rank[suffix] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        single = new & np.append(new[1:], True)
        tied = tied[~single]
        depth *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix (by place in the text) with its predecessor in order, up to `most`.

    Kasai's bound in its permuted form: if the bytes before both suffixes agree, then the value is that of the
    place before less one, so only the other (irreducible) places are compared byte by byte.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    reducible = (at > 0) & (before > 0)
    reducible[reducible] = (text[at[reducible] - 1] == text[before[reducible] - 1]) & (before[at[reducible] - 1] == before[reducible] - 1)
    base = np.flatnonzero(~reducible)
    word = np.concatenate([big_endian_words(text), np.zeros(most + 8, np.uint64)])
    value = np.zeros(len(base), np.int64)
    live = np.flatnonzero(before[base] >= 0)
    # irreducible values may exceed `most` by the length of the run that follows them: compare as far as the run goes
    run = np.diff(np.append(base, n))
    depth = 0
    while len(live):
        a, b = base[live] + depth, before[base[live]] + depth
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        diff = word[a] ^ word[b]
        same = diff == 0
        lead = np.zeros(len(diff), np.int64)
        for s in range(8):
            lead += (diff >> np.uint64(56 - 8 * s)) == 0
        room = n - np.maximum(a, b)
        value[live] = depth + np.minimum(lead, room)
        go = same & (room > 8) & (depth + 8 < most + run[live])
        live = live[go]
        depth += 8
    start = np.repeat(np.arange(len(base)), run)
    return np.maximum(value[start] - (at - base[start]), 0)


def repeated_windows(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Of the windows [s, s + length), which ones occur at two places at least."""
    order = suffix_array(text, length)
    prefix = common_prefixes(text, order, length)
    hit = np.zeros(len(text), bool)
    equal = prefix >= length  # with the predecessor; both count
    hit[equal] = True
    before = np.empty(len(text), np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = order[0]
    hit[before[equal]] = True
    return hit[starts]


def merge_by_search(left: np.ndarray, left_starts: np.ndarray, right: np.ndarray, right_starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of either shard also occur in the other: binary search in the left one's suffix array."""
    words = -(-length // 8)
    reach = np.arange(words) * 8
    reach[-1] = length - 8
    allowed = np.zeros(len(left), bool)
    allowed[left_starts] = True
    order = suffix_array(left, length)
    order = order[allowed[order]]
    lw, rw = big_endian_words(left), big_endian_words(right)

    def below(rows: np.ndarray, query: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether the left windows stand before the right ones."""
        out = np.full(len(rows), or_equal)
        live = np.arange(len(rows))
        for r in reach:
            a, b = lw[rows[live] + r], rw[query[live] + r]
            out[live[a != b]] = (a < b)[a != b]
            live = live[a == b]
            if not len(live):
                break
        return out

    def bound(or_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(right_starts), np.int64), np.full(len(right_starts), len(order))
        while len(order) and (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            less = below(order[mid], right_starts[open_], or_equal)
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        return low

    first, last = bound(False), bound(True)
    change = np.zeros(len(order) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    hit = np.zeros(len(left), bool)
    hit[order[np.cumsum(change)[:-1] > 0]] = True
    return hit[left_starts], last > first


# ---- shards ---------------------------------------------------------------------------------------

def as_runs(flags: np.ndarray, length: int) -> list[dict]:
    """Runs of repeated windows as byte ranges relative to the segment."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [{"start": a, "stop": b + length - 1} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def shard_hits(rows: DataFrame, length: int) -> DataFrame:
    """rows: (anchor, b1, b2, digest, salt, segment), one unit per (anchor, b1, b2).  Byte ranges of repeats."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in parts])
        offs = np.cumsum(sizes + 1) - sizes - 1
        windows = sizes - length + 1
        starts = np.repeat(offs, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        text = np.full(int(sizes.sum()) + len(parts), 0xFF, np.uint8)  # UTF-8 never holds the byte that parts segments
        for a, p in zip(offs, parts, strict=True):
            text[a : a + len(p)] = p
        return text, starts, windows

    def emit(batch: list[tuple[int, int]], flags: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
        cuts = np.cumsum(windows)[:-1]
        runs = [as_runs(f, length) for f in np.split(flags, cuts)]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in batch], pa.int64()), pa.array([d for _, d in batch], pa.int64()), pa.array(runs, kind)], ["anchor", "digest", "spans"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[tuple[int, int]] = []
        parts: list[np.ndarray] = []
        size, last = 0, None
        pair: dict[int, tuple[list, list]] = {}

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal names, parts, size
            if parts:
                text, starts, windows = joined(parts)
                yield emit(names, repeated_windows(text, starts, length), windows)
            names, parts, size = [], [], 0

        def close_pair() -> Iterator[pa.RecordBatch]:
            if len(pair) == 2:
                (n1, p1), (n2, p2) = (pair[s] for s in sorted(pair))
                (t1, s1, w1), (t2, s2, w2) = joined(p1), joined(p2)
                left, right = merge_by_search(t1, s1, t2, s2, length)
                yield emit(n1, left, w1)
                yield emit(n2, right, w2)
            pair.clear()

        for batch in batches:
            raw, offs = B.column_bytes(batch.column("segment"))
            columns = (batch.column(c).to_pylist() for c in ("anchor", "b1", "b2", "digest", "salt"))
            for i, (anchor, b1, b2, digest, salt) in enumerate(zip(*columns, strict=True)):
                if (anchor, b1, b2) != last:
                    yield from close_pair()
                    if size >= SHARD_BYTES:
                        yield from close()
                    last = (anchor, b1, b2)
                segment = raw[offs[i] : offs[i + 1]].copy()
                if b1 == b2:
                    names.append((anchor, digest))
                    parts.append(segment)
                    size += len(segment)
                else:
                    own = pair.setdefault(salt, ([], []))
                    own[0].append((anchor, digest))
                    own[1].append(segment)
        yield from close_pair()
        yield from close()

    keys = ("anchor", "b1", "b2")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "anchor long, digest long, spans array<struct<start: long, stop: long>>")


def cut_out(rows: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """Joins the spans (_rid, spans) to the texts: bytes, removed bytes and runs, and the kept bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in B.text_blocks(batch, "text"):
                removed, runs, kept = [], [], []
                for i, own in enumerate(part.column("spans").to_pylist()):
                    text = data[offs[i] : offs[i + 1]]
                    gone = np.zeros(len(text) + 1, np.int64)
                    for s in own or ():
                        gone[s["start"]] += 1
                        gone[s["stop"]] -= 1
                    flag = np.cumsum(gone)[:-1] > 0
                    removed.append(int(flag.sum()))
                    runs.append(int((np.diff(flag.view(np.int8), prepend=0) == 1).sum()))
                    kept.append(text[~flag].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_rid"), part.column("doc_id"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                    ["_rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("_rid", "doc_id", "text").join(spans.hint("merge"), "_rid", "left").mapInArrow(
        cut, f"_rid long, doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def repeated_spans(rows: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(_rid, spans): byte ranges of each document that are covered by a repeated string."""
    table = saved(anchored(rows, length, k), "segments")
    every = table.select("_rid", F.explode(F.arrays_zip("anchors", "digests", "places")).alias("s")).select("_rid", "s.anchors", "s.digests", "s.places").toDF("_rid", "anchor", "digest", "place")
    # anchors that occur once hold no repeat; those whose segments all agree need no text
    often = saved(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")).where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "often")
    repeats = saved(every.join(often.hint("merge"), "anchor"), "repeats")
    distinct = saved(repeats.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_rid", "place")).alias("where"), F.first("mixed").alias("mixed")), "distinct")
    kinds = saved(distinct.where("mixed").groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")), "kinds")
    open_ = distinct.where("mixed").join(kinds, "anchor").select("anchor", "digest", "n", "where._rid", "where.place", F.ceil(F.col("kinds") / SHARD_SEGMENTS).cast("int").alias("n_salts"))
    # texts of one copy of each open segment
    wanted = open_.groupBy("_rid").agg(F.collect_list(F.struct("anchor", "digest", "place", "n_salts")).alias("want"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in B.text_blocks(batch, "text", B.BLOCK_BYTES):
                anchor, digest, salts, piece = [], [], [], []
                for i, want in enumerate(part.column("want").to_pylist()):
                    for w in want:
                        a = offs[i] + (w["place"] >> 16)
                        anchor.append(w["anchor"])
                        digest.append(w["digest"])
                        salts.append(w["n_salts"])
                        piece.append(data[a : a + (w["place"] & 0xFFFF) + length - 1].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(digest, pa.int64()), pa.array(salts, pa.int32()), pa.array(piece, pa.binary())], ["anchor", "digest", "n_salts", "segment"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = B.column_bytes(batch.column("segment"))
            prefix, n = B.prefix_hash(raw), np.diff(offs) - length + 1
            own = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            start = offs[own] + at
            x, y = B.span_hash(prefix, start, start + length), B.window_digest(B.lane_prefix(raw), start, length)
            keys = [batch.column(c).take(pa.array(own)) for c in ("anchor", "digest")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(at.astype(np.int32)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["anchor", "digest", "at", "x", "y"])

    pieces = rows.select("_rid", "text").join(wanted.hint("merge"), "_rid").mapInArrow(take, "anchor long, digest long, n_salts int, segment binary")
    pieces = saved(pieces, "pieces")
    hot = pieces.where(F.col("n_salts") > MOST_SHARDS).select("anchor", "digest", "segment").mapInArrow(windows, "anchor long, digest long, at int, x long, y long")
    hot = saved(hot, "windows")
    again = saved(hot.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x", "y"), "again")
    span = F.struct(F.col("at").cast("long").alias("start"), (F.col("at") + length).cast("long").alias("stop"))
    of_hot = hot.join(again, ["x", "y"]).groupBy("anchor", "digest").agg(F.collect_list(span).alias("spans"))
    salted = pieces.where(F.col("n_salts") <= MOST_SHARDS).withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("n_salts")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("o"))
    unit = salted.select("anchor", F.least("salt", "o").alias("b1"), F.greatest("salt", "o").alias("b2"), "digest", "salt", "segment")
    found = shard_hits(unit, length).where("size(spans) > 0").groupBy("anchor", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    twice = distinct.where("n > 1").select("anchor", "digest", F.array(F.struct(F.lit(0).cast("long").alias("start"), ((F.col("where.place").bitwiseAND(0xFFFF)) + (length - 1)).alias("stop"))).alias("spans"))
    hits = saved(twice.unionAll(found).unionAll(of_hot), "hits")
    back = repeats.join(hits, ["anchor", "digest"]).select(
        "_rid", F.transform("spans", lambda s: F.struct((s.start + F.shiftright("place", 16)).alias("start"), (s.stop + F.shiftright("place", 16)).alias("stop"))).alias("spans")
    )
    return saved(back.groupBy("_rid").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")


def deduplicate(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans and kept (the remaining bytes)."""
    rows = keyed(as_text(docs), "text").drop("_row")
    return cut_out(rows, repeated_spans(rows, length, k), length).drop("_rid")
