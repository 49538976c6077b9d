"""Benchmark decontamination with a distributed positional inverted index.

The corpus is cut into shards (blocks of documents inside a partition).  Each shard stores the sorted list of
the positions of each of its terms (`build_index`).  A query takes the
rarest terms of a phrase first, shifts their lists by the term's place in the phrase and intersects them
(`search`); `proximity` asks for all terms within a distance instead.  The index is a Parquet table in the
shared folder, one row per shard, so that a shard is a bounded unit of work and the index can be asked again.

Terms are 64-bit hashes of lower-cased words.  The benchmark is asked in blocks of about QUERY_BYTES of
text, one after the other: of each the word hashes are broadcast (8 bytes a word), and given back before the
next.  The number of blocks grows with the benchmark, the size of a broadcast doesn't (a longer single item is a block).

Nulls and empty texts have no words and are clean.  Rows that repeat a doc_id are judged one by one; items
that repeat an item_id count once.  Words of items without item_id are hit like others', but no item is listed for
them.  Columns of the documents keep their names and values, whatever they are.  An empty corpus gives an
empty result; an empty benchmark gives clean rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import as_text, keyed, restored, saved, saved_alone

WINDOW = 13
#: Benchmark text that is asked at once; starts of phrases that a task holds at once.
QUERY_BYTES, MOST_STARTS = 8 << 20, 1 << 21
INDEX_SCHEMA = "rids array<long>, first array<long>, terms array<long>, ptr array<long>, places binary"


def tokenize(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and for each text the index of its first word."""
    data = B.LOWER[data]
    starts, ends, first = B.words(data, offs, B.ALNUM)
    return B.span_digest(data, starts, ends), first


def build_index(docs: DataFrame) -> DataFrame:
    """Postings of docs (_rid, text): per shard the documents, their first positions, and the position lists of each term."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in B.text_blocks(batch, "text"):
                hashes, first = tokenize(data, offs)
                order = np.argsort(hashes, kind="stable")
                found, begin = np.unique(hashes[order], return_index=True)
                one = lambda x: B.list_array(x, np.array([0, len(x)]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [one(part.column("_rid").to_numpy()), one(first), one(found.view(np.int64)), one(np.append(begin, len(order))), pa.array([order.astype(np.int32).tobytes()], pa.binary())],
                    ["rids", "first", "terms", "ptr", "places"],
                )

    return docs.select("_rid", "text").mapInArrow(index, INDEX_SCHEMA)


class Shard:
    """The stored postings of one shard."""

    def __init__(self, batch: pa.RecordBatch, row: int) -> None:
        get = lambda c: np.asarray(batch.column(c)[row].values)
        self.rids, self.first, self.ptr = get("rids"), get("first"), get("ptr")
        self.terms = get("terms").view(np.uint64)
        self.places = np.frombuffer(batch.column("places")[row].as_buffer(), np.int32).astype(np.int64)
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.ptr))
        self.keys = (term << np.int64(34)) | self.places

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Each term's number in this shard, -1 where it doesn't occur."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the terms stand at the places (binary search in their lists)."""
        key = (term << np.int64(34)) | np.maximum(place, 0)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return (self.keys[at] == key) & (place >= 0)

    def phrases(self, query: Query) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, position) of all exact occurrences inside one document, in parts of bounded size."""
        number = self.number(query.terms)[query.flat]
        lacking = np.append(0, np.cumsum(number < 0))
        live = np.flatnonzero(lacking[query.at + query.size] == lacking[query.at])
        length = np.diff(self.ptr)
        for n in np.unique(query.size[live]):
            group = live[query.size[live] == n]
            for a in range(0, len(group), 20_000):
                own = group[a : a + 20_000]
                term = number[query.at[own][:, None] + np.arange(n)]
                order = np.argsort(length[term], axis=1, kind="stable")  # rarest first
                which = np.take_along_axis(term, order, 1)
                reach = np.cumsum(length[which[:, 0]])
                cuts = np.unique(np.append(np.searchsorted(reach, np.arange(MOST_STARTS, reach[-1], MOST_STARTS)), len(own)))
                for b, c in zip(np.append(0, cuts[:-1]), cuts, strict=True):
                    if c > b:
                        row, start = self.shifted(which[b:c], order[b:c])
                        keep = (start >= 0) & (self.document(start) == self.document(start + n - 1))
                        yield own[b:c][row[keep]], start[keep]

    def shifted(self, which: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, start) of phrases whose terms, rarest first, are `which` and stand at `order` in the phrase."""
        count = np.diff(self.ptr)[which[:, 0]]
        row = np.repeat(np.arange(len(which)), count)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = self.places[self.ptr[which[row, 0]] + inside] - order[row, 0]
        for j in range(1, which.shape[1]):  # intersect with the shifted list of the next rarest term
            keep = self.has(which[row, j], start + order[row, j])
            row, start = row[keep], start[keep]
        return row, start

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1


class Query:
    """A block of benchmark items: their ids and word hashes, and the windows as first word and number of words."""

    def __init__(self, rows: list[tuple[str | None, str]], window: int) -> None:
        self.ids = sorted({i for i, _ in rows if i is not None})
        place = {x: i for i, x in enumerate(self.ids)} | {None: -1}
        texts = [t.encode() for _, t in rows]
        hashes, first = tokenize(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        self.terms, self.flat = np.unique(hashes, return_inverse=True)
        words = np.diff(first)
        windows = np.where(words > 0, np.maximum(words - window + 1, 1), 0)
        own = np.repeat(np.arange(len(words)), windows)
        self.at = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.size = np.minimum(words[own], window)
        self.item = np.array([place[i] for i, _ in rows], np.int64)[own]


def queries(benchmark: DataFrame, window: int, block_bytes: int = QUERY_BYTES) -> Iterator[Query]:
    """The benchmark in blocks of about block_bytes of text (one at least)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = saved(items.distinct(), "items")  # read once for each block
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) or 1
    for k in range(n):
        yield Query([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()], window)


HITS_SCHEMA = "_rid long, spans array<struct<start: long, stop: long>>, items array<string>"


def search(index: DataFrame, query: Query) -> DataFrame:
    """Exact matches of a block of windows, stored: of each document that is hit the merged spans of words and the items found."""
    shared = index.sparkSession.sparkContext.broadcast(query)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch, row)
                found = [(shard.document(start), start, start + query.size[phrase], query.item[phrase]) for phrase, start in shard.phrases(query)]
                doc, start, stop, item = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(len(shard.rids) + 1))
                spans: list[list[dict]] = [[] for _ in shard.rids]
                items: list[list[str]] = [[] for _ in shard.rids]
                hit = np.flatnonzero(np.diff(cuts))
                for d in hit:
                    own = order[cuts[d] : cuts[d + 1]]
                    items[d] = [query.ids[i] for i in np.unique(item[own]) if i >= 0]
                    spans[d] = [{"start": a, "stop": b} for a, b in merged(start[own] - shard.first[d], stop[own] - shard.first[d])]
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(shard.rids[hit]), pa.array([spans[d] for d in hit], span), pa.array([items[d] for d in hit], pa.list_(pa.string()))], ["_rid", "spans", "items"])

    out = saved(index.mapInArrow(find, HITS_SCHEMA), "hits")
    shared.destroy()
    return out


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), stops.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def proximity(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """Documents in which all terms stand at most `within` words from one place of the rarest term: _rid, place."""
    data = [t.encode() for t in terms]
    hashes, _ = tokenize(np.frombuffer(b" ".join(data), np.uint8), np.array([0, sum(map(len, data)) + max(len(data) - 1, 0)]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch, row)
                number = shard.number(np.unique(hashes))
                place = np.zeros(0, np.int64)
                if len(number) and (number >= 0).all():
                    number = number[np.argsort(np.diff(shard.ptr)[number], kind="stable")]
                    lists = [shard.places[shard.ptr[t] : shard.ptr[t + 1]] for t in number]
                    place = lists[0]
                    for other in lists[1:]:
                        doc = shard.document(place)
                        low = np.searchsorted(other, np.maximum(place - within, shard.first[doc]))
                        place = place[low < np.searchsorted(other, np.minimum(place + within + 1, shard.first[doc + 1]))]
                doc = shard.document(place)
                yield pa.RecordBatch.from_arrays([pa.array(shard.rids[doc]), pa.array(place - shard.first[doc])], ["_rid", "place"])

    return index.mapInArrow(find, "_rid long, place long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, spans hit, items found.

    Windows are `window` consecutive words of an item; an item with fewer words is one window.
    """
    return _contamination(keyed(as_text(docs), "text"), benchmark, window).drop("_rid")


def _contamination(rows: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    index = saved(build_index(rows), "postings")
    found = reduce(DataFrame.unionAll, [search(index, q) for q in queries(benchmark, window)])
    # a document that is hit has a row for each block of the benchmark that hits it
    hits = found.groupBy("_rid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    sizes = index.select(F.explode(F.arrays_zip("rids", F.transform("rids", lambda _, i: F.get("first", i + 1) - F.get("first", i)).alias("n"))).alias("d")).select(F.col("d.rids").alias("_rid"), F.col("d.n").alias("n_words"))
    none = F.array()
    return (
        rows.select("_rid", "doc_id").join(sizes, "_rid").join(hits, "_rid", "left")
        .withColumn("spans", F.coalesce("spans", none.cast("array<struct<start: long, stop: long>>"))).withColumn("items", F.coalesce("items", none.cast("array<string>")))
    )


def covered(spans: str = "spans") -> F.Column:
    """Number of words in the union of the spans."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.stop - F.greatest(x.start, s.to))).alias("n"), F.greatest(s.to, x.stop).alias("to")),
        lambda s: s.n,
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """The digest of `contamination`: counts, items and the verdict (at least `percent` of the words are hit)."""
    return _report(keyed(as_text(docs), "text"), benchmark, window, percent).drop("_rid")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """The documents that aren't contaminated."""
    rows = keyed(as_text(docs), "text")
    bad = saved_alone(docs.sparkSession, "contaminated", lambda: _report(rows, benchmark, window, percent).where("contaminated").select("_rid"))
    return restored(rows.join(bad, "_rid", "left_anti"))


def _report(rows: DataFrame, benchmark: DataFrame, window: int, percent: int) -> DataFrame:
    return _contamination(rows, benchmark, window).select(
        "_rid",
        "doc_id",
        "n_words",
        covered().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))


def digest(ids: list[str]) -> str:
    """items_sha256 of a list of item ids, for tests and other engines."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
