"""MinHash near-duplicate detection with tensored banding.

Two collections of `m` small hashes are computed, each of `r` minhashes; the m * m tables are keyed by the
pairs (first[i], second[j]).  A document thus pays for 2 * m * r minhashes instead of the 2 * m * m * r that
as many independent tables would need.  Rows that share a table key are candidates and are verified exactly on
the full shingle sets, bucket by bucket (`grouping`), so a reported link is always a true one.

Keys are formed only of key parts that several documents hold, and full sets are sent into a whole bucket only for
rows that bitmaps of the sets don't rule out: neither loses a candidate or a link.

At the default m=10, r=3 a pair with similarity 0.8 is a candidate with probability
(1 - (1 - 0.8**3)**10)**2 = 0.9985, one of 0.85 with 0.9998, one of 0.3 with 0.06; nothing below the threshold is
linked.

Words are the byte runs without white space after lower-casing A-Z.  A set holds the distinct k-word
shingles; a document with fewer words has its whole sequence as one shingle; nulls, empty and blank texts
have an empty set and are linked with nothing (each is kept).  Repeated rows are rows of their own: documents
with equal sets form a class that is verified once.  A repeated doc_id gets the same component as its copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import as_text, keyed, restored, saved, saved_alone
from .grouping import forest, linked, per_unit

#: Most shingles and rows in one block: of rows beside one representative, and of a bucket that is compared whole.
STAR, BLOCK = (100_000, 200), (200_000, 800)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = B.LOWER[data]
    starts, ends, first = B.words(data, offs, B.NONSPACE)
    hashes = B.span_digest(data, starts, ends)
    flat, ptr = B.grams(hashes, first, k)
    out = []
    for i in range(len(offs) - 1):
        own = flat[ptr[i] : ptr[i + 1]]
        if not len(own) and first[i + 1] > first[i]:
            short = hashes[first[i] : first[i + 1]]
            own, _ = B.grams(short ^ np.uint64(len(short)), np.array([0, len(short)]), len(short))
        own = np.sort(own)
        out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
    return out


def signatures(rows: DataFrame, k: int, m: int, r: int) -> DataFrame:
    """(_rid, doc_id, n_shingles, digest of the set, first[m], second[m])."""
    multipliers = np.random.default_rng(8).integers(0, 1 << 63, 2 * m * r, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in B.text_blocks(batch, "text"):
                sets = shingle_sets(data, offs, k)
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                keys = np.zeros((len(sets), 2 * m), np.uint64)
                if len(full):
                    flat = np.concatenate(sets)
                    ptr = np.cumsum(np.append(0, n[full][:-1]))
                    for c in range(2 * m):
                        key = np.full(len(full), c, np.uint64)
                        for j in range(r):
                            key = key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * multipliers[c * r + j], ptr)
                        keys[full, c] = B.mix(key)
                keys = keys.view(np.int64)
                one = lambda x: B.list_array(np.ascontiguousarray(x).ravel(), np.arange(len(sets) + 1) * m, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_rid"), part.column("doc_id"), pa.array(n), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), one(keys[:, :m]), one(keys[:, m:])],
                    ["_rid", "doc_id", "n_shingles", "digest", "first", "second"],
                )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("_rid", "doc_id", "text").mapInArrow(sign, f"_rid long, doc_id {kind}, n_shingles long, digest binary, first array<long>, second array<long>")


def bucket_rows(classes: DataFrame, m: int) -> DataFrame:
    """(key, node, weight): the tables' keys of each class.

    A pair meets in table (i, j) only if it shares first[i] and second[j], so keys are formed only of parts that another
    class holds too: most classes hold few, and 2 * m rows of each are sent, not m * m.
    """
    parts = classes.select("node", "weight", F.posexplode(F.concat("first", "second")).alias("at", "part"))
    often = saved(parts.groupBy("at", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("at", "part"), "minhash-parts")
    # parts grow with the corpus, so they are joined by shuffle at every size
    own = parts.join(often.hint("merge"), ["at", "part"], "left_semi").groupBy("node").agg(F.first("weight").alias("weight"), F.collect_list(F.struct("at", "part")).alias("parts"))
    own = own.select("node", "weight", F.filter("parts", lambda p: p["at"] < m).alias("first"), F.filter("parts", lambda p: p["at"] >= m).alias("second"))
    held = saved(own.where((F.size("first") > 0) & (F.size("second") > 0)), "minhash-held")
    pairs = held.select("node", "weight", F.explode("first").alias("a"), "second").select("node", "weight", "a", F.explode("second").alias("b"))
    return pairs.select(F.xxhash64("a.at", F.col("b.at") - m, "a.part", "b.part").alias("key"), "node", "weight")


def bitmap(own: np.ndarray) -> bytes:
    """Four to eight bits a shingle, of which each shingle sets one; a half laid on the other is the bitmap of half the size."""
    size = 8
    while size < 4 * len(own):
        size *= 2
    out = np.zeros(size, np.uint8)
    out[B.mix(own) & np.uint64(size - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def may_link(bits: list[np.ndarray], n: np.ndarray, percent: int) -> np.ndarray:
    """Whether each two sets of n shingles can be alike enough, by their bitmaps.

    A bit that only one of two bitmaps holds stands for at least one shingle that the other set lacks, so no true link is ruled out.
    """
    size = np.array([len(x) for x in bits])
    out = np.zeros((len(n), len(n)), bool)
    for s in np.unique(size):
        at = np.flatnonzero((size >= s) & (percent * size <= 200 * s))  # others differ too much in n
        same = size[at] == s
        rows = []
        for i in at:
            x = bits[i]
            while len(x) > s:
                x = x[: len(x) // 2] | x[len(x) // 2 :]
            rows.append(x)
        held = np.stack(rows)
        both = np.zeros((len(at), len(at)), np.int64)
        for c in range(0, int(s), 256):
            dense = np.unpackbits(held[:, c : c + 256], axis=1).astype(np.float32)
            both += (dense @ dense.T).astype(np.int64)
        left = n[at] - both.diagonal()
        most = both + np.minimum(left[:, None], left[None, :])
        out[np.ix_(at, at)] |= (100 * most >= percent * (n[at][:, None] + n[at][None, :] - most)) & (same[:, None] | same[None, :])
    return out


def shingle_table(nodes: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(node, n, bits, shingles): the sets of the nodes as bytes with their sizes and bitmaps, stored."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in B.text_blocks(batch, "text"):
                own = shingle_sets(data, offs, k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array([len(s) for s in own], pa.int64()), pa.array([bitmap(s) for s in own], pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())], ["node", "n", "bits", "shingles"]
                )

    # candidates grow with the corpus, so they are joined by shuffle at every size
    texts = rows.select(F.col("_rid").alias("node"), "text").join(nodes.hint("merge"), "node", "left_semi")
    return saved(texts.mapInArrow(sets, "node long, n long, bits binary, shingles binary"), "sets")


def held_sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").combine_chunks()]


def shared_counts(own: list[np.ndarray]) -> np.ndarray:
    """Number of shingles that each two sets share: products of 0/1 matrices over the shingles held twice."""
    flat, row = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    head = np.append(True, flat[1:] != flat[:-1])
    number = np.cumsum(head) - 1
    often = np.bincount(number) > 1
    keep = often[number]
    row, number = row[keep], (np.cumsum(often) - 1)[number[keep]]
    both = np.zeros((len(own), len(own)), np.float32)
    cuts = np.searchsorted(number, np.arange(0, int(number[-1]) + 2 if len(number) else 1, 2048))
    for a, b in zip(cuts, [*cuts[1:], len(number)], strict=True):
        if b > a:
            dense = np.zeros((len(own), int(number[b - 1] - number[a]) + 1), np.float32)
            dense[row[a:b], number[a:b] - number[a]] = 1
            both += dense @ dense.T
    return both


def links_between(units: DataFrame, sets: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Links (a, b) between components, true by the full sets: of a unit's rows with its center, or of all its rows."""

    def edges(pairs: set[tuple[int, int]]) -> pa.RecordBatch | None:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in sorted(pairs)], pa.int64()), pa.array([b for _, b in sorted(pairs)], pa.int64())], ["a", "b"]) if pairs else None

    def beside(table: pa.Table) -> pa.RecordBatch | None:
        own, component = held_sets(table), table.column("component").to_numpy()
        at = int(np.flatnonzero(table.column("center").to_numpy())[0])
        center = own[at]
        rest = [i for i in range(len(own)) if i != at]
        if not rest:
            return None
        n = np.array([len(own[i]) for i in rest])
        flat = np.concatenate([own[i] for i in rest])
        place = np.minimum(np.searchsorted(center, flat), len(center) - 1)
        both = np.add.reduceat(center[place] == flat, np.cumsum(n) - n, dtype=np.int64)
        true = 100 * both >= percent * (n + len(center) - both)
        return edges({(int(component[rest[i]]), int(component[at])) for i in np.flatnonzero(true)})

    def among(table: pa.Table) -> pa.RecordBatch | None:
        component = table.column("component").to_numpy()
        if (component == component[0]).all():
            return None
        own = held_sets(table)
        n = np.array([len(x) for x in own])
        both = shared_counts(own)
        link = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (component[:, None] != component[None, :])
        return edges({(int(component[a]), int(component[b])) for a, b in forest(link)} - {(int(c), int(c)) for c in component})

    def doubtful(table: pa.Table) -> pa.RecordBatch | None:
        component = table.column("component").to_numpy()
        if (component == component[0]).all():
            return None
        bits = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits").combine_chunks()]
        link = may_link(bits, table.column("n").to_numpy(), percent) & (component[:, None] != component[None, :])
        at = np.flatnonzero(link.any(1))
        return table.select(["node", "component", "unit", "block", "other"]).take(at).combine_chunks().to_batches()[0] if len(at) else None

    full = sets.select("node", "shingles").hint("merge")
    if whole:
        slim = units.join(sets.select("node", "n", "bits").hint("merge"), "node")
        left = saved(per_unit(slim, doubtful, "node long, component long, unit long, block int, other int", ("unit", "block", "other")), "doubtful")
        return per_unit(left.join(full, "node"), among, "a long, b long", ("unit", "block", "other"))
    return per_unit(units.join(full, "node"), beside, "a long, b long", ("unit", "block"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, m: int = 10, r: int = 3) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    return _near_duplicates(keyed(as_text(docs), "text"), k, percent, m, r).drop("_rid", "component")


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, m: int = 10, r: int = 3) -> DataFrame:
    """The documents that stay: of each group the one with the smallest doc_id (of equal ones the one with the smallest key)."""
    rows = keyed(as_text(docs), "text")
    first = saved_alone(docs.sparkSession, "kept", lambda: _near_duplicates(rows, k, percent, m, r).groupBy("component").agg(F.min(F.struct("doc_id", "_rid")).alias("x")).select("x._rid"))
    return restored(rows.join(first.hint("merge"), "_rid", "left_semi"))


def _near_duplicates(rows: DataFrame, k: int, percent: int, m: int, r: int) -> DataFrame:
    signed = saved(signatures(rows, k, m, r), "signatures")
    classes = saved(
        signed.where("n_shingles > 0").groupBy("digest").agg(F.min("_rid").alias("node"), F.first("n_shingles").alias("weight"), F.first("first").alias("first"), F.first("second").alias("second")), "classes"
    )
    found = linked(bucket_rows(classes, m), lambda nodes: shingle_table(nodes, rows, k), lambda units, sets, whole: links_between(units, sets, percent, whole), "minhash", STAR, BLOCK)
    named = saved(classes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component")), "named")
    out = signed.join(named, "digest", "left").select("_rid", "doc_id", "n_shingles", F.coalesce("component", "_rid").alias("component"))
    labelled = saved(out, "labelled")
    ids = saved(labelled.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component-ids")
    return labelled.join(ids, "component").select("_rid", "doc_id", "n_shingles", "component", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
