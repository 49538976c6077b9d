"""Embedding near-duplicates with spherical-cap filters of a random product code.

Each of `TURNS` independent random rotations is followed by a cut into `PARTS` parts; each part has a codebook of
random unit vectors.  A filter direction is one code word per part, so codebooks of C words give C**PARTS
directions of which none is stored.  Each vector is list-decoded to its `BEST` directions of each rotation, so that
none has fewer: the best words of the parts are combined part by part.  Vectors that
share a filter are compared exactly in double precision, and each linked pair counts in its first common
filter only.

The number of directions grows with the number of distinct vectors: there are so many that an unrelated vector
seldom shares a filter, and only vectors with a shared filter are moved.  A filter that many similar vectors share
is cut into blocks, and pairs of blocks are spread over the cluster.  A pair that shares no filter of any
rotation is missed; the README gives the share.  Before use, codebooks are tried on random pairs at the threshold and made coarser
until RECALL of them meet, so that few dimensions don't part near vectors.

Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different
lengths don't either.  Equal vectors form a class that is compared once; repeated vec_ids are rows of their
own, and so are rows without vec_id.  Other columns are left out.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, keyed, saved
from .grouping import forest, per_unit

PARTS = 4
#: Rotations, filters of a vector in each, and vectors of unrelated content in a filter (on average).
TURNS, BEST, CROWD = 3, 16, 0.1
#: The share of pairs at the threshold that codebooks must join, and the pairs that they are tried on.
RECALL, PLANTED = 0.985, 1000
#: Rows in one block of a filter.
BLOCK_ROWS = 512


class ProductCode:
    """Random rotation and codebooks for vectors of `size` components."""

    def __init__(self, size: int, words: int, turn: int = 0, seed: int = 5) -> None:
        rng = np.random.default_rng([seed, size, turn])
        self.size = size
        self.width = -(-size // PARTS) * PARTS
        rotation, r = np.linalg.qr(rng.standard_normal((self.width, self.width)))
        self.turn = (rotation * np.sign(np.diag(r)))[:size]
        part = self.width // PARTS
        book = rng.standard_normal((PARTS, words, part))
        self.book = book / np.linalg.norm(book, axis=2, keepdims=True) / np.sqrt(PARTS)
        self.words = words
        self.first = turn * words**PARTS

    def scores(self, unit: np.ndarray) -> np.ndarray:
        turned = (unit @ self.turn).reshape(len(unit), PARTS, -1)
        return np.einsum("npd,pwd->npw", turned, self.book)

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """The numbers of the BEST filters of each vector (of all, where there are fewer)."""
        s = self.scores(unit)
        w = self.words
        # a filter among the best BEST has each of its words and each of its halves among the best BEST
        best = min(BEST, w)
        at = np.argpartition(-s, best - 1, axis=2)[:, :, :best].astype(np.int64)
        top = np.take_along_axis(s, at, 2)
        half, number = [], []
        for p in (0, 2):
            half_sums = (top[:, p, :, None] + top[:, p + 1, None, :]).reshape(len(unit), -1)
            words = (at[:, p, :, None] * w + at[:, p + 1, None, :]).reshape(len(unit), -1)
            k = min(BEST, half_sums.shape[1])
            own = np.argpartition(-half_sums, k - 1, axis=1)[:, :k]
            half.append(np.take_along_axis(half_sums, own, 1))
            number.append(np.take_along_axis(words, own, 1))
        sums = (half[0][:, :, None] + half[1][:, None, :]).reshape(len(unit), -1)
        both = (number[0][:, :, None] * (w * w) + number[1][:, None, :]).reshape(len(unit), -1)
        k = min(BEST, sums.shape[1])
        return self.first + np.take_along_axis(both, np.argpartition(-sums, k - 1, axis=1)[:, :k], 1)


def filters(codes: list[ProductCode], unit: np.ndarray) -> np.ndarray:
    """The filters of each vector in all rotations, sorted."""
    return np.sort(np.concatenate([c.decode(unit) for c in codes], axis=1), axis=1)


def code_words(total: int) -> int:
    """Size of a codebook for so many vectors."""
    return max(2, round((BEST * max(total, 1) / CROWD) ** (1 / PARTS)))


def planted(size: int, cosine: float, n: int = PLANTED) -> tuple[np.ndarray, np.ndarray]:
    """n random unit vectors of `size` components, and one at that cosine to each."""
    a, b = np.random.default_rng([7, size]).standard_normal((2, n, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def met(codes: list[ProductCode], cosine: float) -> float:
    """The share of planted pairs that share a filter."""
    left, right = (filters(codes, x) for x in planted(codes[0].size, cosine))
    return float(np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(left, right, strict=True)]))


@functools.lru_cache(64)
def codes_of(size: int, total: int, cosine: float) -> list[ProductCode]:
    """The rotations and codebooks for so many vectors of so many components.

    In few dimensions fine codebooks part near vectors: they are made coarser until pairs planted at the threshold meet.  One word a
    part is one filter in all, that is comparing all with all.
    """
    words = code_words(total)
    while True:
        codes = [ProductCode(size, words, t) for t in range(TURNS)]
        if words == 1 or size == 1 or met(codes, cosine + 1e-4) >= RECALL:
            return codes
        words = max(1, min(words - 1, words * 4 // 5))


def as_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows with `size` finite components that aren't all zero: (their places, unit vectors, size)."""
    size = len(column[0])
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), size)
    norm = np.linalg.norm(flat, axis=1)
    # a second pass at the scale of the largest component keeps tiny and huge vectors exact
    peak = np.abs(flat).max(axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        flat = flat / peak
        norm = np.linalg.norm(flat, axis=1)
        unit = flat / norm[:, None]
    return np.flatnonzero(np.isfinite(unit).all(axis=1)), unit, size


def filtered(vectors: DataFrame, total: int, cosine: float) -> DataFrame:
    """(node, size, filters, vector): the filters of each distinct vector."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lengths = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            for size in np.unique(lengths).tolist():
                rows = table.filter(pa.array(lengths == size)).combine_chunks()
                good, unit, size = as_matrix(rows.column("vector").combine_chunks())
                codes = codes_of(size, total, cosine)
                for a in range(0, len(good), 1000):
                    at = good[a : a + 1000]
                    lists = list(filters(codes, unit[at]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rows.column("node").to_numpy()[at]),
                            pa.array(np.full(len(at), size, np.int32)),
                            pa.array(rows.column("copies").to_numpy()[at]),
                            pa.array(lists, pa.list_(pa.int64())),
                            pa.array([u.tobytes() for u in unit[at]], pa.binary()),
                        ],
                        ["node", "size", "copies", "filters", "unit"],
                    )

    return vectors.mapInArrow(decode, "node long, size int, copies long, filters array<long>, unit binary")


def link_counts(shared: DataFrame, cosine: float) -> DataFrame:
    """shared: (size, filter, b1, b2, block, node, copies, filters, unit).  (node, n, root): links found per unit and node.

    filters: the sorted filters of a node that it shares with others.
    """

    def work(table: pa.Table) -> pa.RecordBatch | None:
        n = table.num_rows
        if n < 2:
            return None
        this = table.column("filter")[0].as_py()
        b1, b2 = table.column("b1")[0].as_py(), table.column("b2")[0].as_py()
        unit = np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in table.column("unit").combine_chunks()])
        link = unit @ unit.T >= cosine
        np.fill_diagonal(link, False)
        if b1 != b2:
            block = table.column("block").to_numpy()
            link &= block[:, None] != block[None, :]
        if not link.any():
            return None
        # leave out pairs that share an earlier filter
        rows = np.flatnonzero(link.any(1))
        link = link[np.ix_(rows, rows)]
        lists = table.column("filters").combine_chunks().take(pa.array(rows))
        sizes = np.diff(lists.offsets.to_numpy())
        flat, owner = lists.values.to_numpy()[lists.offsets[0].as_py() :], np.repeat(np.arange(len(rows)), sizes)
        flat = flat[: len(owner)]
        early = flat < this
        _, number = np.unique(flat[early], return_inverse=True)
        seen = np.zeros(link.shape, np.float32)
        for c in range(0, int(number.max()) + 1 if len(number) else 0, 2048):
            own = (number >= c) & (number < c + 2048)
            dense = np.zeros((len(rows), 2048), np.float32)
            dense[owner[early][own], number[own] - c] = 1
            seen += dense @ dense.T
        link &= seen == 0
        if not link.any():
            return None
        ids, copies = table.column("node").to_numpy()[rows], table.column("copies").to_numpy()[rows]
        root = np.arange(len(rows))
        for a, b in forest(link):
            root[a] = b
        own = link.any(1)
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array((link @ copies)[own]), pa.array(ids[root][own])], ["node", "n", "root"])

    return per_unit(shared, work, "node long, n long, root long", ("size", "filter", "b1", "b2"))


def near_duplicates(embeddings: DataFrame, cosine: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable), kept."""
    rows = keyed(embeddings.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")), "embedding", key="vec_id").drop("_row")
    rows = rows.withColumn("class", F.struct(F.xxhash64("embedding").alias("x"), F.xxhash64(F.lit(1), "embedding").alias("y"), F.size("embedding").alias("size")))
    usable = rows.where("size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)")
    classes = saved(usable.groupBy("class").agg(F.min("_rid").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("vector")), "vectors")
    vectors = saved(filtered(classes.select("node", "copies", "vector"), classes.count(), cosine), "filters")
    each = vectors.select("size", F.explode("filters").alias("filter"), "node")
    crowds = saved(each.groupBy("size", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size", "filter", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("n_blocks")), "crowds")
    # at most TURNS * BEST filters a node; those that it shares with no one are left behind here
    held = saved(each.join(crowds, ["size", "filter"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("filter", "n_blocks"))).alias("shared")), "shared")
    block = F.pmod(F.xxhash64("node"), F.col("s.n_blocks")).cast("int").alias("block")
    shared = (
        vectors.drop("filters").join(held, "node")
        .select("node", "size", "copies", "unit", F.transform("shared", lambda s: s["filter"]).alias("filters"), F.posexplode("shared").alias("earlier", "s"))
        .select("node", "size", "copies", "unit", F.slice("filters", F.lit(1), F.col("earlier")).alias("filters"), F.col("s.filter").alias("filter"), block, F.explode(F.sequence(F.lit(0), F.col("s.n_blocks") - 1)).alias("other"))
        .select("node", "size", "copies", "unit", "filters", "filter", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    )
    links = saved(link_counts(shared, cosine), "links")
    found = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-links")
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    named = saved(
        classes.select("class", "node", "copies").join(found, "node", "left").join(counts, "node", "left").select("class", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named"
    )
    labelled = saved(rows.select("_rid", "vec_id", "class").join(named, "class", "left").select("_rid", "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "_rid").alias("component")), "labelled")
    ids = saved(labelled.groupBy("component").agg(F.min("vec_id").alias("component_id")), "component-ids")
    return labelled.join(ids, "component").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
