"""Source divergence audit: how far the words of each source of a language lie from those of its other sources.

Spark cuts texts into terms, which are counted per block of documents inside tasks and dealt out into shards by a
hash of language and term.  DuckDB runs the rest of the work on each shard, as SQL over Arrow batches: it sums counts,
keeps the terms that occur in enough documents, and, once Spark has summed up the sources' totals, computes the shard's part of
the sums over terms of each pair of sources and the shard's first terms of each source.  Spark merges both.

A source's share of a term is p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)) of the N occurrences of the V kept terms, for each kept
term, whether it occurs or not; p and q differ by floor((p - q)^2 / (p + q)).  All arithmetic is on integers.  A term
that neither source of a pair has adds the same to the pair's sum whichever term it is, so a shard sums only the
differences from that (`extra`), of the terms that one of both has, and no term is paired with sources that lack it on both sides.

Shards are dealt out twice, by text for the counts and by rows for the sums; a shard's distinct terms must fit a task.  Null texts, languages and sources are empty
ones.  Repeated rows count as often as they occur.  Sources without terms are there with all pairs.  Equal values are
ranked by the items' UTF-8.  An empty table gives no rows.  Other columns are left out, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytesops as B
from .common import saved

#: Documents of its language that a kept term is in; terms that are ranked of a source.
LEAST_DOCS, RANKED = 10, 10
SCALE = 1_000_000_000
#: Text and kept counts of a shard; the second kind of shard gives a row for each pair of sources, so it must hold far more rows than that.
BYTES_PER_SHARD, ROWS_PER_SHARD = 512 << 20, 250_000
#: Bytes of text that are counted at once, and counts that a shard gathers before it sums them.
BLOCK, PENDING = 8 << 20, 500_000

#: [^\x00-\x40\x5B-\x60\x7B-\x7F] after lower-casing A-Z
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

COUNTS = "lang string, source string, term string, n bigint, docs bigint"
KEPT = "lang string, source string, term string, n bigint, whole boolean"
PARTS = "lang string, source string, part string, item string, value bigint"


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values of a column, and the values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each (lang, source) of a block: occurrences and documents."""
    for batch in batches:
        for part, data, offs in B.text_blocks(batch, "text", BLOCK):
            data = B.LOWER[data]
            starts, ends, first = B.words(data, offs, LETTERS)
            if not len(starts):
                continue
            lengths = ends - starts
            bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            letters = np.ascontiguousarray(data[LETTERS[data]])
            terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters))
            code, values = _coded(terms)
            doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
            pairs, n = np.unique(doc * len(values) + code, return_counts=True)
            langs, lang = _coded(part.column("lang"))
            sources, source = _coded(part.column("source"))
            group = (langs * len(source) + sources)[pairs // len(values)]
            keys, at, docs = np.unique(group * len(values) + pairs % len(values), return_inverse=True, return_counts=True)
            group, term = np.divmod(keys, len(values))
            yield pa.RecordBatch.from_arrays(
                [lang.take(pa.array(group // len(source))), source.take(pa.array(group % len(source))), values.take(pa.array(term)).cast(pa.string()), pa.array(np.bincount(at, n).astype(np.int64)), pa.array(docs.astype(np.int64))],
                ["lang", "source", "term", "n", "docs"],
            )


def _connection() -> duckdb.DuckDBPyConnection:
    """In memory only, with one thread, as a Spark task has one core."""
    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})


def _kept(least: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's sums of the terms that are in enough documents, and those of the whole language."""
        with _connection() as db:
            db.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
            pending = 0
            for batch in batches:
                table = pa.Table.from_batches([batch])
                db.register("batch", table)
                db.execute("INSERT INTO counts SELECT * FROM batch")
                db.unregister("batch")
                pending += batch.num_rows
                if pending > PENDING:
                    db.execute("CREATE OR REPLACE TABLE counts AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY ALL")
                    pending = 0
            found = db.sql(f"""
                WITH counted AS MATERIALIZED (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs) AS docs FROM counts GROUP BY ALL),
                kept AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n FROM counted GROUP BY ALL HAVING sum(docs) >= {least})
                SELECT lang, source, term, c.n, false AS whole FROM counted c JOIN kept USING (lang, term)
                UNION ALL SELECT lang, '', term, n, true FROM kept""")
            yield from found.to_arrow_reader(50_000)

    return kept


_DIFFERENCE = "((p - q) * (p - q)) // (p + q)"


def _share(count: str, occurrences: str, terms: str) -> str:
    return f"(1 + ({SCALE}::HUGEINT * ({count} + 2)) // nullif({occurrences}::HUGEINT + 2 * {terms}, 0))::BIGINT"


def _sums(ranked: int):
    def sums(kept: pa.Table, groups: pa.Table) -> pa.Table:
        """A shard's part of the pairs' sums, as the part `extra`, and its first terms of each source."""
        with _connection() as db:
            db.register("kept", kept)
            db.register("groups", groups)
            return db.sql(f"""
                WITH shares AS MATERIALIZED (SELECT lang, source, term, {_share("k.n", "g.n", "terms")} AS p FROM kept k JOIN groups g USING (lang, source) WHERE NOT whole),
                absent AS MATERIALIZED (SELECT lang, source, lang_n, terms, {_share("0", "n", "terms")} AS p0 FROM groups),
                seen AS (
                  SELECT a.lang, a.source AS s, o.source AS t, a.p, coalesce(b.p, o.p0) AS q, mine.p0 AS p0, o.p0 AS q0
                  FROM shares a JOIN absent mine USING (lang, source) JOIN absent o ON o.lang = a.lang AND o.source <> a.source
                  LEFT JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source = o.source
                  WHERE b.p IS NULL OR a.source < o.source
                ),
                extra AS (
                  SELECT lang, least(s, t) AS source, greatest(s, t) AS item, sum({_DIFFERENCE} - ((p0 - q0) * (p0 - q0)) // (p0 + q0))::BIGINT AS value FROM seen GROUP BY ALL
                ),
                whole AS (SELECT k.lang, k.term, {_share("k.n", "g.lang_n", "g.terms")} AS q FROM kept k JOIN (SELECT DISTINCT lang, lang_n, terms FROM groups) g USING (lang) WHERE whole),
                first AS (
                  SELECT lang, source, term AS item, {_DIFFERENCE} AS value FROM shares JOIN whole USING (lang, term) WHERE p > q
                  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {ranked}
                )
                SELECT lang, source, 'extra' AS part, item, value FROM extra UNION ALL SELECT lang, source, 'term', item, value FROM first""").to_arrow_table()

    return sums


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranked: int = RANKED, bytes_per_shard: int = BYTES_PER_SHARD, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """(lang, source, part, item, value, rank): per source the other sources of its language (part pair), all ranked, and its own terms (part term), the first ones."""
    spark = docs.sparkSession
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    text_bytes = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counting = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // bytes_per_shard))
    counts = named.mapInArrow(_counted, COUNTS)
    kept = saved(counts.repartition(counting, "lang", "term").mapInArrow(_kept(least_docs), KEPT), "kept")

    sums = kept.groupBy("lang", "source", "whole").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"))
    own = sums.where("not whole").select("lang", "source", "n")
    langs = sums.where("whole").select("lang", F.col("n").alias("lang_n"), "terms")
    groups = named.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "lang_n", "terms"])
    groups = saved(groups, "groups")

    shards = max(1, -(-kept.count() // rows_per_shard))
    dealt = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    parts = kept.withColumn("shard", _shard(shards)).groupBy("shard").cogroup(dealt.groupBy("shard"))
    parts = saved(parts.applyInArrow(lambda left, right: _sums(ranked)(left, right), PARTS), "parts")

    absent = F.expr(f"1 + cast(div({SCALE} * cast(2 as decimal(20, 0)), cast(n + 2 * terms as decimal(20, 0))) as bigint)")
    side = lambda name, share: groups.select("lang", F.col("source").alias(name), F.when(F.col("terms") > 0, absent).alias(share), *(["terms"] if share == "p" else []))
    extra = parts.where("part = 'extra'").groupBy("lang", "source", "item").agg(F.sum("value").alias("extra"))
    # the pairs of a language's sources are the result's own rows
    pairs = side("source", "p").join(side("item", "q"), "lang").where("source < item").join(extra, ["lang", "source", "item"], "left")
    each = F.expr("div((p - q) * (p - q), p + q)")
    value = F.when(F.col("terms") > 0, F.col("terms") * each + F.coalesce("extra", F.lit(0))).otherwise(F.lit(0)).cast("long")
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("ends")
    pairs = pairs.select("lang", value.alias("value"), both).select("lang", "ends.source", F.lit("pair").alias("part"), "ends.item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = parts.where("part = 'term'").withColumn("rank", place).where(F.col("rank") <= ranked)
    return pairs.withColumn("rank", place).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
