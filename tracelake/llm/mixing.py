"""Mixing sources to target weights with Pareto order sampling.

Sources in code-point order (null last) take the weights in turn and share all words by weight.  A source
never gets more than `most` times its own size; the excess is shared again by weight among the others.

Inside a source with target / size = c, each document first gets floor(c) certain copies.  One more copy goes to
some by Pareto order sampling with unequal probabilities: p = min(1, f * h), where h = size / (size + mean size of the
source) prefers longer documents and f makes the expected words meet what is left of the target.  Documents with p = 1
get theirs for certain; the others are ranked by random odds u / (1 - u) divided by their inclusion odds p / (1 - p), and
the smallest ranks are taken as long as the words left to the target hold them (the sample's size is fixed in
words); of the others the one whose size fits the rest best fills it, if that comes nearer to the target.  u
comes from a hash of the document's key and the seed, and h is a whole multiple of 1 / H_UNIT, so reruns agree, under any
partitioning.  The key is doc_id where ids are unique, else a hash of id, source and text, and of the place among rows that agree in
all three (which may be exchanged).

The boundary rank of a source is found by counting words in ever finer intervals of the rank, all sources
at once, so that no source is sorted in one task.

Words are runs without white space.  A null or blank text has size 0 and takes nothing.  A source without
words has target 0.  Repeated rows are rows of their own.  Other columns of the documents keep their names
and values in `mixture`, whatever they are called.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordering import numbered
from .common import as_text, keyed, restored, saved, saved_alone

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: The rank is a 40-bit number that is refined by so many bits in a step.
RANK_BITS, STEP_BITS = 40, 10
H_UNIT = 1 << 20


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ordered(sources: DataFrame) -> DataFrame:
    """Adds place: 0, 1, ... in code-point order of source, null last.  Range partitions count themselves first."""
    parts = saved(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    # one row per partition, of which there are a fixed number
    before = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("inside", inside).join(before.select("part", "before"), "part").withColumn("place", F.col("before") + F.col("inside") - 1).drop("part", "inside", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sizes: (source, source_size).  Adds target: shares of the whole by weight, none above most * source_size."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = saved(ordered(sizes).withColumn("weight", weight), "weights")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    # a source is at its limit once the common factor exceeds limit / weight: raise the factor until none is added
    factor, before = 0.0, -1
    limit = F.col("source_size") * F.lit(most)
    while True:
        full = F.lit(factor) * F.col("weight") > limit
        n, held, free = table.agg(F.count(F.when(full, 1)), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == before or not free:
            break
        before, factor = n, (total - float(held or 0)) / float(free)
    return table.withColumn("target", F.least(F.lit(factor) * F.col("weight"), limit).cast("double")).drop("weight", "place")


def factors(measured: DataFrame, aims: DataFrame) -> DataFrame:
    """(source, n, certain, factor): documents with words, copies that each has for certain, and f / H_UNIT.

    Sizes are counted first, so the window sorts a source's distinct sizes, not its documents.  With the k largest
    sizes at p = 1, f is what the rest need; the first k at which the next size needs no limit is the right one.
    """
    number = lambda c: c.cast("decimal(38,0)")
    counts = saved(measured.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    docs = saved(counts.groupBy("source").agg(F.sum("n").alias("n")).join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "n", "source_size", F.floor(F.col("target") / F.col("source_size")).alias("certain"), "target"), "source-totals")
    each = counts.withColumnRenamed("n", "m").join(docs.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("h", preference())
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    words, weight = number(F.col("m") * F.col("size")), number(F.col("m") * F.col("size")) * F.col("h")
    left = F.col("target") - F.col("certain") * F.col("source_size") - F.coalesce(F.sum(words).over(larger), F.lit(0)).cast("double")
    later = F.sum(weight).over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    f = each.select("source", "size", "h", (left / later.cast("double")).alias("f")).where(F.col("f") * F.col("h") <= 1)
    first = saved(f.groupBy("source").agg(F.max(F.struct("size", "f")).alias("x")).select(F.col("source").alias("s"), F.greatest("x.f", F.lit(0.0)).alias("factor")), "factors")
    return docs.join(first, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", "certain", F.coalesce("factor", F.lit(float(H_UNIT))).alias("factor"))


def preference() -> Column:
    """h in units of 1 / H_UNIT, from 1 on."""
    mean = F.expr("source_size div n")
    return F.greatest(F.lit(1), F.floor(F.col("size") * H_UNIT / (F.col("size") + mean))).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 17, size: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (= copies * size).  size: a column of docs (else words)."""
    measure = word_count() if size is None else size
    return _mixed(keyed(as_text(docs).withColumn("_size", measure), "source", "_size", "text"), weights, most, seed).drop("_rid")


def drawn_by(rows: DataFrame) -> DataFrame:
    """rows (_rid, doc_id, source, text, _size) with _key, on which the draw hangs: the same on every run."""
    if rows.where(~F.col("_rid").eqNullSafe(F.col("doc_id"))).isEmpty():
        return rows.select("_rid", "doc_id", "source", "_size", F.col("_rid").alias("_key"))
    same = ["doc_id", "source", "_size", "_x", "_y"]
    digested = rows.select("_rid", "doc_id", "source", "_size", F.xxhash64("text").alias("_x"), F.xxhash64(F.lit(1), "text").alias("_y"))
    placed = numbered(digested, same, ["_rid"], "_place")
    return placed.select("_rid", "doc_id", "source", "_size", F.xxhash64(*same, "_place").alias("_key"))


def _mixed(rows: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """rows: (_rid, doc_id, source, text, _size)."""
    measured = saved(drawn_by(rows).select("_rid", "_key", "doc_id", "source", F.col("_size").cast("long").alias("size")), "sizes")
    aims = saved(targets(measured.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    shares = saved(factors(measured, aims), "shares")
    joined = measured.join(aims, measured.source.eqNullSafe(aims.source), "left").drop(aims.source)
    joined = joined.join(shares.withColumnRenamed("source", "s"), joined.source.eqNullSafe(F.col("s")), "left").drop("s")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_key"), 11).cast("double") + 0.5) / float(1 << 53)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    # odds / (1 + odds) keeps their order and lies in (0, 1)
    drawn = (
        joined.withColumn("p", F.when(F.col("size") > 0, F.least(F.lit(1.0), F.col("factor") * preference())).otherwise(0.0))
        .withColumn("certain", F.when(F.col("size") > 0, F.col("certain") + (F.col("p") >= 1).cast("int")).otherwise(F.lit(0)).cast("long"))
        .withColumn("u", u)
        .withColumn("odds", F.when((F.col("p") > 0) & (F.col("p") < 1), odds))
        .withColumn("rank", (F.col("odds") / (1 + F.col("odds")) * F.lit(float(1 << RANK_BITS))).cast("long"))
        .select("_rid", "_key", "doc_id", "source", "size", "source_size", "target", "certain", "rank")
    )
    drawn = saved(drawn, "ranks")
    cut = boundary(drawn)
    first = F.coalesce((F.col("rank") < F.col("limit")) | ((F.col("rank") == F.col("limit")) & (F.col("_key") <= F.col("last"))), F.lit(False))
    chosen = drawn.join(cut.withColumnRenamed("source", "s"), drawn.source.eqNullSafe(F.col("s")), "left").withColumn("first", first).drop("s")
    rest = saved(
        chosen.groupBy("source").agg((F.first("target") - F.sum((F.col("certain") + F.col("first").cast("int")) * F.col("size"))).alias("rest")).withColumnRenamed("source", "s"), "rest"
    )
    others = chosen.where(~F.col("first") & F.col("rank").isNotNull()).join(rest, F.col("source").eqNullSafe(F.col("s")))
    miss = F.abs(F.col("rest") - F.col("size"))
    fill = saved(others.where(miss < F.col("rest")).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "rank", "_key", "_rid")).alias("x")).select(F.col("source").alias("s"), F.col("x._rid").alias("fill")), "fill")
    final = chosen.join(fill, chosen.source.eqNullSafe(F.col("s")), "left")
    extra = (F.col("first") | F.coalesce(F.col("_rid") == F.col("fill"), F.lit(False))).cast("int")
    copies = (F.col("certain") + extra).cast("long")
    return final.select("_rid", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def boundary(drawn: DataFrame) -> DataFrame:
    """(source, limit, last): the documents with (rank, _key) <= (limit, last) are held by the words left to the target."""
    # state per source: the words wanted beyond the certain copies, and the interval that the boundary lies in
    state = saved(
        drawn.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("certain") * F.col("size")).alias("sure"))
        .select("source", (F.col("target") - F.col("sure")).alias("left"), F.lit(0).cast("long").alias("at")), "state"
    )
    for shift in range(RANK_BITS - STEP_BITS, -1, -STEP_BITS):
        own = drawn.where("rank is not null").join(state.withColumnRenamed("source", "s"), drawn.source.eqNullSafe(F.col("s")))
        cell = F.shiftright("rank", shift)
        inside = own.where(F.shiftright(F.col("rank"), shift + STEP_BITS) == F.col("at")).groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
        passed = inside.withColumn("run", run).join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        # the first interval that reaches the words wanted, else the last one
        found = passed.groupBy("source").agg(
            F.coalesce(F.min(F.when(F.col("run") >= F.col("left"), F.struct("cell", (F.col("left") - F.col("run") + F.col("words")).alias("left")))), F.max(F.struct("cell", (F.col("left") - F.col("run") + F.col("words")).alias("left")))).alias("x")
        )
        state = saved(found.select("source", "x.left", F.col("x.cell").alias("at")), "state")
    # equal ranks at the boundary: by key
    tied = drawn.join(state.withColumnRenamed("source", "s"), drawn.source.eqNullSafe(F.col("s"))).where("rank = at")
    run = F.sum("size").over(Window.partitionBy("source").orderBy("_key"))
    last = F.coalesce(F.max(F.when(F.col("run") <= F.col("left"), F.col("_key"))), F.lit(-(1 << 63)))
    return saved(tied.withColumn("run", run).groupBy("source").agg(F.first("at").alias("limit"), last.alias("last")), "cuts")


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 17) -> DataFrame:
    """The mixed documents themselves: each row as often as it is taken (rows without words not at all)."""
    rows = keyed(docs, "source", "text")
    sized = rows.select("_rid", "doc_id", "source", F.col("text").cast("string").alias("text"), word_count(F.col("text").cast("string")).alias("_size"))
    copies = saved_alone(docs.sparkSession, "copies", lambda: _mixed(sized, weights, most, seed).where("copies > 0 and size > 0").select("_rid", "copies"))
    return restored(rows.join(copies.hint("merge"), "_rid").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
