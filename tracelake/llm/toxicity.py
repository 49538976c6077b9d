"""Toxicity with class-conditional Kneser-Ney models.

Two models of the letters of words, one of toxic and one of ordinary texts: interpolated Kneser-Ney of
order `ORDER` over the bytes of a word between its marks.  The highest orders have counts of their own class;
below `SHARED` both classes back off to the same continuation counts, so that rare expressions are smoothed
alike.  A word's value is the difference of its two log-likelihoods; a text has the mean value of its words
and the mean of what exceeds `STRONG`, both length-normalised, from which a logistic curve makes the score.

Counts come from all labelled rows of two parts of the ids, and the curve from a bounded sample of a third: at
most `MAX_DOCS` labelled texts a class, in the order of a hash of the id, weighted by what their class has in all.  Grams, continuation counts and
contexts are tables that grow with the labelled texts; the grams of the corpus's distinct words are joined to
them, words to their grams and texts to their words.  Only the values of the `CACHED` commonest grams and
words are sent to all tasks, so that no common key is joined; this changes no result, since values are whole
multiples of 1 / `UNIT` and their sums exact in any order.  Neither labels nor language, source or id are
inputs of a score.

Null, empty and wordless texts score as a text with no evidence (the curve at zero).  Rows without label or
with a null label don't train; a document labelled twice trains with each.  Texts of any length are read whole.
`clean` gives all columns back as they were, whatever their names; `classify` replaces columns that are called
like its own.  With one class missing all
scores are the share of toxic labels (0 without labels).  Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import as_text, keyed, restored, saved, saved_alone

ORDER, SHARED, DISCOUNT = 6, 3, 0.75
STRONG = 3.0
MAX_DOCS, CACHED = 4000, 100_000
UNIT = 1 << 20


# ---- blocks of texts and words ---------------------------------------------------------------------

def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The `ORDER` bytes up to each byte but the first of the marked words, as one number, and their words' places.

    Grams of lower orders are the last bytes of these, and contexts all bytes but the last.
    """
    offs = np.append(0, np.cumsum([len(w) + 2 for w in words])).astype(np.int64)
    data = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8)
    owner = np.repeat(np.arange(len(words)), np.diff(offs))
    inside = np.arange(len(data)) - offs[owner]
    gram = np.zeros(len(data), np.int64)
    for back in range(ORDER):
        own = np.flatnonzero(inside >= back)
        gram[own] |= data[own - back].astype(np.int64) << (8 * back)
    return gram[inside > 0], owner[inside > 0]


def block_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(hashes and bytes of the distinct words, number of each word, first word of each text) of a block."""
    data = B.LOWER[data]
    starts, ends, first = B.words(data, offs, B.ALNUM)
    hashes, one, number = np.unique(B.span_digest(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    return hashes.view(np.int64), [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], number, first


def looked_up(keys: np.ndarray, cache: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(known, value) of each key; cache: sorted keys and their values."""
    if not len(cache[0]):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(cache[0], keys), len(cache[0]) - 1)
    known = cache[0][at] == keys
    return known, np.where(known, cache[1][at], 0)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression of weighted rows on standardised features, by Newton steps; (weights..., constant) for raw features."""
    mean = np.average(x, axis=0, weights=weight)
    sd = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight)) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), z.T @ (weight * (y - p)) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / sd, w[-1] - (w[:-1] / sd * mean).sum())


# ---- Spark ----------------------------------------------------------------------------------------

def part_of(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id's text modulo 4: rows of part 2 are held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def training_grams(texts: DataFrame) -> DataFrame:
    """(gram, ordinary, toxic): how often texts (text, toxic) of each class hold each gram of the highest order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in B.text_blocks(batch, "text"):
                _, words, number, first = block_words(data, offs)
                label = np.repeat(part.column("toxic").to_numpy(), np.diff(first))
                gram, owner = word_grams(words)
                grams, which = np.unique(gram, return_inverse=True)
                times = [np.bincount(number, label == k, len(words))[owner] for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(grams), *(pa.array(np.bincount(which, t, len(grams)).astype(np.int64)) for t in times)], ["gram", "ordinary", "toxic"])

    return texts.select("text", "toxic").mapInArrow(count, "gram long, ordinary long, toxic long").groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def last_bytes(gram: Column, order: Column | int) -> Column:
    """A gram of the given order from a longer one."""
    order = F.lit(order) if isinstance(order, int) else order
    return gram.bitwiseAND(F.element_at(F.array(*(F.lit((1 << 8 * o) - 1).cast("long") for o in range(1, ORDER + 1))), order))


def backoff(highest: DataFrame) -> DataFrame:
    """(kind, n, gram, x0, x1): of each order n what known grams have (kind 0) and what contexts leave to order n - 1 (kind 1), by class."""
    orders = F.explode(F.sequence(F.lit(1), F.lit(ORDER))).alias("n")
    every = highest.select("gram", "ordinary", "toxic", orders).groupBy("n", last_bytes(F.col("gram"), F.col("n")).alias("gram")).agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    every = saved(every, "grams")
    # continuation counts: in how many longer grams it stands, in the class or (shared) in either
    seen = lambda c: ((F.col(c) > 0) | (F.col("n") <= SHARED + 1)).cast("long")
    lower = every.where("n > 1").groupBy((F.col("n") - 1).alias("n"), last_bytes(F.col("gram"), F.col("n") - 1).alias("gram")).agg(F.sum(seen("ordinary")).alias("c0"), F.sum(seen("toxic")).alias("c1"))
    counts = saved(every.where(F.col("n") == ORDER).select("n", "gram", F.col("ordinary").alias("c0"), F.col("toxic").alias("c1")).unionAll(lower), "continuations")
    counts = counts.withColumn("context", F.shiftright("gram", 8))
    sums = [f(k) for k in (0, 1) for f in (lambda k: F.sum(f"c{k}").alias(f"t{k}"), lambda k: F.sum((F.col(f"c{k}") > 0).cast("long")).alias(f"kinds{k}"))]
    contexts = saved(counts.groupBy("n", "context").agg(*sums), "contexts")
    known = counts.join(contexts, ["n", "context"]).select(
        F.lit(0).alias("kind"), "n", "gram", *(F.when(F.col(f"t{k}") > 0, F.greatest(F.col(f"c{k}") - DISCOUNT, F.lit(0.0)) / F.col(f"t{k}")).otherwise(0.0).alias(f"x{k}") for k in (0, 1))
    )
    left = contexts.select(F.lit(1).alias("kind"), "n", F.col("context").alias("gram"), *(F.when(F.col(f"t{k}") > 0, DISCOUNT * F.col(f"kinds{k}") / F.col(f"t{k}")).otherwise(1.0).alias(f"x{k}") for k in (0, 1)))
    return saved(known.unionAll(left), "backoff")


def gram_values(grams: DataFrame, tables: DataFrame) -> DataFrame:
    """(key, times, value) of grams (gram, times): the difference of their log-likelihoods in units of 1 / UNIT.

    Keys of one or two bytes, which many grams share, are so few that they are broadcast.
    """
    asked = grams.select("gram", F.explode(F.sequence(F.lit(1), F.lit(ORDER))).alias("n")).withColumn("own", last_bytes(F.col("gram"), F.col("n")))
    asked = asked.select(F.col("gram").alias("key"), "n", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("own").alias("gram")), F.struct(F.lit(1).alias("kind"), F.shiftright("own", 8).alias("gram")))).alias("s"))
    asked = asked.select("key", "n", "s.kind", "s.gram")
    on, short = ["kind", "n", "gram"], F.col("gram") < 1 << 16
    found = asked.where(short).join(F.broadcast(tables.where(short)), on).unionByName(asked.where(~short).join(tables.where(~short), on))
    of = lambda kind, n, k: F.max(F.when((F.col("kind") == kind) & (F.col("n") == n), F.col(f"x{k}"))).alias(f"x{kind}{n}{k}")
    wide = found.groupBy("key").agg(*(of(kind, n, k) for kind in (0, 1) for n in range(1, ORDER + 1) for k in (0, 1)))
    p = [F.lit(1 / 256)] * 2
    for n in range(1, ORDER + 1):
        wide = wide.select("*", *((F.coalesce(f"x0{n}{k}", F.lit(0.0)) + F.coalesce(f"x1{n}{k}", F.lit(1.0)) * p[k]).alias(f"p{n}{k}") for k in (0, 1)))
        p = [F.col(f"p{n}{k}") for k in (0, 1)]
    value = F.round((F.log(p[1]) - F.log(p[0])) * UNIT).cast("long")
    return saved(wide.select("key", value.alias("value")).join(grams.withColumnRenamed("gram", "key"), "key").select("key", "times", "value"), "gram-values")


def cached(values: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The values of the commonest keys, CACHED at most, by key.

    Counts are cut at eighths of powers of two, so that no rows are sorted and none but those are gathered.
    """
    level = F.floor(F.log2("times") * 8).alias("level")
    left, least = CACHED, 1 << 30
    for r in sorted(values.groupBy(level).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r.level
    table = values.where(level >= least).select("key", "value").toPandas().sort_values("key")
    return table["key"].to_numpy(np.int64), table["value"].to_numpy(np.int64)


def word_values(docs: DataFrame, tables: DataFrame) -> DataFrame:
    """(key, times, value) of the distinct words of docs; key: hash of the word."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offs in B.text_blocks(batch, "text"):
                hashes, words, number, _ = block_words(data, offs)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(words, pa.binary()), pa.array(np.bincount(number, minlength=len(words)))], ["key", "word", "times"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, times = np.unique(word_grams(batch.column("word").to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(times)], ["gram", "times"])

    words = docs.select("text").mapInArrow(split, "key long, word binary, times long").groupBy("key").agg(F.min("word").alias("word"), F.sum("times").alias("times"))
    words = saved(words, "words")
    known = saved(words.select("word").mapInArrow(grams, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times")), "word-grams")
    values = gram_values(known, tables)
    cache = docs.sparkSession.sparkContext.broadcast(cached(values))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, owner = word_grams(batch.column("word").to_pylist())
            found, value = looked_up(gram, cache.value)
            key, n = batch.column("key").to_numpy(), batch.num_rows
            own = np.zeros(n, np.int64)
            np.add.at(own, owner, value)
            rest = ~found
            # the row of a word itself asks for nothing
            yield pa.RecordBatch.from_arrays([pa.array(np.append(key, key[owner[rest]])), pa.array(np.append(key, gram[rest])), pa.array(np.repeat([0, 1], [n, rest.sum()])), pa.array(np.append(own, np.zeros(rest.sum(), np.int64)))], ["word", "key", "n", "known"])

    rows = words.select("key", "word").mapInArrow(add, "word long, key long, n long, known long").join(values.select("key", "value"), "key", "left")
    sums = rows.groupBy("word").agg(F.sum(F.col("known") + F.col("n") * F.coalesce("value", F.lit(0))).alias("value"))
    return saved(words.select("key", "times").join(sums.withColumnRenamed("word", "key"), "key"), "word-values")


def features(docs: DataFrame, tables: DataFrame) -> DataFrame:
    """(_rid, doc_id, mean, strong) of docs (_rid, doc_id, text): the mean value of a text's words and their mean excess over STRONG."""
    values = word_values(docs, tables)
    cache = docs.sparkSession.sparkContext.broadcast(cached(values))
    strong = int(STRONG * UNIT)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in B.text_blocks(batch, "text"):
                hashes, _, number, first = block_words(data, offs)
                found, value = looked_up(hashes, cache.value)
                each = value[number]
                sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(np.stack([each, np.where(found[number], np.maximum(each - strong, 0), 0)], 1), axis=0)])
                sums = sums[first[1:]] - sums[first[:-1]]
                owner = np.repeat(np.arange(part.num_rows), np.diff(first))
                rest = ~found[number]
                pairs, times = np.unique(np.stack([owner[rest], number[rest]]), axis=1, return_counts=True) if rest.any() else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                rid, zero = part.column("_rid").to_numpy(), np.zeros(len(times), np.int64)
                # the row of a text itself asks for nothing
                columns = [np.append(rid, rid[pairs[0]]), np.append(rid, hashes[pairs[1]]), np.append(np.zeros(len(rid), np.int64), times), np.append(sums[:, 0], zero), np.append(sums[:, 1], zero), np.append(np.diff(first), zero)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_rid", "key", "n", "known", "excess", "words"])

    rows = docs.select("_rid", "text").mapInArrow(add, "_rid long, key long, n long, known long, excess long, words long").join(values.select("key", "value"), "key", "left")
    value = F.coalesce("value", F.lit(0))
    sums = rows.groupBy("_rid").agg(F.sum(F.col("known") + F.col("n") * value).alias("known"), F.sum(F.col("excess") + F.col("n") * F.greatest(value - strong, F.lit(0))).alias("excess"), F.sum("words").alias("words"))
    mean = lambda c: F.col(c) / F.greatest(F.col("words"), F.lit(1)) / UNIT
    return saved(docs.select("_rid", "doc_id").join(sums.select("_rid", mean("known").alias("mean"), mean("excess").alias("strong")), "_rid"), "features")


def curve_rows(known: DataFrame, most: int) -> DataFrame:
    """(mean, strong, toxic, weight) of at most `most` rows a class of known (doc_id, mean, strong, toxic).

    A row stands for as many as its class has for each of its rows here, so that the share of toxic rows stays.
    """
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    own = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id")).limit(most).withColumn("weight", F.lit(max(1.0, sizes.get(k, 0) / most))) for k in (0, 1)]
    return own[0].unionAll(own[1]).select("mean", "strong", "toxic", "weight")


def scored(docs: DataFrame, labels: DataFrame, most: int = MAX_DOCS) -> DataFrame:
    """(_rid, toxic_score) of docs (_rid, doc_id, text)."""
    labels = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    part = part_of()
    shares = {r.toxic: r["count"] for r in docs.where(part != 2).select("doc_id").join(labels.where(part != 2), "doc_id").groupBy("toxic").count().collect()}
    if not (shares.get(0) and shares.get(1)):
        return docs.select("_rid", F.lit(1 / (1 + np.exp(-30.0 if shares.get(1) else 30.0))).alias("toxic_score"))
    # the ids of a part are chosen before the join, so that only their texts are moved
    highest = saved(training_grams(docs.where(part < 2).select("doc_id", "text").join(labels.where(part < 2), "doc_id")), "training-grams")
    if highest.isEmpty():
        return docs.select("_rid", F.lit(1 / (1 + np.exp(30.0))).alias("toxic_score"))
    found = features(docs, backoff(highest))
    known = found.join(labels, "doc_id").where(part != 2)
    rows = curve_rows(known.where(part == 3), most).toPandas()
    if rows["toxic"].nunique() < 2:  # too few rows for a part of their own
        rows = curve_rows(known, most).toPandas()
    w = [float(x) for x in fit_curve(rows[["mean", "strong"]].to_numpy(), rows["toxic"].to_numpy(float), rows["weight"].to_numpy())]
    evidence = F.col("mean") * w[0] + F.col("strong") * w[1] + w[2]
    return found.select("_rid", (1 / (1 + F.exp(-F.greatest(F.least(evidence, F.lit(30.0)), F.lit(-30.0))))).alias("toxic_score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs with toxic_score and toxic_predicted (1 from the threshold on)."""
    rows = keyed(as_text(docs.drop("toxic_score", "toxic_predicted")), "text")
    scores = scored(rows.drop("_row"), labels)
    return rows.join(scores, "_rid").select("_row.*", "toxic_score", (F.col("toxic_score") >= threshold).cast("int").alias("toxic_predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that aren't predicted to be toxic."""
    rows = keyed(docs, "text")
    texts = rows.select("_rid", "doc_id", F.col("text").cast("string").alias("text"))
    good = saved_alone(docs.sparkSession, "not-toxic", lambda: scored(texts, labels).where(F.col("toxic_score") < threshold).select("_rid"))
    return restored(rows.join(good, "_rid", "left_semi"))
