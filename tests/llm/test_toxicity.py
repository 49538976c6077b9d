"""The toxicity models against plain ones, and what happens beyond the sizes of samples."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracelake.llm import toxicity


def plain_value(counts, word):
    """Difference of log-likelihoods by dictionaries; counts: word -> (ordinary, toxic)."""

    def spans(w):
        m = b" " + w + b" "
        return [m[: i + 1] for i in range(1, len(m))]

    grams = [defaultdict(lambda: [0, 0]) for _ in range(toxicity.ORDER + 1)]
    for w, c in counts.items():
        for s in spans(w):
            for n in range(1, toxicity.ORDER + 1):
                for k in (0, 1):
                    grams[n][s[-n:]][k] += c[k]
    tables = {toxicity.ORDER: grams[toxicity.ORDER]}
    for n in range(1, toxicity.ORDER):
        tables[n] = defaultdict(lambda: [0, 0])
        for g, c in grams[n + 1].items():
            for k in (0, 1):
                tables[n][g[-n:]][k] += c[k] > 0 or n <= toxicity.SHARED
    total, kinds = Counter(), Counter()
    for n, t in tables.items():
        for g, c in t.items():
            for k in (0, 1):
                total[n, g[:-1], k] += c[k]
                kinds[n, g[:-1], k] += c[k] > 0
    out = 0
    for s in spans(word):
        p = [1 / 256, 1 / 256]
        for n in range(1, toxicity.ORDER + 1):
            g = s[-n:]
            for k in (0, 1):
                if t := total[n, g[:-1], k]:
                    c = tables[n][g][k] if g in tables[n] else 0
                    p[k] = max(c - toxicity.DISCOUNT, 0) / t + toxicity.DISCOUNT * kinds[n, g[:-1], k] / t * p[k]
        out += math.log(p[1]) - math.log(p[0])
    return out


@pytest.mark.parametrize("cached", [100_000, 3])
def test_words_have_the_values_of_a_plain_model(spark, monkeypatch, cached):
    monkeypatch.setattr(toxicity, "CACHED", cached)
    texts = [("abc abd the they", 0), ("abcé bad baddest x", 1), ("the bad thing thing", 0), ("Thing baddest", 1)]
    counts = defaultdict(lambda: [0, 0])
    for t, y in texts:
        for w in t.lower().encode().split():
            counts[w][y] += 1
    training = spark.createDataFrame(texts, "text string, toxic int")
    tables = toxicity.backoff(toxicity.training_grams(training))
    words = ["abc", "baddest", "unknown", "they", "abcé"]
    docs = spark.createDataFrame([(i, i, f"{w} {w}, the") for i, w in enumerate(words)] + [(9, 9, None)], "_rid long, doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.features(docs, tables).collect()}
    the = plain_value(counts, b"the")
    for i, w in enumerate(words):
        v = plain_value(counts, w.encode())
        assert got[i].mean == pytest.approx((2 * v + the) / 3, abs=1e-4)
        assert got[i].strong == pytest.approx((2 * max(v - toxicity.STRONG, 0) + max(the - toxicity.STRONG, 0)) / 3, abs=1e-4)
    assert (got[9].mean, got[9].strong) == (0, 0)


def test_counts_read_all_labelled_texts(spark):
    """An expression that only labelled texts beyond the first 4000 of a class hold is learnt."""
    ids = spark.range(24_000).withColumn("toxic", (F.col("id") % 2).cast("int")).withColumn("part", toxicity.part_of("id"))
    ranked = [r.id for r in ids.where("toxic = 1 and part < 2").orderBy(F.xxhash64("id")).collect()]
    late = ids.where("part > 1").union(ids.where(~F.col("id").isin(ranked[:4000]))).where("toxic = 1").select("id").distinct().withColumn("late", F.lit(True))
    text = F.when(F.col("late"), "zqxj zqxj").otherwise("calm words")
    docs = ids.join(late, "id", "left").select(F.col("id").alias("doc_id"), text.alias("text"))
    docs = docs.union(spark.createDataFrame([(-1, "zqxj"), (-2, "calm words")], docs.schema))
    labels = ids.select(F.col("id").alias("doc_id"), "toxic")
    score = {r.doc_id: r.toxic_score for r in toxicity.classify(docs, labels).where("doc_id < 0").collect()}
    assert score[-1] > 0.9 and score[-2] < 0.3


def test_scores_stay_where_the_sample_of_the_curve_is_small(spark):
    """5 % of the rows are toxic; evidence is weak, so that the share of toxic rows shows in the scores."""
    rng = random.Random(1)
    toxic = [int(rng.random() < 0.05) for _ in range(8000)]
    texts = [" ".join("bad" if rng.random() < (0.3 if y else 0.2) else "good" for _ in range(10)) for y in toxic]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)] + [(8000, 8000, "")], "_rid long, doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    full, few = ({r._rid: r.toxic_score for r in toxicity.scored(docs, labels, most).collect()} for most in (4000, 90))
    mean = [sum(x.values()) / len(x) for x in (full, few)]
    print("mean scores", mean, "no evidence", full[8000], few[8000])
    assert mean[0] == pytest.approx(0.05, abs=0.02) and mean[1] == pytest.approx(mean[0], abs=0.02)
