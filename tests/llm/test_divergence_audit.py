"""The audit of sources against its SQL and a plain version."""

import os
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import actual, expected  # noqa: E402

from tracelake.llm import divergence_audit, queries  # noqa: E402

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, ranked=10):
    """rows (text, lang, source)."""
    count, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(LOWER))
        count[lang, source].update(words)
        docs[lang].update(set(words))
        sources[lang].add(source)
    out = []
    for lang, mine in sources.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def shares(of, kept=kept):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in mine}
        q = shares(sum((count[lang, s] for s in mine), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranked)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def told(spark, rows, schema="text string, lang string, source string", **options):
    return sorted(tuple(r) for r in divergence_audit.audit(spark.createDataFrame(rows, schema), **options).select("lang", "source", "part", "item", "value", "rank").collect())


def texts(seed, n):
    draw = np.random.default_rng(seed)
    words = ["the", "The", "naïve", "ÉTÉ", "été", "x1y", "日本", "a-b", "🦊", *(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))]
    weights = 1 / np.arange(1, len(words) + 1)
    out = []
    for i in range(n):
        lang = ["en", "fr", None, ""][i % 7 % 4]
        source = "hot" if i % 3 == 0 else f"s{draw.integers(0, 9)}"
        out.append((" ".join(draw.choice(np.roll(words, i % 5), draw.integers(0, 60), p=weights / weights.sum())), lang, source))
    return out


def test_against_plain(spark):
    rows = texts(3, 900)
    rows += rows[:50] + [(None, "en", "empty"), ("", "de", "alone"), ("one two", "de", None), (None, None, None), ("rare words here", "xx", "a"), ("123 456", "xx", "b")]
    for text, kept in ((1 << 30, 1 << 20), (1 << 10, 20)):
        assert told(spark, rows, bytes_per_shard=text, rows_per_shard=kept) == plain(rows)


def test_ties_long_text_clashes_and_empty_table(spark):
    rows = [("aa bb cc dd " * 50_000, "en", s) for s in ("x", "y")] + [("aa bb cc dd ee", "en", s) for s in "xyz" for _ in range(12)] + [("ee ff gg", "en", "z")] * 20
    wide = [(*r, 1, "k") for r in rows]
    assert told(spark, wide, "text string, lang string, source string, n int, term string") == plain(rows)
    assert told(spark, []) == []
    assert told(spark, rows, least_docs=1, ranked=2) == plain(rows, 1, 2)


@pytest.mark.parametrize("pending", [10])
def test_shard_sums_in_steps(spark, pending, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence_audit, "PENDING", pending)
    batch = pa.RecordBatch.from_pylist([{"lang": "l", "source": s, "term": t, "n": 2, "docs": 1} for s in "ab" for t in "pqrstu"])
    got = [r for b in divergence_audit._kept(10)(iter([batch] * 5)) for r in b.to_pylist()]
    assert sorted((r["source"], r["term"], r["n"]) for r in got if not r["whole"]) == [(s, t, 10) for s in "ab" for t in "pqrstu"]
    assert sorted((r["term"], r["n"]) for r in got if r["whole"]) == [(t, 20) for t in "pqrstu"]


def test_query(spark):
    from tracelake.llm.oracles import ORACLES

    assert actual(queries.op12_divergence_audit(spark, "/root/testdata/sf0.001")) == expected(ORACLES["op12_divergence_audit"], "/root/testdata/sf0.001")
