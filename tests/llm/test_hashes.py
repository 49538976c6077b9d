"""Words that a polynomial hash modulo 2**64 can't tell apart, and hashes with few bits."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from tracelake.llm import bytesops as B  # noqa: E402
from tracelake.llm import decontamination, license_scan, minhash_dedup, suffix_dedup, token_output, toxicity  # noqa: E402


def twins(turns=10):
    """The word of Thue and Morse in a and b of 2**turns letters, and its complement."""
    a, b = "a", "b"
    for _ in range(turns):
        a, b = a + b, b + a
    return a, b


A, Z = twins()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_twins_collide_under_the_polynomial_alone():
    data = np.frombuffer((A + " " + Z).encode(), np.uint8)
    starts, ends = np.array([0, 1025]), np.array([1024, 2049])
    poly, own = B.span_hash(B.prefix_hash(data), starts, ends), B.span_digest(data, starts, ends)
    assert poly[0] == poly[1] and own[0] != own[1]
    for n in range(3, 10):  # shorter ones are hashed by groups of 8 bytes
        x, y = (t.encode() for t in twins(n))
        both = np.frombuffer(x + y, np.uint8)
        got = B.span_digest(both, np.array([0, len(x)]), np.array([len(x), 2 * len(x)]))
        assert got[0] != got[1]


def test_equal_ranges_have_equal_hashes():
    draw = np.random.default_rng(1)
    text = draw.integers(0, 4, 600).astype(np.uint8)
    data = np.concatenate([text, np.zeros(3, np.uint8), text])
    starts = draw.integers(0, 500, 300)
    ends = starts + draw.integers(0, 100, 300)
    own = B.span_digest(data, starts, ends)
    assert (own == B.span_digest(data, starts + 603, ends + 603)).all() and (own != B.span_digest(data, starts, ends, seed=1)).all()
    raw = data.tobytes()
    assert len({raw[a:b] for a, b in zip(starts, ends, strict=True)}) == len(set(own.tolist()))
    lanes, long = B.lane_prefix(data), ends - starts >= 8
    segments = B.segment_digest(lanes, starts[long], ends[long])
    assert (segments == B.segment_digest(lanes, starts[long] + 603, ends[long] + 603)).all()
    assert len({raw[a:b] for a, b in zip(starts[long], ends[long], strict=True)}) == len(set(segments.tolist()))
    for length in (8, 13, 200):
        at = np.arange(600 - length)
        prefix = B.lane_prefix(data)
        windows = B.window_digest(prefix, at, length)
        assert (windows == B.window_digest(prefix, at + 603, length)).all()
        assert len(set(windows.tolist())) == len({raw[a : a + length] for a in at})


def test_operators_tell_twins_apart(spark):
    docs = [(1, A), (2, Z), (3, f"x {A} y"), (4, f"x {Z} y"), (5, f"{A} the general public license {Z}"), (6, " ".join([A] * 30)), (7, " ".join([Z] * 30))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    items = [("a", A), ("b", f"{A} y")]
    got = decontamination.report(table, spark.createDataFrame(items, "item_id string, text string"))
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.op1(docs, items), key=str)
    assert rows_of(minhash_dedup.near_duplicates(table, k=4), "doc_id", "n_shingles", "component_id", "kept") == sorted((tuple(r) for r in brute.op6(docs)), key=str)
    assert rows_of(token_output.encode(table), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(brute.op8(docs), key=str)
    cut = suffix_dedup.deduplicate(table).withColumn("kept", F.sha2("kept", 256))
    assert rows_of(cut, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(brute.op2(docs), key=str)
    assert {r.doc_id: len(r.places) for r in license_scan.scan(table).collect()} == {i: int(i == 5) for i, _ in docs}


def test_models_tell_twins_apart():
    data = np.frombuffer(f"{A} {Z} {A}".encode(), np.uint8)
    _, words, number, _ = toxicity.block_words(data, np.array([0, len(data)]))
    assert sorted(words) == sorted([A.encode(), Z.encode()]) and number[0] == number[2] != number[1]


@pytest.mark.parametrize("bits", [0, 2, 6])
def test_token_ids_need_no_luck(spark, monkeypatch, bits):
    """With a first hash of so few bits, most pieces of a block share one."""
    plain = B.span_digest
    monkeypatch.setattr(token_output.B, "span_digest", lambda data, starts, ends, seed=0: plain(data, starts, ends, seed) >> np.uint64(0 if seed else 63 - bits))
    texts = [f"some words {i} and others, {i * 7919} again\nand again" for i in range(60)]
    data = "".join(texts).encode()
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    encoder = token_output.Encoder(token_output.public_tokenizer())
    for _ in range(2):
        ids, ptr = encoder.encode(np.frombuffer(data, np.uint8), offs)
        for i, t in enumerate(texts):
            assert ids[ptr[i] : ptr[i + 1]].tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, token_output.END]
