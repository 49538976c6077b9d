"""Fill-in-the-middle against a plain version."""

import hashlib
import os
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import actual, expected  # noqa: E402

from tracelake.llm import fill_in_middle, queries  # noqa: E402

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by a regular expression."""
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNITS.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    spm = h[3] % 100 < 80
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def result(spark, rows, schema="doc_id long, text string"):
    out = fill_in_middle.transformed(spark.createDataFrame(rows, schema))
    return out.withColumn("back", fill_in_middle.restored(F.col("fim_text"), F.col("fim_form"))).collect()


PIECES = [" ", "\n", "\t", "a", "word", "é", "日本", "🦊", "<", "<P", "P>", "<S>", "<<M", ">", "\x0b", "\x1f", " ", "\\", "$1"]


def test_against_plain(spark):
    draw = np.random.default_rng(5)
    texts = ["", None, " ", "  \n", "a", " a", "a ", "<P>", "a<S>b", "<<M>", "<P >", "<<P", "P>"] + ["".join(draw.choice(PIECES, draw.integers(1, 40))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "repeated row"), (7, "repeated row"), (None, "no id here at all")]
    got = result(spark, rows)
    assert len(got) == len(rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.text, r.n_units, r.fim_form, r.prefix_chars, r.middle_chars, r.fim_text) for r in got), key=key) == sorted(((i, t, *plain(i, t)) for i, t in rows), key=key)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.fim_form for r in got} == {"plain", "psm", "spm"}


def test_long_text_clashes_and_empty_table(spark):
    long = ("日本 <P text\n" * 150_000)[:-1]
    ids = [i for i in range(40) if plain(i, "x y z")[1] != "plain"][:3]
    got = result(spark, [(i, long, 1, 2, 3) for i in ids], "doc_id long, text string, fim_form int, n int, cut int")
    assert sorted((r.doc_id, r.n_units, r.fim_form, r.prefix_chars, r.middle_chars, r.fim_text) for r in got) == [(i, *plain(i, long)) for i in ids]
    assert all(r.back == long and (r.n, r["cut"]) == (2, 3) for r in got)
    assert result(spark, []) == []


@pytest.mark.parametrize("piece", [1, 2, 7, 512])
def test_pieces_of_any_size_agree(piece):
    text = "ab <P> <<S>é <M\n🦊 <M>x".encode()
    step, emit = fill_in_middle.automaton()
    state, bits = 0, []
    for byte in text:
        bits.append(int(emit[state, byte]))
        state = step[state, byte]
    assert fill_in_middle.emitted(np.frombuffer(text, np.uint8), step, emit, piece).tolist() == bits
    assert sum(b & fill_in_middle.MARK > 0 for b in bits) == 3 and sum(b & fill_in_middle.POINT > 0 for b in bits) == len(text.decode())


def test_sentinels_that_begin_in_one_another():
    step, emit = fill_in_middle.automaton(("aab", "ab", "aabaa"))
    bits = fill_in_middle.emitted(np.frombuffer(b"aaabaab aabaaab", np.uint8), step, emit)
    assert [i for i, b in enumerate(bits) if b & fill_in_middle.MARK] == [3, 5, 6, 10, 12, 14]


def test_query(spark):
    from tracelake.llm.oracles import ORACLES

    assert actual(queries.op13_fill_in_middle(spark, "/root/testdata/sf0.001")) == expected(ORACLES["op13_fill_in_middle"], "/root/testdata/sf0.001")
