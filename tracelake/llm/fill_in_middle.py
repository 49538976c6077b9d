"""Fill-in-the-middle: texts are cut at two unit boundaries and written as prefix, suffix and middle between sentinels.

A unit is white space (0x20, 0x09 to 0x0D) and the run of other characters behind it; white space at the end is a unit
of its own.  A byte automaton, held as a table of states and bytes, does three things in one scan: it tells the bytes that begin
a code point from UTF-8 continuations, finds where units begin, and recognises sentinels (an Aho-Corasick trie over
them).  Its transitions emit bits, which are counted per text; a second pass goes to the counted places and returns
the cuts.  A block of texts is scanned by pieces side by side: each piece is run from every state at once, which gives a map from
state to state; the maps in order give the state in which each piece really begins, and a run from there emits.

Which form a text takes and where it is cut follows from sha256(seed:doc_id) alone, so reruns and other partitionings
agree.  Texts that hold a sentinel, or nothing, stay plain.

A null text is an empty one, a null doc_id an empty text.  Repeated rows get the same cuts; rows stay rows of
their own.  An empty table gives an empty result.  A text of any length is scanned whole.  Other columns are kept; those called
like the operator's own are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B

# The marks before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 42, 50, 80
#: What a transition emits: a unit begins, a sentinel ends, a code point begins.
UNIT, MARK, POINT = 1, 2, 4
#: Stands before each text of a block; no byte of UTF-8 is like it.
BREAK = 0xFF
#: Bytes of a piece.
PIECE = 512
OWN = ("n_units", "fim_form", "prefix_chars", "middle_chars", "fim_text")


def automaton(sentinels: Sequence[str] = SENTINELS) -> tuple[np.ndarray, np.ndarray]:
    """(next state, emitted bits) of each state and byte; state 0 is the begin of a text, 1 is in white space, 2 in a word.

    Further states are in a word, too, at each non-empty beginning of a sentinel.
    """
    heads = sorted({s.encode()[:n] for s in sentinels for n in range(1, len(s.encode()) + 1)})
    states = {head: 3 + i for i, head in enumerate(heads)} | {b"": 2}
    whole = {s.encode() for s in sentinels}
    step, emit = np.full((3 + len(heads), 256), 2, np.uint8), np.zeros((3 + len(heads), 256), np.uint8)
    seen = {0: b"", 1: b""} | {state: head for head, state in states.items()}
    for state, head in seen.items():
        for byte in range(256):
            if byte == BREAK:
                step[state, byte] = 0
                continue
            bits = POINT * (not 0x80 <= byte < 0xC0)
            if B.NONSPACE[byte]:
                read = head + bytes([byte])
                tail = next(read[i:] for i in range(len(read) + 1) if read[i:] in states)
                step[state, byte] = states[tail]
                bits |= UNIT * (state == 0) | MARK * any(read.endswith(s) for s in whole)
            else:
                step[state, byte] = 1
                bits |= UNIT * (state != 1)
            emit[state, byte] = bits
    return step, emit


def emitted(data: np.ndarray, step: np.ndarray, emit: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """The bits that the automaton, begun in state 0, emits at each byte."""
    n, pieces = len(data), max(1, -(-len(data) // piece))
    columns = np.full(pieces * piece, BREAK, np.uint8)
    columns[:n] = data
    columns = np.ascontiguousarray(columns.reshape(pieces, piece).T)
    step, emit = step.astype(np.int32).ravel() << 8, emit.ravel()
    states = len(emit) >> 8
    to = np.repeat(np.arange(states, dtype=np.int32)[:, None] << 8, pieces, axis=1)
    for column in columns:
        to = step[to | column]
    begin, at = np.zeros(pieces, np.int32), 0
    for k, ends in enumerate(to.T.tolist()):
        begin[k] = at
        at = ends[at >> 8]
    out = np.empty((piece, pieces), np.uint8)
    for column, bits in zip(columns, out, strict=True):
        begin |= column
        emit.take(begin, out=bits)
        begin = step[begin]
    return out.T.ravel()[:n]


def cuts(data: np.ndarray, offs: np.ndarray, first: np.ndarray, second: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """(units, sentinels, code points of the prefix, of the middle) of each text; it is cut after first and second modulo (units + 1) units."""
    n = len(offs) - 1
    with_breaks = np.insert(data, offs[:-1], BREAK)
    bits = emitted(with_breaks, *tables)
    begins = offs + np.arange(n + 1)  # of the breaks, and the end
    places = np.flatnonzero(bits & UNIT)
    unit = np.searchsorted(places, begins)
    units = np.diff(unit)
    total = lambda bit: np.concatenate([[0], np.cumsum((bits & bit) > 0)])
    marks, points = total(MARK), total(POINT)
    places = np.append(places, len(bits))
    ends = []
    for h in (first, second):
        at = h % (units + 1)
        ends.append(points[np.where(at == units, begins[1:], places[unit[:-1] + np.minimum(at, units)])])
    low, high = np.minimum(*ends), np.maximum(*ends)
    return [units, np.diff(marks[begins]), low - points[begins[:-1]], high - low]


def _cut_column(text: Column, first: Column, second: Column, sentinels: Sequence[str]) -> Column:
    @F.arrow_udf("struct<n: bigint, marks: bigint, prefix: bigint, middle: bigint>")
    def found(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tables = automaton(sentinels)
        for texts, *drawn in columns:
            batch = pa.RecordBatch.from_arrays([texts, *drawn], ["text", "first", "second"])
            parts = [np.zeros((4, 0), np.int64)]
            for part, data, offs in B.text_blocks(batch, "text"):
                parts.append(np.array(cuts(data, offs, part.column("first").to_numpy(), part.column("second").to_numpy(), tables)))
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in np.concatenate(parts, axis=1)], ["n", "marks", "prefix", "middle"])

    return found(text, first, second)


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """docs with n_units, fim_form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and fim_text.

    rate percent of the documents are transformed, of these spm_rate percent with the suffix first.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in OWN)).alias("row")
    drawn = docs.select(row, text.alias("text"), digest.alias("digest"))
    h = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    found = drawn.select("row", "text", *(x.alias(f"h{i}") for i, x in enumerate(h[2:], 3)), _cut_column(F.col("text"), h[0], h[1], sentinels).alias("cut"))
    plain = (F.col("text") == "") | (F.col("cut.marks") > 0) | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    placed = found.select("row", "text", form.alias("form"), "cut.n", F.col("cut.prefix").cast("int").alias("prefix"), F.col("cut.middle").cast("int").alias("middle"))
    p, s, m = (F.lit(x) for x in sentinels)
    parts = [F.left("text", F.col("prefix")), F.substr("text", F.col("prefix") + 1, F.col("middle")), F.substr("text", F.col("prefix") + F.col("middle") + 1)]
    psm, spm = F.concat(p, parts[0], s, parts[2], m, parts[1]), F.concat(s, parts[2], p, parts[0], m, parts[1])
    count = lambda c: F.when(F.col("form") != "plain", F.col(c).cast("long"))
    return placed.select(
        "row.*", F.col("n").alias("n_units"), F.col("form").alias("fim_form"), count("prefix").alias("prefix_chars"), count("middle").alias("middle_chars"),
        F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("fim_text"),
    )


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output of a form was made of, rebuilt from these two alone."""
    p, s, m = sentinels
    between = lambda left, right: F.substring_index(F.substring_index(output, left, -1), right, 1)
    psm = F.concat(between(p, s), F.substring_index(output, m, -1), between(s, m))
    spm = F.concat(between(p, m), F.substring_index(output, m, -1), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
