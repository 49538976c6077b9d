"""Vectorised helpers over UTF-8 text held as one byte array plus offsets.

Every function works inside one task, on one bounded block of rows.  Words are byte ranges: the word
classes used by the operators are unions of single bytes and of all bytes >= 0x80, so splitting the
UTF-8 bytes gives the same words as splitting the code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once inside a task; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 20

_rng = np.random.default_rng(20240611)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: [^\x20\x09-\x0D]
NONSPACE = np.ones(256, bool)
NONSPACE[0x20] = NONSPACE[0x09:0x0E] = False

#: Bytes up to which a range is hashed beside others.
LONG_SPAN = 512
_LANE_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        for k, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads all input bits over all output bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def text_blocks(batch: pa.RecordBatch, column: str, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices a batch so that the texts of a slice have about max_bytes (one text at least)."""
    raw, offs = column_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1
        end = min(n, max(end, at + 1))
        yield batch.slice(at, end - at), raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    flag = np.zeros(n + 2, bool)
    flag[1:-1] = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = flag[1:-1] & (~flag[:-2] | edge[:-1])
    stop = flag[1:-1] & (~flag[2:] | edge[1:])
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**64; span_hash reads any byte range from them.

    Texts of some forms collide (two of 1024 letters are known for any base), so this hash picks anchors but doesn't decide alone.
    """
    power, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * power[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [starts, ends)."""
    _, inverse = _power_tables(len(prefix))
    lengths = (ends - starts).astype(np.uint64)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


def span_digest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte ranges [starts, ends) that mix each 8 bytes into all bits before the next ones come.

    No texts collide by their form, as they do in a polynomial modulo 2**64 (`span_hash`).  Ranges over LONG_SPAN bytes are hashed by blake2b.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    length = ends - starts
    out = mix(length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64)))
    long = np.flatnonzero(length > LONG_SPAN)
    live = np.flatnonzero((length > 0) & (length <= LONG_SPAN))
    at, left, h = starts[live], length[live], out[live]
    while len(live):
        h = mix(h ^ (lanes[at] & _LANE_MASK[np.minimum(left, 8)]))
        out[live] = h
        more = np.flatnonzero(left > 8)
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def lane_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums, 8 bytes apart, of a polynomial over mixed groups of 8 bytes; window_digest reads windows from them."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    mixed = mix(np.ndarray(len(data) + 8, "<u8", padded, strides=(1,)) + np.uint64(0x9E3779B97F4A7C15))
    rows = -(-len(mixed) // 8)
    power, _ = _power_tables(rows + 1)
    grid = np.zeros((rows + 1, 8), np.uint64)
    grid[1:].reshape(-1)[: len(mixed)] = mixed
    grid[1:] *= power[:rows, None]
    return np.cumsum(grid, axis=0, out=grid)


def window_digest(prefix: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of `length` (8 at least) bytes from starts on; groups of 8 bytes are told apart by all their bits."""
    _, inverse = _power_tables(len(prefix))

    def groups(starts: np.ndarray) -> np.ndarray:
        row, column = np.divmod(starts, 8)
        return mix((prefix[row + length // 8, column] - prefix[row, column]) * inverse[row])

    out = groups(starts)
    return out if length % 8 == 0 else out ^ mix(groups(starts + length % 8) + np.uint64(1))


def segment_digest(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [starts, ends) of 8 bytes at least, from `lane_prefix`: of their groups of 8 bytes, their last 8 bytes and their lengths."""
    _, inverse = _power_tables(len(prefix))

    def groups(starts: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        row, column = np.divmod(starts, 8)
        return (prefix[row + n, column] - prefix[row, column]) * inverse[row]

    length = ends - starts
    return mix(groups(starts, length // 8) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ mix(groups(ends - 8, 1) + np.uint64(1))


def byte_grams(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k bytes from each place on."""
    n = max(len(prefix) - k, 0)
    _, inverse = _power_tables(len(prefix))
    return mix((prefix[k:] - prefix[:n]) * inverse[:n])


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-grams of words inside texts, and for each text the index of its first k-gram."""
    counts = np.diff(first)
    n = np.maximum(counts - k + 1, 0)
    ptr = np.zeros(len(first), np.int64)
    np.cumsum(n, out=ptr[1:])
    total = int(ptr[-1])
    at = np.repeat(first[:-1] - ptr[:-1], n) + np.arange(total)
    out = np.zeros(total, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + hashes[at + j]
    return mix(out), ptr


def list_array(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values, type=kind))
