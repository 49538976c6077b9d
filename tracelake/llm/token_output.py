"""Token ids as Arrow files of equal-length sequences.

Documents in ascending doc_id order are range-partitioned; each task encodes its run of documents, appends the
end id to each, and packs the ids into sequences of `SEQUENCE` ids.  A part is two Arrow files: the sequences
(record batches with the columns ids: fixed_size_list<uint16 or uint32>, by the size of the vocabulary, and mask:
fixed_size_list<bool>, false where the last sequence is padded), and the documents (doc_id, first id within
the part, number of ids).
Every sequence has its place at a fixed multiple of its length, so a memory-mapped file gives any sequence, its mask
(as Arrow holds it, one bit an id) or any document's ids without a copy.  Files get unique names and a part counts once its row is in the manifest:
a task that was lost or ran twice leaves only files that nobody reads.

Encoding works on pieces: a text is cut before each single space or line break that stands between two other
characters.  The byte-level pre-tokenizer always starts a new token there, so the ids of a text are those of its pieces,
and a task encodes each distinct piece once.

Null and empty texts give the end id alone.  A special token's string inside a text gives that token, as the
library has it.  Equal
doc_ids stand in the order of a hash of their text, null ones first.  Other columns aren't written.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytesops as B
from .common import as_text, saved, scratch_dir

SEQUENCE, END = 2048, 2
#: Distinct pieces that a worker remembers.
CACHE_PIECES = 1_000_000
#: New pieces that the tokenizers library gets as one text.
JOINED_PIECES = 1_000
#: Sequences in one record batch.
BATCH = 128


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pieces start: at texts, and before a lone space or line break between two characters that are no white space."""
    n = len(data)
    plain = (data > 0x20) & (data != 0x7F)
    # first bytes of characters beyond ASCII that are or may be white space: keep their neighbourhood together
    two = np.append(data[1:], 0)
    odd = ((data == 0xC2) & ((two == 0x85) | (two == 0xA0))) | ((data == 0xE1) & (two == 0x9A)) | ((data == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((data == 0xE3) & (two == 0x80))
    at = np.flatnonzero(odd)
    for j in range(3):
        plain[np.minimum(at + j, n - 1)] = False
    cut = (data == 0x20) | (data == 0x0A)
    cut[1:] &= plain[:-1]
    cut[:-1] &= plain[1:]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    cut &= ~edge[1:]  # a text's last byte has no next one
    cut |= edge[:-1]
    return np.flatnonzero(cut)


class Encoder:
    """Encodes blocks of texts; distinct pieces go to the tokenizers library once."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        # looking for special tokens takes the library a lot of memory: only texts that hold one go to `whole`
        self.tokenizer.encode_special_tokens = True
        self.whole = functools.cache(lambda: Tokenizer.from_file(path))
        # a byte-level token has one character per byte
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = list(map(len, vocabulary))
        self.clear()

    def clear(self) -> None:
        # pieces in order of their hash, each with its slot in ptr
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.ptr = np.zeros(1, np.int64)

    def _batch(self, texts: list[str], special: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has."""
        ids = [e.ids for e in (self.whole() if special else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64)

    def _alone(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, special: bool = False) -> tuple[np.ndarray, np.ndarray]:
        return self._batch([data[a:z].tobytes().decode("utf-8", "replace") for a, z in zip(start.tolist(), stop.tolist(), strict=True)], special)

    def _with_special(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Which texts hold the string of a special token."""
        out, raw = np.zeros(len(offs) - 1, bool), data.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                out[np.searchsorted(offs, at, "right") - 1] = True
                at = raw.find(token, at + len(token))
        return out

    def _joined(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Like _alone, for pieces that start and end at a cut: they are encoded side by side and told apart by the widths of the tokens."""
        size = stop - start
        end = np.cumsum(size)
        if not len(end) or self.tokenizer.normalizer is not None:
            return self._alone(data, start, stop)
        whole = data[np.repeat(start - end + size, size) + np.arange(int(end[-1]))]
        bounds = [0, *end[JOINED_PIECES - 1 :: JOINED_PIECES].tolist()]
        if bounds[-1] < len(whole):
            bounds.append(len(whole))
        ids, _ = self._batch([whole[a:z].tobytes().decode("utf-8", "replace") for a, z in itertools.pairwise(bounds)])
        reach = np.cumsum(self.width[ids])
        last = np.searchsorted(reach, end)
        if last[-1] != len(ids) - 1 or (reach[last] != end).any():  # bytes that are no UTF-8
            return self._alone(data, start, stop)
        return ids, np.diff(last, prepend=-1)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their offsets, end ids included."""
        n_texts = len(offs) - 1
        if not len(data):
            return np.full(n_texts, END, np.uint32), np.arange(n_texts + 1)
        if len(self.hash) > CACHE_PIECES:
            self.clear()
        start = piece_starts(data, offs)
        special = self._with_special(data, offs)
        if special.any():  # such texts are one piece
            text = np.searchsorted(offs, start, "right") - 1
            start = start[~special[text] | (start == offs[text])]
        stop = np.append(start[1:], len(data))
        every, second = B.span_digest(data, start, stop), B.span_digest(data, start, stop, seed=1)
        while True:  # pieces are told apart by both hashes
            h, one, number = np.unique(every, return_index=True, return_inverse=True)
            check = second[one]
            other = check[number] != second
            if not other.any():
                break
            every[other] += np.uint64(1)
        a, z = start[one], stop[one]
        slots = np.full(len(h), -1, np.int64)
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            slots = np.where((self.hash[at] == h) & (self.check[at] == check), self.slot[at], -1)
        new = np.flatnonzero(slots < 0)
        if len(new):
            edge = np.zeros(len(data) + 1, bool)
            edge[offs] = True
            inner = ~(edge[a[new]] | edge[z[new]])
            odd = special[np.searchsorted(offs, a[new], "right") - 1]
            new = np.concatenate([new[inner], new[~inner & ~odd], new[odd]])
            n, m = int(inner.sum()), len(new) - int(odd.sum())
            parts = [self._joined(data, a[new[:n]], z[new[:n]]), self._alone(data, a[new[n:m]], z[new[n:m]])]
            if m < len(new):
                parts.append(self._alone(data, a[new[m:]], z[new[m:]], True))
            slots[new] = len(self.ptr) - 1 + np.arange(len(new))
            self.flat = np.concatenate([self.flat, *(ids for ids, _ in parts)])
            self.ptr = np.concatenate([self.ptr, self.ptr[-1] + np.cumsum(np.concatenate([sizes for _, sizes in parts]))])
            known = np.concatenate([self.hash, h[new]])
            order = np.argsort(known, kind="stable")
            self.hash, self.check, self.slot = known[order], np.concatenate([self.check, check[new]])[order], np.concatenate([self.slot, slots[new]])[order]
        slot = slots[number]
        size = self.ptr[slot + 1] - self.ptr[slot]
        total = np.append(0, np.cumsum(size))
        # ids of the pieces one after the other, with each text's end id between
        out_ptr = total[np.searchsorted(start, offs)] + np.arange(n_texts + 1)
        body = np.ones(int(out_ptr[-1]), bool)
        body[out_ptr[1:] - 1] = False
        out = np.full(len(body), END, np.uint32)
        out[body] = self.flat[np.repeat(self.ptr[slot] - total[:-1], size) + np.arange(int(total[-1]))]
        return out, out_ptr


@functools.lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a Python worker, which keeps it from task to task."""
    return Encoder(path)


def open_dir(uri: str):
    """(file system, path) of a folder that the cluster shares."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


class SequenceWriter:
    """Packs ids into sequences of one part and writes the two files."""

    def __init__(self, folder: str, length: int, vocabulary: int) -> None:
        self.system, path = open_dir(folder)
        self.system.create_dir(path, recursive=True)
        self.name, self.length = uuid.uuid4().hex, length
        self.kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.system.open_output_stream(f"{path}/{self.name}.ids.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.index_sink = self.system.open_output_stream(f"{path}/{self.name}.docs.arrow")
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])
        self.index = pa.ipc.new_file(self.index_sink, self.index_schema)
        self.rest = np.zeros(0, self.kind)
        self.tokens = self.docs = 0

    def _batches(self, ids: np.ndarray, mask: np.ndarray) -> None:
        lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x), self.length)
        step = self.length * BATCH
        for a in range(0, len(ids), step):
            self.out.write_batch(pa.RecordBatch.from_arrays([lists(ids[a : a + step]), lists(mask[a : a + step])], schema=self.schema))

    def add(self, doc_id: pa.Array, ids: np.ndarray, ptr: np.ndarray) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_id.cast(pa.int64()), pa.array(self.tokens + ptr[:-1]), pa.array(np.diff(ptr))], schema=self.index_schema))
        self.tokens += len(ids)
        self.docs += len(ptr) - 1
        ids = np.concatenate([self.rest, ids.astype(self.kind)])
        whole = len(ids) - len(ids) % (self.length * BATCH)  # all batches but the last are full, so places are computable
        self._batches(ids[:whole], np.ones(whole, bool))
        self.rest = ids[whole:]

    def close(self) -> None:
        pad = -len(self.rest) % self.length
        self._batches(np.append(self.rest, np.zeros(pad, self.kind)), np.append(np.ones(len(self.rest), bool), np.zeros(pad, bool)))
        for x in (self.out, self.sink, self.index, self.index_sink):
            x.close()


class SequenceReader:
    """Random access to the sequences of a part."""

    def __init__(self, folder: str, name: str) -> None:
        system, path = open_dir(folder)
        file = f"{path}/{name}.ids.arrow"
        self.source = pa.memory_map(file) if system.type_name == "local" else system.open_input_file(file)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        docs = f"{path}/{name}.docs.arrow"
        with system.open_input_file(docs) as f:
            self.docs = pa.ipc.open_file(f).read_all()
        self._at, self._batch = -1, None

    def batch(self, k: int) -> pa.RecordBatch:
        if k != self._at:
            self._at, self._batch = k, self.file.get_batch(k)
        return self._batch

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of the k-th sequence, views of the file."""
        b = self.batch(k // BATCH)
        row = k % BATCH
        return b.column(0).values.to_numpy()[row * self.length : (row + 1) * self.length], b.column(1).values.slice(row * self.length, self.length)

    def ids(self, first: int, n: int) -> list[np.ndarray]:
        """The ids [first, first + n) of the part, as views of its batches."""
        step, out = self.length * BATCH, []
        while n:
            k, a = divmod(first, step)
            flat = self.batch(k).column(0).flatten().to_numpy()
            out.append(flat[a : a + n])
            first, n = first + len(out[-1]), n - len(out[-1])
        return out


def write_sequences(docs: DataFrame, tokenizer: str | None = None, length: int = SEQUENCE) -> tuple[str, DataFrame]:
    """Writes the files; returns their folder and the manifest (part, name, n_docs, n_tokens), in order of the parts."""
    spark = docs.sparkSession
    folder = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    path = tokenizer or public_tokenizer()
    order = (F.col("doc_id"), F.xxhash64("text"))
    ranged = as_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = encoder = None
        for batch in batches:
            for part, data, offs in B.text_blocks(batch, "text"):
                if writer is None:
                    encoder = encoder_of(path)
                    writer = SequenceWriter(folder, length, encoder.tokenizer.get_vocab_size())
                writer.add(part.column("doc_id"), *encoder.encode(data, offs))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [writer.name], "n_docs": [writer.docs], "n_tokens": [writer.tokens]})

    return folder, saved(ranged.mapInArrow(write, "part int, name string, n_docs long, n_tokens long"), "manifest")


def read_documents(folder: str, manifest: DataFrame) -> DataFrame:
    """Reads the files: per document doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # one row per file; their number is that of the partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist(), strict=True):
                part = SequenceReader(folder, name)
                for docs in part.docs.to_batches(max_chunksize=10_000):
                    crc = []
                    for first, n in zip(docs.column("first").to_pylist(), docs.column("n").to_pylist(), strict=True):
                        value = 0
                        for piece in part.ids(first, n):
                            value = zlib.crc32(piece.astype("<u4"), value)
                        crc.append(value)
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(docs.column("first").to_numpy() + start), docs.column("n"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return files.select("part", "name", "before").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(docs: DataFrame, tokenizer: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """Writes the token files of docs and reads the documents' rows back from them."""
    return read_documents(*write_sequences(docs, tokenizer, length))
