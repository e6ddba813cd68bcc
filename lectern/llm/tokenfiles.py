"""Token ids in Arrow files of equal-length sequences, written and read back (operator 9).

Documents in ascending id order become one stream of ids, each document closed by an end id. The
table is split by ranges of the id; every range becomes one Arrow IPC file whose batches hold
``rows`` sequences as fixed-size lists (ids, and a mask that is false on the padding of the range's
last sequence), so sequence ``k`` is row ``k % rows`` of batch ``k // rows`` and is read from a memory map without
a copy. A second small Arrow file holds where each document starts. File names carry a random part;
the manifest lists only those of tasks that succeeded, so a task that ran twice does no harm.

Null and empty texts are a lone end id. Rows that share an id are neighbours, by text. A null id
comes first. An empty table gives an empty manifest and an empty result.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from lectern.llm import bpe, frames

# Chunks of these characters need no normalising beyond lower case; all others go to the library whole.
PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]*")
# The splitting rule of the tokenizer file, for lower-case plain characters.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
# Bytes that stand for themselves in byte-level vocabularies; the rest follow from 256 on.
SELF = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))


class WordEncoder:
    """The tokenizer of a file, with what it gives per white-space-separated chunk remembered.

    White space always parts tokens of this kind of tokenizer and vanishes, so a text's ids are
    those of its chunks one after the other. A new chunk is split and mapped to the byte alphabet
    here and merged by the library's model; one with characters outside ``PLAIN`` is left to the
    library as it is.
    """

    def __init__(self, source: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_str(source)
        self.whole.encode_special_tokens = True
        self.bare = Tokenizer.from_str(source)
        self.bare.encode_special_tokens = True
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        model = json.loads(source)["model"]
        suffix = model["end_of_word_suffix"]
        self.size = self.whole.get_vocab_size()
        self.final = np.zeros(self.size, bool)  # ids that end a word
        self.final[[i for word, i in model["vocab"].items() if word.endswith(suffix)]] = True
        others = itertools.count(256)
        self.alphabet = {b: chr(b if b in SELF else next(others)) for b in range(256)}
        self.parts = bpe.MergeCache(self._merge_parts, limit=300_000)
        self.chunks = bpe.MergeCache(self._merge_chunks, limit=500_000)

    def _merge_parts(self, found: list) -> tuple[np.ndarray, np.ndarray]:
        plain = [w.encode().decode("latin-1").translate(self.alphabet) for w in found if isinstance(w, str)]
        joined = [" ".join(plain[i : i + 1000]) for i in range(0, len(plain), 1000)]
        flat = np.array([i for e in self.bare.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], np.uint32)
        ends = np.flatnonzero(self.final[flat]) + 1
        counts = np.diff(ends, prepend=0)
        if len(plain) == len(found):
            return counts, flat
        mine = iter(np.split(flat, ends[:-1]))
        whole = self.whole.encode_batch([w.decode() for w in found if not isinstance(w, str)], add_special_tokens=False)
        other = iter(np.array(e.ids, np.uint32) for e in whole)
        each = [next(mine) if isinstance(w, str) else next(other) for w in found]
        return np.array([len(x) for x in each]), np.concatenate(each)

    def _merge_chunks(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts: list = []
        counts = []
        for chunk in found:
            word = chunk.decode()
            if PLAIN.fullmatch(word):
                own = [word.lower()] if word.isalpha() else PARTS.findall(word.lower())
            else:
                own = [chunk]
            parts += own
            counts.append(len(own))
        flat, sizes = self.parts.encode(parts)
        ahead = np.concatenate([[0], np.cumsum(sizes)])
        return np.diff(ahead[np.concatenate([[0], np.cumsum(counts)])]), flat

    def encode(self, texts: frames.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many ids lie before each text."""
        data, chunks, counts = texts.raw.tobytes(), [], [0]
        for a, b in itertools.pairwise(texts.bounds.tolist()):
            chunks += data[a:b].split()
            counts.append(len(chunks))
        ids, sizes = self.chunks.encode(chunks)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[counts]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(source: str) -> WordEncoder:
    if source not in _ENCODERS:
        _ENCODERS[source] = WordEncoder(source)
    return _ENCODERS[source]


def _place(folder: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    folder = re.sub(r"^file:/+", "/", folder)
    return (fs.LocalFileSystem(use_mmap=True), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


class _ShardWriter:
    """Appends documents' ids to one shard: sequences to one file, document starts to another."""

    def __init__(self, folder: str, shard: int, id_type: pa.DataType, length: int, rows: int, kind: np.dtype, end_id: int):
        self.fs, root = _place(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"part-{shard:06d}-{uuid.uuid4().hex}"
        self.length, self.rows, self.kind, self.end_id = length, rows, kind, end_id
        self.sequences = pa.schema([(c, pa.list_(t, length)) for c, t in (("ids", pa.from_numpy_dtype(kind)), ("mask", pa.bool_()))])
        self.index = pa.schema([("doc", id_type), ("start", pa.int64()), ("n", pa.int64())])
        self.files = [self.fs.open_output_stream(f"{root}/{self.name}.{x}.arrow") for x in ("ids", "docs")]
        self.writers = [pa.ipc.new_file(f, s) for f, s in zip(self.files, (self.sequences, self.index), strict=True)]
        self.waiting: list[np.ndarray] = []
        self.held = self.total = self.documents = 0

    def add(self, docs: pa.Array, ids: np.ndarray, before: np.ndarray) -> None:
        flat = np.insert(ids, before[1:], self.end_id).astype(self.kind)
        n = np.diff(before) + 1
        self.writers[1].write_batch(pa.RecordBatch.from_arrays([docs, pa.array(self.total + np.cumsum(n) - n), pa.array(n)], schema=self.index))
        self.total += len(flat)
        self.documents += len(n)
        self.waiting.append(flat)
        self.held += len(flat)
        if self.held >= self.rows * self.length:
            flat = np.concatenate(self.waiting)
            size = self.rows * self.length
            whole = len(flat) // size * size
            for k in range(0, whole, size):
                self._write(flat[k : k + size], size)
            self.waiting, self.held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, used: int) -> None:
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, np.arange(len(flat)) < used)]
        self.writers[0].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.sequences))

    def close(self) -> None:
        if self.held:
            padded = np.zeros(-(-self.held // self.length) * self.length, self.kind)
            padded[: self.held] = np.concatenate(self.waiting)
            self._write(padded, self.held)
        for x in (*self.writers, *self.files):
            x.close()


def write(df: DataFrame, source: str, folder: str, length: int = 2048, rows: int = 128, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents as Arrow files into ``folder``, with a Parquet manifest.

    ``source`` is the path of a tokenizers file on the driver. ``folder`` must be reachable from
    all executors (a shared mount, or any address that Arrow's file systems know).
    """
    with open(source, encoding="utf-8") as file:
        told = df.sparkSession.sparkContext.broadcast(file.read())
    docs = df.select(id_col, text)
    parted = docs.repartitionByRange(id_col).sortWithinPartitions(id_col, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(told.value)
        kind = np.dtype(np.uint16 if encoder.size <= 1 << 16 else np.uint32)
        shard, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            for part in frames.slices(batch, text):
                if writer is None:
                    writer = _ShardWriter(folder, shard, part.column(id_col).type, length, rows, kind, end_id)
                writer.add(part.column(id_col), *encoder.encode(frames.Texts(part.column(text))))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [writer.name], "n_ids": [writer.total], "n_docs": [writer.documents]})

    parted.mapInArrow(run, "shard long, name string, n_ids long, n_docs long").write.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, id_type: T.DataType, id_col: str = "doc_id") -> DataFrame:
    """Documents read back: id, ``start`` in the whole stream, ``n_tokens`` and ``ids_crc32``."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    # One row per file: the running sum is over the manifest alone.
    before = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")
    shards = manifest.select("shard", "name", before.alias("base")).repartition(max(1, manifest.count()))
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(c, T.LongType(), False) for c in ("start", "n_tokens", "ids_crc32"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                yield from _documents(fs, f"{root}/{row['name']}", row["base"], schema.names)

    return shards.mapInArrow(run, schema)


def _documents(fs, path: str, base: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Checksums of a shard's documents; holds one batch of sequences at a time."""
    with fs.open_input_file(f"{path}.ids.arrow") as file, fs.open_input_file(f"{path}.docs.arrow") as listed:
        sequences, index = pa.ipc.open_file(file), pa.ipc.open_file(listed)
        flat, at, k = np.empty(0, np.uint32), 0, 0  # ids from stream position `at` on; next batch
        for i in range(index.num_record_batches):
            docs = index.get_batch(i)
            sums = []
            for start, n in zip(docs.column("start").to_pylist(), docs.column("n").to_pylist(), strict=True):
                crc, end = 0, start + n
                while True:
                    crc = zlib.crc32(flat[max(start - at, 0) : max(end - at, 0)], crc)
                    if end <= at + len(flat):
                        break
                    start = max(start, at + len(flat))
                    at += len(flat)
                    flat = sequences.get_batch(k).column("ids").flatten().to_numpy().astype("<u4")
                    k += 1
                sums.append(crc)
            starts = pa.array(docs.column("start").to_numpy() + base)
            yield pa.RecordBatch.from_arrays([docs.column("doc"), starts, docs.column("n"), pa.array(sums, pa.int64())], names=names)


def sequence(folder: str, name: str, k: int, rows: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence ``k`` of a shard, as views of the memory-mapped file where it is local."""
    fs, root = _place(folder)
    batch = pa.ipc.open_file(fs.open_input_file(f"{root}/{name}.ids.arrow")).get_batch(k // rows)
    ids, mask = (batch.column(c)[k % rows].values for c in ("ids", "mask"))
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)
