"""Shared steps of the operators: text batches as arrays, runs, digests, reliable checkpoints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the word rules: [\x20\x09-\x0D].
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

# Bytes of text that a task turns into arrays at a time; one longer text is taken alone.
SLICE_BYTES = 1 << 20

# 64-bit words of the filter that `sifted` broadcasts, whatever the input; a power of two.
SIEVE = 1 << 18


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so a lost executor costs nothing.

    The folder is ``spark.checkpoint.dir``; a session without one (a local test) gets a folder
    below its warehouse, which every executor of that session reaches.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"


def sifted(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name``: true for all rows whose columns of the same names are in ``ids``, and for few others.

    A Bloom filter of ``SIEVE`` words, two bits of one word for a row, joined as a broadcast of fixed size. What it
    lets through a join must settle, so only those rows are shuffled: 0.05 % of the others when ``ids`` has 10**5
    rows, 1.6 % at 10**6, half of them at 10**7, which costs no more than that join alone.
    """
    key = F.xxhash64(*ids.columns)
    word, bits = spare(df.columns, "_word"), spare(df.columns, "_bits")
    first, second = (F.shiftrightunsigned(key, k).bitwiseAND(F.lit(63)).cast("int") for k in (0, 6))
    one = F.lit(1).cast("long")
    mask = F.call_function("shiftleft", one, first).bitwiseOR(F.call_function("shiftleft", one, second))
    place = F.shiftrightunsigned(key, 12).bitwiseAND(F.lit(SIEVE - 1))
    held = ids.groupBy(place.alias(word)).agg(F.bit_or(mask).alias(bits))
    let = F.coalesce(F.col(bits).bitwiseAND(mask) == mask, F.lit(False))
    return df.withColumn(word, place).join(F.broadcast(held), word, "left").select(*df.columns, let.alias(name))


def without(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose columns of the same names are in no row of ``ids``; only those that ``sifted`` marks are shuffled."""
    mark = spare(df.columns, "_mark")
    marked = sifted(df, ids, mark)
    rest = marked.where(mark).join(ids, ids.columns, "left_anti").select(*df.columns)
    return marked.where(~F.col(mark)).select(*df.columns).unionByName(rest)


class Texts:
    """UTF-8 texts end to end in one array, with the bounds of each; a null text is empty."""

    def __init__(self, array: pa.Array):
        if pa.types.is_large_string(array.type):
            array = array.cast(pa.string())
        n = len(array)
        if n == 0 or array.buffers()[1] is None:
            bounds = np.zeros(n + 1, np.int64)
        else:
            bounds = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
        data = array.buffers()[2] if n else None
        if data is None or bounds[-1] == bounds[0]:
            self.raw = np.empty(0, np.uint8)
        else:
            self.raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        self.bounds = bounds - bounds[0]
        self.n = n


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch whose texts hold about ``size`` bytes."""
    bounds = Texts(batch.column(text)).bounds
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(bounds, bounds[start] + size, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte position of each."""
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(raw):
        return points, np.arange(len(raw))
    return points, np.flatnonzero((raw & 0xC0) != 0x80)


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word ``[^\\x20\\x09-\\x0D]+``, and how many words lie before each text."""
    return spans(~BLANK[texts.raw], texts.bounds)


def spans(solid: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of true bytes within one text, and how many runs lie before each text."""
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(solid))]
    opens[edges] = solid[edges]
    closes[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, bounds)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_ODD, _INVERSE)):
            grown = np.full(1 << int(n - 1).bit_length(), base, np.uint64)
            grown[0] = 1
            _POWERS[k] = np.multiply.accumulate(grown)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each span: equal spans have equal hashes wherever they stand.

    For short spans only; long ones of a simple shape can collide (``word_hashes`` is for words).
    """
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


# Bytes of a word that are mixed lane by lane; a longer word goes through a cryptographic hash.
LANES = 64


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word: eight bytes at a time go into a non-linear chain that starts at the length.

    Unlike a sum of powers it has no words of a simple shape that collide. Two seeds give two
    independent hashes.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64((seed + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
    lanes = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    at = np.flatnonzero((size > 0) & (size <= LANES))
    done = 0
    while len(at):
        left = (size[at] - done).astype(np.uint64)
        lane = lanes[starts[at] + done]
        short = left < 8
        lane[short] &= (np.uint64(1) << (left[short] * np.uint64(8))) - np.uint64(1)
        out[at] = mix((out[at] ^ mix(lane + _ODD)) * _ODD + np.uint64(done + 1))
        done += 8
        at = at[left > 8]
    for i in np.flatnonzero(size > LANES).tolist():
        key = hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(key, "little")
    return out


def spare(columns: list[str], name: str) -> str:
    """``name``, with underscores appended until no column has it (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def run_hashes(items: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of every run of ``length`` consecutive items (empty if there are fewer), by doubling."""
    if len(items) < length:
        return np.empty(0, np.uint64)
    n = len(items) - length + 1
    have, block, out, done = 1, items, None, 0
    while True:
        if length & have:
            part = block[done : done + n]
            out = mix(part + _ODD) if out is None else mix(out * _ODD + mix(part))
            done += have
        if have * 2 > length:
            return out
        block = mix(block[:-have] * _ODD + mix(block[have:]))
        have *= 2


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` consecutive values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers ``start .. start + count - 1`` of every pair, one after the other."""
    counts = counts.astype(np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
