"""Best-fit packing of documents into fixed-length sequences by a configuration linear program (operator 7).

Documents become ids with an end id; one longer than the capacity is cut into pieces, the first of
which may be shorter. Only the histogram of piece lengths (at most ``capacity`` entries, whatever the
input) reaches the driver. There the program "fewest patterns that cover all lengths" is solved by
multiplicative weights: each step prices lengths, one knapsack dynamic program gives the best pattern
around every length, and the mixture of those near the best makes the lengths it covers cheaper. The
mean of the mixtures is rounded up while pieces are there, what is left is solved again, and best-fit
packs the last pieces; where best-fit alone needs fewer sequences, fewer of the program's patterns, or none,
are kept. Pieces then look their place up by length and rank; ranks are numbered inside slices of a
length, so a length that holds a third of all rows is spread over many tasks.

A null or empty text is one piece with the end id alone. Rows that share an id are packed
each by itself. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import bpe, frames

# Sequences are dealt to patterns in shares of one in so many.
GRAIN = 4000
PIECES = "piece int, start long, length long, ids_crc32 long"


def cut(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Pieces of every document's ids (byte-level BPE of the rank file, then ``end_id``).

    One row per piece: the id column, ``piece``, ``start`` (ids of the document before it),
    ``length``, ``ids_crc32``, and with ``ids=True`` the ids themselves.
    """
    ranks = df.sparkSession.sparkContext.broadcast(bpe.read_ranks(path))
    schema = T.StructType([df.schema[id_col], *T._parse_datatype_string(PIECES).fields])
    if ids:
        schema.add("ids", T.ArrayType(T.IntegerType(), False), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.vocabulary(ranks.value)
        for batch in batches:
            for part in frames.slices(batch, text):
                found, before = vocab.encode(frames.Texts(part.column(text)))
                sizes = np.diff(before) + 1
                flat = np.insert(found, before[1:], np.uint32(end_id)).astype("<u4")
                counts = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), counts)
                piece = frames.ranges(np.zeros(len(sizes), np.int64), counts)
                first = (sizes - (counts - 1) * capacity)[row]
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                length = np.where(piece == 0, first, capacity)
                at = np.cumsum(length) - length
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [part.column(id_col).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(frames.list_array(flat.astype(np.int32), length, pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(id_col, text).mapInArrow(run, schema)


def _priced(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over all rooms up to the capacity: greatest worth, and the length taken last (-1: none)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        n = fitting[room]
        if n:
            values = best[room - lengths[:n]] + worth[:n]
            k = int(values.argmax())
            if values[k] > best[room] + 1e-12:
                best[room], took[room] = values[k], k
    return best, took


def _patterns(lengths: np.ndarray, worth: np.ndarray, capacity: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """For every length the best pattern that holds it, if its worth is within ``slack`` of the best of all.

    Gives (pattern, position of a length) pairs, one per copy, the lengths whose patterns count, and the best worth.
    One dynamic program prices them all.
    """
    best, took = _priced(lengths, worth, capacity)
    value = worth + best[capacity - lengths]
    lead = np.flatnonzero(value >= (1 - slack) * best[capacity])
    # The next smaller room that something was taken for.
    filled = np.maximum.accumulate(np.where(took >= 0, np.arange(capacity + 1), 0))
    rows, items = [np.arange(len(lead))], [lead]
    room = filled[capacity - lengths[lead]]
    at = np.flatnonzero(room > 0)
    while len(at):
        k = took[room[at]]
        rows.append(at)
        items.append(k)
        room[at] = filled[room[at] - lengths[k]]
        at = at[room[at] > 0]
    return np.concatenate(rows), np.concatenate(items), lead, float(best[capacity])


def solve(histogram: dict[int, int], capacity: int, steps: int = 40, gap: float = 0.01, rate: float = 3.0) -> tuple[dict[tuple[int, ...], float], float]:
    """Fractional solution of the configuration program: patterns with their amounts, and the gap left.

    Each step prices the lengths by multiplicative weights (those whose covering lags gain) and answers with a
    mixture of the patterns within a few percent of the best. The amounts are the mean of the steps' answers, scaled to
    the program's bound from the prices; the gap is the share of all ids that they leave uncovered. Steps go on
    until it is under ``gap``.
    """
    lengths = np.array(sorted(histogram))
    demand = np.array([float(histogram[k]) for k in lengths.tolist()])
    bound = float(lengths @ demand) / capacity
    made = np.zeros(len(lengths))  # copies covered by the answers so far, each of them one `bound` in all
    amounts: dict[tuple[int, ...], float] = {}
    left, t = 1.0, 0
    for t in range(1, steps + 1):
        lag = np.clip(rate * (1 - made / (demand * max(t - 1, 1))), -20, 20) if t > 1 else np.zeros(len(lengths))
        worth = lengths * np.exp(0.05 * lag * np.sqrt(t))
        rows, items, lead, best = _patterns(lengths, worth, capacity, 0.02)
        bound = max(bound, float(worth @ demand) / best)  # any prices bound the program from below
        share = (worth * demand * np.exp(np.clip(lag, -10, 4)))[lead]
        share *= bound / share.sum()
        made += np.bincount(items, share[rows], len(lengths))
        order = np.argsort(rows, kind="stable")
        counts = np.bincount(rows, minlength=len(lead))
        flat = -np.sort(-(rows[order].astype(np.int64) * -(capacity + 1) + lengths[items[order]]))  # longest first within a pattern
        flat += (capacity + 1) * np.repeat(np.arange(len(lead)), counts)
        ends = np.cumsum(counts)
        listed = flat.tolist()
        for a, b, x in zip((ends - counts).tolist(), ends.tolist(), share.tolist(), strict=True):
            key = tuple(listed[a:b])
            amounts[key] = amounts.get(key, 0.0) + x
        left = float(np.maximum(demand - made / t, 0) @ lengths) / float(demand @ lengths)
        if left < gap:
            break
    return {p: x / t for p, x in amounts.items()}, left


def _rounded(left: dict[int, int], capacity: int, full: float, **options) -> list[tuple[list[int], int]]:
    """The program's solution in whole sequences: patterns by their longest piece, rounded up while pieces are there.

    Amounts are rounded up to a ``GRAIN``-th of all sequences, so the number of patterns does not grow with the pieces.
    """
    amounts, _ = solve(left, capacity, **options)
    grain = max(1, sum(k * n for k, n in left.items()) // (capacity * GRAIN))
    rest, out = dict(left), []
    for pattern in sorted(amounts, key=lambda p: (-p[0], -sum(p), -amounts[p], p)):
        if sum(pattern) < full * capacity:
            continue
        need: dict[int, int] = {}
        for k in pattern:
            need[k] = need.get(k, 0) + 1
        times = min(grain * -int(-amounts[pattern] // grain), *(rest[k] // n for k, n in need.items()))
        if times > 0:
            for k, n in need.items():
                rest[k] -= n * times
            out.append((list(pattern), times))
    return out


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over a histogram: sequences with equal content are one pattern with a count."""
    rooms: list[tuple[int, int]] = []  # (room, pattern), sorted
    patterns: list[list[int]] = []
    counts: list[int] = []
    for size in sorted(left, reverse=True):
        n = left[size]
        while n > 0:
            at = bisect.bisect_left(rooms, (size, -1))
            room, old = rooms.pop(at) if at < len(rooms) else (capacity, -1)
            have = counts[old] if old >= 0 else n
            each = min(room // size, n)
            times = min(have, n // each)
            if old >= 0 and times < have:
                counts[old] -= times
                bisect.insort(rooms, (room, old))
            if old < 0 or times < have:
                patterns.append([])
                counts.append(0)
                new = len(patterns) - 1
            else:
                new = old
            patterns[new] = (patterns[old] if old >= 0 else []) + [size] * each
            counts[new] = times
            bisect.insort(rooms, (room - each * size, new))
            n -= each * times
    return [(p, n) for p, n in zip(patterns, counts, strict=True) if n]


def plan(histogram: dict[int, int], capacity: int = 2048, rounds: int = 8, **options) -> list[tuple[list[int], int]]:
    """Patterns (lists of lengths) and how many sequences follow each; together they hold every piece.

    The program is solved and rounded, then again for what rounding leaves, and best-fit by counts packs
    the rest; of the plans after each round, the one with the fewest sequences wins, the one with more of the program if
    several do. The work depends on the capacity, not on the number of pieces.
    """
    return [p for part in settled(histogram, capacity, rounds, **options) for p in part]


def settled(histogram: dict[int, int], capacity: int = 2048, rounds: int = 8, **options) -> tuple[list, list, list]:
    """The plan in parts: whole sequences of one piece, the program's, best-fit's."""
    whole = [([capacity], histogram[capacity])] if histogram.get(capacity) else []
    pieces = {k: n for k, n in histogram.items() if k < capacity and n > 0}
    left = dict(pieces)
    taken: list[tuple[list[int], int]] = []
    rest = _best_fit(left, capacity)
    best, fewest = (taken, rest), sum(n for _, n in rest)
    for turn in range(rounds):
        if not left:
            break
        more = _rounded(left, capacity, 1.0 if turn < rounds - 2 else 0.98, **options)
        if not more:
            continue
        taken = taken + more
        for lengths, times in more:
            for k in lengths:
                left[k] -= times
        left = {k: n for k, n in left.items() if n}
        rest = _best_fit(left, capacity)
        if sum(n for _, n in taken + rest) <= fewest:
            best, fewest = (taken, rest), sum(n for _, n in taken + rest)
    # Patterns rounded last may cost a sequence; without some of them best-fit has more to choose from.
    for share in (0.98, 0.95, 0.9, 0.8, 0.6, 0.4, 0.2):
        kept, rest_of, bound = [], dict(pieces), share * sum(n for _, n in taken)
        for lengths, times in taken:
            n = min(times, int(bound))
            bound -= n
            if n > 0:
                kept.append((lengths, n))
                for k in lengths:
                    rest_of[k] -= n
        rest = _best_fit({k: n for k, n in rest_of.items() if n}, capacity)
        total = sum(n for _, n in kept + rest)
        if total < fewest or total == fewest and sum(n for _, n in kept) > sum(n for _, n in best[0]):
            best, fewest = (kept, rest), total
    return whole, *best


def _places(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of pieces of one length: key (length, first rank), first sequence and offset."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for k in lengths:
            rank = given.get(k, 0)
            rows.append(((k << 40) + rank, sequence - rank, offset))
            given[k] = rank + times
            offset += k
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()


def pack(pieces: DataFrame, capacity: int = 2048, id_col: str = "doc_id", length: str = "length", slice_rows: int = 200_000) -> DataFrame:
    """Give every piece a ``sequence_id`` and its ``offset`` there, in as few sequences as possible."""
    pieces = frames.checkpoint(pieces)
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most `capacity` rows
    slices = max(8, sum(counts.values()) // slice_rows)
    order = [c for c in pieces.columns if not isinstance(pieces.schema[c].dataType, T.ArrayType)]
    dealt = pieces.withColumn("_slice", F.pmod(F.xxhash64(id_col, "piece"), F.lit(slices)).cast("int"))
    sizes = dealt.groupBy(length, "_slice").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(length).orderBy("_slice")
    sizes = sizes.select(length, "_slice", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    w = Window.partitionBy(length, "_slice").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(w) - 1).join(sizes, [length, "_slice"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).select(*pieces.columns, "_rank")
    # Bounded: patterns times their slots, independent of the number of pieces.
    table = pieces.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, offset = table.value
        for batch in batches:
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            key = (batch.column(length).to_numpy(zero_copy_only=False).astype(np.int64) << 40) + rank
            at = np.searchsorted(keys, key, "right") - 1
            columns = [batch.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first[at] + rank), pa.array(offset[at])], schema.names)

    return ranked.mapInArrow(run, schema)
