"""Benchmark decontamination by a generalised suffix automaton (operator 13).

Words are runs of ``[0-9a-z]`` and of code points from U+0080 on, after A-Z are lower-cased. A benchmark
item of n words has windows of ``min(length, ceil(coverage * n))`` consecutive words, one at least. One
suffix automaton over all items knows every run of item words; each of its states that is a window of some
item carries the window's length and the items. Documents stream through it: the automaton keeps the longest
run of item words that ends at each word, and its suffix links give every window that ends there. All words
under a window are hit; the hit words are cut out of the text.

Before the automaton is walked, arrays look up which pairs of neighbouring words stand in any item at all. A
run of words can only match where all its pairs do, so the walk starts afresh at each run of such pairs and
skips runs shorter than the shortest window; results are those of a walk over every word.

The automaton of a benchmark is broadcast. Its size is bounded: a benchmark of more than ``room`` words is
dealt into shards (items by a hash of their id and text, items longer than a quarter of ``room`` as pieces
that overlap by a window less a word), every shard is streamed in turn over all documents, and the hits are
added up. Documents are never shuffled for one shard, and only by row for several.

Null and empty texts have no words, on both sides; an item without words is never met. Rows that share
an id, of documents, are judged one by one; items that share an id count as one, an item with a null id is
met but not listed. A text or item of any length is taken whole. Ties do not occur. An empty benchmark
leaves every document as it is; empty documents give an empty result. Other columns of the documents are
kept unless their name is that of an output, which replaces them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import frames

# Lower case of A-Z, and the bytes that belong to words after it.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SOLID = np.zeros(256, bool)
SOLID[ord("0") : ord("9") + 1] = SOLID[ord("a") : ord("z") + 1] = SOLID[0x80:] = True


def words_of(texts: frames.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, byte start and end of every word, and how many words lie before each text."""
    raw = LOWER[texts.raw]
    return raw, *frames.spans(SOLID[raw], texts.bounds)


class Automaton:
    """Suffix automaton of several word sequences, with the windows that end in its states."""

    def __init__(self, items: list[tuple[str | None, list[bytes], int]]):
        """``items``: id, words, and the window length of the item."""
        self.words: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.long = [-1], [0]
        sequences = []
        for _, words, _ in items:
            sequence = [self.words.setdefault(w, len(self.words)) for w in words]
            last = 0
            for w in sequence:
                last = self._extend(last, w)
            sequences.append(sequence)
        self.shortest = min((w for _, words, w in items if words), default=0)
        # Per state: the window lengths that it stands for, ascending, each with the ids of its items.
        self.marks: dict[int, dict[int, set]] = {}
        for (name, _, width), sequence in zip(items, sequences, strict=True):
            state = size = 0
            for w in sequence:
                state, size = self.step[state][w], size + 1
                if size >= width:
                    at = state
                    while self.long[self.link[at]] >= width:
                        at = self.link[at]
                    self.marks.setdefault(at, {}).setdefault(width, set()).add(name)
                    # Only runs of one window matter from here on.
                    state, size = at, width
        self.marks = {s: dict(sorted(m.items())) for s, m in self.marks.items()}
        # Nearest state on the suffix links, itself excluded, that has a mark.
        self.above = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.long.__getitem__):
            up = self.link[s]
            self.above[s] = up if up in self.marks else self.above[up]
        known = list(self.words)
        hashes = _hashes(known)
        self.known = np.sort(hashes)
        pairs = {(a, b) for seq in sequences for a, b in zip(seq, seq[1:], strict=False)}
        if pairs:
            both = np.array(list(pairs))
            self.pairs = np.sort(_pair(hashes[both[:, 0]], hashes[both[:, 1]]))
        else:
            self.pairs = np.empty(0, np.uint64)

    def _extend(self, last: int, w: int) -> int:
        """The state of the sequence so far with ``w`` appended."""
        step, link, long = self.step, self.link, self.long
        there = step[last].get(w)
        if there is not None:
            return there if long[there] == long[last] + 1 else self._split(last, w, there)
        new = len(link)
        step.append({})
        long.append(long[last] + 1)
        link.append(0)
        while last >= 0 and w not in step[last]:
            step[last][w] = new
            last = link[last]
        if last >= 0:
            there = step[last][w]
            link[new] = there if long[there] == long[last] + 1 else self._split(last, w, there)
        return new

    def _split(self, last: int, w: int, there: int) -> int:
        """Part the runs of ``there`` that are no longer than ``last`` and ``w`` from the longer ones."""
        part = len(self.link)
        self.step.append(dict(self.step[there]))
        self.long.append(self.long[last] + 1)
        self.link.append(self.link[there])
        self.link[there] = part
        while last >= 0 and self.step[last].get(w) == there:
            self.step[last][w] = part
            last = self.link[last]
        return part

    def walk(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Windows (first word, end) met in a run of words, the longest at each end, and the items' ids."""
        state = size = 0
        met, items = [], set()
        step, link, long, marks, above = self.step, self.link, self.long, self.marks, self.above
        for i, word in enumerate(words):
            w = self.words.get(word)
            if w is None:
                state = size = 0
                continue
            while state and w not in step[state]:
                state = link[state]
                size = long[state]
            state = step[state].get(w, 0)
            size = size + 1 if state else 0
            widest, at = 0, state
            while at > 0:
                for width, names in marks.get(at, {}).items():
                    if width <= size:
                        widest = max(widest, width)
                        items |= names
                at = above[at]
            if widest:
                met.append((i + 1 - widest, i + 1))
        return met, items

    def search(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, dict[int, set]]:
        """Which words are hit, and the ids of the items met by each text that meets any."""
        n = len(starts)
        gain = np.zeros(n + 1, np.int64)
        found: dict[int, set] = {}
        if n and self.shortest:
            hashes = frames.word_hashes(raw, starts, ends)
            if self.shortest == 1:
                opens = np.zeros(n + 1, bool)
                opens[before[:-1]] = True  # first word of a text
                good = _among(hashes, self.known)
                first = np.flatnonzero(good & (opens[:n] | ~np.concatenate([[False], good[:-1]])))
                stop = np.flatnonzero(good & (opens[1:] | ~np.concatenate([good[1:], [False]]))) + 1
            else:
                good = np.zeros(n, bool)  # the pair of this word and the next one of its text
                good[:-1] = _among(_pair(hashes[:-1], hashes[1:]), self.pairs)
                edge = before[1:]
                good[edge[edge > 0] - 1] = False
                first, stop = _runs(good)
                stop = stop + 1
            long = stop - first >= self.shortest
            first, stop = first[long], stop[long]
            row = np.searchsorted(before, first, "right") - 1
            data = raw.tobytes()
            for a, b, r in zip(first.tolist(), stop.tolist(), row.tolist(), strict=True):
                met, items = self.walk([data[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)])
                for x, y in met:
                    gain[a + x] += 1
                    gain[a + y] -= 1
                if met:
                    found.setdefault(r, set()).update(items)
        return np.cumsum(gain[:n]) > 0, found


def _hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.empty(0, np.int64)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if words else ends
    return frames.word_hashes(np.frombuffer(b"".join(words), np.uint8), starts, ends)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return frames.mix(a * np.uint64(3) + frames.mix(b))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _runs(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true values."""
    edge = np.diff(np.concatenate([[False], good, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def items_of(benchmark: DataFrame, item_id: str, text: str, length: int, coverage: float, piece: int) -> DataFrame:
    """Rows (name, words, width) of every item that has words; long items as overlapping pieces."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("width", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = frames.Texts(batch.column("text"))
            raw, starts, ends, before = words_of(texts)
            data = raw.tobytes()
            out: dict[str, list] = {c: [] for c in schema.names}
            for name, a, b in zip(batch.column("name").to_pylist(), before[:-1].tolist(), before[1:].tolist(), strict=True):
                if a == b:
                    continue
                width = max(1, min(length, math.ceil(coverage * (b - a))))
                for k in range(a, max(b - width + 1, a + 1), piece):
                    stop = min(k + piece + width - 1, b)
                    found = [data[s:e].decode() for s, e in zip(starts[k:stop].tolist(), ends[k:stop].tolist(), strict=True)]
                    for c, v in zip(schema.names, (name, found, width), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("name", pa.string()), ("words", pa.list_(pa.string())), ("width", pa.int32())]))

    named = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(text).cast("string").alias("text"))
    return named.mapInArrow(run, schema)


OUTPUTS = ("n_words", "n_hit", "items", "spans", "clean")


def _schema(docs: DataFrame, names: tuple[str, ...]) -> T.StructType:
    span = T.StructType([T.StructField("first", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)])
    kinds = [T.LongType(), T.LongType(), T.ArrayType(T.StringType(), False), T.ArrayType(span, False), T.StringType()]
    replaced = {n.lower() for n in names}
    kept = [f for f in docs.schema if f.name.lower() not in replaced]
    return T.StructType(kept + [T.StructField(c, k) for c, k in zip(names, kinds, strict=True)])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _finish(part: pa.RecordBatch, target: pa.Schema, texts: frames.Texts, text: str, found, hit: np.ndarray, items: list) -> pa.RecordBatch:
    """Kept columns and the five outputs, from the hit words and the items met by each row."""
    starts, ends, before = found
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(hit)])
    n_hit = total[before[1:]] - total[before[:-1]]
    clean, spans = part.column(text).to_pylist(), [[] for _ in range(texts.n)]
    for r in np.flatnonzero(n_hit).tolist():
        a, b, base = int(before[r]), int(before[r + 1]), texts.bounds[r]
        own = texts.raw[base : texts.bounds[r + 1]]
        kept = np.ones(len(own), bool)
        for x, y in zip(*(e.tolist() for e in _runs(hit[a:b])), strict=True):
            spans[r].append({"first": x, "end": y})
            kept[starts[a + x] - base : ends[a + y - 1] - base] = False
        clean[r] = own[kept].tobytes().decode()
    values = [np.diff(before), n_hit, items, spans, clean]
    kinds = target.types[-5:]
    columns = [part.column(c) for c in target.names[:-5]]
    return pa.RecordBatch.from_arrays(columns + [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], schema=target)


def scan(docs: DataFrame, automaton, text: str, names: tuple[str, ...]) -> DataFrame:
    """Stream the documents through one broadcast automaton."""
    schema = _schema(docs, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, target = automaton.value, _arrow(schema)
        for batch in batches:
            for part in frames.slices(batch, text):
                texts = frames.Texts(part.column(text))
                raw, *found = words_of(texts)
                hit, met = known.search(raw, *found)
                items = [sorted(x for x in met.get(r, ()) if x is not None) for r in range(texts.n)]
                yield _finish(part, target, texts, text, found, hit, items)

    return docs.mapInArrow(run, schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    length: int = 10,
    coverage: float = 1.0,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    names: tuple[str, str, str, str, str] = OUTPUTS,
    room: int = 200_000,
) -> DataFrame:
    """Add to every document the number of its words, of those hit, the items met, the spans hit and the text without them.

    ``spans`` are ranges of word numbers. ``names`` are the five output columns. A run of item words is
    removed when it has ``length`` words or is ``coverage`` of its item, whichever is less.
    """
    items = items_of(benchmark, item_id, item_text, length, coverage, max(room // 4, length))
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(-(-total // room), 1)
    shard = F.pmod(F.xxhash64("name", "words"), F.lit(shards))
    context = docs.sparkSession.sparkContext

    def automaton(k: int):
        own = items if shards == 1 else items.where(shard == k)
        rows = own.distinct().toLocalIterator()
        return context.broadcast(Automaton([(r["name"], [w.encode() for w in r["words"]], r["width"]) for r in rows]))

    if shards == 1:
        return scan(docs, automaton(0), text, names)
    return _in_turn(docs, automaton, shards, text, names)


def _in_turn(docs: DataFrame, automaton, shards: int, text: str, names: tuple[str, ...]) -> DataFrame:
    """Every shard over all documents; hit words and items of one document are put together."""
    row, met_items, met_spans = (frames.spare(docs.columns, c) for c in ("_row", "_met_items", "_met_spans"))
    marked = frames.checkpoint(docs.withColumn(row, F.monotonically_increasing_id()))
    parts = None
    for k in range(shards):
        met = scan(marked.select(F.col(row).alias("row"), F.col(text).alias("text")), automaton(k), "text", OUTPUTS)
        met = frames.checkpoint(met.where("n_hit > 0").select("row", "items", "spans"))
        parts = met if parts is None else parts.unionByName(met)
    joined = parts.groupBy(F.col("row").alias(row)).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(met_items),
        F.flatten(F.collect_list("spans")).alias(met_spans),
    )
    both = marked.join(joined, row, "left")
    schema = _schema(docs, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = _arrow(schema)
        for batch in batches:
            for part in frames.slices(batch, text):
                texts = frames.Texts(part.column(text))
                _, *found = words_of(texts)
                before = found[2]
                gain = np.zeros(before[-1] + 1, np.int64)
                for a, spans in zip(before[:-1].tolist(), part.column(met_spans).to_pylist(), strict=True):
                    for s in spans or []:
                        gain[a + s["first"]] += 1
                        gain[a + s["end"]] -= 1
                items = [x or [] for x in part.column(met_items).to_pylist()]
                yield _finish(part, target, texts, text, found, np.cumsum(gain[:-1]) > 0, items)

    return both.mapInArrow(run, schema)
