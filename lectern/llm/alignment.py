"""Alignment of two tokenizers by interval coalescing (operator 11).

Both tokenizers read a space and the text. All their tokens are byte intervals: those of A and of B are sorted
together by start (``lexsort``), the running maximum of their ends is taken, and a group begins where a start
reaches that maximum. Inside a group every A token is linked with every B token.

``align`` gives the ids of both sides and how many of each side every group holds; a text that is null or
empty, or whose tokens of either side do not spell the space and the text byte for byte, has none.

``measure`` aligns, counts in how many documents each id pair is linked, and measures every document against these
counts. Nothing is counted row by row across the network: consecutive documents form a
lot, whose distinct pairs are listed once with their documents; only these lists are shuffled and summed, so
a pair that stands in every document sends one row a lot. Counts return to the lots' lists, and a lot's list
meets its documents, which name pairs by their place in it. A lot is about one megabyte of text (a longer text is a
lot of its own); a group's pairs are expanded block by block, never all at once. The table of pairs is at
most as large as the product of both vocabularies; it is never broadcast by a hint.

Texts of any length are taken whole. Repeated rows and ids are documents of their own. There are no ties but
those of best counts, which all count. An empty table gives an empty result. Other columns are kept unless
their name is that of an output, which replaces them.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import bpe, frames

# The printable characters that stand for bytes in a byte-level vocabulary; the bytes left
# over are written as the characters from U+0100 on, in order.
PRINTABLE = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))

# Pairs that are expanded at a time, bytes of text that are read by both sides at a time, and merged pieces kept.
BLOCK = 1 << 18
READ = 1 << 18
CACHED = 200_000


class ByteLevel:
    """Ids of a byte-level tokenizer file for texts with a space before them, and the bytes of every id.

    Where the file's merges are in the order of their ids, as in files made from ranks, pieces are found and
    merged by operator 8's cached encoder; the library reads any other file.
    """

    def __init__(self, data: bytes):
        whole = json.loads(data)
        vocab, merges = whole["model"]["vocab"], whole["model"]["merges"]
        ids = vocab | {t["content"]: t["id"] for t in whole.get("added_tokens", ())}
        hidden = [b for b in range(256) if b not in set(PRINTABLE)]
        back = {chr(b): b for b in PRINTABLE} | {chr(0x100 + i): b for i, b in enumerate(hidden)}
        self.words = [b""] * (max(ids.values()) + 1)
        for word, i in ids.items():
            self.words[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
        self.ranked = self.tokenizer = None
        if all(vocab["".join(m.split(" ") if isinstance(m, str) else m)] == 256 + k for k, m in enumerate(merges)):
            lines = [base64.b64encode(self.words[i]) + b" %d" % i for i in vocab.values() if i < 256 + len(merges)]
            self.ranked = bpe.Vocabulary(b"\n".join(lines))
            self.ranked.cache.limit = CACHED
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(data.decode())
            self.tokenizer.encode_special_tokens = True

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many lie before each text (one entry more)."""
        spaced = [" " + t for t in texts]
        if self.ranked is None:
            return _flat([e.ids for e in self.tokenizer.encode_batch(spaced, add_special_tokens=False)])
        ids, before = self.ranked.encode(frames.Texts(pa.array(spaced, pa.string())))
        return ids.astype(np.int64), before


class Pieces:
    """Ids of a piece model that puts a space before a text itself, and the bytes of every id."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.words = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many lie before each text (one entry more)."""
        return _flat(self.model.encode(texts, num_threads=1))


_MADE: dict[object, tuple] = {}


def _sides(files) -> tuple:
    """Both tokenizers with flat tables of their ids' bytes, made once in each Python worker."""
    key = id(files)
    if key not in _MADE:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        made = []
        for side in (ByteLevel(files[0]), Pieces(files[1])):
            count = np.array([len(w) for w in side.words], np.int64)
            made.append((side, count, np.cumsum(count) - count, np.frombuffer(b"".join(side.words), np.uint8)))
        _MADE[key] = (files, made)
    return _MADE[key][1]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids end to end, and how many lie before each text."""
    before = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=before[1:])
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(before[-1])), before


def _whole(side, ids: np.ndarray, before: np.ndarray, spelled: list[bytes]) -> np.ndarray:
    """Texts whose tokens spell them byte for byte."""
    _, count, start, data = side
    joined = data[frames.ranges(start[ids], count[ids])].tobytes()
    ahead = np.concatenate([np.zeros(1, np.int64), np.cumsum(count[ids])])[before].tolist()
    return np.array([joined[a:b] == s for (a, b), s in zip(itertools.pairwise(ahead), spelled, strict=True)], bool)


def coalesce(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of every A and every B token, given the byte lengths of two token sequences that tile the same bytes."""
    ends = np.concatenate([np.cumsum(a_size), np.cumsum(b_size)])
    starts = ends - np.concatenate([a_size, b_size])
    side = np.repeat(np.array([0, 1], np.int8), [len(a_size), len(b_size)])
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    opens = np.ones(len(order), bool)
    opens[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    return group[: len(a_size)], group[len(a_size) :]


ALIGNED = ("a_ids", "b_ids", "a_in_group", "b_in_group")


def _shared(df: DataFrame, a_file: str, b_file: str):
    files = []
    for path in (a_file, b_file):
        with open(path, "rb") as file:
            files.append(file.read())
    return df.sparkSession.sparkContext.broadcast(tuple(files))


def align(df: DataFrame, a_file: str, b_file: str, text: str = "text", names: tuple[str, str, str, str] = ALIGNED) -> DataFrame:
    """Replace the text by both sides' ids and, group by group, how many ids of each side it holds.

    ``a_file`` is a byte-level tokenizer file, ``b_file`` a piece model; both lie on the driver and are
    broadcast, their size being that of a vocabulary.
    """
    replaced = {n.lower() for n in (text, *names)}
    kept = [f for f in df.schema if f.name.lower() not in replaced]
    schema = T.StructType(kept + [T.StructField(c, T.ArrayType(T.IntegerType(), False), False) for c in names])
    shared = _shared(df, a_file, b_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _sides(shared.value)
        for batch in batches:
            for part in frames.slices(batch, text, READ):
                found = _groups(a, b, part.column(text).to_pylist())
                lists = [frames.list_array(x.astype(np.int32), c, pa.int32()) for x, c in found]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + lists, schema.names)

    return df.select(*(f.name for f in kept), text).mapInArrow(run, schema)


def _groups(a, b, texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """A ids, B ids, and how many of each every group holds, end to end with the count of each text."""
    some = np.array([bool(t) for t in texts], bool)
    read = [t for t in texts if t]
    spelled = [b" " + t.encode() for t in read]
    sides = [side[0].encode(read) for side in (a, b)]
    good = np.logical_and.reduce([_whole(s, *found, spelled) for s, found in zip((a, b), sides, strict=True)]) if read else np.empty(0, bool)
    ids, per_text = [], []
    for flat, before in sides:
        counts = np.diff(before)
        ids.append(flat[np.repeat(good, counts)])
        full = np.zeros(len(texts), np.int64)
        full[np.flatnonzero(some)[good]] = counts[good]
        per_text.append(full)
    groups = coalesce(a[1][ids[0]], b[1][ids[1]])
    n = int(groups[0][-1]) + 1 if len(groups[0]) else 0
    # The group in which every text's first token stands tells how many groups each text has.
    heads = np.concatenate([groups[0], [n]])[np.concatenate([np.zeros(1, np.int64), np.cumsum(per_text[0])])]
    return [*zip(ids, per_text, strict=True), *((np.bincount(g, minlength=n), np.diff(heads)) for g in groups)]


def _lists(part: pa.RecordBatch, names: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Flat values of list columns, and how many lie before each row."""
    out = []
    for c in names:
        column = part.column(c)
        before = np.zeros(len(column) + 1, np.int64)
        np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=before[1:])
        out.append((column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), before))
    return out


def distinct_links(a_ids: np.ndarray, b_ids: np.ndarray, a_n: np.ndarray, b_n: np.ndarray, group_key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``group_key + a * size + b`` over the id pairs linked in groups, ascending, and how often each is.

    Groups are expanded in blocks of at most ``BLOCK`` pairs; a group beyond that is first reduced to
    its distinct ids, and these are paired a few A ids at a time.
    """
    a_at, b_at = np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n
    links = a_n * b_n
    keys, times = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(more: np.ndarray, n: np.ndarray | None) -> None:
        nonlocal keys, times
        if n is None and not len(keys):
            keys, times = np.unique(more, return_counts=True)
            return
        both = np.concatenate([keys, more])
        counts = np.concatenate([times, np.ones(len(more), np.int64) if n is None else n])
        order = np.argsort(both, kind="stable")
        both, counts = both[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.empty(0, np.int64)
        keys, times = both[first], np.add.reduceat(counts, first) if len(first) else counts

    usual = np.flatnonzero(links <= BLOCK)
    upto = np.cumsum(links[usual])
    first = 0
    while first < len(usual):
        done = upto[first - 1] if first else 0
        last = max(int(np.searchsorted(upto, done + BLOCK, "right")), first + 1)
        g = usual[first:last]
        # Each A token of these groups, once for every B token of its group.
        a_token = frames.ranges(a_at[g], a_n[g])
        b_first, n = np.repeat(b_at[g], a_n[g]), np.repeat(b_n[g], a_n[g])
        keys_a = a_ids[a_token] * size + np.repeat(group_key[g], a_n[g])
        add(np.repeat(keys_a, n) + b_ids[frames.ranges(b_first, n)], None)
        first = last
    for g in np.flatnonzero(links > BLOCK).tolist():
        x, nx = np.unique(a_ids[a_at[g] : a_at[g] + a_n[g]], return_counts=True)
        y, ny = np.unique(b_ids[b_at[g] : b_at[g] + b_n[g]], return_counts=True)
        step = max(BLOCK // len(y), 1)
        for k in range(0, len(x), step):
            add((group_key[g] + x[k : k + step, None] * size + y).ravel(), (nx[k : k + step, None] * ny).ravel())
    return keys, times


def groups_text(a_ids: np.ndarray, b_ids: np.ndarray, a_n: np.ndarray, b_n: np.ndarray, per_text: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` for every text: decimal ids of its groups in order (no groups: empty)."""
    if not len(a_ids):
        return [b""] * len(per_text)
    a_place = np.arange(len(a_ids)) + np.repeat(np.cumsum(b_n) - b_n, a_n)
    b_place = np.arange(len(b_ids)) + np.repeat(np.cumsum(a_n), b_n)
    ids = np.empty(len(a_ids) + len(b_ids), np.int64)
    ids[a_place], ids[b_place] = a_ids, b_ids
    mark = np.full(len(ids), ord(","), np.uint8)
    last_b = np.cumsum(a_n + b_n) - 1
    mark[last_b - b_n] = ord("|")
    mark[last_b] = ord(";")
    digits = np.ones(len(ids), np.int64)
    for k in range(1, len(str(int(ids.max())))):
        digits += ids >= 10**k
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]), np.uint8)
    out[ends - 1] = mark
    rest, k = ids, 0
    at = np.arange(len(ids))
    while len(at):
        out[ends[at] - 2 - k] = rest % 10 + ord("0")
        k += 1
        more = digits[at] > k
        at, rest = at[more], rest[more] // 10
    data = out.tobytes()
    stops = np.concatenate([np.zeros(1, np.int64), ends[last_b]])[np.concatenate([np.zeros(1, np.int64), np.cumsum(per_text)])].tolist()
    return [data[x : max(y - 1, x)] for x, y in itertools.pairwise(stops)]


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _lot(part: pa.RecordBatch, found: list, kept: list, lot: int, size: int, target: pa.Schema) -> pa.RecordBatch:
    """Measures of a lot's documents, their pairs as places in the lot's list, and that list on the first row."""
    (a_ids, n_a), (b_ids, n_b), (a_n, n_groups), (b_n, _) = found
    rows = len(n_a)
    span = (int(a_ids.max()) + 1 if len(a_ids) else 1) * size
    row_of_group = np.repeat(np.arange(rows), n_groups)
    keys, times = distinct_links(a_ids, b_ids, a_n, b_n, row_of_group * span, size)
    known, place, documents = np.unique(keys % span, return_inverse=True, return_counts=True)
    counts = np.bincount(keys // span, minlength=rows)
    texts = groups_text(a_ids, b_ids, a_n, b_n, n_groups)
    links = np.concatenate([np.zeros(1, np.int64), np.cumsum(a_n * b_n)])
    ahead = np.concatenate([np.zeros(1, np.int64), np.cumsum(n_groups)])
    values = [n_a, n_b, n_groups, links[ahead[1:]] - links[ahead[:-1]], [hashlib.sha256(t).hexdigest() if t else "" for t in texts], np.full(rows, lot)]
    kinds = target.types[len(kept) :]
    columns = [pa.array(v, k) for v, k in zip(values, kinds, strict=False)]
    columns += [frames.list_array(place.astype(np.int32), counts, pa.int32()), frames.list_array(times, counts, pa.int64())]
    head = [None] * (rows - 1)
    columns += [pa.array([x, *head], pa.list_(pa.int64())) for x in (known, documents)]
    columns = [c.cast(k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + columns, schema=target)


def measure(
    df: DataFrame, a_file: str, b_file: str, b_size: int, text: str = "text", names: tuple[str, ...] = MEASURES, lot: int = frames.SLICE_BYTES
) -> DataFrame:
    """Replace the text by the measures of its alignment against the pair counts of all documents.

    Files as for ``align``; ``b_size`` is the number of ids of side B, ``lot`` the bytes of text in a lot.
    """
    replaced = {n.lower() for n in (text, *names)}
    kept = [f for f in df.schema if f.name.lower() not in replaced]
    own = [frames.spare([f.name for f in kept], f"_{c}") for c in ("n_a", "n_b", "n_groups", "n_links", "groups", "lot", "place", "times", "pairs", "documents")]
    lot_col, place, times, pairs, documents = own[5:]
    longs = T.ArrayType(T.LongType(), False)
    added = [T.LongType()] * 4 + [T.StringType(), T.LongType(), T.ArrayType(T.IntegerType(), False), longs, longs, longs]
    listing = T.StructType(kept + [T.StructField(c, k) for c, k in zip(own, added, strict=True)])
    spark, shared = df.sparkSession, _shared(df, a_file, b_file)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (a, b), target = _sides(shared.value), _arrow(listing)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in frames.slices(batch, text, lot):
                read = [_groups(a, b, few.column(text).to_pylist()) for few in frames.slices(part, text, READ)]
                found = [tuple(map(np.concatenate, zip(*x, strict=True))) for x in zip(*read, strict=True)]
                yield _lot(part, found, kept, number, b_size, target)
                number += 1

    path = f"{frames.shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    df.select(*(f.name for f in kept), text).mapInArrow(aligned, listing).write.parquet(path)
    listed = spark.read.parquet(path)

    heads = listed.where(F.col(pairs).isNotNull()).select(F.col(lot_col).alias("lot"), F.col(pairs).alias("pairs"), F.col(documents).alias("documents"))
    rows = heads.select("lot", F.posexplode(F.arrays_zip("pairs", "documents")).alias("at", "both"))
    rows = rows.select("lot", "at", F.col("both.pairs").alias("pair"), F.col("both.documents").alias("documents"))
    counts = rows.groupBy("pair").agg(F.sum("documents").alias("n"))
    # At most as many rows per A id as side B has ids.
    per_a = Window.partitionBy(F.floor(F.col("pair") / b_size))
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(per_a))
    known = rows.select("lot", "at", "pair").join(counts, "pair").select("lot", "at", "n", "best")

    docs = listed.select(*(F.col(c) for c in [f.name for f in kept] + own[:8]))
    kinds = [T.LongType()] * 6 + [T.StringType()]
    schema = T.StructType(kept + [T.StructField(c, k) for c, k in zip(names, kinds, strict=True)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        at = right.column("at").to_numpy()
        n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy()
        left = left.combine_chunks()
        part = left.to_batches()[0]
        (where, before), (often, _) = _lists(part, (place, times))
        sums = [np.concatenate([np.zeros(1, np.int64), np.cumsum(x)]) for x in (often * best[where], often * n[where])]
        n_best, count_sum = (s[before[1:]] - s[before[:-1]] for s in sums)
        columns = [part.column(f.name) for f in kept] + [part.column(c) for c in own[:4]]
        columns += [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), part.column(own[4])]
        return pa.Table.from_arrays(columns, schema=_arrow(schema))

    return docs.groupBy(lot_col).cogroup(known.groupBy("lot")).applyInArrow(run, schema)
