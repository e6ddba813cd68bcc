"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding (operator 8).

Texts become one array of code-point classes. The splitting rule is a small automaton; every class
is a function on its states, and because functions compose associatively, blocks of text are
reduced side by side, their composed functions scanned, and all blocks then walked at once from
known states. No regular expression is run. The slices found go through a cache of merged pieces.

Null and empty texts give no ids. A text of any length is taken whole. Repeated rows and ids give
the same ids again. Other columns are passed through.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm import frames

# Code points of the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# Classes: letter, number, other, apostrophe before one- and two-letter endings, space and other white
# space before a visible character, white space before more of it or the end. +8: first of a text.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, BREAK, GAP = range(8)
# States: what the open piece is. JOIN: a space waiting for what follows; ONE, TWO: letters that an
# ending still takes; DONE: nothing open.
IN_L, IN_N, IN_O, IN_W, JOIN, ONE, TWO, DONE = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this character."""
    if kind == LETTER:
        if state in (ONE, TWO):
            return (DONE if state == ONE else ONE), False
        return IN_L, state not in (IN_L, JOIN)
    if kind == NUMBER:
        return IN_N, state not in (IN_N, JOIN)
    if kind == OTHER or state in (IN_O, JOIN) and kind in (SHORT, LONG):
        return IN_O, state not in (IN_O, JOIN)
    if kind in (SHORT, LONG):
        return (ONE if kind == SHORT else TWO), True
    if kind == GAP:
        return IN_W, state != IN_W
    return (JOIN if kind == SPACE else DONE), True


class _Automaton:
    """Step tables, and the closed set of step functions with its composition table."""

    def __init__(self):
        rows = [[_step(DONE if kind >= 8 else s, kind % 8) for s in range(8)] for kind in range(16)]
        self.next = np.array([[r[0] for r in row] for row in rows], np.uint8)
        self.opens = np.array([[r[1] for r in row] for row in rows], bool)
        kinds = [tuple(int(x) for x in row) for row in self.next]
        known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *kinds]))}
        todo = list(known)
        while todo:
            f = todo.pop()
            for g in list(known):
                for a, b in ((f, g), (g, f)):
                    both = tuple(b[x] for x in a)
                    if both not in known:
                        known[both] = len(known)
                        todo.append(both)
        self.functions = np.array(list(known), np.uint8)
        self.of_kind = np.array([known[k] for k in kinds], np.uint16)
        n = len(known)
        self.then = np.empty((n, n), np.uint16)
        for a, i in known.items():
            for b, j in known.items():
                self.then[i, j] = known[tuple(b[x] for x in a)]
        self.size = n


_TABLES: dict[str, object] = {}


def _automaton() -> _Automaton:
    if "automaton" not in _TABLES:
        _TABLES["automaton"] = _Automaton()
    return _TABLES["automaton"]


def _class_table() -> np.ndarray:
    """Letter, number, other or white space (GAP) of every code point."""
    if "classes" not in _TABLES:
        first = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)).encode(), np.uint8)
        table = np.full(len(first), OTHER, np.uint8)
        table[first == ord("L")] = LETTER
        table[first == ord("N")] = NUMBER
        table[list(WHITE_SPACE)] = GAP
        _TABLES["classes"] = table
    return _TABLES["classes"]


def classes(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Class of every code point, given the positions at which texts start."""
    n = len(points)
    kind = _class_table()[points]
    last = np.zeros(n, bool)  # of its text
    last[firsts[1:] - 1] = True
    last[-1] = True
    seen = np.zeros(n, bool)  # a visible character of the same text follows
    seen[:-1] = (kind[1:] != GAP) & ~last[:-1]
    out = kind.copy()
    out[(kind == GAP) & seen] = BREAK
    out[(points == 0x20) & seen] = SPACE
    at = np.flatnonzero((points == 0x27) & seen)
    if len(at):
        one = points[at + 1]
        two = np.where(last[at + 1], 0, points[np.minimum(at + 2, n - 1)])
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        out[at[np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])]] = LONG
    out[firsts] += 8
    return out


def boundaries(kind: np.ndarray, block: int = 512) -> np.ndarray:
    """Positions at which pieces start, by a scan over composed step functions."""
    auto = _automaton()
    n = len(kind)
    rows = -(-n // block)
    grid = np.full(rows * block, GAP, np.uint8)
    grid[:n] = kind
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)  # a row per step: blocks side by side
    then = auto.then.ravel()
    whole = auto.of_kind[grid[0]].astype(np.intp)
    for j in range(1, block):
        whole = then[whole * auto.size + auto.of_kind[grid[j]]].astype(np.intp)
    before = np.empty(rows, np.uint8)
    state = DONE
    for i, f in enumerate(whole.tolist()):
        before[i] = state
        state = int(auto.functions[f, state])
    step, opens = auto.next.ravel(), auto.opens.ravel()
    found = np.empty((block, rows), bool)
    state = before
    for j in range(block):
        key = (grid[j] << 3) | state
        found[j] = opens[key]
        state = step[key]
    return np.flatnonzero(found.T.ravel()[:n])


def pieces(texts: frames.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte position of every piece, and how many pieces lie before each text."""
    if not len(texts.raw):
        return np.empty(0, np.int64), np.zeros(texts.n + 1, np.int64)
    points, at = frames.code_points(texts.raw)
    full = texts.bounds[:-1][np.diff(texts.bounds) > 0]
    starts = at[boundaries(classes(points, np.searchsorted(at, full)))]
    return starts, np.searchsorted(starts, texts.bounds)


class MergeCache:
    """Ids of the pieces seen so far, in flat arrays; at most ``limit`` pieces are kept."""

    def __init__(self, merge_all, limit: int = 500_000):
        self.merge_all, self.limit = merge_all, limit
        self.index: dict = {}
        self.ids = np.empty(1 << 20, np.uint32)
        self.start = np.empty(1 << 18, np.int64)
        self.count = np.empty(1 << 18, np.int32)
        self.n = self.used = 0

    def _append(self, counts: np.ndarray, flat: np.ndarray) -> None:
        for name, need in (("ids", self.used + len(flat)), ("start", self.n + len(counts)), ("count", self.n + len(counts))):
            have = getattr(self, name)
            if need > len(have):
                grown = np.empty(max(need, len(have) * 3 // 2), have.dtype)
                grown[: len(have)] = have
                setattr(self, name, grown)
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[self.n : self.n + len(counts)] = self.used + np.cumsum(counts) - counts
        self.count[self.n : self.n + len(counts)] = counts
        self.n += len(counts)
        self.used += len(flat)

    def encode(self, found: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the number of ids of each piece."""
        at = np.fromiter(map(self.index.get, found, itertools.repeat(-1)), np.int64, len(found))
        missing = np.flatnonzero(at < 0)
        fresh: dict = {}
        n, used = self.n, self.used
        if len(missing):
            fresh = dict.fromkeys([found[i] for i in missing.tolist()])
            new = list(fresh)
            self._append(*self.merge_all(new))
            fresh = dict(zip(new, range(n, self.n), strict=True))
            at[missing] = np.fromiter((fresh[found[i]] for i in missing.tolist()), np.int64, len(missing))
        counts = self.count[at]
        ids = self.ids[frames.ranges(self.start[at], counts)]
        if fresh:
            if self.n <= self.limit:
                self.index.update(fresh)
            else:
                self.n, self.used = n, used
        return ids, counts


class Vocabulary:
    """Byte-level ranks, the encoder over them and the bytes of every id."""

    def __init__(self, lines: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        # The pattern is never used: pieces are found above and merged one by one.
        self._merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.cache = MergeCache(self._merge_all)
        size = max(ranks.values()) + 1
        self.size = size
        self.count = np.zeros(size, np.int32)
        words = [b""] * size
        for word, rank in ranks.items():
            words[rank] = word
        self.count[:] = [len(w) for w in words]
        self.start = np.cumsum(self.count) - self.count
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def _merge_all(self, found: list) -> tuple[np.ndarray, np.ndarray]:
        merged = list(map(self._merge, found))
        counts = np.fromiter(map(len, merged), np.int32, len(merged))
        return counts, np.fromiter(itertools.chain.from_iterable(merged), np.uint32, int(counts.sum()))

    def encode(self, texts: frames.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many ids lie before each text (one entry more)."""
        starts, before = pieces(texts)
        data = texts.raw.tobytes()
        ends = [*starts[1:].tolist(), len(data)] if len(starts) else []
        ids, counts = self.cache.encode([data[a:b] for a, b in zip(starts.tolist(), ends, strict=True)])
        ahead = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=ahead[1:])
        return ids, ahead[before]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids end to end."""
        return self.bytes[frames.ranges(self.start[ids], self.count[ids])]


def vocabulary(lines: bytes) -> Vocabulary:
    """The vocabulary of a rank file's bytes, made once in each Python worker."""
    if ("ranks", lines) not in _TABLES:
        _TABLES["ranks", lines] = Vocabulary(lines)
    return _TABLES["ranks", lines]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", ends: str = "ends", digest: str = "ids_sha256") -> DataFrame:
    """Replace the text column by its ids, the byte at which each id's bytes end, and a digest of the ids.

    ``path`` is a rank file on the driver (base64 piece, space, rank); it is broadcast, its size
    being that of a vocabulary. The digest is the lowercase hex SHA-256 of the ids as little-endian
    unsigned 32-bit integers. A column that has the name of an output is replaced.
    """
    keep = [c for c in df.columns if c not in (text, ids, ends, digest)]
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    schema = T.StructType(
        [df.schema[c] for c in keep]
        + [T.StructField(c, T.ArrayType(T.IntegerType(), False), False) for c in (ids, ends)]
        + [T.StructField(digest, T.StringType(), False)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks.value)
        for batch in batches:
            for part in frames.slices(batch, text):
                found, before = vocab.encode(frames.Texts(part.column(text)))
                sizes = np.cumsum(vocab.count[found])
                first = np.concatenate([[0], sizes])[before[:-1]]
                own = (sizes - np.repeat(first, np.diff(before))).astype(np.int32)
                columns = [part.column(c) for c in keep]
                columns += [frames.list_array(x.astype(np.int32), np.diff(before), pa.int32()) for x in (found, own)]
                columns.append(pa.array([hashlib.sha256(found[a:b].astype("<u4")).hexdigest() for a, b in itertools.pairwise(before.tolist())]))
                yield pa.RecordBatch.from_arrays(columns, [*keep, ids, ends, digest])

    return df.select(*keep, text).mapInArrow(run, schema)


def list_values(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column without nulls in it, and how many lie before each row; null: empty."""
    counts = np.zeros(len(array) + 1, np.int64)
    np.cumsum(array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=counts[1:])
    return array.flatten().to_numpy(zero_copy_only=False), counts


def decode(df: DataFrame, path: str, ids: str = "ids", ends: str = "ends", data: str = "bytes") -> DataFrame:
    """Add the bytes that the ids stand for (a null list: none), cut at the offsets that encoding kept."""
    keep = [c for c in df.columns if c != data]
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(data, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found, _ = list_values(part.column(ids))
                last, before = list_values(part.column(ends))
                full = np.diff(before) > 0
                sizes = np.zeros(len(full) + 1, np.int64)
                sizes[1:][full] = last[before[1:][full] - 1]
                ahead = np.cumsum(sizes).tolist()
                raw = vocab.decode(found).tobytes()
                column = pa.array([raw[a:b] for a, b in itertools.pairwise(ahead)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [column], [*keep, data])

    return df.mapInArrow(run, schema)
