"""Near-duplicate groups by a chosen-path set similarity join on minwise tokens (operator 4).

A document's set is its distinct ``words``-word shingles. Documents with equal sets form a class;
the rest works on one row per class. Each class carries ``width`` minwise tokens of its set.

1. Each of ``trees`` trees picks some token positions, one over the similarity in expectation and one at least,
   and puts every class into the node that its own token there names. A node of more than ``BLOCK`` classes
   branches again on positions of its own, ``depth`` times at most; a class whose tokens agree with those of one that
   branches as much as a link's would leaves it to that one, so a crowd of near copies does not multiply. The classes
   of a small node are all compared, those of an oversized one in blocks dealt anew in every node. A comparison at this stage is the share of equal
   tokens; a node hands out a spanning forest of the pairs that may be similar (four standard deviations under the
   threshold and up), so its rows grow with its members, not with their pairs.
2. Connected by these, classes form canopies: two classes that may be similar and met in any tree are in one.
3. The exact way for what the trees miss, be it by chance, by blocks or by token estimates: any two linked sets share one
   of the rarest n - ceil(threshold * n) + 1 shingles of each, in any order common to all; the order is by how often
   shingles of one slot of hashes occur. Classes of different canopies that share such a shingle meet there, once however
   many they share, in blocks that all meet if there are more than ``BLOCK``. Parity sketches, which never rule out a
   link, say which of them may be linked; these canopies become one. Each task hands out no more pairs than connect
   its canopies.
4. Each class brings its full set to its canopy once; sets are made where the texts lie, of ids that a fixed-size
   filter lets through, so no text is shuffled. All pairs of a canopy that parity sketches do not rule out are
   compared exactly, by full sets, unless confirmed links connect them already; the canopy hands out a forest of
   confirmed links. A canopy of more than ``BLOCK`` classes or ``ROOM`` shingles is compared block by block, every block
   with every other.
5. Components of the confirmed links come from large-star/small-star rounds.

Step 1 settles most with few comparisons: one tree joins two classes of similarity s with probability
1 - exp(-s/threshold) or more where nodes are small. No link is lost for what it leaves out: from step 3 on
nothing is estimated, up to equal 64-bit hashes. A crowd of documents just under the threshold costs the square of
its size in comparisons inside tasks; its rows grow by its size over ``BLOCK``.

Null and empty texts have the empty set and are linked with nothing, themselves their component. A text of any
length is taken whole; its set is held by one task. An empty table gives an empty result. Rows
with one id count as one document. Rows with a null id take no part: component null, kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.llm import frames

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
BLOCK = 1024
# Shingles of the sets that one comparison holds.
ROOM = 1 << 21
# Shingles are counted in so many slots of their hashes, dealt out in rows of so many; both powers of two.
SLOTS, SLOT_ROW = 1 << 20, 1 << 12
# 64-bit words of the widest parity sketch, and pairs that a task looks at together.
WIDEST, PAIRS = 1 << 10, 1 << 20
# Sets that a task remembers so as not to hand out their copies; a power of two.
RECENT = 1 << 16


def shingle_sets(texts: frames.Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts end to end, and how many lie before each text."""
    raw = _LOWER[texts.raw]
    starts, ends, before = frames.words(texts)
    hashes = frames.word_hashes(raw, starts, ends)
    runs = frames.run_hashes(hashes, words)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            out.append(frames.run_hashes(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(hashes[:0])
    counts = np.zeros(texts.n + 1, np.int64)
    np.cumsum([len(x) for x in out], out=counts[1:])
    return (np.concatenate(out) if out else hashes[:0]), counts


def _coordinates(seed: int, n: int) -> np.ndarray:
    return frames.mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))


def _chosen(path: np.uint64, width: int, threshold: float) -> np.ndarray:
    """Token positions at which the node of this path branches."""
    draw = frames.mix(_coordinates(7, width) ^ path)
    return np.flatnonzero(draw < np.uint64(int(2**64 / (threshold * width))))


def _roots(trees: int, width: int, threshold: float) -> list[tuple[int, int]]:
    """(tree, position) of all first-level branches; a tree that drew none takes one."""
    out = []
    for tree in range(trees):
        picks = _chosen(frames.mix(np.array([tree + 1], np.uint64))[0], width, threshold)
        out += [(tree, int(i)) for i in picks] or [(tree, tree % width)]
    return out


def sketch(df: DataFrame, words: int, width: int, trees: int, percent: int) -> DataFrame:
    """Per row: set size, 128-bit set digest, first-level nodes, 16 bits of each minwise token, and parity sketch."""
    id_type = df.schema["_doc"]
    schema = T.StructType(
        [id_type, T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())]
        + [T.StructField("nodes", T.ArrayType(T.LongType(), False)), T.StructField("tokens", T.BinaryType())]
        + [T.StructField("bits", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = (_coordinates(1, width) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        shift = (_coordinates(2, width) >> np.uint64(32)).astype(np.uint32)
        roots = _roots(trees, width, percent / 100)
        at = np.array([i for _, i in roots])
        salt = frames.mix(np.array([t * width + i + 1 for t, i in roots], np.uint64))
        for batch in batches:
            for part in frames.slices(batch, "_text"):
                texts = frames.Texts(part.column("_text"))
                items, before = shingle_sets(texts, words)
                n = np.diff(before)
                full = np.flatnonzero(n)
                tokens = np.zeros((texts.n, width), np.uint32)
                digests = np.zeros((2, texts.n), np.uint64)
                bits: list[bytes] = [b""] * texts.n
                if len(full):
                    begin = before[full]
                    digests[0, full] = np.add.reduceat(items, begin)
                    digests[1, full] = np.add.reduceat(frames.mix(items), begin)
                    short = (items >> np.uint64(32)).astype(np.uint32)
                    for i in range(width):
                        tokens[full, i] = np.minimum.reduceat(short * factor[i] + shift[i], begin)
                    size = _sketch_words(n[full], percent)
                    held, ends = _parities(items, np.append(begin, len(items)), size), np.cumsum(size)
                    for row, x, y in zip(full.tolist(), (ends - size).tolist(), ends.tolist(), strict=True):
                        bits[row] = held[x:y].tobytes()
                nodes = frames.mix(tokens[:, at].astype(np.uint64) ^ salt)
                packed = np.ascontiguousarray((tokens * np.uint32(0x9E3779B1) >> np.uint32(16)).astype("<u2"))
                columns = [part.column("_doc"), pa.array(n)]
                columns += [pa.array(frames.mix(d).view(np.int64)) for d in digests]
                columns.append(frames.list_array(nodes.ravel().view(np.int64), np.full(texts.n, len(roots)), pa.int64()))
                columns.append(pa.array([packed[i].tobytes() for i in range(texts.n)], pa.binary()))
                columns.append(pa.array(bits, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def _forest(like: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest of a dense similarity matrix (0: no edge)."""
    m = len(like)
    edges, free = [], np.ones(m, bool)
    best, source = np.zeros(m, like.dtype), np.zeros(m, np.int64)
    for _ in range(m):
        reach = np.where(free, best, 0)
        i = int(reach.argmax())
        if reach[i] == 0:
            i = int(free.argmax())
        else:
            edges.append((int(source[i]), i))
        free[i], best[i] = False, 0
        better = free & (like[i] > best)
        best[better], source[better] = like[i][better], i
    return edges


def _likeness(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, threshold: float) -> np.ndarray:
    """Share of equal tokens of each pair, 0 where it is too low or the set sizes rule the pair out."""
    width = x.shape[1]
    same = np.zeros((len(x), len(y)), np.uint16)
    if len(x) < width:
        for i in range(len(x)):
            same[i] = (y == x[i]).sum(1)
    else:
        across, down = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
        for k in range(width):
            same += across[k][:, None] == down[k]
    like = same / np.float32(width)
    least = threshold - 4 * (threshold * (1 - threshold) / width) ** 0.5
    like[(like < least) | (np.minimum(n_y, n_x[:, None]) < threshold * np.maximum(n_y, n_x[:, None]) - 1e-9)] = 0
    return like


def _tokens(rows: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    tokens = np.frombuffer(b"".join(rows.column("tokens").to_pylist()), "<u2").reshape(rows.num_rows, width)
    return tokens, rows.column("n").to_numpy(zero_copy_only=False)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Rows of whole runs with equal integer keys, and the bounds of the runs in them."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        change = np.zeros(table.num_rows - 1, bool)
        for key in keys:
            change |= np.diff(table.column(key).to_numpy()) != 0
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        if len(cuts) > 1:
            yield table.to_batches()[0].slice(0, cuts[-1]), cuts
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks().to_batches()[0], [0, rest.num_rows]


def _per_group(df: DataFrame, keys: list[str], schema: T.StructType, look: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """What ``look`` makes of each run of rows with equal integer keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for rows, cuts in _runs(batches, keys):
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                out.append(look(rows.slice(x, y - x)))
                if len(out) >= 2000:
                    yield from pa.Table.from_batches([o for o in out if o is not None], empty).combine_chunks().to_batches()
                    out.clear()
        yield from pa.Table.from_batches([o for o in out if o is not None], empty).combine_chunks().to_batches()

    empty = to_arrow_schema(schema)
    return df.mapInArrow(run, schema)


def _leaders(like: np.ndarray, threshold: float) -> np.ndarray:
    """Members none of which is as good as linked to an earlier one, the best connected first; each other member is to one of them."""
    close = like >= threshold
    taken = np.zeros(len(like), bool)
    out = []
    for i in np.argsort(-close.sum(1), kind="stable").tolist():
        if not taken[i]:
            out.append(i)
            taken |= close[i]
            taken[i] = True
    return np.array(out)


def _look(level: DataFrame, classes: DataFrame, sizes: DataFrame, width: int, threshold: float) -> DataFrame:
    """Spanning forests (a < b, no node) of the pairs that may be similar, node by node, oversized nodes in blocks.

    From oversized nodes also the members that branch on, as rows (node, a).
    """
    rep = classes.schema["rep"].dataType
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("a", rep), T.StructField("b", rep)])
    target = to_arrow_schema(schema)

    def look(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        tokens, n = _tokens(rows, width)
        like = _likeness(tokens, tokens, n, n, threshold)
        np.fill_diagonal(like, 0)
        ids, out = rows.column("rep"), []
        if like.any():
            a, b = (np.array(c) for c in zip(*_forest(like), strict=True))
            low, high = (ids.take(pa.array(f(a, b))) for f in (np.minimum, np.maximum))
            out.append(pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), low, high], schema=target))
        if rows.column("size")[0].as_py() > BLOCK:
            lead = pa.array(_leaders(like, threshold))
            out.append(pa.RecordBatch.from_arrays([rows.column("node").take(lead), ids.take(lead), pa.nulls(len(lead), ids.type)], schema=target))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    members = level.join(sizes, "node").join(classes.select("rep", "n", "tokens"), "rep")
    members = members.withColumn("block", F.pmod(F.xxhash64("rep", "node"), F.ceil(F.col("size") / BLOCK)).cast("int"))
    members = members.select("node", "block", "rep", "n", "size", "tokens")
    members = members.repartition("node", "block").sortWithinPartitions("node", "block", "rep")
    return _per_group(members, ["node", "block"], schema, look).distinct()


def _branch(level: DataFrame, classes: DataFrame, width: int, threshold: float) -> DataFrame:
    """Children of nodes, for the members (rep, node) that branch: (rep, node) on positions that each node draws for itself."""
    schema = T.StructType([T.StructField("rep", classes.schema["rep"].dataType), T.StructField("node", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), "<u2").reshape(batch.num_rows, width)
            node = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            draw = frames.mix(_coordinates(7, width)[None, :] ^ node[:, None])
            # One position at least: that of the smallest draw.
            chosen = (draw < np.uint64(int(2**64 / (threshold * width)))) | (draw == draw.min(1)[:, None])
            row, at = np.nonzero(chosen)
            child = frames.mix(frames.mix(node[row] + np.uint64(1) + at.astype(np.uint64)) ^ tokens[row, at].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(row)), pa.array(child.view(np.int64))], names=schema.names)

    rows = level.join(classes.select("rep", "tokens"), "rep").select("rep", "node", "tokens")
    return rows.mapInArrow(run, schema)


def _canopies(classes: DataFrame, width: int, threshold: float, depth: int) -> DataFrame:
    """(rep, canopy) of every class that may be similar to another one."""
    level, edges = classes.select("rep", F.explode(F.array_distinct("nodes")).alias("node")), None
    for left in range(depth, -1, -1):
        sizes = frames.checkpoint(level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"))
        found = frames.checkpoint(_look(level, classes, sizes, width, threshold))
        links = found.where("node IS NULL").select("a", "b")
        edges = links if edges is None else edges.unionByName(links)
        more = found.where("node IS NOT NULL").select(F.col("a").alias("rep"), "node")
        if not left or more.isEmpty():
            break
        level = frames.checkpoint(_branch(more, classes, width, threshold))
    return components(edges).select("rep", F.col("component").alias("canopy"))


def _sketch_words(n: np.ndarray, percent: int) -> np.ndarray:
    """64-bit words of the parity sketch of a set: six bits or more for each shingle by which a linked set may differ."""
    bits = 12 * (100 - percent) / (100 + percent) * np.asarray(n)
    return np.minimum(1 << np.ceil(np.log2(np.maximum(bits / 64, 1))).astype(np.int64), WIDEST)


def _parities(items: np.ndarray, before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Parity sketches end to end: bit k is set if an odd number of a set's shingles falls on k.

    The bits in which two sketches differ are never more than the shingles that only one of the sets holds. A sketch
    whose halves are added bit by bit is that of half the width.
    """
    row = np.repeat(np.arange(len(words)), np.diff(before))
    bits = words[row] * 64
    at = (np.cumsum(words) - words)[row] * 64 + (items & (bits - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(words.sum()) * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8")


def _differing(sketches: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the sketches (end to end, of unlike widths) of each pair differ, at the width of the narrower."""
    begin = np.cumsum(words) - words
    least = np.minimum(words[a], words[b])
    out = np.empty(len(a), np.int64)

    def folded(rows: np.ndarray, width: int) -> np.ndarray:
        bits = np.zeros((len(rows), width), np.uint64)
        for k in range(0, int(words[rows].max()), width):
            some = np.flatnonzero(words[rows] > k)
            bits[some] ^= sketches[(begin[rows[some]] + k)[:, None] + np.arange(width)]
        return bits

    for width in np.unique(least).tolist():
        at = np.flatnonzero(least == width)
        for part in np.array_split(at, -(-len(at) * width // (1 << 22))):
            out[part] = np.bitwise_count(folded(a[part], width) ^ folded(b[part], width)).sum(1)
    return out


def _at_most(apart: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    """The most that sets can be alike of which ``apart`` shingles or more are in one only; 0 if that makes no link."""
    both = n_x + n_y
    apart = np.maximum(apart, np.abs(n_x - n_y))
    return np.where(100 * (both - apart) >= percent * (both + apart), (both - apart) / (both + apart), 0).astype(np.float32)


def _all_at_most(sets: list[np.ndarray], n: np.ndarray, percent: int) -> np.ndarray:
    """``_at_most`` of all pairs of some sets, by sketches of one width that suits nearly all of them."""
    words = int(_sketch_words(np.percentile(n, 90), percent))
    before = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    bits = _parities(np.concatenate(sets), before, np.full(len(sets), words)).reshape(-1, words)
    apart = np.zeros((len(sets), len(sets)), np.int64)
    for column in np.ascontiguousarray(bits.T):
        apart += np.bitwise_count(column[:, None] ^ column)
    return _at_most(apart, n[:, None], n, percent)


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sets: pair by pair, or all by a matrix product if that is less work."""
    out = np.empty(len(a), np.int64)
    if not len(a):
        return out
    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    items = np.concatenate([sets[i] for i in used])
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    by_pair = len(a) * (1e-5 + 3e-8 * (len(items) / len(used)))
    if by_pair > 0.5:
        order = np.argsort(items, kind="stable")
        ordered = items[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        code = np.cumsum(new) - 1
        held = np.bincount(code)
        shared = held[code] > 1  # what only one set holds is in no intersection
        code = (np.cumsum(held > 1) - 1)[code[shared]]
        who = row[order][shared]
        step = 4096
        total = int(code[-1]) + 1 if len(code) else 0
        if -(-total // step) * len(used) ** 2 * step / 1e10 < by_pair:
            grid = np.zeros((len(used), len(used)), np.float32)
            for k in range(0, total, step):
                lo, hi = np.searchsorted(code, [k, k + step])
                part = np.zeros((len(used), step), np.float32)
                part[who[lo:hi], code[lo:hi] - k] = 1
                grid += part @ part.T
            return np.rint(grid[place[: len(a)], place[len(a) :]]).astype(np.int64)
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        merged = np.concatenate([sets[i], sets[j]])
        merged.sort(kind="stable")
        out[k] = (merged[1:] == merged[:-1]).sum()
    return out


class _Union:
    """Which of m members are connected, as an array of labels."""

    def __init__(self, m: int):
        self.label = np.arange(m)
        self.links: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.label[i], self.label[j]
            if x != y:
                self.label[self.label == y] = x
                self.links.append((i, j))


def _confirmed(like: np.ndarray, sets: list[np.ndarray], n: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of exact links among the pairs of a symmetric matrix that may be similar (0: not)."""
    union = _Union(len(n))

    def check(a: np.ndarray, b: np.ndarray) -> None:
        common = _common(sets, a, b)
        holds = 100 * common >= percent * (n[a] + n[b] - common)
        union.add(a[holds], b[holds])

    # The likeliest links first, as they may connect most; then every pair that is still apart.
    for _ in range(2):
        if not like.any():
            return union.links
        a, b = (np.array(c) for c in zip(*_forest(like), strict=True))
        check(a, b)
        like[a, b] = like[b, a] = 0
        like[union.label[:, None] == union.label] = 0
    a, b = np.nonzero(np.triu(like, 1))
    for k in range(0, len(a), 1 << 17):
        x, y = a[k : k + (1 << 17)], b[k : k + (1 << 17)]
        apart = union.label[x] != union.label[y]
        check(x[apart], y[apart])
    return union.links


def _frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """How often shingles of each slot of hashes occur, on a scale of eight steps to the octave."""
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("held", T.BinaryType())])
    target = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in frames.slices(batch, "_text"):
                items, _ = shingle_sets(frames.Texts(part.column("_text")), words)
                counts += np.bincount((items // np.uint64(2**64 // SLOTS)).astype(np.int64), minlength=SLOTS)
        rows = counts.reshape(-1, SLOT_ROW)
        used = np.flatnonzero(rows.any(1))
        narrow = np.min_scalar_type(counts.max()).newbyteorder("<")
        held = [rows[k].astype(narrow).tobytes() for k in used.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(held, pa.binary())], schema=target)

    def add(rows: pa.RecordBatch) -> pa.RecordBatch:
        held = [v.as_buffer() for v in rows.column("held")]
        total = sum(np.frombuffer(x, f"<u{x.size // SLOT_ROW}").astype(np.int64) for x in held)
        step = np.minimum(np.rint(8 * np.log2(1 + total)), 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays([rows.column("part").slice(0, 1), pa.array([step.tobytes()], pa.binary())], schema=target)

    counted = docs.select("_text").mapInArrow(count, schema).repartition("part").sortWithinPartitions("part")
    steps = np.zeros((SLOTS // SLOT_ROW, SLOT_ROW), np.uint8)
    for row in _per_group(counted, ["part"], schema, add).collect():
        steps[row["part"]] = np.frombuffer(row["held"], np.uint8)
    return steps.ravel()


def _rarest(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of every set: the rarest shingles, of which any two linked sets share one; of copies a task hands out few."""
    schema = T.StructType([T.StructField("d1", T.LongType()), T.StructField("rare", T.ArrayType(T.LongType()))])
    frequency = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = frequency.value
        seen = ~np.arange(RECENT)  # by its last bits the set that came last; at first none
        for batch in batches:
            for part in frames.slices(batch, "_text"):
                items, before = shingle_sets(frames.Texts(part.column("_text")), words)
                n = np.diff(before)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                d1 = frames.mix(np.add.reduceat(items, before[full])).view(np.int64)
                d1, at = np.unique(d1, return_index=True)
                new = seen[d1 & (RECENT - 1)] != d1
                seen[d1 & (RECENT - 1)] = d1
                d1, full = d1[new], full[at[new]]
                if not len(full):
                    continue
                n, begin = n[full], before[full]
                step = steps[(items // np.uint64(2**64 // SLOTS)).astype(np.int64)]
                keys = (step.astype(np.uint64) << np.uint64(56)) | (items >> np.uint64(8))
                first = np.minimum(n - -(-percent * n // 100) + 1, n)
                rare = [np.partition(keys[x : x + k], f - 1)[:f] for x, k, f in zip(begin.tolist(), n.tolist(), first.tolist(), strict=True)]
                lists = frames.list_array(np.concatenate(rare).view(np.int64), first, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(d1), lists], names=schema.names)

    return docs.where("_doc IS NOT NULL").select("_text").mapInArrow(run, schema)


def _companies(rarest: DataFrame) -> DataFrame:
    """(d1, node) of the sets that share a rarest shingle with others, each company of such sets once.

    Sets that share one shingle mostly share more. A node is named by the sets that meet in it; should two companies
    have one name, they meet together.
    """
    node = Window.partitionBy("node")
    met = rarest.select("d1", F.explode("rare").alias("node")).repartition("node").dropDuplicates(["node", "d1"])
    met = met.select("d1", F.count("*").over(node).alias("size"), F.bit_xor(F.xxhash64("d1")).over(node).alias("node"))
    return met.where("size > 1").select("d1", "node").distinct()


def _completed(docs: DataFrame, classes: DataFrame, canopies: DataFrame, words: int, percent: int) -> DataFrame:
    """Canopies (rep, canopy) with every link inside one: those of classes that may be linked become one."""
    kind = classes.schema["rep"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    placed = classes.select("rep", "d1").join(canopies, "rep", "left").withColumn("canopy", F.coalesce("canopy", "rep"))

    node = Window.partitionBy("node")
    met = _companies(_rarest(docs, words, percent)).join(placed, "d1").select(
        "rep", "d1", "node", "canopy", F.count("*").over(node).alias("size"), F.min("canopy").over(node).alias("low"), F.max("canopy").over(node).alias("high")
    )
    met = met.where("low <> high").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("d1", "node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "d1", "canopy"
    )
    keys = ["node", "i", "j"]
    met = met.join(classes.select("rep", "d1", "n", "bits"), ["rep", "d1"]).drop("rep").repartition(*keys).sortWithinPartitions(*keys, "d1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _runs(batches, keys):
            names = rows.column("canopy").dictionary_encode()
            own, n = names.indices.to_numpy(), rows.column("n").to_numpy()
            block, once = rows.column("block").to_numpy(), rows.column("i").to_numpy() == rows.column("j").to_numpy()
            held = rows.column("bits").to_pylist()
            sketches, width = np.frombuffer(b"".join(held), "<u8"), np.array([len(x) // 8 for x in held])
            union = _Union(len(names.dictionary))
            # Every row meets the rows after it in its run, a bounded number of pairs at a time.
            after = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(rows.num_rows) - 1
            total, lo = np.concatenate([[0], np.cumsum(after)]), 0
            while lo < rows.num_rows:
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
                a, b = np.repeat(np.arange(lo, hi), after[lo:hi]), frames.ranges(np.arange(lo, hi) + 1, after[lo:hi])
                lo = hi
                apart = (union.label[own[a]] != union.label[own[b]]) & (once[a] | (block[a] != block[b]))
                a, b = a[apart], b[apart]
                like = _at_most(np.zeros(len(a), np.int64), n[a], n[b], percent) > 0
                a, b = a[like], b[like]
                like = _at_most(_differing(sketches, width, a, b), n[a], n[b], percent) > 0
                union.add(own[a[like]], own[b[like]])
            if union.links:
                a, b = (names.dictionary.take(pa.array(c)) for c in zip(*union.links, strict=True))
                yield pa.RecordBatch.from_arrays([a, b], names=schema.names)

    found = frames.checkpoint(met.mapInArrow(run, schema).distinct())
    if found.isEmpty():
        return canopies
    joined = frames.checkpoint(components(found))
    both = canopies.unionByName(joined.select("rep", F.col("rep").alias("canopy"))).distinct()
    both = both.join(joined.withColumnRenamed("rep", "canopy"), "canopy", "left")
    return frames.checkpoint(both.select("rep", F.coalesce("component", "canopy").alias("canopy")))


def _exact(docs: DataFrame, classes: DataFrame, canopies: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) of all canopies, a forest from each comparison."""
    rep = classes.schema["rep"].dataType
    schema = T.StructType([T.StructField("a", rep), T.StructField("b", rep)])
    placed = frames.checkpoint(classes.select("rep", "n", "d1").join(canopies, "rep"))
    sets = _sets(docs, placed, words)
    sizes = placed.groupBy("canopy").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / ROOM)).cast("int").alias("blocks"))
    rows = placed.join(sizes, "canopy").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "canopy", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "d1", "n"
    )
    rows = rows.join(sets, ["rep", "d1"]).drop("d1")

    def look(part: pa.RecordBatch) -> pa.RecordBatch | None:
        n = part.column("n").to_numpy()
        held = [np.frombuffer(v.as_buffer(), np.uint64) for v in part.column("set")]
        block, first = part.column("block").to_numpy(), part.column("i")[0].as_py()
        like = _all_at_most(held, n, percent)
        if part.column("j")[0].as_py() != first:
            side = block == first
            like[side[:, None] == side] = 0
        np.fill_diagonal(like, 0)
        links = _confirmed(like, held, n, percent)
        if not links:
            return None
        a, b = (pa.array(c) for c in zip(*links, strict=True))
        ids = part.column("rep")
        return pa.RecordBatch.from_arrays([ids.take(a), ids.take(b)], names=schema.names)

    keys = ["canopy", "i", "j"]
    return _per_group(rows.repartition(*keys).sortWithinPartitions(*keys, "rep"), keys, schema, look)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Full shingle sets, as sorted 64-bit values, of the wanted classes' first documents and a few others; no text is shuffled."""
    schema = T.StructType([T.StructField("rep", docs.schema["_doc"].dataType), T.StructField("d1", T.LongType()), T.StructField("set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frames.slices(batch, "_text"):
                items, before = shingle_sets(frames.Texts(part.column("_text")), words)
                sums = np.add.reduceat(np.append(items, np.uint64(0)), before[:-1]) if part.num_rows else items
                keep = np.flatnonzero(np.diff(before) > 0)
                data = [items[before[i] : before[i + 1]].tobytes() for i in keep.tolist()]
                columns = [part.column("_doc").take(pa.array(keep)), pa.array(frames.mix(sums).view(np.int64)[keep]), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = frames.sifted(docs, wanted.select(F.col("rep").alias("_doc")), "_wanted").where("_wanted").select("_doc", "_text")
    return rows.mapInArrow(run, schema)


def _tasks(df: DataFrame, rows: int = 20_000) -> int:
    """Tasks for a loop over a checkpointed table of slim rows: as many as its size asks for."""
    return max(1, -(-df.count() // rows))


def components(links: DataFrame) -> DataFrame:
    """(rep, component) of every linked class: large-star and small-star rounds until nothing moves."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = frames.checkpoint(edges), None
    tasks = _tasks(edges)
    edges = edges.coalesce(tasks)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks)
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        lifted = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = lifted.unionByName(lowest.withColumnRenamed("m", "v")).where("u <> v").coalesce(tasks).distinct()
        edges = frames.checkpoint(small.coalesce(tasks))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("rep"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("rep"), F.col("v").alias("component")).distinct())


def groups(
    df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", width: int = 96, trees: int = 12, depth: int = 3
) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable over links) and ``kept``."""
    threshold = percent / 100
    docs = df.select(F.col(id_col).alias("_doc"), F.col(text).alias("_text"))
    rows = frames.checkpoint(sketch(docs, words, width, trees, percent))
    classes = rows.where("_doc IS NOT NULL AND n_shingles > 0").groupBy("d1", "d2")
    classes = frames.checkpoint(
        classes.agg(F.min("_doc").alias("rep"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in ("nodes", "tokens", "bits")))
    )
    canopies = frames.checkpoint(_canopies(classes, width, threshold, depth))
    canopies = _completed(docs, classes, canopies, words, percent)
    links = frames.checkpoint(_exact(docs, classes, canopies, words, percent))
    placed = components(links)
    # The smallest id of a class is its rep, so the least rep of a component is its smallest id. Two
    # classes may share a rep if rows share an id; they are then one document, hence one component.
    member = classes.select("d1", "d2", "rep").join(placed, "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("_doc", "n_shingles", "d1", "d2").join(member, ["d1", "d2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_doc"))
    own = F.when(F.col("_doc").isNotNull(), own)
    return out.select(F.col("_doc").alias(id_col), "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True))
    )
