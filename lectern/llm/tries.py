"""Prefix trie of conversations as a burst trie (operator 12).

A turn is its token, a digest of role and text; a conversation is its sequence of tokens, and its first d
tokens are a node of depth d. The node's name is a digest chained over these tokens.

1. All conversations start in one container under the root. A container whose suffixes hold more than ``room``
   turns bursts: its suffixes are dealt by their next token into containers one turn deeper, and the node it
   hung under becomes a trie head. Each round bursts twice as many levels at once as the one before, so a
   conversation of n turns takes log n rounds, and it looks only at conversations still in oversized containers.
2. Every remaining container is one small group: its suffixes are sorted and swept, neighbours sharing a prefix,
   into all of its nodes with their subtrees' sums.
3. Heads are few names that many conversations share, so they are aggregated, never gathered. Sums over a head's
   subtree need no recursion: every node below counts once, at its smallest conversation, and that conversation
   passes through all heads above; so running sums along each conversation, summed again by head, give them.

A list of all conversations that end in a head (copies of one conversation) is sorted by ranges, packed into pieces
range by range, and only the pieces stream through the task that digests them.

One conversation's turns stream through one task in order, as their digests are chained; a row of it is some
tens of bytes by then. Texts of any length are digested whole. A null role or text is empty. Rows without a
conversation id take no part. Turns that tie in order are taken by role, then by token. Repeated rows are turns of
their own. No rows give no nodes. Columns beyond those named are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import frames

SALTS = 32


def with_token(df: DataFrame, role: str = "role", text: str = "text", token: str = "token", words: str = "words") -> DataFrame:
    """Add the token of every turn and the number of words of its text."""
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    whole = F.concat(F.length(by).cast("string"), F.lit(":"), by, said)
    count = F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return df.withColumn(token, F.unhex(F.substring(F.sha2(whole, 256), 1, 32))).withColumn(words, count)


def rebuilt(conversations: DataFrame, head_turns: Column, base: Column) -> DataFrame:
    """Conversations (conv_id, place, token, words) whose first turns are those of another one.

    ``head_turns`` and ``base`` are functions of ``conv_id``: so many first turns of conversation ``base`` come
    before the conversation's own turns after as many. A conversation without any turn left keeps a
    row with a null place.
    """
    turns = with_token(conversations.where("conv_id IS NOT NULL")).select(
        "conv_id", "token", "words", F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.col("token")).alias("order")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("order.turn").asc_nulls_first(), "order.role", "order.token")
    own = turns.withColumn("place", F.row_number().over(order)).drop("order")
    ids = own.where("place = 1").select("conv_id", head_turns.alias("h"), base.alias("base"))
    tails = own.where(F.col("place") > head_turns).select("conv_id", "place", "token", "words")
    lent = own.select(F.col("conv_id").alias("base"), "place", "token", "words")
    heads = ids.where("h > 0").join(lent, "base").where("place <= h").select("conv_id", "place", "token", "words")
    alone = ids.select("conv_id", F.lit(None).cast("int").alias("place"), F.lit(None).cast("binary").alias("token"), F.lit(0).cast("long").alias("words"))
    return tails.unionByName(heads).unionByName(alone)


PATHS = T.StructType(
    [
        T.StructField("conv_id", T.LongType(), False),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("head", T.BinaryType(), False),
        T.StructField("up", T.BinaryType()),
        T.StructField("words", T.LongType(), False),
        T.StructField("below", T.IntegerType(), False),
    ]
)


def paths(turns: DataFrame) -> DataFrame:
    """A row per conversation and depth: the node there, its parent, its text's words, and how many turns follow."""
    by_conv = Window.partitionBy("conv_id")
    counted = turns.repartition("conv_id").withColumn("n", F.count("place").over(by_conv))
    ordered = counted.sortWithinPartitions("conv_id", F.col("place").asc_nulls_first(), "token").select("conv_id", "place", "token", "words", "n")
    target = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("head", pa.binary()), ("up", pa.binary()), ("words", pa.int64()), ("below", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, head = None, 0, b""
        for batch in batches:
            out: list[list] = [[] for _ in target]
            for c, place, token, words, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    conv, depth, head = c, 0, b""
                    for column, v in zip(out, (c, 0, b"", None, 0, n), strict=True):
                        column.append(v)
                if place is not None:
                    up, depth = head, depth + 1
                    head = hashlib.blake2b(up + token, digest_size=16).digest()
                    for column, v in zip(out, (c, depth, head, up, words, n - depth), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, target.types, strict=True)], schema=target)

    return ordered.mapInArrow(run, PATHS)


def containers(path_rows: DataFrame, room: int) -> DataFrame:
    """Per conversation the first depth at which its container holds at most ``room`` turns (``cut``), and that node."""
    deepest = path_rows.agg(F.max("depth")).first()[0]
    closed, low, high = None, 0, 0
    while deepest is not None and low <= deepest:
        rows = path_rows.where(F.col("depth").between(low, high))
        if closed is not None:
            rows = rows.join(closed, "conv_id", "left_anti")
        rows = frames.checkpoint(rows.select("conv_id", "depth", "head", "below"))
        if rows.isEmpty():
            break
        # At each depth no more than turns / room nodes are oversized, so spelling them out per salt is cheap.
        big = rows.groupBy("head").agg(F.sum(F.col("below") + 1).alias("size")).where(F.col("size") > room)
        big = big.select("head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
        small = salted.join(big, ["head", "salt"], "left_anti")
        found = small.groupBy("conv_id").agg(F.min("depth").alias("cut"), F.min_by("head", "depth").alias("container"))
        found = frames.checkpoint(found)
        closed = found if closed is None else closed.unionByName(found)
        low, high = high + 1, max(high * 2 + 1, 1)
    return closed


NODES = T.StructType(
    [
        T.StructField(c, T.LongType())
        for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    ]
    + [T.StructField("ends_sha256", T.StringType()), T.StructField("top", T.BooleanType()), T.StructField("up", T.BinaryType())]
)


class _Open:
    """A node under the sweep."""

    __slots__ = ("head", "up", "depth", "words", "least", "n", "children", "leaves", "saved", "ends", "rows")

    def __init__(self, head, up, depth, words):
        self.head, self.up, self.depth, self.words = head, up, depth, words
        self.least = None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends: list[int] = []
        self.rows: list[list] = []  # finished children, whose parent is not known yet


def sweep(suffixes: list[list[tuple]]) -> list[list]:
    """Nodes of one container: ``suffixes`` are rows (conv_id, depth, head, up, words) of one conversation each."""
    out: list[list] = []
    stack: list[_Open] = []

    def close() -> None:
        node = stack.pop()
        if node.ends:
            node.n += len(node.ends)
            least = min(node.ends)
            node.least = least if node.least is None else min(node.least, least)
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.words
        for row in node.rows:
            row[2] = node.least
        digest = hashlib.sha256(",".join(map(str, sorted(node.ends))).encode()).hexdigest()
        row = [node.least, node.depth, None, node.n, node.children, node.leaves, node.saved, digest, not stack, None if stack else node.up]
        out.append(row)
        if stack:
            above = stack[-1]
            above.rows.append(row)
            above.children += 1
            above.n += node.n
            above.leaves += node.leaves
            above.saved += node.saved
            above.least = node.least if above.least is None else min(above.least, node.least)

    for suffix in sorted(suffixes, key=lambda s: [r[2] for r in s]):
        shared = 0
        while shared < min(len(stack), len(suffix)) and stack[shared].head == suffix[shared][2]:
            shared += 1
        while len(stack) > shared:
            close()
        for _, depth, head, up, words in suffix[shared:]:
            stack.append(_Open(head, up, depth, words))
        stack[-1].ends.append(suffix[-1][0])
    while stack:
        close()
    return out


def swept(rows: DataFrame) -> DataFrame:
    """Nodes of all containers; one container at a time is in memory."""
    ordered = rows.repartition("container").sortWithinPartitions("container", "conv_id", "depth")
    ordered = ordered.select("container", "conv_id", "depth", "head", "up", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(NODES)

        def nodes(done: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done, strict=True), target.types, strict=True)], schema=target)

        container, conv, suffixes, done = None, None, [], []
        for batch in batches:
            for own, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if own != container:
                    if suffixes:
                        done += sweep(suffixes)
                    container, conv, suffixes = own, None, []
                if row[0] != conv:
                    conv = row[0]
                    suffixes.append([])
                suffixes[-1].append(tuple(row))
                if len(done) > 10_000:
                    yield nodes(done)
                    done = []
        if suffixes:
            done += sweep(suffixes)
        if done:
            yield nodes(done)

    return ordered.mapInArrow(run, NODES)


def end_digests(ends: DataFrame, piece: int = 1 << 14) -> DataFrame:
    """SHA-256 of the ascending conversation ids of every head, comma-joined."""
    ordered = ends.select("head", "conv_id").repartitionByRange("head", "conv_id").sortWithinPartitions("head", "conv_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, ids = None, []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([head], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["head", "first", "ids"])

        for batch in batches:
            for h, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if ids and (h != head or len(ids) == piece):
                    yield packed()
                    ids = []
                head = h
                ids.append(c)
        if ids:
            yield packed()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, state = None, None

        def finished() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([head], pa.binary()), pa.array([state.hexdigest()])], ["head", "ends_sha256"])

        for batch in batches:
            for h, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if state is None or h != head:
                    if state is not None:
                        yield finished()
                    head, state = h, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if state is not None:
            yield finished()

    pieces = ordered.mapInArrow(pack, "head binary, first long, ids string")
    return pieces.repartition("head").sortWithinPartitions("head", "first").mapInArrow(digest, "head binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, room: int = 4096) -> DataFrame:
    """Nodes of the trie of conversations given as rows (conv_id, place, token, words).

    A row with a null place is no turn; it only says that the conversation is there.
    """
    spark = turns.sparkSession
    path = f"{frames.shared_folder(spark)}/trie-{uuid.uuid4().hex}"
    paths(turns).write.parquet(path)
    rows = spark.read.schema(PATHS).parquet(path)
    closed = containers(rows, room)
    if closed is None:
        return spark.createDataFrame([], T.StructType(NODES.fields[:-2]))
    placed = rows.join(closed, "conv_id", "left")
    below = frames.checkpoint(swept(placed.where("depth >= cut")))
    above = frames.checkpoint(placed.where("cut IS NULL OR depth < cut").select(*PATHS.names))

    heads = frames.checkpoint(
        above.groupBy("head").agg(
            F.min("conv_id").alias("conv_id"),
            F.first("depth").alias("depth"),
            F.first("up").alias("up"),
            F.first("words").alias("words"),
            F.count("*").alias("n_convs"),
        )
    )
    tops = below.where("top")
    children = heads.select("up").unionByName(tops.select("up")).where("up IS NOT NULL").groupBy(F.col("up").alias("head")).agg(F.count("*").alias("n_children"))
    heads = heads.join(children, "head", "left").fillna(0, ["n_children"])

    # Every node below a head, and every container, counts at its smallest conversation.
    own = heads.select("conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    located = own.unionByName(tops.select("conv_id", "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    located = located.withColumn("head", F.lit(None).cast("binary"))
    along = above.select("conv_id", "depth", F.lit(0).alias("leaves"), F.lit(0).alias("saved"), "head").unionByName(located)
    deeper = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = along.select("head", F.sum("leaves").over(deeper).alias("leaves"), F.sum("saved").over(deeper).alias("saved"))
    sums = summed.where("head IS NOT NULL").groupBy("head").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    digests = end_digests(above.where("below = 0"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    upper = heads.join(sums, "head").join(digests, "head", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))

    # One head may have most of all children: parents are spelled out per salt.
    parents = heads.select(F.col("head").alias("up"), F.col("conv_id").alias("above_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "up"]
    hung = upper.select(*columns).unionByName(tops.select(*columns))
    hung = hung.withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int"))
    hung = hung.join(parents, ["up", "salt"], "left").withColumnRenamed("above_id", "parent_conv_id")
    names = NODES.names[:-2]
    return hung.unionByName(below.where("NOT top"), allowMissingColumns=True).select(*(F.col(c).cast(NODES[c].dataType) for c in names))
