"""Greedy near-duplicate removal: keep an item unless it is too like one kept before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.functions.text import token_jaccard
from lectern.operators.lineage import cut

THRESHOLD = 0.8
# Slots that token frequencies are counted in (a power of two), items of a shared token compared
# in the first round, and times as many in each round after.
SLOT_BITS = 20
LEADERS, GROWTH = 64, 8
# Words of 64 bits in the sketch that every bucket row carries, and the most of an item's own wide sketch.
NARROW, WIDEST = 8, 256
# Tasks for each core that the table of items is dealt out to, at least.
TASKS_PER_CORE = 2
# Seeds of a group are numbered in so many parts.
SEED_PARTS = 64


def _prefix_size(size, threshold: float):
    """Rarest tokens two sets must overlap in to be more alike than the threshold."""
    hundredths = round(threshold * 100)
    if isinstance(size, Column):
        return (size - F.floor(size * hundredths / 100)).cast("int")
    return size - size * hundredths // 100


def _weights(items: DataFrame) -> np.ndarray:
    """How often tokens of each slot of hashes occur: as many numbers as there are slots."""
    slot = F.shiftrightunsigned(F.col("token"), 64 - SLOT_BITS)
    counted = items.select(F.explode("tokens").alias("token")).groupBy(slot.alias("slot")).count().toArrow()
    weights = np.zeros(1 << SLOT_BITS, np.int64)
    weights[counted["slot"].to_numpy()] = counted["count"].to_numpy()
    return weights


def _sketch(tokens: np.ndarray, row: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Parity sketches end to end: bit k of a row is 1 if an odd number of its tokens falls on k.

    The bits in which two sketches differ are never more than the tokens that only one of the sets holds.
    """
    first = np.cumsum(words) - words
    bits = words[row] * 64
    at = first[row] * 64 + (tokens % bits.astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(words.sum()) * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def with_signature(items: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """Size, rarest tokens and two parity sketches of each item (``grp``, ``pos``, ``seed``, hashed ``tokens``).

    Any fixed order of tokens is right; putting the most frequent last keeps shared tokens rare. Tokens of the prefix
    are written with the rank of their slot before their lower bits, so they sort as numbers; those that no other item can hold are
    counted in ``skip`` and left out.
    """
    low = 64 - SLOT_BITS
    ranks = np.empty(1 << SLOT_BITS, np.uint64)
    ranks[np.argsort(weights, kind="stable")] = np.arange(1 << SLOT_BITS, dtype=np.uint64)
    ranks <<= np.uint64(low)
    # Slots of no or one token come first.
    shared = np.uint64(np.count_nonzero(weights < 2)) << np.uint64(low)
    kept = [items.schema[c] for c in ("grp", "pos", "seed")]
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [*kept, T.StructField("size", T.IntegerType()), T.StructField("skip", T.IntegerType()), T.StructField("prefix", longs)]
        + [T.StructField(f"s{i}", T.LongType()) for i in range(NARROW)]
        + [T.StructField("wide", longs)]
    )
    target = to_arrow_schema(schema)

    def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
        bounds = np.zeros(len(counts) + 1, np.int32)
        np.cumsum(counts, out=bounds[1:])
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("tokens")
            size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            row = np.repeat(np.arange(len(size)), size)
            ranked = ranks[(flat >> np.uint64(low)).astype(np.int64)] | (flat & np.uint64((1 << low) - 1))
            first = _prefix_size(size, threshold)
            prefix, skip, at = [ranked[:0]], np.zeros(len(size), np.int64), 0
            for i, (n, leading) in enumerate(zip(size.tolist(), first.tolist(), strict=True)):
                tokens = np.sort(ranked[at : at + n])[:leading]
                skip[i] = np.searchsorted(tokens, shared)
                prefix.append(tokens[skip[i] :])
                at += n
            words = np.minimum(1 << np.ceil(np.log2(np.maximum(size / 64, 1))).astype(np.int64), WIDEST)
            narrow = _sketch(flat, row, np.full(len(size), NARROW)).reshape(-1, NARROW)
            columns = [batch.column(c.name) for c in kept] + [pa.array(size, pa.int32()), pa.array(skip, pa.int32())]
            columns.append(lists(np.concatenate(prefix).view(np.int64), first - skip))
            columns += [pa.array(np.ascontiguousarray(narrow[:, i])) for i in range(NARROW)]
            columns.append(lists(_sketch(flat, row, words), words))
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return items.select("grp", "pos", "seed", "tokens").mapInArrow(run, schema)


def _dealt(items: DataFrame) -> DataFrame:
    """Materialise items dealt out by key, so that joins by key leave them where they are.

    The checkpoint remembers how its rows are dealt only if the plan behind it is final from the start.
    """
    conf, name = items.sparkSession.conf, "spark.sql.adaptive.enabled"
    # As many tasks as the session shuffles in, or some for each core of a large cluster.
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * items.sparkSession.sparkContext.defaultParallelism)
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(items.repartition(parts, "grp", "pos"))
    finally:
        conf.set(name, before)


def greedy_filter(
    items: DataFrame,
    group: str,
    order: str,
    tokens: str,
    seeds: DataFrame | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Verdict of every item in arrival order: kept, repeat, near or empty.

    An item is dropped when its Jaccard likeness to an item kept before it in its group (or a
    seed) exceeds the threshold; a dropped item blocks nothing. ``order`` is unique in a group.

    Exact copies fall to the first of them in one aggregate. The rest are settled in rounds:
    alike items share one of their rarest tokens, so each round compares every open item with
    the first few open items of its token buckets. An item whose buckets hold no earlier open
    item outside those few is fully informed: it is kept unless an earlier open item is like it.
    Items like a newly kept one leave at once, so a crowd of copies costs one round; the first few
    are ``GROWTH`` times as many every round, so rounds grow with the logarithm of the fullest bucket.

    Tokens are held as 64-bit hashes, one table dealt out by item that no round moves. Rows of a bucket
    carry a sketch that rules out nearly all unlike pairs where they meet, and never an alike one;
    sets are read only for the pairs left, of each item the earliest one first.
    """
    hashed = F.sort_array(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))))
    digest = F.md5(F.to_json(F.sort_array(tokens))).alias("digest")
    place = [F.col(group).alias("grp"), F.col(order).alias("pos")]
    start = items.select(*place, digest, hashed.alias("tokens"), F.lit(False).alias("seed"))
    if seeds is not None:
        # Seeds stand before every item and are never dropped.
        stems = seeds.select(F.col(group).alias("grp"), digest, hashed.alias("tokens")).filter(F.size("tokens") > 0).dropDuplicates(["grp", "digest"])
        stems = stems.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(SEED_PARTS)))
        nth = F.row_number().over(Window.partitionBy("grp", "part").orderBy("digest"))
        start = start.unionByName(
            stems.select("grp", (-nth.cast("bigint") * SEED_PARTS - F.col("part") - 1).alias("pos"), "digest", "tokens", F.lit(True).alias("seed"))
        )
    base = _dealt(start)
    full = base.filter(F.size("tokens") > 0)
    firsts = cut(
        full.filter("grp is not null").groupBy("grp", "digest").agg(
            F.min(F.when(F.col("seed"), F.lit(None)).otherwise(F.col("pos"))).alias("item_pos"),
            F.bool_or("seed").alias("seed"),
            F.min("pos").alias("pos"),
        )
    )
    sets = full.select("grp", "pos", "digest", "tokens")
    # Two keys, as the table is dealt out by these.
    first = firsts.select("grp", "pos", F.col("digest").alias("first"), "seed")
    chosen = sets.join(first, ["grp", "pos"]).filter("digest = first").dropDuplicates(["grp", "pos"])
    signed = _dealt(with_signature(chosen, _weights(full), threshold))
    kept = signed.filter("seed").select("grp", "pos")
    open_items = signed.filter("not seed")
    if seeds is not None:
        leading = _buckets(signed.filter("seed"))
        pairs = cut(_pairs(_buckets(open_items), leading, threshold))
        near = _verified(pairs, signed, sets, threshold).select("grp", "pos").distinct()
        open_items = cut(open_items.join(near, ["grp", "pos"], "left_anti").select("grp", "pos"))
    else:
        open_items = open_items.select("grp", "pos")
    leaders = LEADERS
    while not open_items.isEmpty():
        fresh, open_items = _settle(open_items, signed, sets, threshold, leaders)
        leaders *= GROWTH
        kept = cut(kept.unionByName(fresh))
    verdicts = (
        full.filter("not seed")
        .select("grp", "pos", "digest")
        .join(firsts.select("grp", "digest", "item_pos", F.col("seed").alias("seeded")), ["grp", "digest"])
        .join(kept.withColumn("kept", F.lit(True)), ["grp", "pos"], "left")
        .select(
            "grp",
            "pos",
            F.when(F.col("kept"), "kept")
            .when(F.col("seeded") | (F.col("pos") > F.col("item_pos")), "repeat")
            .otherwise("near")
            .alias("verdict"),
        )
    )
    empty = base.filter((F.size("tokens") == 0) & ~F.col("seed")).select("grp", "pos", F.lit("empty").alias("verdict"))
    return verdicts.unionByName(empty).select(
        F.col("grp").alias(group), F.col("pos").alias(order), "verdict"
    )


def _buckets(items: DataFrame) -> DataFrame:
    """One row per (item, rare token) with the token's place among the item's own, rarest first.

    Group and token are one number, by which rows are sorted as numbers; where two fall together, more pairs are looked at.
    """
    narrow = [f"s{i}" for i in range(NARROW)]
    rows = items.select("grp", "pos", "size", "skip", *narrow, F.posexplode("prefix").alias("nth", "token"))
    return rows.select("grp", "pos", "size", *narrow, (F.col("nth") + F.col("skip")).alias("rank"), F.xxhash64("grp", "token").alias("bucket"))


def _apart(size: Column, other: Column, threshold: float) -> Column:
    """Tokens that only one of two alike sets holds are fewer."""
    return (size + other) * ((1 - threshold) / (1 + threshold)) + 1e-6


def _pairs(buckets: DataFrame, leading: DataFrame, threshold: float) -> DataFrame:
    """Pairs (item, earlier leader) that share a rare token and that size, places and sketches do not rule out.

    The rarest token that two sets share has only more frequent ones behind it in either.
    """
    mine = ["size", "rank", *[f"s{i}" for i in range(NARROW)]]
    mine.append("grp")
    b = leading.select("bucket", F.col("pos").alias("leader"), *[F.col(c).alias(f"leader_{c}") for c in mine])
    small, large = F.least("size", "leader_size"), F.greatest("size", "leader_size")
    fits = small > large * threshold - 1e-9
    reach = F.least(F.col("size") - F.col("rank"), F.col("leader_size") - F.col("leader_rank"))
    placed = reach > (F.col("size") + F.col("leader_size")) * (threshold / (1 + threshold)) - 1e-6
    differ = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"leader_s{i}"))) for i in range(NARROW)), F.lit(0))
    close = differ < _apart(F.col("size"), F.col("leader_size"), threshold)
    # Not as an equality, which would become a key of the join and have the rows dealt out again.
    together = (F.col("grp") >= F.col("leader_grp")) & (F.col("grp") <= F.col("leader_grp"))
    return (
        buckets.join(b, "bucket")
        .filter((F.col("leader") < F.col("pos")) & fits & placed & close & together)
        .select("grp", "pos", "leader")
        .distinct()
    )


def _half(sketch: Column) -> Column:
    """A sketch folded to half its bits."""
    n = (F.size(sketch) / 2).cast("int")
    return F.zip_with(F.slice(sketch, F.lit(1), n), F.slice(sketch, n + 1, n), lambda a, b: a.bitwiseXOR(b))


def _verified(pairs: DataFrame, signed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs above the threshold: wide sketches rule out what they can, sets decide."""
    theirs = signed.select("grp", F.col("pos").alias("leader"), F.col("size").alias("leader_size"), F.col("wide").alias("leader_wide"))
    met = pairs.join(signed.select("grp", "pos", "size", "wide"), ["grp", "pos"]).join(theirs, ["grp", "leader"])
    mine, other = F.col("wide"), F.col("leader_wide")
    n, m = F.size(mine), F.size(other)
    same = F.when(n == m, mine).when(n == m * 2, _half(mine)).when(n * 2 == m, mine)
    also = F.when(n * 2 == m, _half(other)).otherwise(other)
    differ = F.aggregate(F.zip_with(same, also, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, c: t + c)
    small = F.col("size") <= 64 * NARROW  # the bucket's sketch said as much
    close = small | (F.coalesce(differ, F.lit(0)) < _apart(F.col("size"), F.col("leader_size"), threshold))
    left = met.filter(close).select("grp", "pos", "leader")
    lead = sets.select("grp", F.col("pos").alias("leader"), F.col("tokens").alias("leader_tokens"))
    return (
        left.join(sets.select("grp", "pos", "tokens"), ["grp", "pos"])
        .join(lead, ["grp", "leader"])
        .filter(token_jaccard(F.col("tokens"), F.col("leader_tokens")) > threshold)
        .select("grp", "pos", "leader")
    )


def _settle(open_items: DataFrame, signed: DataFrame, sets: DataFrame, threshold: float, leaders: int) -> tuple[DataFrame, DataFrame]:
    """One round: items kept in it, and the items still open after it.

    Whether an item waits for an earlier one is told by its earliest pair if that holds, by all of its pairs if not;
    then only pairs with items newly kept matter.
    """
    item, pair = ["grp", "pos"], ["grp", "pos", "leader"]

    def test(some: DataFrame) -> DataFrame:
        return cut(_verified(some, signed, sets, threshold))

    buckets = _buckets(signed.join(open_items, item, "left_semi"))
    placed = buckets.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("pos")))
    # Both sides are the same rows dealt out once; a limit that Spark knows would have the first few dealt out again.
    few = F.least("place", F.lit(leaders)) == F.col("place")
    pairs = cut(_pairs(placed, placed.filter(few), threshold))
    waiting = placed.filter(F.col("place") > leaders).select(*item).distinct()
    earliest = pairs.groupBy(*item).agg(F.min("leader").alias("leader"))
    held = test(earliest)
    others = pairs.join(held, item, "left_anti").join(earliest, pair, "left_anti")
    edges = held.unionByName(test(others))
    fresh = cut(open_items.join(waiting, item, "left_anti").join(edges, item, "left_anti"))
    new = fresh.select("grp", F.col("pos").alias("leader"))
    beaten = edges.join(new, ["grp", "leader"], "left_semi").select(*item).distinct()
    # Items whose earliest pair holds with one not kept: their later pairs with those newly kept.
    unsure = held.join(beaten, item, "left_anti").select(*item)
    later = pairs.join(unsure, item, "left_semi").join(new, ["grp", "leader"], "left_semi").join(held, pair, "left_anti")
    settled = fresh.unionByName(beaten).unionByName(_verified(later, signed, sets, threshold).select(*item)).distinct()
    return fresh, cut(open_items.join(settled, item, "left_anti"))
