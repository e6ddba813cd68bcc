"""Exact top-k by inner product: a Voronoi join (operator 5).

Data vectors are grouped under their nearest pivot. A group's summary is its pivot, size and radius;
from it follows an upper bound on the score that a query can reach there: ``q.p + |q| * radius``.
Every query is first solved in the most promising groups that hold enough rows, which gives its k-th
best score so far; then it goes to just those other groups whose bound reaches that score. Groups are
cut into blocks of bounded size (of rows and of queries), so neither a crowd of equal vectors
nor a crowd of queries meets in one task, and each block returns k rows a query at most.

Components become ``floor(scale * x)``; scores are whole numbers, exact up to 2**53. A vector that
is null, holds null or non-finite components, or has another length than most takes no part. Equal
scores: smaller id first. Rows that share an id count as one, that of the least vector in the order of its
packed bytes. Fewer than k others: all of them. An empty table gives an empty result.
Pivots come from a sample of at most ``sample`` rows and change the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import frames

BLOCK = 4096


def whole_numbers(df: DataFrame, scale: int, id_col: str, vector: str) -> DataFrame:
    """(id, values): the usable vectors as packed whole numbers."""
    schema = T.StructType([T.StructField("vec", df.schema[id_col].dataType), T.StructField("values", T.BinaryType()), T.StructField("size", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(vector)
            values = lists.flatten()
            before = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            x = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            good = (bad[before[1:]] == bad[before[:-1]]) & (np.diff(before) > 0) & lists.is_valid().to_numpy(zero_copy_only=False)
            good &= batch.column(id_col).is_valid().to_numpy(zero_copy_only=False)
            x = np.floor(scale * x)
            keep = np.flatnonzero(good)
            packed = [x[before[i] : before[i + 1]].tobytes() for i in keep.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(keep)), pa.array(packed, pa.binary()), pa.array(np.diff(before)[keep], pa.int32())], names=schema.names)

    return df.select(id_col, vector).mapInArrow(run, schema)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def _pivots(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """A few rounds of k-means over the bounded sample."""
    points = np.unique(sample, axis=0)
    centres = points[:: max(1, len(points) // count)][:count].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _solve(work: DataFrame, size: int, k: int) -> DataFrame:
    """Best k rows of each query in each block; queries of a block come before its data."""
    vec = work.schema["vec"].dataType
    schema = T.StructType([T.StructField("query_id", vec), T.StructField("vec_id", vec), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, best = None, None, None

        def result() -> Iterator[pa.RecordBatch]:
            if best is None:
                return
            q, v, s = best
            yield pa.RecordBatch.from_arrays([pa.array(queries[0][q]), pa.array(v), pa.array(s)], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("group", "part", "lot")], 1)
            side = batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if key is None or (keys[a] != key).any():
                    yield from result()
                    key, queries, best = keys[a], None, None
                ids = batch.column("vec").slice(a, b - a).to_numpy()
                matrix = _matrix(batch.column("values").slice(a, b - a), size)
                floor = batch.column("least").slice(a, b - a).to_numpy(zero_copy_only=False)
                if side[a] == 0:
                    new = (ids, matrix, floor)
                    queries = new if queries is None else tuple(np.concatenate(x) for x in zip(queries, new, strict=True))
                elif queries is not None:
                    for c in range(0, len(ids), 1024):
                        best = _better(best, queries, ids[c : c + 1024], matrix[c : c + 1024], k)
        yield from result()

    sorted_ = work.repartition("group", "part", "lot").sortWithinPartitions("group", "part", "lot", "side", "vec")
    return sorted_.mapInArrow(run, schema)


def _better(best, queries, ids: np.ndarray, matrix: np.ndarray, k: int):
    """Merge the k best of some more rows into (query position, id, score), sorted by query."""
    scores = queries[1] @ matrix.T
    good = (scores >= queries[2][:, None]) & (ids[None, :] != queries[0][:, None])
    if scores.shape[1] > 4 * k:  # the k-th best score of a row bounds what can matter
        masked = np.where(good, scores, -np.inf)
        good &= scores >= np.partition(masked, -k, axis=1)[:, -k][:, None]
    q, v = np.nonzero(good)
    rows = (q, ids[v], scores[q, v].astype(np.int64))
    if best is not None:
        rows = tuple(np.concatenate(x) for x in zip(best, rows, strict=True))
    order = np.lexsort((rows[1], -rows[2], rows[0]))
    q, v, s = (x[order] for x in rows)
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], v[keep], s[keep]


def search(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", sample: int = 20_000, probes: int = 3) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score`` of the k best rows for each row whose id meets ``is_query``."""
    spark = df.sparkSession
    usable = whole_numbers(df, scale, id_col, vector)
    sizes = usable.groupBy("size").count().orderBy(F.desc("count"), "size").first()  # lengths, counted
    size, total = (sizes[0], sizes[1]) if sizes else (1, 0)
    usable = usable.where(F.col("size") == size)
    if not df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        usable = usable.groupBy("vec").agg(F.min("values").alias("values"))
    taken = usable.sample(min(1.0, sample / max(total, 1)), seed=5).select("values").limit(2 * sample).collect()
    points = np.frombuffer(b"".join(bytes(r[0]) for r in taken), np.float64).reshape(-1, size) if taken else np.zeros((1, size))
    told = spark.sparkContext.broadcast(_pivots(points, int(np.clip(total**0.5, 1, 1024))))

    grouped_schema = T.StructType([usable.schema["vec"], usable.schema["values"], T.StructField("group", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = told.value
        for batch in batches:
            x = _matrix(batch.column("values"), size)
            away = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T
            near = away.argmin(1)
            far = np.sqrt(((x - pivots[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("values"), pa.array(near, pa.int32()), pa.array(far)], names=grouped_schema.names)

    data = frames.checkpoint(usable.select("vec", "values").mapInArrow(assign, grouped_schema))
    # One row for each pivot, of which there are at most 1024.
    summary = {r[0]: (r[1], r[2]) for r in data.groupBy("group").agg(F.count("*"), F.max("far")).collect()}
    counts = np.array([summary.get(j, (0, 0))[0] for j in range(len(told.value))])
    radius = np.array([summary.get(j, (0, 0))[1] for j in range(len(told.value))])
    bounds = spark.sparkContext.broadcast((counts, radius))
    queries = data.withColumnRenamed("vec", id_col).where(is_query).select(F.col(id_col).alias("vec"), "values")

    sent_schema = T.StructType([usable.schema["vec"], usable.schema["values"], T.StructField("group", T.IntegerType()), T.StructField("least", T.DoubleType())])

    def send(promising: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, (n, r) = told.value, bounds.value
            for batch in batches:
                for c in range(0, batch.num_rows, 1024):
                    part = batch.slice(c, 1024)
                    q = _matrix(part.column("values"), size)
                    top = q @ pivots.T + np.sqrt((q**2).sum(1))[:, None] * r
                    top[:, n == 0] = -np.inf
                    order = np.argsort(-(q @ pivots.T) + np.where(n == 0, np.inf, 0), axis=1, kind="stable")
                    held = np.cumsum(n[order], axis=1)
                    tried = np.zeros(top.shape, bool)  # the first groups that hold enough rows
                    rank = np.arange(len(n))
                    np.put_along_axis(tried, order, (rank < probes) | (held - n[order] <= 2 * k), axis=1)
                    tried &= n > 0
                    if promising:
                        go, least = tried, np.full(len(q), -np.inf)
                    else:
                        least = part.column("least").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                        go = ~tried & (top >= least[:, None] - 1e-6 * (1 + np.abs(least[:, None]))) & (n > 0)
                    row, group = np.nonzero(go)
                    who = part.select(["vec", "values"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*who.columns, pa.array(group, pa.int32()), pa.array(least[row])], names=sent_schema.names)

        return run

    def solved(sent: DataFrame) -> DataFrame:
        """Meet the sent queries with the data of their groups, block by block."""
        asked = {r[0]: r[1] for r in sent.groupBy("group").count().collect()}  # at most one row a pivot
        lots = np.array([-(-asked.get(j, 0) // BLOCK) for j in range(len(counts))])
        parts = np.maximum(1, -(-counts // BLOCK))
        table = spark.createDataFrame([(j, int(parts[j]), int(lots[j])) for j in range(len(counts)) if lots[j]] or [(-1, 1, 1)], "group int, parts int, lots int")
        table = F.broadcast(table)
        left = sent.join(table, "group").select(
            "group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("vec"), "lots").cast("int").alias("lot"), F.lit(0).alias("side"), "vec", "values", "least"
        )
        right = data.join(table, "group").select(
            "group", F.pmod(F.xxhash64("vec"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(1).alias("side"), "vec", "values", F.lit(0.0).alias("least")
        )
        return _solve(left.unionByName(right), size, k)

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = frames.checkpoint(solved(queries.mapInArrow(send(True), sent_schema)))
    ranked = first.withColumn("rank", F.row_number().over(w))
    least = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("vec"), F.col("score").cast("double").alias("least"))
    again = frames.checkpoint(queries.join(least, "vec", "left").mapInArrow(send(False), sent_schema))
    found = first.unionByName(solved(again)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
