"""Document fingerprints by winnowing (operator 6).

Hashes of all ``gram``-character runs roll over the text; of every ``window`` consecutive hashes the
smallest is selected, the rightmost if several are, and its position is kept. Two texts that share
``gram + window - 1`` characters in a row share a selected hash. A text with fewer runs than a window
is one window; one shorter than a run is hashed whole. Null and empty texts have no hashes. Equal
texts have equal fingerprints. The likeness of two fingerprints is the Jaccard similarity of their
hashes (1 if both are empty).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import frames

GRAM, WINDOW = 10, 17  # 26 characters in common are always seen
_TOP = np.uint64(0xFFFFFFFF)


def select(points: np.ndarray, bounds: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected hashes of texts end to end, their positions in their text, and how many lie before each."""
    n = np.diff(bounds)
    grams = np.where(n >= gram, n - gram + 1, np.minimum(n, 1))
    at = frames.ranges(bounds[:-1], grams)  # where runs start
    row = np.repeat(np.arange(len(n)), grams)
    ends = np.minimum(at + gram, bounds[row + 1])
    hashes = frames.span_hashes(points, at, ends) >> np.uint64(32)
    first = np.cumsum(grams) - grams
    key = hashes << np.uint64(32) | (_TOP - (at - bounds[row]).astype(np.uint64))  # rightmost wins ties
    picked, owner = [], []
    if len(key) >= window:
        least = frames.window_minima(key, window)
        whole = np.flatnonzero(np.arange(len(least)) + window <= (first + grams)[row[: len(least)]])
        least, own = least[whole], row[whole]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1])
        picked.append(least[new])
        owner.append(own[new])
    short = np.flatnonzero((grams > 0) & (grams < window))
    if len(short):
        edges = np.stack([first[short], first[short] + grams[short]], 1).ravel()
        picked.append(np.minimum.reduceat(np.append(key, _TOP), edges)[::2])
        owner.append(short)
    picked = np.concatenate(picked) if picked else key[:0]
    owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
    order = np.argsort(owner, kind="stable")
    picked, owner = picked[order], owner[order]
    return (picked >> np.uint64(32)).astype(np.uint32), (_TOP - (picked & _TOP)).astype(np.int64), np.searchsorted(owner, np.arange(len(n) + 1))


def _points(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = frames.Texts(array)
    points, at = frames.code_points(texts.raw)
    return points, np.searchsorted(at, texts.bounds)


def fingerprints(df: DataFrame, text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add the selected hashes and their character positions to every row."""
    keep = [c for c in df.columns if c not in ("hashes", "positions")]
    lists = T.ArrayType(T.LongType(), False)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, lists, False) for c in ("hashes", "positions")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frames.slices(batch, text):
                hashes, positions, before = select(*_points(part.column(text)), gram, window)
                columns = [frames.list_array(x.astype(np.int64), np.diff(before), pa.int64()) for x in (hashes, positions)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + columns, names=schema.names)

    return df.select(*keep).mapInArrow(run, schema)


def _sets(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs, sorted, and how many each text has."""
    row = np.repeat(np.arange(len(before) - 1), np.diff(before)).astype(np.uint64)
    pairs = np.unique(row << np.uint64(32) | hashes)
    return pairs, np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=len(before) - 1)


def _likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    both = a[0][np.isin(a[0], b[0], assume_unique=True)]
    common = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(a[1]))
    union = a[1] + b[1] - common
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def with_next(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows by descending id in runs, each run followed by the row that comes next: see ``edited``.

    Ids are cut into many value ranges; each range is a bucket, sorted in one task. The first row of a
    range is also sent, as a copy, to the end of the range before it (the very first row to the
    end of the last), so neighbours always meet and texts are shuffled once.
    """
    spark = df.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).alias("_doc"), F.col(text).alias("_text"))
    known = rows.where("_doc IS NOT NULL").select("_doc")
    cuts = known.agg(F.percentile_approx("_doc", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or []
    told = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(told, ids.to_numpy(), "left").astype(np.int32))

    # At most `buckets` rows.
    heads = dict(known.withColumn("_bucket", bucket("_doc")).groupBy("_bucket").agg(F.max("_doc")).collect())
    order = sorted(heads)
    sent = {heads[b]: above for b, above in zip(order, [*order[1:], order[0]], strict=True)} if order else {}
    target = F.create_map(*[F.lit(x) for pair in sent.items() for x in pair])[F.col("_doc")] if sent else F.lit(None).cast("int")
    placed = rows.where("_doc IS NOT NULL").withColumn("_bucket", bucket("_doc"))
    copies = placed.where(F.col("_doc").isin([int(k) for k in sent])).withColumn("_bucket", target).withColumn("_copy", F.lit(True))
    lone = rows.where("_doc IS NULL").withColumn("_bucket", F.lit(-1)).withColumn("_copy", F.lit(False))
    both = placed.withColumn("_copy", F.lit(False)).unionByName(copies).unionByName(lone)
    return both.repartition("_bucket").sortWithinPartitions("_bucket", "_copy", F.desc("_doc"), "_text")


def edited(df: DataFrame, id_col: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprint each text and its edited form, and compare them and the next document's.

    The edited text has its last half replaced by as many characters of the next document's start.
    Order: descending id, rows with one id by text; after the last comes the first. A row
    with a null id is its own next document.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, id_type), T.StructField("n_chars", T.LongType(), False)]
        + [T.StructField(c, T.StringType(), False) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType(), False) for c in ("near_edited", "near_next")]
    )

    def facts(rows: pa.RecordBatch) -> pa.RecordBatch:
        """For all rows but the last, and those that have no successor in their bucket."""
        points, bounds = _points(rows.column("_text"))
        copy = rows.column("_copy").to_numpy(zero_copy_only=False)
        lone = rows.column("_bucket").to_numpy() == -1
        own = np.flatnonzero(~copy & (lone | (np.arange(rows.num_rows) < rows.num_rows - 1)))
        after = np.where(lone[own], own, own + 1)
        n = np.diff(bounds)
        half = n[own] // 2
        starts = np.stack([bounds[own], bounds[after]], 1).ravel()
        counts = np.stack([n[own] - half, np.minimum(half, n[after])], 1).ravel()
        new = points[frames.ranges(starts, counts)]
        new_bounds = np.concatenate([[0], np.cumsum(counts.reshape(-1, 2).sum(1))]).astype(np.int64)
        hashes, _, before = select(points, bounds, gram, window)
        changed, _, ahead = select(new, new_bounds, gram, window)

        def of(rows_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = np.diff(before)[rows_]
            return _sets(hashes[frames.ranges(before[rows_], size)], np.concatenate([[0], np.cumsum(size)]))

        first = of(own)
        raw = new.astype("<u4").tobytes()
        text_of = [raw[4 * a : 4 * b].decode("utf-32-le").encode() for a, b in itertools.pairwise(new_bounds.tolist())]
        hexed = [x.astype(">u4").tobytes().hex() for x in (hashes, changed)]
        columns = [
            rows.column("_doc").take(pa.array(own)),
            pa.array(n[own]),
            pa.array([hashlib.sha256(x).hexdigest() for x in text_of], pa.string()),
            pa.array([hexed[0][8 * before[i] : 8 * before[i + 1]] for i in own.tolist()], pa.string()),
            pa.array([hexed[1][8 * a : 8 * b] for a, b in itertools.pairwise(ahead.tolist())], pa.string()),
            pa.array(_likeness(first, _sets(changed, ahead))),
            pa.array(_likeness(first, of(after))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: its successor may be in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            rows = table.combine_chunks().to_batches()[0]
            sizes = frames.Texts(rows.column("_text")).bounds
            start = 0
            while start < rows.num_rows - 1:
                stop = int(np.searchsorted(sizes, sizes[start] + frames.SLICE_BYTES, "right")) - 1
                stop = min(max(stop, start + 1), rows.num_rows - 1)
                yield facts(rows.slice(start, stop - start + 1))
                start = stop
            held = rows.slice(rows.num_rows - 1)
        if held is not None and not held.column("_copy")[0].as_py():
            yield facts(held)  # a row with a null id

    return with_next(df, id_col, text).mapInArrow(run, schema)
