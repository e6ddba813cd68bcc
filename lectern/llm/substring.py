"""Exact removal of repeated word windows by super-k-mers (operator 1).

A window is ``width`` consecutive words of one document. Its minimiser is the smallest hash among
its runs of ``anchor`` words; consecutive windows with one minimiser form a super-k-mer, a stretch
of text that holds them all.

1. Every super-k-mer gives one small row: minimiser, digest of its words, document, position. Equal
   stretches of several documents are settled on these rows alone: all but the smallest document
   are covered. Rows are aggregated before they are shuffled, and the join back is one whose large
   partitions Spark can split, so a text copied a million times is not one task.
2. Where one minimiser stands in unlike stretches, each distinct stretch travels, once, as a packed
   string to the bucket of its minimiser. Buckets are sorted by minimiser and document; the first
   document in which a window is met is its smallest, and windows are compared as strings.
3. A minimiser with more than ``crowd`` unlike stretches (a very common phrase) is too much for one
   bucket: its windows are dealt by their own 128-bit digests and aggregated instead.

Windows are judged on the input. A word is removed if any window over it also starts in a document
with a smaller id. Null or empty texts and texts shorter than a window lose nothing. Rows with a
null id take no part and keep all words. Rows that share an id do not remove one another.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import frames

_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def _sequence_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of window hashes ``[start, end)``."""
    up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(hashes), _ODD)]))
    down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(hashes), np.uint64(pow(int(_ODD), -1, 1 << 64)))]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(frames.mix(hashes) * up[:-1])])
    return frames.mix((sums[ends] - sums[starts]) * down[starts])


def super_kmers(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    """Rows (minimiser, digest, document, mark, first window, windows)."""
    id_type = docs.schema["_doc"]
    schema = T.StructType(
        [T.StructField("anchor", T.LongType()), T.StructField("digest", T.LongType()), id_type]
        + [T.StructField(c, T.IntegerType()) for c in ("_mark", "first", "n")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frames.slices(batch, "_text"):
                texts = frames.Texts(part.column("_text"))
                starts, ends, before = frames.words(texts)
                if len(starts) < width:
                    continue
                hashes = frames.word_hashes(texts.raw, starts, ends)
                lowest = frames.window_minima(frames.run_hashes(hashes, anchor), width - anchor + 1)
                row = np.repeat(np.arange(texts.n), np.diff(before))[: len(lowest)]
                inside = np.flatnonzero(np.arange(len(lowest)) + width <= before[row + 1])
                if not len(inside):
                    continue
                value, row = lowest[inside], row[inside]
                opens = np.ones(len(inside), bool)
                opens[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(opens)
                n = np.diff(at, append=len(inside))
                first, row = inside[at], row[at]
                digest = _sequence_hashes(frames.run_hashes(hashes, width), first, first + n)
                taken = part.select(["_doc", "_mark"]).take(pa.array(row))
                columns = [pa.array(value[at].view(np.int64)), pa.array(digest.view(np.int64)), taken.column(0), taken.column(1)]
                columns += [pa.array(x, pa.int32()) for x in (first - before[row], n)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.where("_doc IS NOT NULL").mapInArrow(run, schema)


def _stretches(rows: DataFrame, heads: DataFrame, width: int, id_col: str, text: str) -> DataFrame:
    """Packed strings of the listed super-k-mers; for a crowded minimiser, its windows' digests.

    ``rows`` are joined just as ``remove`` joins them in the same plan (an outer join, which a random
    predicate keeps from becoming an inner one), so Spark shuffles the texts once for both.
    """
    lists = heads.groupBy("_doc", "_mark").agg(F.collect_list(F.struct("anchor", "first", "n", "crowded")).alias("_runs"))
    met = rows.join(lists.withColumnRenamed("_doc", id_col), [id_col, "_mark"], "left").where(F.col("_runs").isNotNull() | (F.rand(1) < -1))
    schema = T.StructType(
        [T.StructField("anchor", T.LongType()), heads.schema["_doc"]]
        + [T.StructField(c, T.IntegerType()) for c in ("_mark", "first", "n")]
        + [T.StructField("words", T.StringType())]
        + [T.StructField(c, T.ArrayType(T.LongType(), False)) for c in ("high", "low")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frames.slices(batch, text):
                texts = frames.Texts(part.column(text))
                starts, ends, before = frames.words(texts)
                data = texts.raw.tobytes()
                out: dict[str, list] = {c: [] for c in schema.names}
                ids = zip(part.column(id_col).to_pylist(), part.column("_mark").to_pylist(), part.column("_runs").to_pylist(), strict=True)
                for i, (doc, mark, runs) in enumerate(ids):
                    at = before[i]
                    both = None
                    for r in runs:
                        a, n = at + r["first"], r["n"]
                        packed, high, low = None, None, None
                        if r["crowded"]:
                            if both is None:
                                span = starts[at : before[i + 1]], ends[at : before[i + 1]]
                                both = [frames.run_hashes(frames.word_hashes(texts.raw, *span, seed), width).view(np.int64) for seed in (0, 1)]
                            high, low = (x[r["first"] : r["first"] + n] for x in both)
                        else:
                            packed = b" ".join([data[s:e] for s, e in zip(starts[a : a + n + width - 1].tolist(), ends[a : a + n + width - 1].tolist(), strict=True)]).decode()
                        for c, v in zip(schema.names, (r["anchor"], doc, mark, r["first"], n, packed, high, low), strict=True):
                            out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=_arrow(schema))

    return met.mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


COVERS = ("_doc", "_mark", "first", "n")


def _in_buckets(stretches: DataFrame, width: int) -> DataFrame:
    """Windows of each stretch that a smaller document has too, bucket by bucket."""
    schema = T.StructType([stretches.schema[c] for c in COVERS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, seen = None, {}  # window -> smallest document; of one minimiser at a time
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, doc, mark, first, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", "_doc", "_mark", "first", "words")), strict=True):
                if key != anchor:
                    anchor, seen = key, {}
                ends = [i for i, c in enumerate(words) if c == " "]
                starts = [0, *(i + 1 for i in ends)]
                ends.append(len(words))
                hit = [seen.setdefault(words[a:b], doc) < doc for a, b in zip(starts, ends[width - 1 :], strict=False)]
                k = 0
                for covered, same in itertools.groupby(hit):
                    n = len(list(same))
                    if covered:
                        for c, v in zip(out, (doc, mark, first + k, n), strict=True):
                            c.append(v)
                    k += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _arrow(schema), strict=True)], names=schema.names)

    packed = stretches.where("words IS NOT NULL").select("anchor", "_doc", "_mark", "first", "words")
    return packed.repartition("anchor").sortWithinPartitions("anchor", "_doc").mapInArrow(run, schema)


def _in_crowds(stretches: DataFrame) -> DataFrame:
    """The same for crowded minimisers, on digests of single windows."""
    windows = stretches.where("high IS NOT NULL").select("_doc", "_mark", "first", F.posexplode(F.arrays_zip("high", "low")).alias("_k", "_w"))
    windows = windows.select("_doc", "_mark", (F.col("first") + F.col("_k")).alias("first"), "_w.high", "_w.low")
    smallest = windows.groupBy("high", "low").agg(F.min("_doc").alias("_least"))
    return windows.join(smallest, ["high", "low"]).where("_doc > _least").select("_doc", "_mark", "first", F.lit(1).alias("n"))


def _repeats(rows: DataFrame, width: int, anchor: int, crowd: int, id_col: str, text: str) -> DataFrame:
    """Covered windows of every document as rows (document, mark, first window, windows)."""
    runs = super_kmers(rows.select(F.col(id_col).alias("_doc"), "_mark", F.col(text).alias("_text")), width, anchor)
    strings = runs.groupBy("anchor", "digest").agg(F.min("_doc").alias("least"), F.max("_doc").alias("most"))
    anchors = strings.groupBy("anchor").agg(F.count("*").alias("strings"), F.min("least").alias("lo"), F.max("least").alias("hi"))
    anchors = anchors.where("lo < hi").select("anchor", (F.col("strings") > crowd).alias("crowded"))
    strings = strings.join(anchors, "anchor", "left").where("least < most OR crowded IS NOT NULL")
    met = runs.join(strings.select("anchor", "digest", "least", "crowded"), ["anchor", "digest"])
    met = frames.checkpoint(met.where("_doc > least OR crowded IS NOT NULL"))
    heads = met.where("_doc = least").select("anchor", *COVERS, "crowded")
    covers = met.where("_doc > least").select(*COVERS)
    covers = covers.unionByName(_in_buckets(_stretches(rows, heads.where("NOT crowded"), width, id_col, text), width))
    crowds = heads.where("crowded")
    return covers if crowds.isEmpty() else covers.unionByName(_in_crowds(_stretches(rows, crowds, width, id_col, text)))


def remove(
    df: DataFrame,
    width: int = 50,
    anchor: int = 8,
    crowd: int = 1000,
    id_col: str = "doc_id",
    text: str = "text",
    names: tuple[str, str, str] = ("n_words", "n_removed", "kept_sha256"),
) -> DataFrame:
    """Every row with its text reduced to the kept words, one space between them, and the counts.

    Adds the columns ``names`` in place of any that are there; all others are passed through, whatever
    their names. A row that loses nothing keeps its text as it was (the digest is of its words joined).
    """
    replaced = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in replaced]
    plain = df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(kept)])
    told = tuple(f"told{i}" for i in range(len(names)))
    own = (f"c{kept.index(c)}" for c in (id_col, text))
    return _remove(plain, width, anchor, crowd, *own, told).toDF(*kept, *names)


def _remove(df: DataFrame, width: int, anchor: int, crowd: int, id_col: str, text: str, told: tuple[str, ...]) -> DataFrame:
    """The same for columns whose names meet no name used here."""
    keep = df.columns
    # The mark tells rows with one id apart.
    rows = df.select(*keep, F.hash(text).alias("_mark"))
    covers = _repeats(rows, width, anchor, crowd, id_col, text)
    lists = covers.groupBy("_doc", "_mark").agg(F.collect_list(F.struct("first", "n")).alias("_covers"))
    rows = rows.join(lists.withColumnRenamed("_doc", id_col), [id_col, "_mark"], "left")
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.LongType(), False) for c in told[:2]] + [T.StructField(told[2], T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frames.slices(batch, text):
                texts = frames.Texts(part.column(text))
                starts, _, before = frames.words(texts)
                data, kept, lost, digests = texts.raw.tobytes(), [], [], []
                given = part.column("_covers")
                pairs, ahead = given.flatten(), np.concatenate([[0], np.cumsum(given.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                first, n = (pairs.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                for i, old in enumerate(part.column(text)):
                    own = data[texts.bounds[i] : texts.bounds[i + 1]].split()
                    gone = 0
                    if ahead[i] < ahead[i + 1]:
                        delta = np.zeros(before[i + 1] - before[i] + 1, np.int64)
                        f = first[ahead[i] : ahead[i + 1]]
                        np.add.at(delta, f, 1)
                        np.subtract.at(delta, f + n[ahead[i] : ahead[i + 1]] + width - 1, 1)
                        bare = np.cumsum(delta[:-1]) == 0
                        gone = int(len(own) - bare.sum())
                        own = [own[k] for k in np.flatnonzero(bare).tolist()]
                    joined = b" ".join(own)
                    digests.append(hashlib.sha256(joined).hexdigest())
                    kept.append(joined.decode() if gone else old.as_py())
                    lost.append(gone)
                columns = [pa.array(kept, pa.string()) if c == text else part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(before)), pa.array(lost, pa.int64()), pa.array(digests)], names=schema.names)

    return rows.mapInArrow(run, schema)
