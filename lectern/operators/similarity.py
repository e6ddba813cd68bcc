"""Embedding text, incremental embedding plans and nearest neighbours by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.functions.text import blank_to_null, collapse_space, trim_space
from lectern.operators.lineage import cut
from lectern.operators.listing import optional
from lectern.operators.quality import embeddable
from lectern.operators.ranks import first_rows, number_rows

# Presets of the site (candidates kept before any cap, longest description), rows per request.
NEAREST = 200
DESCRIPTION_CHARS = 1500
BATCH = 200

# Rows held by one block of the all-courses form, rows for each cluster, and the fewest and most clusters it makes.
BLOCK_ROWS = 2048
CLUSTER_ROWS = 1024
FEWEST, CLUSTERS = 16, 512
# Rows that one task finds the nearest of, if there are many, and bytes of the vectors it takes them past.
TASK_ROWS, PART_BYTES = 4096, 64 << 20
# Rows of a block multiplied at a time, numbers gathered at a time for exact products, and finds that are held before they are ranked.
TILE_ROWS, GATHERED, FRESH = 256, 1 << 22, 1 << 16


def embedding_text(title: Column, department: Column, description: Column, chars: int | None = None) -> Column:
    """Title, department and description, one per line, blanks left out.

    ``chars`` shortens the description (``DESCRIPTION_CHARS`` is the site's preset).
    """
    about = F.trim(collapse_space(description))
    about = about if chars is None else F.substring(about, 1, chars)
    return F.concat_ws(
        "\n",
        blank_to_null(trim_space(title)),
        blank_to_null(trim_space(department)),
        blank_to_null(about),
    )


def content_hash(model: str, text: Column) -> Column:
    return F.sha1(F.concat(F.lit(model + "\n"), text))


def embedding_plan(courses: DataFrame, stored: DataFrame, model: str, chars: int | None = None) -> DataFrame:
    """What an embedding run does with each course: delete, keep, or embed in batches of one college.

    ``courses``: course_id, college_id, course_number, title, department_name, description.
    ``stored``: course_id, content_hash.
    """
    text = embedding_text(F.col("title"), F.col("department_name"), F.col("description"), chars)
    prepared = courses.withColumns(
        {
            "thin": ~embeddable(F.col("course_number"), F.col("title"), F.col("description")),
            "text": text,
        }
    ).withColumn("new_hash", content_hash(model, F.col("text")))
    compared = prepared.select("course_id", "college_id", "thin", "text", "new_hash").join(
        stored.select("course_id", "content_hash"), "course_id", "left"
    )
    return compared.select(
        "course_id",
        "college_id",
        "new_hash",
        F.length("text").alias("chars"),
        F.when(F.col("thin"), "delete")
        .when(F.col("new_hash") == F.col("content_hash"), "unchanged")
        .otherwise("embed")
        .alias("action"),
    )


def embedding_batches(plan: DataFrame, size: int = BATCH) -> DataFrame:
    """Batch number of each course to embed, counted inside its college."""
    pending = plan.filter("action = 'embed'").select("college_id", "course_id")
    numbered = number_rows(
        pending, ["college_id"], [F.asc("course_id")], F.floor(F.col("course_id") / 10_000), "n"
    )
    return numbered.select(
        "college_id", "course_id", F.floor((F.col("n") - 1) / size).alias("batch")
    )


def embedding_totals(plan: DataFrame, rate_per_million: float) -> DataFrame:
    """Run totals per college with the dry-run estimate of four characters a token."""
    tokens = F.ceil(F.sum(F.when(F.col("action") == "embed", F.col("chars")).otherwise(0)) / 4)
    return (
        plan.groupBy("college_id")
        .agg(
            F.count_if(F.col("action") == "embed").alias("embedded"),
            F.count_if(F.col("action") == "unchanged").alias("unchanged"),
            F.count_if(F.col("action") == "delete").alias("skipped"),
            tokens.alias("tokens"),
        )
        .withColumn("cost", F.round(F.col("tokens") / 1e6 * rate_per_million, 6))
    )


def _unit(vectors: pd.Series) -> np.ndarray:
    rows = np.array(vectors.tolist(), dtype=np.float64)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, np.nan, norms)


@F.pandas_udf(T.DoubleType())
def _cosine(vectors: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series(np.einsum("ij,ij->i", _unit(vectors), _unit(target)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vector columns; null beside a zero vector."""
    return F.nanvl(_cosine(a, b), F.lit(None).cast("double"))


def similar_courses(
    embeddings: DataFrame,
    course_id: object | None = None,
    vector: Sequence[float] | Column | None = None,
    exclude_college: object | None = None,
    limit: int | None = 10,
    per_college: int | None = 2,
    min_similarity: float = 0.5,
    nearest: int | None = None,
) -> DataFrame:
    """Nearest courses to a stored course or a vector: threshold and caps.

    ``nearest`` keeps so many candidates before both (``NEAREST`` is the site's preset).

    ``embeddings``: course_id, college_id, embedding, and college_rank, course_number when known.
    The target vector is a one-row subquery; the scan keeps a bounded top-k per task.
    """
    if course_id is not None:
        target = embeddings.where(F.col("course_id") == F.lit(course_id)).select("embedding").scalar()
    elif vector is not None:
        target = vector if isinstance(vector, Column) else F.array(*[F.lit(float(v)) for v in vector])
    else:
        return embeddings.limit(0).select("course_id", "college_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("place"))
    scope = embeddings.filter(optional(F.col("college_id"), exclude_college, exclude=True))
    scope = scope.filter(optional(F.col("course_id"), course_id, exclude=True))
    extra = [c for c in embeddings.columns if c not in ("course_id", "college_id", "embedding")]
    order = [F.desc("similarity"), F.asc("course_id")]
    near = (
        scope.withColumn("target", target)
        .filter(F.col("target").isNotNull())
        .select("course_id", "college_id", *extra, cosine(F.col("embedding"), F.col("target")).alias("similarity"))
        .filter(F.col("similarity").isNotNull())
    )
    if nearest is not None:
        near = near.orderBy(*order).limit(nearest)
    near = near.filter(F.col("similarity") >= min_similarity)
    if per_college is not None:
        near = first_rows(near, ["college_id"], order, per_college, "college_place")
    tail = [F.asc_nulls_last(c) for c in ("college_rank", "course_number") if c in extra]
    final = [F.desc("similarity"), *tail, F.asc("course_id")]
    out = first_rows(near.withColumn("one", F.lit(1)), ["one"], final, limit, "place")
    return out.select("course_id", "college_id", *extra, "similarity", "place")


def _packed(table: pa.Table) -> pa.Table:
    """The rows of one block as one row: ids, colleges in runs, vectors end to end."""
    table = table.sort_by("college_id").combine_chunks()
    bounds = pa.array([0, table.num_rows], pa.int32())

    def whole(name: str) -> pa.Array:
        column = table.column(name)
        return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column

    vectors = whole("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return pa.table(
        {
            "cluster": whole("cluster")[:1],
            "block": whole("block")[:1],
            "radius": pa.array([whole("angle").to_numpy(zero_copy_only=False).max()], pa.float64()),
            "ids": pa.ListArray.from_arrays(bounds, whole("course_id")),
            "colleges": pa.ListArray.from_arrays(bounds, whole("college_id")),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
        }
    )


def _values(column: pa.Array) -> np.ndarray:
    """Numbers as they are, anything else and what has nulls as objects."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    return np.array([*column.to_pylist(), None], dtype=object)[:-1]


def _ranks(values: np.ndarray) -> np.ndarray:
    """What sorts as the values do, nulls first."""
    return pd.factorize(values, sort=True)[0] if values.dtype == object else values


class _Block:
    """One packed block: ids, numbers of colleges (null is -1) and unit vectors, exact and for a first look."""

    def __init__(self, row: dict, prefix: str, seen: dict):
        self.cluster, self.radius = row[f"{prefix}cluster"].as_py(), row[f"{prefix}radius"].as_py()
        self.id_column, self.college_column = row[f"{prefix}ids"].values, row[f"{prefix}colleges"].values
        self.ids = _values(self.id_column)
        part, known = pd.factorize(_values(self.college_column))
        self.college = np.array([*(seen.setdefault(x, len(seen)) for x in known.tolist()), -1])[part]
        raw = np.frombuffer(row[f"{prefix}vectors"].as_buffer(), np.float32).reshape(len(self.ids), -1).astype(np.float64)
        self.exact = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        self.rough = self.exact.astype(np.float32)
        starts = np.flatnonzero(np.diff(self.college, prepend=-2))
        self.runs = {int(self.college[x]): (int(x), int(y)) for x, y in zip(starts, [*starts[1:], len(self.ids)], strict=True) if self.college[x] >= 0}


class _Best:
    """The best of other colleges so far for every course of a block."""

    def __init__(self, block: _Block, least: float, per_college: int, limit: int, nearest: int | None):
        self.block, self.least, self.per_college, self.limit, self.nearest = block, least, per_college, limit, nearest
        self.bound = np.full(len(block.ids), float(least))
        # Courses of the block, likeness, numbers of colleges and ids of others: the best, then what came since.
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.fresh = 0

    def meet(self, row: dict, pivots: np.ndarray, seen: dict) -> None:
        mine = self.block
        apart = math.acos(max(-1.0, min(1.0, float(pivots[mine.cluster] @ pivots[row["other_cluster"].as_py()]))))
        widest = math.acos(max(-1.0, min(1.0, float(self.bound.min()))))
        if apart - mine.radius - row["other_radius"].as_py() > widest + 1e-7:
            return
        other = _Block(row, "other_", seen)
        wide = mine.exact.shape[1]
        slack = (wide + 16) * 1.2e-7  # more than single precision can be wrong by
        for first in range(0, len(mine.ids), TILE_ROWS):
            last = min(first + TILE_ROWS, len(mine.ids))
            cos = mine.rough[first:last] @ other.rough.T
            for college, (x, y) in mine.runs.items():
                if x < last and y > first and college in other.runs:
                    cos[max(x - first, 0) : y - first, slice(*other.runs[college])] = -2
            hit = np.flatnonzero(cos >= (self.bound[first:last] - slack).astype(np.float32)[:, None])
            for few in np.array_split(hit, -(-len(hit) * wide // GATHERED)) if len(hit) else ():
                self.add(few // len(other.ids) + first, few % len(other.ids), other)

    def add(self, row: np.ndarray, picked: np.ndarray, other: _Block) -> None:
        cos = np.einsum("ij,ij->i", self.block.exact[row], other.exact[picked])
        mine, theirs = self.block.ids[row], other.ids[picked]
        same = np.equal(mine, theirs).astype(bool)
        if mine.dtype == object:
            same &= np.not_equal(mine, None).astype(bool)
        keep = (cos >= self.bound[row]) & ~same
        if keep.any():
            self.parts.append((row[keep], cos[keep], other.college[picked[keep]], theirs[keep]))
            self.fresh += int(keep.sum())
            if self.fresh >= max(FRESH, 8 * len(self.bound)):
                self.settle()

    def settle(self) -> None:
        """Keep what the caps can leave; ties are cut by id, as the final ranking does."""
        row, cos, college, ids = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        sort = np.lexsort((_ranks(ids), -cos, row))
        most = self.nearest
        if most is None:
            # Only the first few of each college, and of those the first few, can stay.
            most, by = self.limit, np.lexsort((college[sort], row[sort]))
            few = np.zeros(len(sort), bool)
            few[by] = _nth(row[sort][by], college[sort][by]) < self.per_college
            sort = sort[few]
        nth = _nth(row[sort])
        full = sort[nth == most - 1]
        self.bound[row[full]] = cos[full]
        kept = sort[nth < most]
        self.parts, self.fresh = [(row[kept], cos[kept], college[kept], ids[kept])], 0

    def found(self, schema: pa.Schema, seen: dict) -> pa.RecordBatch:
        if not self.parts:
            return pa.RecordBatch.from_pylist([], schema)
        self.settle()
        row, cos, college, ids = self.parts[0]
        mine, block = pa.array(row), self.block
        names = pa.array(list(seen), schema.field("other_college").type)
        columns = [block.id_column.take(mine), block.college_column.take(mine), pa.array(ids, schema.field("other_id").type)]
        columns += [names.take(pa.array(college, mask=college < 0)), pa.array(cos, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def _nth(*keys: np.ndarray) -> np.ndarray:
    """Place of each row in its run of equal keys, from 0."""
    at = np.arange(len(keys[0]))
    new = np.zeros(len(at), bool)
    for k in keys:
        new |= np.diff(k, prepend=k[:1]) != 0
    return at - np.maximum.accumulate(np.where(new, at, 0))


def similar_for_all(
    embeddings: DataFrame,
    min_similarity: float = 0.6,
    per_college: int = 2,
    limit: int = 10,
    nearest: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Nearest courses of every course at other colleges, exact.

    Vectors are put with their nearest of a few sampled pivots and clusters are cut into blocks
    of bounded size, so a crowded cluster becomes many blocks; a block is one row of packed vectors.
    The number of pivots grows with the table. A task takes some blocks past all blocks of a part of the
    table, which are read from the checkpoint and not copied to each block that meets them, and keeps the best so far of each
    course: those that the caps can leave, at most ``limit``. Two blocks are compared only
    when the triangle inequality on angles leaves room for what could still get in. With ``nearest`` the candidates
    are cut to so many before the caps (``NEAREST`` is the site's preset).
    """
    vectors = embeddings.select("course_id", "college_id", "embedding").filter(
        F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x) > 0
    )
    # More pivots as the table grows, so clusters stay small; at most CLUSTERS rows come to the driver.
    clusters = min(max(vectors.count() // CLUSTER_ROWS, FEWEST), CLUSTERS)
    sample = vectors.select("embedding").orderBy(F.xxhash64("course_id")).limit(clusters).collect()
    if not sample:
        return vectors.limit(0).select(
            "course_id",
            "college_id",
            F.lit(0).alias("place"),
            F.col("course_id").alias("other_id"),
            F.col("college_id").alias("other_college"),
            F.lit(0.0).alias("similarity"),
        )
    pivots = _unit(pd.Series([r["embedding"] for r in sample]))
    pivots = pivots[np.isfinite(pivots).all(axis=1)]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and len(pivots):
                cos = np.clip(_unit(pdf["embedding"]) @ pivots.T, -1, 1)
                fine = np.isfinite(cos[:, 0])
                cos = cos[fine]
                yield pdf[fine].assign(cluster=cos.argmax(axis=1), angle=np.arccos(cos.max(axis=1)))

    ids = vectors.schema
    id_type, college_type = (ids[c].dataType.simpleString() for c in ("course_id", "college_id"))
    placed = cut(
        vectors.mapInPandas(
            place,
            f"course_id {id_type}, college_id {college_type}, embedding array<float>, "
            "cluster int, angle double",
        )
    )
    # One row per pivot.
    shapes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("embedding")).alias("wide")).collect()
    held = {s["cluster"]: max(1, -(-s["rows"] // block_rows)) for s in shapes}
    dealt = F.element_at(F.create_map(*[F.lit(x) for pair in held.items() for x in pair]), F.col("cluster")) if held else F.lit(1)
    blocks = cut(
        # Rows are dealt by their place in the checkpoint, whatever their ids.
        placed.withColumn("block", F.pmod(F.monotonically_increasing_id(), dealt).cast("int"))
        .groupBy("cluster", "block")
        .applyInArrow(
            _packed,
            f"cluster int, block int, radius double, ids array<{id_type}>, colleges array<{college_type}>, vectors binary",
        )
    )
    rows = sum(s["rows"] for s in shapes)
    size = sum(s["rows"] * (4 * s["wide"] + 16) for s in shapes)
    tasks = max(2 * embeddings.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    names = ["cluster", "block", "radius", "ids", "colleges", "vectors"]
    left = blocks.repartition(max(1, min(tasks, sum(held.values()))))
    right = blocks.repartition(max(1, -(-size // PART_BYTES))).select(*[F.col(c).alias(f"other_{c}") for c in names])
    schema = T.StructType(
        [
            T.StructField("course_id", ids["course_id"].dataType),
            T.StructField("college_id", ids["college_id"].dataType),
            T.StructField("other_id", ids["course_id"].dataType),
            T.StructField("other_college", ids["college_id"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    target = to_arrow_schema(schema)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, at = None, None
        seen: dict = {}  # numbers of colleges
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                key = row["cluster"].as_py(), row["block"].as_py()
                if key != at:
                    if mine is not None:
                        yield mine.found(target, seen)
                    at, mine = key, _Best(_Block(row, "", seen), min_similarity, per_college, limit, nearest)
                mine.meet(row, pivots, seen)
        if mine is not None:
            yield mine.found(target, seen)

    hits = left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(match, schema).repartition("course_id")
    order = [F.desc("similarity"), F.asc("other_id")]
    top = hits if nearest is None else first_rows(hits, ["course_id"], order, nearest, "near_place")
    capped = first_rows(top, ["course_id", "other_college"], order, per_college, "college_place")
    return first_rows(capped, ["course_id"], order, limit, "place").select(
        "course_id", "college_id", "place", "other_id", "other_college", "similarity"
    )
