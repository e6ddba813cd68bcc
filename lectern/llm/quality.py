"""Document quality by a regularised quadratic discriminant (operator 10).

Each text becomes a dozen statistics (lengths, shares of letters, capitals, digits and symbols,
repetition), transformed towards normal shape. Each class has its mean and a covariance shrunk
towards the pooled and the diagonal one; the score is the logistic of the difference of the two
log densities, each a squared Mahalanobis distance through the class's Cholesky factor, which is
made once and broadcast with the model.

Training reads at most ``sample`` labelled rows (by a hash of the id); scores cover every whole text.
Null and empty texts have the statistics of no text and are scored like any other. Without labelled
rows of both classes every score is the share of label 1, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import frames

NAMES = ("length", "words", "word_length", "capitals", "capital_words", "digits", "symbols", "symbol_words", "marks", "lone_symbols", "lines", "distinct", "repeats")


def _kinds() -> np.ndarray:
    """A row per kind: capital, digit, symbol, mark (, . ; : ! ? quotes), line feed, letter or other character."""
    table = np.zeros((6, 256), np.uint8)
    table[0, ord("A") : ord("Z") + 1] = 1
    table[1, ord("0") : ord("9") + 1] = 1
    table[2, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 1
    table[3, [ord(c) for c in "!\"'(),-.:;?"]] = 1
    table[4, 10] = 1
    table[5, [*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = 1
    return table


_KINDS = _kinds()


def statistics(texts: frames.Texts) -> np.ndarray:
    """One row of transformed statistics per text."""
    raw = texts.raw
    starts, ends, before = frames.words(texts)
    sums = [np.concatenate([[0], np.cumsum(k[raw], dtype=np.int64)]) for k in _KINDS]
    at = texts.bounds
    size = np.diff(at).astype(float)
    n = np.diff(before).astype(float)
    capital, digit, symbol, mark, line, letter = (s[at[1:]] - s[at[:-1]] for s in sums)
    row = np.repeat(np.arange(texts.n), np.diff(before))

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(row, flags, texts.n)

    width = ends - starts
    capitals, symbols, letters = (s[ends] - s[starts] for s in (sums[0], sums[2], sums[5]))
    words = frames.word_hashes(raw, starts, ends) if len(starts) else np.empty(0, np.uint64)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((words, row))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order], new, texts.n)
    some, any_ = np.maximum(n, 1), np.maximum(size, 1)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.sqrt(part / whole)

    columns = [
        np.log1p(size),
        np.log1p(n),
        np.log1p(size / some),
        share(capital, any_),
        share(per_text((capitals > 1) & (2 * capitals > width)), some),
        share(digit, any_),
        share(symbol, any_),
        share(per_text(symbols > 0), some),
        share(mark, any_),
        share(per_text(letters == 0), some),
        share(line, any_),
        np.log(np.maximum(distinct, 1) / some) / np.log(some + 2),
        share(per_text(same), some),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Model:
    """Per class: mean, inverse Cholesky factor, log density at the mean with the prior."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    share: float
    soften: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.share)
        dense = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip((dense[1] - dense[0]) / self.soften, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.1, floor: float = 1e-3) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        return Model(np.empty((0, x.shape[1])), np.empty((0, 0, 0)), np.empty(0), share, 1.0)
    pooled = np.cov(np.concatenate([x[y == c] - x[y == c].mean(0) for c in (0, 1)]).T)
    means, factors, offsets = [], [], []
    for c in (0, 1):
        own = x[y == c]
        cov = np.cov(own.T) if len(own) > 1 else pooled
        cov = (1 - shrink) * cov + shrink * (pooled + np.diag(np.diag(pooled))) / 2 + floor * np.eye(x.shape[1])
        lower = np.linalg.cholesky(cov)
        means.append(own.mean(0))
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(len(own) / len(x)) - np.log(np.diag(lower)).sum())
    return Model(np.array(means), np.array(factors), np.array(offsets), share, float(x.shape[1]))


def _with_statistics(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("_x", T.ArrayType(T.DoubleType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frames.slices(batch, text):
                x = statistics(frames.Texts(part.column(text)))
                column = frames.list_array(x.ravel(), np.full(len(x), x.shape[1]), pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), column], names=schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, id_col: str = "doc_id", text: str = "text", label: str = "quality", **options) -> Model:
    """Fit on the labels of ``sample`` rows at most; the sample alone is broadcast to find their texts."""
    mark = F.xxhash64(id_col)
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label).alias("_label"), mark.alias("_mark"))
    chosen = chosen.orderBy("_mark", "_label").limit(sample)
    rows = docs.select(id_col, text).join(F.broadcast(chosen), id_col)
    rows = _with_statistics(rows.select("_mark", "_label", text), ["_mark", "_label"], text).orderBy("_mark", "_label", "_x").limit(2 * sample).collect()
    x = np.array([r["_x"] for r in rows]).reshape(-1, len(NAMES))
    return fit(x, np.array([r["_label"] for r in rows]), **options)


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability-like score of each row's whole text (higher: label 1 likelier)."""
    keep = [c for c in df.columns if c != name]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.DoubleType(), False)])
    told = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frames.slices(batch, text):
                x = statistics(frames.Texts(part.column(text)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(told.value.score(x))], names=schema.names)

    return df.select(*keep).mapInArrow(run, schema)
