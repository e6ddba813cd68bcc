"""A training corpus from raw documents: five stages, each one operator, each written and read again.

Language labelling, quality and near-duplicate stages drop documents, substring removal
shortens texts, packing lays out what is left. All stages but the last return the columns of
``documents``, so each works on exactly what its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import frames, language, neardup, packing, quality, queries, substring

# Language: rejected if no learned language holds this share of the words. On held-out documents of `sf0.01` the
# least share is 0.54; texts with the letters of each word shuffled reach 0.24 at most, other scripts 0.01.
LEAST_LANGUAGE = 0.4
# Quality: rejected below this score.
LEAST_QUALITY = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a prevailing language."""
    model = language.train(docs)
    label, share = (frames.spare(docs.columns, c) for c in ("_label", "_share"))
    scored = language.predict(docs, model, pred=label, score=share)
    return scored.where((F.col(label) != "und") & (F.col(share) >= LEAST_LANGUAGE)).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that look like those labelled 0, as learned from the labelled documents still here."""
    model = quality.train(docs, queries.table(spark, sf_dir, "labels"))
    name = frames.spare(docs.columns, "_score")
    return quality.score(docs, model, name=name).where(F.col(name) >= LEAST_QUALITY).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies (five-word shingles, similarity 0.8)."""
    groups = neardup.groups(docs, words=5, percent=80)
    gone = frames.checkpoint(groups.where(~F.col("kept")).select("doc_id").distinct())
    return frames.without(docs, gone).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove 50-word passages that a smaller id holds; a document left without a word goes."""
    words, removed, digest = (frames.spare(docs.columns, c) for c in ("_words", "_removed", "_digest"))
    cleaned = substring.remove(docs, names=(words, removed, digest)).where(F.col(removed) < F.col(words))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 ids."""
    pieces = packing.cut(docs.select("doc_id", "text"), queries.vocabulary_file("byte_bpe_50k.tiktoken"))
    return packing.pack(pieces)


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", without_near_copies),
    ("substrings", without_repeats),
    ("packing", packed),
]

# Learned models and a byte-level vocabulary have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder."""
    folder = f"{frames.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
