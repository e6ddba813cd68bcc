"""The pipeline on the smallest tables, stage by stage, and its rules against brute force."""

import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import queries
from test_llm_operators import linked, windows_removed

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = queries.table(spark, FOLDER, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in docs.collect()} if name != "packing" else docs.collect()
    labels = {r.doc_id: r.quality for r in queries.table(spark, FOLDER, "labels").collect()}
    before = {r.doc_id for r in queries.table(spark, FOLDER, "documents").collect()}
    assert set(kept["language"]) == before  # every document here has a language
    dropped = set(kept["language"]) - set(kept["quality"])
    assert all(labels.get(i, 0) == 0 for i in dropped) and any(labels.get(i) == 0 for i in dropped)
    least = linked(kept["quality"], 5, 80)
    assert set(kept["near_duplicates"]) == {i for i, (_, _, own) in least.items() if own}
    removed = windows_removed(kept["near_duplicates"], 50)
    for i, (n, gone, digest) in removed.items():
        if gone == n:
            assert i not in kept["substrings"]
        else:
            words = kept["substrings"][i].split()
            assert len(words) == n - gone and hashlib.sha256(" ".join(words).encode()).hexdigest() == digest
    assert {r.doc_id for r in kept["packing"]} == set(kept["substrings"])


def test_language_stage_rejects(spark):
    """Text in no learned language goes, documents of the tables stay."""
    docs = queries.table(spark, FOLDER, "documents").select("doc_id", "text", "lang")
    long = docs.where(F.length("text") > 300).orderBy("doc_id").limit(20).collect()
    rng = random.Random(6)
    made = [(-1, "Все семьи похожи друг на друга, каждая несчастлива", None), (-2, "xkcd qwrtz zzpl mnbv hjkl", None), (-3, "12 34", None)]
    made += [(-10 - r.doc_id, " ".join("".join(rng.sample(w, len(w))) for w in r.text.split()), None) for r in long]
    both = docs.unionByName(spark.createDataFrame(made, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, both, FOLDER).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_columns_and_null_rows(spark, tmp_path):
    docs = queries.table(spark, FOLDER, "documents").withColumn("n_words", F.lit(5)).withColumn("score", F.lit("s"))
    clashes = ("_mark", "_covers", "_score", "_label", "_pred", "_Words", "_removed", "_digest", "_text", "_runs", "c0", "told0")
    docs = docs.withColumns({c: F.lit(c) for c in clashes})
    null = spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")
    docs = docs.unionByName(null, allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert {r for r in docs.select(*clashes).distinct().collect()} == {clashes}
    assert docs.where("doc_id < 0").count() == 0 and docs.agg(F.max("n_words")).first()[0] == 5
