"""The registered queries of the operators and, where SQL can tell, their checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import alignment, bpe, chat, decontam, frames, language, neardup, packing, quality, substring, tokenfiles, topk, tries, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the 50-word windows that a document with a smaller id holds too."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substring.remove(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL["op1_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s
  FROM words, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50
), hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM windows) WHERE least < doc_id
), positions AS (
  SELECT doc_id, i, w[i] AS word FROM words, unnest(range(1, len(w) + 1)) AS t(i)
), marked AS (
  SELECT p.doc_id, p.i, p.word,
    coalesce(p.i - max(h.i) OVER (PARTITION BY p.doc_id ORDER BY p.i), 50) < 50 AS gone
  FROM positions p LEFT JOIN hits h ON p.doc_id = h.doc_id AND p.i = h.i
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text
  FROM marked GROUP BY doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
"""


@query
def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one that quotes the template's own control strings, read back from ids."""
    quoted = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", quoted), (-1, 1, "assistant", quoted)], rows.schema)
    ranks = vocabulary_file("byte_bpe_50k.tiktoken")
    return chat.read_back(chat.encode_turns(rows.unionByName(extra), ranks), ranks)


SQL["op2_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '|', '\p')) + 1
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""


@query
def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, folder, "documents")
    rest = language.remainder("doc_id", 4)
    model = language.train(docs.where(rest != 2))
    scored = language.predict(docs.select("doc_id", (rest == 2).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score")


@query
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of three-word shingles of 0.85 or more."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return neardup.groups(docs, words=3, percent=85)


SQL["op4_near_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 1, 2))) AS t(i) WHERE len(w) > 0
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT least.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = least.doc_id AS kept
FROM least LEFT JOIN sizes ON least.doc_id = sizes.doc_id
"""


@query
def op5_top_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    return topk.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


SQL["op5_top_scores"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    return winnowing.edited(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces = packing.cut(docs, vocabulary_file("byte_bpe_50k.tiktoken"))
    return packing.pack(pieces)


@query
def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded, and decoded from its ids alone."""
    ranks = vocabulary_file("byte_bpe_50k.tiktoken")
    ids = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), ranks)
    return bpe.decode(ids, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids_sha256",
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written as Arrow files of 2048-id sequences, and what the files say of each."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    place = f"{frames.shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    tokenfiles.write(docs, vocabulary_file("word_bpe_49k.json"), place)
    return tokenfiles.read(spark, place, docs.schema["doc_id"].dataType)


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from labels that are not held out."""
    docs = table(spark, folder, "documents")
    rest = language.remainder("doc_id", 3)
    model = quality.train(docs, table(spark, folder, "labels").where(rest != 1))
    scored = quality.score(docs.select("doc_id", (rest == 1).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that stand in ten consecutive words of a benchmark item, or in a whole shorter one."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontam.decontaminate(docs, table(spark, folder, "benchmark"), length=10, coverage=1.0)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL["op13_decontamination"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM items, unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0
), runs AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM words, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) + 2 - n)) AS t(i)
), hits AS (
  SELECT doc_id, i, runs.n, item_id FROM runs JOIN windows ON runs.n = windows.n AND runs.s = windows.s
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) AS t(k) GROUP BY doc_id
), met AS (
  SELECT doc_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id LEFT JOIN met ON words.doc_id = met.doc_id
"""


@query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document read by two tokenizers, their tokens' groups, and how usual its links are in the corpus."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return alignment.measure(docs, vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model"), b_size=32_000)


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the trie of all conversations, each begun by the first turns of its block's first one."""
    conv = F.col("conv_id")
    turns = tries.rebuilt(
        table(spark, folder, "conversations"),
        head_turns=(F.crc32(conv.cast("string").cast("binary")) % 4).cast("int"),
        base=conv - conv % 20,
    )
    return tries.prefix_trie(turns)


SQL["op12_prefix_trie"] = r"""
WITH RECURSIVE own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
    md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS token,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), turns AS (
  SELECT ids.conv_id, place, token, words FROM ids JOIN own ON own.conv_id = ids.conv_id WHERE place > h
  UNION ALL SELECT ids.conv_id, place, token, words FROM ids JOIN own ON own.conv_id = ids.base WHERE place <= h
), paths AS MATERIALIZED (
  SELECT conv_id, row_number() OVER c AS depth, string_agg(token, '') OVER c AS node, words, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns WINDOW c AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0, (SELECT count(*) FROM turns WHERE turns.conv_id = ids.conv_id) FROM ids
), nodes AS MATERIALIZED (
  SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256
  FROM paths GROUP BY node
), children AS MATERIALIZED (
  SELECT left(node, length(node) - 32) AS node, count(*) AS n_children FROM nodes WHERE node <> '' GROUP BY 1
), up AS (
  SELECT node, node AS over FROM nodes
  UNION ALL SELECT node, left(over, length(over) - 32) FROM up WHERE over <> ''
), sums AS (
  SELECT over AS node, count(*) FILTER (children.node IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM up JOIN nodes USING (node) LEFT JOIN children USING (node) GROUP BY over
)
SELECT a.conv_id, a.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM nodes a JOIN sums ON a.node = sums.node LEFT JOIN children ON a.node = children.node
LEFT JOIN nodes p ON a.node <> '' AND p.node = left(a.node, length(a.node) - 32)
"""
