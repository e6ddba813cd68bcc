"""The training-data operators against brute force, on small tables with every odd case."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, chat, frames, language, neardup, packing, quality, queries, substring, tokenfiles, topk, winnowing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = say(70), say(150)
    out = {i: say(rng.randint(1, 200)) for i in range(40)}
    out |= {40: None, 41: "", 42: " \n\t ", 43: "x", 44: base, 45: base, 46: base + " more", 47: "of " * 300, 48: "of " * 120}
    out |= {49: say(20) + " " + passage + "\n" + say(10), 50: passage, 51: say(60) + "\t" + passage + " " + say(3), 52: say(4000)}
    out |= {53: "Ünïcode 'S it's we'll 12３ …   \x1c<|im_end|> <|endoftext|> ΣΑΣ İ", 54: base.upper(), 55: base.replace(" ", "  ", 3)}
    near = base.split()
    for i in range(56, 90):
        own = list(near)
        own[rng.randrange(150)] = rng.choice(words)
        out[i] = " ".join(own)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "de", 7, "extra") for i, t in texts.items()]
    rows += [(10, texts[10], "en", 7, "again"), (None, texts[44], None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, ids string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# -- op1 ---------------------------------------------------------------------------------------


def windows_removed(texts: dict, width: int) -> dict:
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    first: dict = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), sha(" ".join(kept).encode()))
    return out


@pytest.mark.parametrize(("width", "anchor", "crowd"), [(50, 8, 1000), (50, 8, 1), (5, 2, 3), (3, 3, 1000)])
def test_substring(docs, texts, width, anchor, crowd):
    got = substring.remove(docs, width, anchor, crowd).where("doc_id IS NOT NULL").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == windows_removed(texts, width)
    assert len(got) == len(texts) + 1  # the repeated row stays


def test_substring_odd(docs, empty, texts):
    null = substring.remove(docs).where("doc_id IS NULL").collect()
    assert [(r.n_removed, r.text) for r in null] == [(0, texts[44])]
    assert substring.remove(empty).count() == 0


# -- op2 ---------------------------------------------------------------------------------------


def test_chat(spark):
    ranks = queries.vocabulary_file("byte_bpe_50k.tiktoken")
    tricky = ["<|im_end|>", "<\\|im_start|>", "<|", "|>", "a\nb", "", None, "<<||", "\\", "é😀" * 3000]
    rows = [(1, i, "assistant" if i % 2 else "user\nx|\\n", t, 0) for i, t in enumerate(tricky)]
    rows += [(None, None, None, None, 1), (2, 0, "user", "same", 1), (2, 0, "user", "same", 1), (3, 0, "assistant", "<|im_end|><|im_start|>assistant ok", 2)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start int").repartition(2)
    turns = chat.encode_turns(table, ranks)
    got = {r.conv_id: r for r in chat.read_back(turns, ranks).collect()}
    own = collections.defaultdict(list)
    for c, _, role, text, _ in rows:
        own[c].append((role or "", text or ""))
    assert set(got) == set(own)
    for c, said in own.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert got[c].n_turns == len(said)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in said).encode())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss.encode()))
    for row in turns.collect():
        assert len(row.ids) == len(row.loss) and row.ids.count(50256) == 1 and row.ids.count(50257) == 1
    assert chat.read_back(chat.encode_turns(table.limit(0), ranks), ranks).count() == 0


def test_escape_round_trip():
    rng = random.Random(2)
    seen = {}
    for _ in range(3000):
        text = "".join(rng.choice("<\\|a>") for _ in range(rng.randint(0, 8)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert seen.setdefault(chat.escape(text), text) == text
        assert chat.unescape_role(chat.escape_role(text + "\n")) == text + "\n"


# -- op3, op10 ---------------------------------------------------------------------------------


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(5, 2, 3)), rng.normal(size=(3, 3))
    valid = np.array([[1, 1], [1, 1], [1, 1], [1, 0], [1, 0]], bool)
    gamma, _ = language.forward_backward(scores, valid, moves)
    for c, n in ((0, 5), (1, 3)):
        mass = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(sum(scores[t, c, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            for t, y in enumerate(path):
                mass[t, y] += p
        assert np.allclose(gamma[:n, c], mass / mass.sum(1, keepdims=True))
        assert np.allclose(language.probabilities(scores, valid, moves)[:n, c], gamma[:n, c])


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.op3_language(spark, folder).join(queries.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


def test_language_says_no(spark):
    """Held-out documents keep a high score; their shuffled letters, random ones and other scripts get a low one."""
    documents = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rest = language.remainder("doc_id", 4)
    model = language.train(documents.where(rest != 2))
    rows = documents.where((rest == 2) & (F.length("text") > 300)).orderBy("doc_id").limit(60).collect()
    rng = random.Random(4)
    made = [(r.doc_id, "clean", r.text) for r in rows]
    made += [(r.doc_id, "shuffled", " ".join("".join(rng.sample(w, len(w))) for w in r.text.split())) for r in rows]
    made += [(r.doc_id, "random", " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in w) for w in r.text.split())) for r in rows]
    made += [(-1, "script", "Все семьи похожи друг на друга"), (-2, "script", "吾輩は猫である。名前はまだ無い。"), (-3, "script", "كان يا ما كان في قديم الزمان")]
    made += [(r.doc_id, "joined", "".join(r.text.split())) for r in rows]
    got = language.predict(spark.createDataFrame(made, "doc_id long, kind string, text string"), model).collect()
    langs = {r.doc_id: r.lang for r in rows}
    assert all(r.lang_pred in model.labels for r in got)
    assert all(r.score > 0.5 for r in got if r.kind == "clean")
    assert all(r.score < 0.4 for r in got if r.kind in ("shuffled", "random", "script"))
    assert sum(r.lang_pred == langs[r.doc_id] for r in got if r.kind == "joined") >= 57


def test_language_reads_the_middle_of_long_words():
    starts, ends, before = language.stretches(np.array([0, 70, 71]), np.array([65, 71, 131]), np.array([0, 1, 3]))
    assert list(zip(starts.tolist(), ends.tolist())) == [(0, 30), (30, 60), (60, 65), (70, 71), (71, 101), (101, 131)]
    assert before.tolist() == [0, 3, 6]
    word = "".join(chr(97 + k % 26) for k in range(95))
    assert b"".join(language.words_of(word)) == word.encode() and max(map(len, language.words_of(word))) == 30


def test_language_repeats_and_ties(spark, docs):
    model = language.train(docs)
    rows = spark.createDataFrame([(1, "the and of"), (1, "the and of"), (2, "the and of")], "doc_id long, text string")
    got = language.predict(rows, model).collect()
    assert len(got) == 3 and len({(r.lang_pred, r.score) for r in got}) == 1
    level = language.Model(["aa", "bb"], np.zeros_like(model.weights)[:, :3], np.zeros((3, 3)))
    assert language.predict(rows, level).first().lang_pred == "aa"


def test_language_odd(spark, docs, empty):
    model = language.train(docs)
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "12 !?", 1.0), (4, "… 12", 1.0), (5, "abc " * 20000, 1.0)], "doc_id long, text string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 4)) and got[5][0] in ("de", "en")
    assert language.train(empty) is None
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_quality(spark, docs, empty):
    folder = "/root/testdata/sf0.001"
    got = queries.op10_quality(spark, folder).join(queries.table(spark, folder, "labels"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0]
    assert right > 0.9
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scores = [r.score for r in quality.score(docs, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    none = quality.train(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.score(docs, none).collect()} == {1.0}
    assert quality.train(empty, labels.limit(0)).share == 0.5
    assert quality.score(empty, model).count() == 0


def test_quadratic_discriminant_matches_densities():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (200, 3))])
    y = np.repeat([1, 0], [300, 200])
    model = quality.fit(x, y, shrink=0.0, floor=0.0)

    def dense(c):
        own = x[y == c]
        cov, d = np.cov(own.T), x - own.mean(0)
        return np.log(len(own) / len(x)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(dense(1) - dense(0)) / 3)))


# -- op4 ---------------------------------------------------------------------------------------


def linked(texts: dict, words: int, percent: int) -> dict:
    lower = {i: WORD.findall("".join(c.lower() if c.isascii() else c for c in t or "")) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set()) for i, w in lower.items()}
    least = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                moved = True
    return {i: (len(sets[i]), least[i], least[i] == i) for i in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, texts, words, percent):
    got = neardup.groups(docs, words, percent).where("doc_id IS NOT NULL").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == linked(texts, words, percent)


def test_near_duplicates_odd(docs, empty):
    null = neardup.groups(docs).where("doc_id IS NULL").collect()
    assert [(r.component_id, r.kept) for r in null] == [(None, True)]
    assert neardup.groups(empty).count() == 0


def test_near_duplicates_crowd(spark, monkeypatch):
    """A crowd of near copies larger than a block, with a few of its own kind at its edge."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(80)]
    rows = {}
    for i in range(120):
        own = list(base)
        for k in rng.sample(range(80), rng.choice([0, 1, 1, 2])):
            own[k] = f"w{i}.{k}"
        rows[i] = " ".join(own)
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = neardup.groups(table, 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == linked(rows, 3, 85)


@pytest.mark.parametrize("block", [1024, 64])
def test_near_duplicates_under_threshold(spark, monkeypatch, block):
    """True pairs inside a crowd just under the threshold, in one block and over many."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = {}
    for i in range(300):
        # 78 common words, 11 own: 0.78; every 10th document shares 3 of them with the next: 0.844.
        own = [f"pair{i // 10}.{k}" if i % 10 < 2 and k < 3 else f"own{i}.{k}" for k in range(11)]
        rows[i] = " ".join([f"c{k}" for k in range(78)] + own)
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = neardup.groups(table, 1, 80).collect()
    want = {i: i - 1 if i % 10 == 1 else i for i in rows}
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_at_threshold(spark):
    """A ring whose neighbours are exactly at the threshold, far pairs under it: estimates chain, links decide."""
    rows = {i: " ".join([f"c{k}" for k in range(90)] + [f"p{(i + k) % 200}" for k in range(15)]) for i in range(0, 200, 5)}
    rows |= {i + 1000: " ".join([f"c{k}" for k in range(90)] + [f"q{i}.{k}" for k in range(12)]) for i in range(60)}
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = neardup.groups(table, 1, 91).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == linked(rows, 1, 91)


@pytest.mark.parametrize(("block", "trees", "depth"), [(8, 1, 0), (1024, 2, 1)])
def test_near_duplicates_that_no_tree_joins(spark, monkeypatch, block, trees, depth):
    """True pairs inside a crowd with half its words in common: found where trees are few and nodes hold many blocks."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(5)
    rows = {}
    for i in range(400):
        # 60 common words; 40 own, of which each pair shares 34 or more, so about 0.89.
        own = [f"pair{i // 2}.{k}" if k < rng.randint(34, 38) else f"own{i}.{k}" for k in range(40)]
        rows[i] = " ".join([f"c{k}" for k in range(60)] + own)
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = neardup.groups(table, 1, 85, trees=trees, depth=depth).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == linked(rows, 1, 85)


def test_near_duplicates_rule_out_no_link():
    """Rarest shingles and sketches of sets of many sizes: no pair at the threshold or over it fails either."""
    rng = np.random.default_rng(3)
    for percent, size in itertools.product((50, 80, 85, 97), (3, 7, 40, 300, 2500)):
        base = rng.integers(0, 2**64, size, np.uint64)
        sets = [np.unique(base)]
        for _ in range(30):
            keep = base[rng.random(size) > rng.choice([0.0, 0.02, 0.1, 0.2])]
            more = rng.integers(0, 2**64, rng.integers(0, max(2, size // 5)), np.uint64)
            sets.append(np.unique(np.concatenate([keep, more, base[:1]])))
        n = np.array([len(s) for s in sets])
        before, width = np.concatenate([[0], np.cumsum(n)]), neardup._sketch_words(n, percent)
        sketches = neardup._parities(np.concatenate(sets), before, width)
        a, b = (np.array(c) for c in zip(*itertools.combinations(range(len(sets)), 2), strict=True))
        common = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
        linked_pairs = 100 * common >= percent * (n[a] + n[b] - common)
        apart = neardup._differing(sketches, width, a, b)
        assert (apart <= n[a] + n[b] - 2 * common).all()
        assert (neardup._at_most(apart, n[a], n[b], percent)[linked_pairs] > 0).all()
        assert (neardup._all_at_most(sets, n, percent)[a, b][linked_pairs] > 0).all()


def test_near_duplicates_of_one_id(spark):
    """Unlike texts under one id are each compared as they are."""
    words = [f"w{i}" for i in range(60)]
    rows = [(5, " ".join(words)), (5, "x y z"), (7, " ".join([*words, "more"])), (8, "x y z v"), (5, "x y z"), (9, "v x y z q r s")]
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 1, 75).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(5, 60, 5), (5, 3, 5), (7, 61, 5), (8, 4, 5), (9, 7, 9)}


def test_near_duplicates_shuffle_no_text(spark, docs):
    """Full sets are made where the texts lie, of all wanted classes, whatever size the tables seem to have."""
    rows = frames.checkpoint(docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")))
    every = neardup.sketch(rows, 3, 96, 12, 85).where("_doc IS NOT NULL AND n_shingles > 0").select(F.col("_doc").alias("rep"), "d1")
    wanted = frames.checkpoint(every.where("rep % 3 = 0"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sets = neardup._sets(rows, wanted, 3)
        plan = sets._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert wanted.count() > 0 and wanted.exceptAll(sets.select("rep", "d1")).count() == 0
    assert sets.join(wanted, ["rep", "d1"], "left_anti").count() <= every.count() // 100


def test_near_duplicates_companies_meet_once(spark):
    """Sets that share many rare shingles meet once, copies of a set count as one, and a node of one set is none."""
    rare = [(1, [*range(50), 90]), (2, [*range(50), 91]), (2, [*range(50), 91]), (3, [90, 92]), (4, [93]), (4, [93])]
    got = neardup._companies(spark.createDataFrame(rare, "d1 long, rare array<long>")).collect()
    by_node = {}
    for r in got:
        by_node.setdefault(r.node, []).append(r.d1)
    assert sorted(sorted(x) for x in by_node.values()) == [[1, 2], [1, 3]]


def test_sifted_and_without(spark):
    """Sifting marks all looked-for rows and few others; what is left without them equals an anti join, nulls stay."""
    table = spark.range(20_000).select(F.expr("nullif(id % 10000, 7)").alias("doc_id"), F.col("id").cast("string").alias("_mark"))
    ids = spark.range(0, 10_000, 7).select(F.col("id").alias("doc_id"))
    marked = frames.sifted(table, ids, "likely")
    assert marked.columns == [*table.columns, "likely"] and marked.count() == 20_000
    assert marked.where("NOT likely").join(ids, "doc_id").count() == 0
    assert marked.where("likely").count() < 2 * ids.count() + 200
    want = table.join(ids, "doc_id", "left_anti").select(*table.columns)
    got = frames.without(table, ids)
    assert got.columns == table.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert not want.where("doc_id IS NULL").isEmpty()
    assert frames.without(table, ids.limit(0)).count() == table.count()
    twice = table.select("doc_id", F.length("_mark").alias("size"))
    pairs = twice.where("doc_id % 3 = 0").distinct()
    assert frames.without(twice, pairs).exceptAll(twice.join(pairs, ["doc_id", "size"], "left_anti")).isEmpty()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (5, 400)]
    got = dict(neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(31)) and got[400] == 0 and got[150] == got[200] == 100


# -- op5 ---------------------------------------------------------------------------------------


def test_top_k_with_repeated_ids(spark):
    rows = [(i, [float(i), 1.0]) for i in range(12)] + [(11, [11.0, 1.0]), (11, [0.5, 0.25]), (0, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    x = {i: np.floor(256 * np.array(v)) for i, v in rows}
    x[11] = min((np.floor(256 * np.array(v)) for i, v in rows if i == 11), key=lambda v: v.tobytes())
    want = {}
    for q in (0, 10):
        best = sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    got = topk.search(table, F.col("vec_id") % 10 == 0, sample=100).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert topk.search(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 8)], "x") for i in range(300)]
    rows += [(i, [0.5] * 8, "same") for i in range(300, 340)]
    rows += [(900, None, ""), (950, [0.1] * 7 + [float("nan")], ""), (1000, [0.1] * 7 + [None], ""), (1050, [0.1] * 7, ""), (1100, [float("inf")] * 8, ""), (None, [0.1] * 8, "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    got = topk.search(table, F.col("vec_id") % 50 == 0, sample=100)
    x = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows[:340]}
    want = set()
    for q in x:
        if q % 50 == 0:
            best = sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want
    few = topk.search(table.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank) for r in sorted(few)] == [(0, 1), (0, 2)]
    assert topk.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# -- op6 ---------------------------------------------------------------------------------------


def winnow(text: str, gram: int, window: int) -> list[int]:
    """Positions by the definition: rightmost smallest hash of every window."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(points) - gram + 1 if len(points) >= gram else min(len(points), 1)
    at = np.arange(n)
    hashes = (frames.span_hashes(points, at, np.minimum(at + gram, len(points))) >> np.uint64(32)).tolist()
    picked = []
    for k in range(max(n - window + 1, min(n, 1))):
        own = range(k, min(k + window, n))
        best = min(own, key=lambda i: (hashes[i], -i))
        if not picked or picked[-1] != best:
            picked.append(best)
    return picked


@pytest.mark.parametrize(("gram", "window"), [(24, 77), (5, 4), (1, 1)])
def test_winnowing(docs, texts, gram, window):
    rows = winnowing.fingerprints(docs, gram=gram, window=window).where("doc_id IS NOT NULL").collect()
    for r in rows:
        assert r.positions == winnow(texts[r.doc_id] or "", gram, window)


def test_winnowing_guarantee():
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(20):
        common = make(winnowing.GRAM + winnowing.WINDOW - 1)
        both = [make(rng.randint(0, 300)) + common + make(rng.randint(0, 300)) for _ in range(2)]
        found = []
        for text in both:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            found.append(set(winnowing.select(points, np.array([0, len(points)]))[0].tolist()))
        assert found[0] & found[1]


def test_edited_short_texts(spark):
    """Half of a short text is kept, and its fingerprint tells; the next text is another."""
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(54, 140)))) for i in range(200)]
    got = winnowing.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 200 and all(r.near_edited > 0 and r.near_next < 0.1 for r in got)
    assert sum(r.near_edited for r in got) > 0.2 * len(got)


def test_edited_matches_brute_force(spark, docs, texts):
    """Fingerprints of both texts and both measures of likeness, from the definition."""

    def hashes(text: str) -> list[int]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return [
            int(frames.span_hashes(points, np.array([k]), np.array([min(k + winnowing.GRAM, len(points))]))[0] >> np.uint64(32))
            for k in winnow(text, winnowing.GRAM, winnowing.WINDOW)
        ]

    def alike(a: list[int], b: list[int]) -> float:
        return len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0

    own = {i: t or "" for i, t in texts.items()}
    order = sorted(own, reverse=True)
    rows = winnowing.edited(spark.createDataFrame(list(own.items()), "doc_id long, text string")).collect()
    assert len(rows) == len(own)
    for r in rows:
        text, after = own[r.doc_id], own[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(text) // 2
        a, b, c = hashes(text), hashes(text[: len(text) - half] + after[:half]), hashes(after)
        assert r.fingerprint == "".join(f"{x:08x}" for x in a) and r.edited_fingerprint == "".join(f"{x:08x}" for x in b)
        assert (r.near_edited, r.near_next) == pytest.approx((alike(a, b), alike(a, c)))


def test_edited(docs, empty, texts):
    got = {r.doc_id: r for r in winnowing.edited(docs).where("doc_id IS NOT NULL").collect()}
    order = sorted([*texts, 10], reverse=True)
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        if i == 10:
            continue
        half = len(own) // 2
        assert (got[i].n_chars, got[i].edited_sha256) == (len(own), sha((own[: len(own) - half] + after[:half]).encode()))
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[44].fingerprint == got[45].fingerprint and got[45].near_next == 1 and got[41].fingerprint == ""
    assert winnowing.edited(docs).count() == docs.count()
    assert winnowing.edited(docs.where("doc_id = 3")).first().near_next == 1
    assert winnowing.edited(empty).count() == 0


# -- op7, op8, op9 -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks(queries.vocabulary_file("byte_bpe_50k.tiktoken")).splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_random(encoding):
    rng = random.Random(1)
    alphabet = list("ab st'remvldé日1２ \n\t  !?'' \x1c\x85ʼ́٣Ⅷ😀")
    many = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    many += ["", "'s", "it's we'll I'd'", "  a", "a  ", "\n\n x", " 's'll", "'", " ' "]
    vocab = bpe.vocabulary(bpe.read_ranks(queries.vocabulary_file("byte_bpe_50k.tiktoken")))
    ids, before = vocab.encode(frames.Texts(pa.array(many)))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(before.tolist())] == [encoding.encode_ordinary(t) for t in many]


def test_bpe_tables(docs, empty, texts, encoding):
    path = queries.vocabulary_file("byte_bpe_50k.tiktoken")
    for r in bpe.decode(bpe.encode(docs, path), path).where("doc_id IS NOT NULL").collect():
        ids = encoding.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == ids and bytes(r.bytes) == (texts[r.doc_id] or "").encode()
        assert r.ids_sha256 == sha(np.array(ids, "<u4").tobytes())
        assert r.ends == list(itertools.accumulate(len(encoding.decode_single_token_bytes(i)) for i in ids))
    assert bpe.decode(bpe.encode(empty, path), path).count() == 0


def test_packing(docs, empty, texts, encoding):
    path = queries.vocabulary_file("byte_bpe_50k.tiktoken")
    rows = packing.pack(packing.cut(docs, path, capacity=256), capacity=256).collect()
    want = collections.Counter()
    for i, t in [*texts.items(), (10, texts[10]), (None, texts[44])]:
        ids = [*encoding.encode_ordinary(t or ""), 0]
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    full = collections.defaultdict(list)
    for r in rows:
        full[r.sequence_id].append((r.offset, r.length))
    for placed in full.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack(packing.cut(empty, path)).count() == 0


def test_packing_plan():
    rng = random.Random(5)
    for sizes in ([rng.randint(1, 2048) for _ in range(30_000)], [600] * 5000 + [1400] * 5000, [1025] * 999, [1] * 10, [2048, 2048]):
        histogram = collections.Counter(sizes)
        plan = packing.plan(histogram)
        used = collections.Counter()
        for lengths, times in plan:
            assert sum(lengths) <= 2048
            for k in lengths:
                used[k] += times
        assert used == histogram
        large = sum(s > 1024 for s in sizes)
        assert sum(t for _, t in plan) <= 1.005 * max(large, -(-sum(sizes) // 2048)) + 1


def test_packing_program_beats_best_fit():
    rng = random.Random(5)
    triples = collections.Counter(rng.choice([400, 500, 600, 700, 748, 848, 950]) for _ in range(3000))
    for histogram in (triples, collections.Counter({683: 3000, 682: 3000, 1000: 2000, 500: 1500, 341: 900, 900: 1000, 450: 3000, 248: 900})):
        whole, program, rest = packing.settled(histogram)
        alone = packing._best_fit(dict(histogram), 2048)
        used = collections.Counter()
        for lengths, times in program + rest:
            assert sum(lengths) <= 2048
            used.update({k: times * n for k, n in collections.Counter(lengths).items()})
        assert used == histogram and not whole
        assert sum(n for _, n in program + rest) < sum(n for _, n in alone)
        assert sum(n for _, n in program) > 0.5 * sum(n for _, n in program + rest)


def test_packing_program_settles_documents():
    """Lengths spread as those of documents are: nearly all sequences come from the program."""
    rng = random.Random(11)
    histogram = collections.Counter(min(2047, 1 + int(rng.lognormvariate(5.5, 1.0))) for _ in range(8000))
    _, program, rest = packing.settled(histogram)
    total = sum(n for _, n in program + rest)
    assert total <= sum(n for _, n in packing._best_fit(dict(histogram), 2048))
    assert sum(n for _, n in program) >= 0.9 * total


def test_packing_matches_its_library(spark, docs, texts):
    """Piece lengths and checksums from the tokenizers library and the JSON file."""
    import tokenizers

    own = tokenizers.Tokenizer.from_file(queries.vocabulary_file("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    rows = packing.cut(docs.where("doc_id IS NOT NULL"), queries.vocabulary_file("byte_bpe_50k.tiktoken")).where("doc_id <> 10").collect()
    found = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.piece):
        found[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for i, pieces in found.items():
        ids = [*own.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        assert sum(n for _, n, _ in pieces) == len(ids)
        assert all(crc == zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for a, n, crc in pieces)


def test_token_files(spark, docs, empty, texts, tmp_path):
    from tokenizers import Tokenizer

    source = queries.vocabulary_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(source)
    tokenizer.encode_special_tokens = True
    tokenfiles.write(docs, source, str(tmp_path / "a"), length=64, rows=2)
    got = tokenfiles.read(spark, str(tmp_path / "a"), docs.schema["doc_id"].dataType).orderBy("start").collect()
    order = [None, *sorted([*texts, 10])]
    stream: list[int] = []
    for i, r in zip(order, got, strict=True):
        ids = [*tokenizer.encode(texts[44 if i is None else i] or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, len(stream), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        stream += ids
    shard = spark.read.parquet(str(tmp_path / "a/manifest")).orderBy("shard").first()
    ids, mask = tokenfiles.sequence(str(tmp_path / "a"), shard["name"], 3, rows=2)
    assert ids.tolist() == stream[192:256] and mask.all()
    last = (shard["n_ids"] - 1) // 64
    assert tokenfiles.sequence(str(tmp_path / "a"), shard["name"], last, rows=2)[1].sum() == shard["n_ids"] - 64 * last
    tokenfiles.write(empty, source, str(tmp_path / "b"))
    assert tokenfiles.read(spark, str(tmp_path / "b"), docs.schema["doc_id"].dataType).count() == 0


def test_word_encoder_random():
    from tokenizers import Tokenizer

    source = queries.vocabulary_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(source)
    tokenizer.encode_special_tokens = True
    with open(source, encoding="utf-8") as file:
        encoder = tokenfiles.WordEncoder(file.read())
    rng = random.Random(6)
    alphabet = list("abSTé'sreÀß×÷日1２² \n\t!?ΣİŒ́ \x1c<|>")
    many = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    many += ["<|endoftext|>", "<|startoftext|> x", "don't WE'LL", ""]
    ids, before = encoder.encode(frames.Texts(pa.array(many)))
    want = [e.ids for e in tokenizer.encode_batch(many, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(before.tolist())] == want
