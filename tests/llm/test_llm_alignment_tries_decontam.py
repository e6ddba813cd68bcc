"""Operators 11 to 13 against brute force, on small tables with every odd case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import alignment, decontam, frames, neardup, queries, substring, tries

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


FILES = (queries.vocabulary_file("byte_bpe_50k.json"), queries.vocabulary_file("piece_bpe_32k.model"))

# -- op11 --------------------------------------------------------------------------------------


def brute_alignment(texts: list) -> list[tuple]:
    """Measures of every text in order, from token strings, pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.vocabulary_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary_file("piece_bpe_32k.model"))
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    back = {chr(x): x for x in shown}
    for x in range(256):
        if x not in shown:
            back[chr(256 + len(back) - len(shown))] = x
    out, links_of = [], []
    for t in texts:
        groups = []
        if t:
            ids = [a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)]
            spelled = [[bytes(back[c] for c in a.id_to_token(i)) for i in ids[0]]]
            spelled.append([bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]])
            if all(b"".join(s) == (" " + t).encode() for s in spelled):
                ends = [np.cumsum([len(w) for w in s]).tolist() for s in spelled]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                groups = [([], []) for _ in cuts]
                for side in (0, 1):
                    for i, e in zip(ids[side], ends[side], strict=True):
                        groups[next(k for k, c in enumerate(cuts) if e <= c)][side].append(i)
        links_of.append([(x, y) for g in groups for x in g[0] for y in g[1]])
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links_of[-1]), sha(text) if groups else ""))
    count = collections.Counter(p for links in links_of for p in set(links))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [
        (*row[:4], sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), row[4])
        for row, links in zip(out, links_of, strict=True)
    ]


TEXTS = [
    None, "", " ", "  ", "x", "Hello, world! It's 2024.", "Hello, world! It's 2024.", "tabs\tand\n\nnewlines\r\n  end ", "<|endoftext|> <s> <0x41> </s>",
    "Ünïcödé ｆｕｌｌ ﬁ ＡＢＣ é é 中文字符不分 日本語テキスト 한국어 😀🎉", "under▁score ▁", "nul\x00byte", "a" * 700, "of " * 500, "中" * 400, "Ω≈ç√∫˜µ≤≥÷", "　​  x",
]


def aligned(spark, texts, **more):
    rows = [(i, t, 5, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_A int, lot string").repartition(3)
    return alignment.measure(docs, *FILES, b_size=32_000, **more)


@pytest.mark.parametrize("lot", [1 << 20, 150])
def test_alignment_equals_pair_by_pair_counts(spark, lot):
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choices(["the ", "ing", "é", "中", " ", "\n", "Zürich", "0x", "ly ", "'s"], k=rng.randint(1, 60))) for _ in range(60)]
    found = aligned(spark, texts, lot=lot)
    assert found.columns == ["doc_id", "lot", *alignment.MEASURES]
    got = {r["doc_id"]: tuple(r[c] for c in alignment.MEASURES) for r in found.collect()}
    want = brute_alignment(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert got[10][0] == 0 and got[8][0] > 0


def test_alignment_of_no_documents(spark):
    assert aligned(spark, ["x"]).count() == 1
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.measure(docs, *FILES, b_size=32_000).collect() == []
    assert alignment.align(docs, *FILES).collect() == []


def test_aligned_groups_hold_the_ids_of_both_sides(spark):
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in alignment.align(docs, *FILES).collect():
        t = TEXTS[r["doc_id"]]
        assert sum(r["a_in_group"]) == len(r["a_ids"]) and sum(r["b_in_group"]) == len(r["b_ids"]) and len(r["a_in_group"]) == len(r["b_in_group"])
        if r["a_ids"]:
            assert r["a_ids"] == a.encode(" " + t, add_special_tokens=False).ids


def test_own_merging_equals_the_library_on_every_character(spark):
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    texts = [f"a{c}b {c}{c}1{c}" for c in map(chr, range(1, 0x30000)) if not 0xD800 <= ord(c) < 0xE000]
    with open(FILES[0], "rb") as file:
        ids, before = alignment.ByteLevel(file.read()).encode(texts)
    want = [e.ids for e in a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert ids.tolist() == [i for e in want for i in e]


def test_a_huge_group_is_expanded_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 40, 300), rng.integers(0, 30, 200)
    a_n, b_n, key = np.array([100, 1, 199]), np.array([1, 150, 49]), np.array([0, 0, 10**6])
    want = alignment.distinct_links(a, b, a_n, b_n, key, 1000)
    monkeypatch.setattr(alignment, "BLOCK", 60)
    got = alignment.distinct_links(a, b, a_n, b_n, key, 1000)
    count = collections.Counter()
    for s, t, u, v, k in ((0, 100, 0, 1, 0), (100, 101, 1, 151, 0), (101, 300, 151, 200, 10**6)):
        count.update(k + int(x) * 1000 + int(y) for x in a[s:t] for y in b[u:v])
    for pairs, times in (want, got):
        assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == count


def test_groups_are_the_common_boundaries():
    a, b = alignment.coalesce(np.array([2, 3, 1, 4]), np.array([5, 2, 2, 1]))
    assert a.tolist() == [0, 0, 1, 1] and b.tolist() == [0, 1, 1, 1]
    ids = np.array([10, 7, 0, 4]), np.array([123, 5, 6])
    assert alignment.groups_text(*ids, np.array([2, 1, 1]), np.array([1, 1, 1]), np.array([0, 2, 0, 1, 0])) == [b"", b"10,7|123;0|5", b"", b"4|6", b""]


def test_op11_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = dict(zip(texts, brute_alignment(list(texts.values())), strict=True))
    got = queries.op11_alignment(spark, folder).collect()
    assert {r["doc_id"]: tuple(r[c] for c in alignment.MEASURES) for r in got} == want and len(got) == len(texts)


# -- op12 --------------------------------------------------------------------------------------


def brute_trie(rows: list[tuple]) -> list[tuple]:
    """Nodes from rows (conv, turn, role, text) by spelling out every prefix."""
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "")
    own = collections.defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    out = []
    for p, of in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(BLANK_WORD.findall(q[-1][1])) for q in under if q)
        ends = sorted(c for c in of if len(rebuilt[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(of), len(p), parent, len(of), kids[p], sum(not kids[q] for q in under), saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def conversations() -> list[tuple]:
    rng = random.Random(11)
    say = ["yes", "no way", "", None, "tell me more please", "ok\tthen\nso", "x " * 400]
    rows = []
    for c in range(90):
        if c % 20 == 0 and c == 40:
            continue  # an absent base
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, ["user", "assistant", None][rng.randrange(3)] if rng.random() < 0.2 else "user", rng.choice(say[:2]) if rng.random() < 0.6 else rng.choice(say)))
    rows += [(200 + i, t, "user", f"copy {t}") for i in range(60) for t in range(5)]  # copies
    rows += [(300, t, "user", f"long {t}") for t in range(70)]  # one long conversation and its prefixes
    rows += [(c, t, "user", f"long {t}") for c in range(301, 330) for t in range(c - 300)]
    rows += [(41, None, None, None), (42, None, "user", "null first"), (None, 0, "user", "nobody"), (7, 2, "user", "same turn"), (7, 2, "tool", "same turn")]
    return rows


def trie_of(spark, rows, room):
    schema = "conv_id long, turn long, role string, text string, token string, words string"
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema).repartition(4)
    conv = F.col("conv_id")
    turns = tries.rebuilt(df, (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int"), conv - conv % 20)
    return tries.prefix_trie(turns, room=room)


@pytest.mark.parametrize("room", [100_000, 40, 1])
def test_trie_equals_spelled_out_prefixes(spark, room):
    rows = conversations()
    got = trie_of(spark, rows, room)
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_few_conversations(spark):
    assert trie_of(spark, [], 10).collect() == []
    one = trie_of(spark, [(3, 0, "user", "a b")], 10).collect()
    h = zlib.crc32(b"3") % 4
    assert len(one) == (2 if h == 0 else 1)


def test_long_lists_of_copies_are_packed_in_pieces(spark):
    rows = spark.range(1000).select(F.lit(b"k").alias("head"), F.col("id").alias("conv_id")).repartition(5)
    got = tries.end_digests(rows, piece=7).collect()
    assert [(bytes(r[0]), r[1]) for r in got] == [(b"k", sha(",".join(map(str, range(1000)))))]


# -- op13 --------------------------------------------------------------------------------------


def brute_decontam(texts: dict, items: list[tuple], length: int, coverage: float) -> dict:
    words_of = lambda t: WORD.findall("".join(c.lower() if c < "\x80" else c for c in t or ""))
    windows = collections.defaultdict(set)
    for name, text in items:
        w = words_of(text)
        if w:
            n = max(1, min(length, int(np.ceil(coverage * len(w)))))
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(name)
    out = {}
    for i, t in texts.items():
        w, hit, met = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    met |= windows[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), sorted(x for x in met if x is not None))
    return out


def contaminated() -> tuple[dict, list]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(9)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(str(i), say(rng.randint(1, 40))) for i in range(30)]
    items += [("100", "One two, three!"), ("101", "ONE TWO THREE four five"), ("102", None), ("103", " .;: "), ("7", items[3][1]), (None, "nobody lists me"), ("104", "ÄÖ äö 日本"), ("105", items[4][1])]
    items += [("106", "x1 " * 30), ("107", "solo")]
    texts = {i: say(rng.randint(0, 120)) for i in range(60)}
    texts |= {100: None, 101: "", 102: "--", 103: "say one-two three now", 104: "äö日本 ÄÖ äö 日本 solo", 105: "x1 " * 500, 106: "x1 x1 x1"}
    texts |= {107: say(3000), 108: "nobody lists me", 109: f"{say(5)}. {items[9][1].upper()}? {say(5)}", 110: "solo", 111: "solo solo"}
    return texts, items


@pytest.mark.parametrize("length,coverage,room", [(10, 1.0, 10_000), (3, 1.0, 10_000), (10, 0.3, 10_000), (10, 1.0, 120), (4, 0.5, 60)])
def test_decontamination_equals_window_search(spark, length, coverage, room):
    texts, items = contaminated()
    docs = spark.createDataFrame([(i, t, 3, "clash") for i, t in texts.items()], "doc_id long, text string, N_HIT int, _row string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontam.decontaminate(docs, bench, length=length, coverage=coverage, room=room)
    assert found.columns == ["doc_id", "text", "_row", *decontam.OUTPUTS]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert {i: (r["n_words"], r["n_hit"], r["items"]) for i, r in rows.items()} == brute_decontam(texts, items, length, coverage)
    for i, r in rows.items():
        words = WORD.findall((texts[i] or "").lower())
        cut = {k for s in r["spans"] for k in range(s["first"], s["end"])}
        assert len(cut) == r["n_hit"]
        assert WORD.findall((r["clean"] or "").lower()) == [w for k, w in enumerate(words) if k not in cut] or texts[i] is None


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("1", "a b c")], "item_id string, text string")
    kept = decontam.decontaminate(docs, bench.limit(0)).collect()
    assert [(r["n_words"], r["n_hit"], r["clean"]) for r in sorted(kept)] == [(3, 0, "a b c"), (0, 0, None)]
    assert decontam.decontaminate(docs.limit(0), bench).collect() == []


# -- word hashes -------------------------------------------------------------------------------


def swaps() -> list[str]:
    """Two words of 1,024 letters on which sums of powers modulo 2**64 agree."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return [word, word.translate(str.maketrans("ab", "ba"))]


def test_word_hashes_tell_words_apart():
    rng = random.Random(1)
    words = swaps() + ["".join(rng.choice("ab") for _ in range(rng.randint(20, 1100))) for _ in range(10_000)]
    words = sorted(set(words) | {"a" * n for n in range(1, 200)})
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    found = frames.word_hashes(data, starts, ends)
    assert len(np.unique(found)) == len(words)
    assert not len(np.intersect1d(found, frames.word_hashes(data, starts, ends, seed=1)))
    again = frames.word_hashes(np.frombuffer(b"xx" + words[5].encode(), np.uint8), np.array([2]), np.array([2 + len(words[5])]))
    assert again[0] == found[5]


def test_words_on_which_sums_of_powers_agree_stay_apart(spark):
    one, other = swaps()
    tail = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{one} p q"), (4, f"{other} p q")], "doc_id long, text string")
    for crowd in (1000, 0):
        assert {r["doc_id"]: r["n_removed"] for r in substring.remove(docs, crowd=crowd).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    groups = neardup.groups(docs.where("doc_id > 2"), words=3, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in groups} == {3: 3, 4: 4}


def test_run_hashes_tell_sequences_apart():
    one, other = ([w == "a" for w in s[:1500]] for s in swaps())
    words = frames.mix(np.array([[2, 1][x] for x in one + other], np.uint64))
    for length in (1, 2, 3, 5, 50, 64, 900):
        found = frames.run_hashes(words, length)
        assert len(found) == len(words) - length + 1
        runs = {words[i : i + length].tobytes() for i in range(len(found))}
        assert len(np.unique(found)) == len(runs)
