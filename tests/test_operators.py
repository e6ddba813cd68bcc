"""Operators whose order matters, against plain loops on small data, and hot groups."""

import itertools
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import catalog, costs, crawl, dedupe, quota, ranks, search, similarity, writes
from lectern.plans import assess
from lectern.sources import markup, pages


def greedy_loop(items, seeds=()):
    """items: (grp, pos, tokens) in any order."""
    seen, out = {}, {}
    for grp, tokens in seeds:
        seen.setdefault(grp, []).append(set(tokens))
    for grp, pos, tokens in sorted(items):
        mine = set(tokens)
        if not mine:
            out[grp, pos] = False
            continue
        close = any(o and len(mine & o) / len(mine | o) > 0.8 for o in seen.get(grp, []))
        out[grp, pos] = not close
        if not close:
            seen.setdefault(grp, []).append(mine)
    return out


def random_items(rng, n, hot=True):
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(6, 14))] for _ in range(8)]
    items = []
    for pos in range(n):
        tokens = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            tokens[rng.randrange(len(tokens))] = f"w{rng.randrange(60)}"
        if rng.random() < 0.03:
            tokens = []
        items.append(("hot" if hot and rng.random() < 0.7 else "cold", pos, sorted(set(tokens))))
    return items


@pytest.mark.parametrize("leaders", [3, 64])
def test_greedy_filter_matches_loop(spark, monkeypatch, leaders):
    monkeypatch.setattr(dedupe, "LEADERS", leaders)
    rng = random.Random(leaders)
    items = random_items(rng, 220)
    seeds = [("hot", items[5][2]), ("cold", ["w1", "w2", "w3"])]
    df = spark.createDataFrame(items, "grp string, pos bigint, tokens array<string>")
    sd = spark.createDataFrame(seeds, "grp string, tokens array<string>")
    for given, frame in (((), None), (seeds, sd)):
        got = {(r.grp, r.pos): r.verdict == "kept" for r in dedupe.greedy_filter(df, "grp", "pos", "tokens", frame).collect()}
        assert got == greedy_loop(items, given)


def test_greedy_filter_rejected_items_block_nothing(spark):
    a = [f"t{i}" for i in range(20)]
    b = a[2:] + ["x1", "x2"]  # close to a
    c = b[4:] + ["y1", "y2"]  # close to b, not to a
    df = spark.createDataFrame([("g", 0, a), ("g", 1, b), ("g", 2, c), ("g", 3, a)], "grp string, pos int, tokens array<string>")
    got = {r.pos: r.verdict for r in dedupe.greedy_filter(df, "grp", "pos", "tokens").collect()}
    assert got == {0: "kept", 1: "near", 2: "kept", 3: "repeat"}


def test_greedy_filter_rounds_grow_by_logarithm(spark, monkeypatch):
    rounds = []
    settle = dedupe._settle
    monkeypatch.setattr(dedupe, "_settle", lambda *a: rounds.append(1) or settle(*a))
    rng = random.Random(3)
    items = [("g", i, ["shared", *sorted({f"w{rng.randrange(4000)}" for _ in range(5)})]) for i in range(600)]
    df = spark.createDataFrame(items, "grp string, pos bigint, tokens array<string>")
    got = {(r.grp, r.pos): r.verdict == "kept" for r in dedupe.greedy_filter(df, "grp", "pos", "tokens").collect()}
    assert got == greedy_loop(items) and len(rounds) <= 6


def test_upsert_takes_one_row_of_a_repeated_key(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    source = spark.createDataFrame([(1, "b"), (1, "c"), (2, "d"), (2, "d")], "k int, v string")
    assert sorted(tuple(r) for r in writes.upsert(target, source, ["k"], ["v"]).collect()) == [(1, "c"), (2, "d")]


def quota_loop(rows, plans, last=3):
    out = set()
    for key, plan in plans.items():
        held, room = [], dict(plan)
        for r in sorted(r for r in rows if r[0] == key):
            _, attempt, pos, kind, level, tokens = r
            mine = set(tokens)
            if len(held) >= plan["count"] or not mine:
                continue
            if any(len(mine & h) / len(mine | h) > 0.8 for h in held):
                continue
            if attempt != last and not (room[kind] > 0 and room[level] > 0):
                continue
            room[kind] -= 1
            room[level] -= 1
            held.append(mine)
            out.add((key, attempt, pos))
    return out


@pytest.mark.parametrize("turn", [7, 500])
def test_accept_by_quota_matches_loop(spark, monkeypatch, turn):
    monkeypatch.setattr(quota, "ROUND_CANDIDATES", turn)
    rng = random.Random(turn)
    rows = []
    for key in "abc":
        for g, pos, tokens in random_items(rng, 60, hot=False):
            rows.append((key, rng.randrange(1, 4), pos, rng.choice(list(quota.TYPE_MIX)), rng.choice(list(quota.DIFFICULTY_MIX)), tokens))
    df = spark.createDataFrame(rows, "set string, attempt int, pos int, type string, difficulty string, tokens array<string>")
    sets = spark.createDataFrame([("a", 10), ("b", 25), ("c", 40)], "set string, count int")
    plans = quota.with_mix(sets, "count")
    got = {(r.set, r.attempt, r.pos) for r in quota.accept_by_quota(df, plans, "set").collect()}
    assert got == quota_loop(rows, {r["set"]: r.asDict() for r in plans.collect()})


PLANS = {
    10: [(10, 7, 2, 1, 3, 5, 2)],
    25: [(25, 17, 4, 4, 8, 11, 6)],
    40: [(25, 19, 3, 3, 11, 9, 5), (15, 9, 3, 3, 1, 9, 5)],
    70: [(25, 18, 3, 4, 8, 11, 6), (25, 18, 4, 3, 9, 11, 5), (20, 13, 4, 3, 4, 10, 6)],
    100: [(25, 18, 4, 3, 8, 11, 6), (25, 18, 3, 4, 8, 11, 6), (25, 17, 4, 4, 7, 12, 6), (25, 17, 4, 4, 7, 11, 7)],
}


def test_batch_plans(spark):
    sets = spark.createDataFrame([(n, n) for n in PLANS], "set_id int, total int")
    rows = quota.batch_plans(sets, "set_id", "total").orderBy("set_id", "batch").collect()
    got = {n: [tuple(r[2:]) for r in rows if r.set_id == n] for n in PLANS}
    assert got == PLANS
    uneven = spark.createDataFrame([(1, 50)], "set_id int, total int")
    counts = [r["count"] for r in quota.batch_plans(uneven, "set_id", "total", 20).orderBy("batch").collect()]
    assert counts == [20, 20, 10]


def test_merge_lists_matches_loop(spark):
    rng = random.Random(3)

    def rows(n):
        return [("q", i, i, f"N{rng.randrange(4)}", f"T {rng.randrange(3)}", f"c{rng.randrange(4)}") for i in range(n)]

    schema = "query string, place int, course_id int, course_number string, title string, college_id string"
    for _ in range(3):
        a, b = rows(12), rows(12)
        seen, per, want = set(), {}, []
        for m in itertools.chain(a, b):
            key = (m[5], m[3], m[4].replace(" ", ""))
            if len(want) >= 6 or key in seen or per.get(m[5], 0) >= 2:
                continue
            seen.add(key)
            per[m[5]] = per.get(m[5], 0) + 1
            want.append((m[2], m[3], m[5]))
        got = search.merge_lists(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["query"], 6, 2)
        assert [(r.course_id, r.course_number, r.college_id) for r in got.orderBy("merged_place").collect()] == want


def test_number_rows_splits_a_group(spark):
    rows = [("hot", i // 7, i) for i in range(100)] + [("cold", 1, 5)]
    df = spark.createDataFrame(rows, "k string, day int, ts int")
    got = ranks.number_rows(df, ["k"], [F.asc("ts")], F.col("day"), "n").filter("k = 'hot'").collect()
    assert sorted((r.ts, r.n) for r in got) == [(i, i + 1) for i in range(100)]


def robots_loop(path, rules):
    import re

    verdict, best = True, -1
    for allow in (False, True):
        for a, rule in rules:
            if a != allow:
                continue
            pattern = re.sub(r"[.+^${}()|\[\]\\]", lambda m: "\\" + m.group(0), rule).replace("*", ".*")
            pattern = re.sub(r"\\\$$", "$", pattern)
            if (rule == "/" or re.match(pattern, path)) and (len(rule) > best or (allow and len(rule) == best)):
                verdict, best = allow, len(rule)
    return verdict


def test_robots(spark):
    body = "\n".join(
        ["User-agent: *", "Disallow: /private", "Allow: /private/open", "Disallow: /*.pdf$", "Disallow: /a+b", "Disallow: /same", "Allow: /same", "# Disallow: /"]
    )
    own = "User-agent: *\nDisallow: /\nUser-agent: Campus-Reader\nUser-agent: x\nDisallow: /x\nUser-agent: campus-reader/2\nDisallow: /only\nUser-agent: *\nDisallow: /late"
    robots = spark.createDataFrame([("https://a.edu", body), ("https://b.edu", own), ("https://c.edu", "x" * 500_001)], "origin string, body string")
    rules = crawl.robots_rules(robots, "campus-reader")
    plain = [(False, "/private"), (True, "/private/open"), (False, "/*.pdf$"), (False, "/a+b"), (False, "/same"), (True, "/same")]
    paths = ["/private/x", "/private/open/1", "/f.pdf", "/f.pdf?x=1", "/a+b", "/aab", "/same", "/"]
    urls = [("https://a.edu" + p, robots_loop(p, plain)) for p in paths]
    urls += [("https://b.edu/only/1", False), ("https://b.edu/x", True), ("https://b.edu/late", True), ("https://c.edu/q", True), ("junk", False)]
    df = spark.createDataFrame(urls, "url string, want boolean")
    got = {r.url: r.allowed for r in crawl.robots_verdicts(df, rules).collect()}
    assert got == dict(urls)


def crawl_loop(seed, graph, max_pages=25, depth=2):
    out, seen, frontier = [], {seed}, [(seed, 0)]
    while frontier and len(out) < max_pages:
        later = []
        for url, d in frontier:
            if len(out) >= max_pages:
                break
            if url not in graph:
                continue
            out.append((url, d))
            if d >= depth:
                continue
            for link in graph[url]:
                if len(seen) > max_pages * 12:
                    break
                if link not in seen:
                    seen.add(link)
                    later.append((link, d + 1))
        frontier = later
    return out


@pytest.mark.parametrize("limit", [2, 25])
def test_bounded_crawl_matches_loop(spark, limit):
    rng = random.Random(limit)
    url = "https://h.edu/{}".format
    graph = {url(i): [url(rng.randrange(90)) for _ in range(30)] for i in range(60)}
    links = spark.createDataFrame([(u, n, h) for u, hs in graph.items() for n, h in enumerate(hs)], "url string, n int, href string")
    stored = spark.createDataFrame([(u,) for u in graph], "url string")
    seeds = [url(0), url(7), url(80)]
    sd = spark.createDataFrame([(s,) for s in seeds], "seed string")
    rows = crawl.bounded_crawl(sd, stored, links, max_pages=limit).collect()
    for s in seeds:
        got = [(r.url, r.depth) for r in sorted((r for r in rows if r.seed == s), key=lambda r: (r.depth, r.order))]
        assert got == crawl_loop(s, graph, limit)


def test_similar_for_all_with_many_blocks(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 16))
    vectors = [(i, i % 5, (centres[0 if i < 60 else i % 3] + 0.4 * rng.normal(size=16)).tolist()) for i in range(150)]
    df = spark.createDataFrame(vectors, "course_id int, college_id int, embedding array<float>")
    got = similarity.similar_for_all(df, 0.5, 2, 6, nearest=40, block_rows=8)
    unit = np.array([np.array(v[2], dtype=np.float32).astype(float) for v in vectors])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cos = unit @ unit.T
    want = {}
    for i in range(150):
        near = sorted((j for j in range(150) if j % 5 != i % 5), key=lambda j: (-cos[i, j], j))[:40]
        per, kept = {}, []
        for j in near:
            if cos[i, j] >= 0.5 and per.get(j % 5, 0) < 2 and len(kept) < 6:
                per[j % 5] = per.get(j % 5, 0) + 1
                kept.append(j)
        want[i] = kept
    rows = got.orderBy("course_id", "place").collect()
    have = {i: [r.other_id for r in rows if r.course_id == i] for i in range(150)}
    assert have == want


@pytest.mark.parametrize("null", [False, True])
def test_similar_for_all_copies_no_vectors_and_loses_none(spark, null):
    rng = np.random.default_rng(6)
    vectors = [(i, None if null and i % 9 == 0 else i % 5, rng.normal(size=8).tolist()) for i in range(200)]
    df = spark.createDataFrame(vectors, "course_id int, college_id int, embedding array<float>")
    conf = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = similarity.similar_for_all(df, 0.2, 2, 6, block_rows=8)
        # Neither a copy of each vector for each block it meets, nor a join of rows.
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = got.orderBy("course_id", "place").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    unit = np.array([np.array(v[2], dtype=np.float32).astype(float) for v in vectors])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cos = unit @ unit.T
    college = [v[1] for v in vectors]
    for i in range(200):
        per, kept = {}, []
        for j in sorted(range(200), key=lambda j: (-cos[i, j], j)):
            other = i != j and (college[i] is None or college[i] != college[j])
            if other and cos[i, j] >= 0.2 and per.get(college[j], 0) < 2 and len(kept) < 6:
                per[college[j]] = per.get(college[j], 0) + 1
                kept.append((j, college[j]))
        assert [(r.other_id, r.other_college) for r in rows if r.course_id == i] == kept
    assert "Generate explode" not in plan


def test_run_costs_by_scope(spark):
    runs = [(1, None, None, "a", 0, 100), (2, "t", None, "a", 50, 200), (3, None, None, None, 0, 60)]
    ledger = [(None, None, "a", 10, 1.0), ("t", None, "a", 60, 2.0), (None, None, "b", 50, 4.0), ("t", None, "a", 201, 8.0)]
    r = spark.createDataFrame(runs, "run_id int, test_set_id string, course_id string, college_id string, s int, f int").select(
        "*", F.timestamp_seconds("s").alias("started_at"), F.timestamp_seconds("f").alias("finished_at")
    )
    u = spark.createDataFrame(ledger, "test_set_id string, course_id string, college_id string, at int, c double").select(
        "*", F.timestamp_seconds("at").alias("created_at"), costs.money(F.col("c")).alias("cost"), F.lit(1).alias("total_tokens")
    )
    got = {x.run_id: float(x.run_cost) for x in costs.run_costs(r, u).collect()}
    assert got == {1: 3.0, 2: 2.0, 3: 7.0}


def test_unique_codes_and_duplicates(spark):
    df = spark.createDataFrame([("s", "CS", 0), ("s", "CS", 1), ("s", "EE", 2)], "site string, code string, n int")
    assert sorted(r.code for r in catalog.unique_codes(df, ["site"], "n").collect()) == ["CS", "CS2", "EE"]
    rows = [("p", 0, "CS 1", "a", "short"), ("p", 1, "cs-1", "b", "longer text"), ("p", 2, "CS1", "c", "longer text")]
    df = spark.createDataFrame(rows, "page_id string, n int, course_number string, title string, description string")
    assert [r.title for r in catalog.dedupe_by_number(df, ["page_id"], "n").collect()] == ["b"]


def test_upsert_and_toggle(spark):
    target = spark.createDataFrame([(1, "a", "keep"), (2, "b", "keep")], "k int, v string, s string")
    source = spark.createDataFrame([(2, "B", "new"), (3, "c", "new")], "k int, v string, s string")
    got = {tuple(r) for r in writes.upsert(target, source, ["k"], ["v"]).collect()}
    assert got == {(1, "a", "keep"), (2, "B", "keep"), (3, "c", "new")}
    stars = spark.createDataFrame([("u", 1), ("u", 2)], "user string, item int")
    presses = spark.createDataFrame([("u", 1), ("u", 3), ("u", 2), ("u", 2)], "user string, item int")
    assert {tuple(r) for r in writes.toggle(stars, presses, ["user", "item"]).collect()} == {("u", 2), ("u", 3)}


def block(*fields: str) -> str:
    return '<div class="courseblock">' + "".join(fields) + "</div>"


def mark(kind: str, text: str, tag: str = "span") -> str:
    return f'<{tag} class="{kind}">{text}</{tag}>'


def test_course_block_layouts(spark):
    tagged = block(
        mark("detail-code", "<b>KELP 310.</b>"),
        mark("detail-title", "Tidal Gardens."),
        mark("detail-hours_html", "(2 Units)"),
        mark("courseblockextra", "How kelp grows.", "p"),
        mark("detail-prerequisites", "Prerequisite: KELP 200"),
    )
    plain = block(mark("courseblocktitle", "14.220 Bridges and Arches", "h4"), mark("courseblockprereq", "Prereq: None"), mark("courseblockdesc", "Load paths.", "p"))
    names = ", ".join(f"Teacher Nr{chr(65 + i)}" for i in range(12))
    long = block(mark("courseblocktitle", "QUAY 9, *Harbour Work,  1 Credit", "p"), mark("courseblockinstructors", names), mark("courseblockdesc", "word " * 3000, "p"))
    df = spark.createDataFrame([(i, "https://h.edu/courses/x/", h) for i, h in enumerate([tagged, plain, long])], "page_id int, url string, html string")
    rows = pages.course_blocks(df, F.lit("")).orderBy("page_id").collect()
    assert [(r.course_number, r.title, r.credits, r.prerequisites) for r in rows] == [
        ("KELP 310", "Tidal Gardens", "2 Units", "KELP 200"),
        ("14.220", "Bridges and Arches", None, None),
        ("QUAY 9", "Harbour Work", "1 Credit", None),
    ]
    assert rows[0].description == "How kelp grows." and len(rows[2].instructors) == 12 and len(rows[2].description) > 14_000


def test_passages_of_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    many = "".join(block(mark("courseblocktitle", f"N{i}", "p"), "<p>same</p>") for i in range(500))
    df = spark.createDataFrame([(1, "u", deep), (2, "u", many), (3, "u", None)], "page_id int, url string, html string")
    got = {}
    for r in pages.block_passages(df).orderBy("page_id", "n").collect():
        got.setdefault(r.page_id, []).append(r.passage)
    assert got[1] == ["core"] and got[3] == [""]
    assert len(got[2]) == 1001 and got[2].count("same") == 1 and got[2][:3] == ["## N0", "N0", "same"]


def test_unique_codes_first_come(spark):
    rows = [(1, i, c) for i, c in enumerate(["CS", "CS", "CS2", "X" * 24, "X" * 24, "CS", "CS22", "CS2"])]
    df = spark.createDataFrame(rows, "page_id int, n int, code string")
    got = [r.code for r in catalog.unique_codes(df, ["page_id"], "n").orderBy("n").collect()]
    assert got == ["CS", "CS2", "CS22", "X" * 24, "X" * 23 + "2", "CS3", "CS222", "CS23"]


def test_search_table_form_equals_literal_form(spark):
    titles = ["Linear Algebra", "Introduction to Psychology", "Data Structures", "Machine Learning", "Seminar in C++", "Ökonomie I", "AI"]
    rows = [(i, f"CS {i}0{i % 3}", titles[i % len(titles)], f"u{i % 3}") for i in range(40)]
    df = spark.createDataFrame(rows, "course_id int, course_number string, title string, college_id string")
    queries = ["linear algebra", "cs 1", "CS100", "c++", "in", "ökonomie", "introduction to", "AI", "learn"]
    table = spark.createDataFrame([(q,) for q in queries], "query string")
    for mode in ("score", "exactness"):
        a = search.search_courses(df, queries, limit=25, per_college=3, rank_by=mode).collect()
        b = search.search_courses(df, table, limit=25, per_college=3, rank_by=mode).collect()
        assert sorted(map(str, a)) == sorted(map(str, b)) and a


def test_question_candidates_whole_texts(spark):
    """Proposed questions are whole texts: long ones are rejected, equal beginnings are no repeats."""
    start = "the same first sixty characters of every document of this test"
    rows = [(i, f"{start} {i}\nline {i}", "en", "web") for i in (2, 5, 8)] + [(14, f"{start}\n" + "x" * 1200, "en", "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    t = SimpleNamespace(read=lambda name: docs)
    verdicts = {r.verdict: r.questions for r in assess.validate_questions(t).collect()}
    assert verdicts == {"accepted": 3, "question must be 10 to 1200 long": 1}
    assert [r.repeated_stems for r in assess.question_mix(t).collect()] == [0]


def test_greedy_filter_moves_no_sets_between_tasks(spark, monkeypatch):
    """Whole sets are dealt out once; rounds move slim rows and read sets only of pairs that sketches leave."""
    rng = random.Random(4)
    base = [f"w{i:03d}" for i in range(120)]
    items = [("g", i, sorted({*rng.sample(base, 60), *(f"own{i}.{k}" for k in range(20))})) for i in range(60)]
    items += [("g", 100 + i, sorted({*items[i][2][2:], "x"})) for i in range(10)]
    met = []
    pairs = dedupe._pairs
    monkeypatch.setattr(dedupe, "_pairs", lambda *a: met.append(pairs(*a)) or met[-1])
    df = spark.createDataFrame(items, "grp string, pos bigint, tokens array<string>")
    got = {(r.grp, r.pos): r.verdict == "kept" for r in dedupe.greedy_filter(df, "grp", "pos", "tokens").collect()}
    assert got == greedy_loop(items)
    assert {(r.pos, r.leader) for r in met[0].collect()} == {(100 + i, i) for i in range(10)}


def test_greedy_filter_leaves_out_tokens_of_one_item_and_grows_fast(spark, monkeypatch):
    """Tokens that no other item holds make no bucket rows, buckets are keyed by one number, and few rounds reach a full bucket."""
    rng = random.Random(8)
    items = [(g, i, ["shared", *(f"own{g}{i}.{k}" for k in range(9)), *sorted({f"w{rng.randrange(300)}" for _ in range(4)})]) for g in "ab" for i in range(150)]
    items += [(g, 200 + i, [*t[:-1], "other"]) for g, i, t in items[::10]]
    rounds, made = [], []
    settle, buckets = dedupe._settle, dedupe._buckets
    monkeypatch.setattr(dedupe, "LEADERS", 4)
    monkeypatch.setattr(dedupe, "_settle", lambda *a: rounds.append(1) or settle(*a))
    monkeypatch.setattr(dedupe, "_buckets", lambda *a: made.append(buckets(*a)) or made[-1])
    df = spark.createDataFrame(items, "grp string, pos bigint, tokens array<string>")
    got = {(r.grp, r.pos): r.verdict == "kept" for r in dedupe.greedy_filter(df, "grp", "pos", "tokens").collect()}
    assert got == greedy_loop(items) and len(rounds) <= 3
    rows = made[0].collect()
    # Only the items that were copied and their near copies hold rare tokens together.
    assert {(r.grp, r.pos) for r in rows if r.rank < 2} <= {(g, p) for g, i, _ in items[:300:10] for p in (i, 200 + i)}
    assert {f.name: f.dataType.simpleString() for f in made[0].schema.fields}["bucket"] == "bigint"


def test_parity_sketches_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(5)
    for n in (3, 70, 700):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.union1d(a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, 4).astype(np.uint64))
        x, y = (dedupe._sketch(s, np.zeros(len(s), np.int64), np.array([8])) for s in (a, b))
        differ = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x ^ y)
        apart = len(np.setxor1d(a, b))
        assert differ <= apart and (apart - differ) % 2 == 0


def test_pages_read_once_give_every_reader_its_own_records(spark):
    """One table of records serves three readers, with the results each has when it reads the pages itself."""
    listed = (
        '<article class="search-courseresult"><h3>KITE {0}, Paths</h3><div class="courseblockdesc">Earns 3 credits.</div></article>'
        '<ul><li><a href="preview_course.php?id={0}">PROSE {0} - Drafts</a> Writing.</li></ul>'
        '<table><tr><td class="nttitle">BREW {0} - Study</td></tr><tr><td class="ntdefault">2 Credit hours</td></tr></table>'
    )
    rows = [(i, f"https://x.edu/{i}", listed.format(i)) for i in range(1, 6)] + [(6, "https://x.edu/6", None), (7, None, ""), (1, "https://x.edu/1", listed.format(1))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    once = pages.read_once(table, [markup.search_results, markup.listed_links, markup.title_cells], pages.RECORD)
    for read in (lambda p: pages.search_results(p, F.lit("KITE")), pages.listed_courses, pages.schedule_courses):
        got, want = (sorted(map(str, read(p).collect())) for p in (once, table))
        assert got == want and len(got) >= 5
    html = listed.format(3)
    assert markup.tree(root := markup.tree(html)) is root and [*markup.title_cells(root)] == [*markup.title_cells(html)]
