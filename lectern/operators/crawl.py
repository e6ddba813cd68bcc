"""Robots verdicts, the discovery winner of each college, and bounded walks over stored links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import web
from lectern.operators.lineage import cut
from lectern.operators.ranks import first_rows

# Longest robots file read, and the scores and limits of discovery and crawl.
LONGEST_ROBOTS = 500_000
GOOD_SCORE, SEARCH_SCORE, LOWEST_SCORE, SURE_SCORE = 70, 40, 30, 90
LOW_CONFIDENCE, TRUSTED_SCORE = 0.4, 60
SHORTEST_PAGE = 500
MAX_PAGES, MAX_DEPTH, SEEN_PER_PAGE = 25, 2, 12


def robots_rules(robots: DataFrame, own_name: str, longest: int | None = None) -> DataFrame:
    """Rules that bind us at each origin: those of our own name, else those of everyone.

    ``robots``: origin, body. One origin's file is one group; ``longest`` leaves out longer files
    (``LONGEST_ROBOTS`` is the site's preset).
    """
    lines = (
        robots.filter(F.lit(True) if longest is None else F.length("body") <= longest)
        .select("origin", F.posexplode(F.split("body", "\n")).alias("n", "raw"))
        .withColumn("line", F.trim(F.regexp_replace("raw", r"#.*$|\r", "")))
        .filter(F.contains("line", F.lit(":")))
        .select(
            "origin",
            "n",
            F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"),
            F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"),
        )
    )
    running = Window.partitionBy("origin").orderBy("n")
    agent = F.last(F.when(F.col("key") == "user-agent", F.lower("value")), ignorenulls=True)
    named = lines.withColumn("agent", agent.over(running)).withColumn(
        "own", F.contains("agent", F.lit(own_name.lower()))
    )
    seen_own = named.groupBy("origin").agg(F.bool_or("own").alias("has_own"))
    rules = named.filter(F.col("key").isin("allow", "disallow") & (F.col("value") != ""))
    binding = rules.join(seen_own, "origin").filter(
        F.col("own") | (~F.coalesce("has_own", F.lit(False)) & (F.col("agent") == "*"))
    )
    return binding.select(
        "origin", (F.col("key") == "allow").alias("allow"), F.col("value").alias("rule")
    )


def _rule_holds(path: Column, rule: Column) -> Column:
    """Prefix match with ``*`` for anything and a closing ``$`` for the end."""
    # Fixed value: a question mark is not escaped, so it acts on the sign before it.
    escaped = F.regexp_replace(rule, r"[.+^${}()|\[\]\\]", r"\\$0")
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r"\*", ".*"), r"\\\$$", r"\$"))
    unreadable = rule.rlike(r"^\?|[^*?]\?{3,}|\*\?{2,}")
    return (
        F.when(rule == "/", True)
        .when(unreadable, F.startswith(path, rule))
        .otherwise(F.regexp_like(path, pattern))
    )


def _literal(rule: Column) -> Column:
    """What every path that the rule holds for begins with: the rule up to its first sign with a meaning.

    A question mark makes the sign before it optional, so that one is left out too.
    """
    plain = F.regexp_extract(F.regexp_replace(rule, r"\$$", ""), r"^(?:[^*?](?!\?))*", 0)
    return F.when(rule == "/", "").otherwise(plain)


# Copies of an origin's rules, among which the addresses of a busy site are dealt.
RULE_SALTS = 16


def robots_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether each address may be fetched: the longest rule wins, allow on ties, else yes.

    Rules and addresses meet by equal origin and literal beginning. An address is cut only at the lengths that its
    site's rules have, so it meets the rules that begin as it does and no others; wildcards are then tried on
    those. Each distinct path is judged once.
    """
    place = F.concat(web.path(F.col("url")), F.regexp_extract("url", r"^[^?#]*(\?[^#]*)", 1))
    at = urls.withColumns({"origin": web.origin(F.col("url")), "place": place})
    begun = rules.select("origin", "rule", "allow").distinct().withColumn("begins", _literal(F.col("rule")))
    # As many numbers as the site's longest rule has letters, at most.
    lengths = begun.groupBy("origin").agg(F.collect_set(F.length("begins")).alias("lengths"))
    cuts = F.filter("lengths", lambda n: n <= F.length("place"))
    salt = F.pmod(F.xxhash64("place"), F.lit(RULE_SALTS)).cast("int")
    parts = (
        at.filter("origin IS NOT NULL")
        .select("origin", "place")
        .distinct()
        .join(lengths, "origin")
        .select("origin", "place", F.explode(F.transform(cuts, lambda n: F.substring(F.col("place"), F.lit(1), n))).alias("begins"))
        .withColumn("salt", salt)
    )
    dealt = begun.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(RULE_SALTS - 1))))
    met = parts.join(dealt, ["origin", "salt", "begins"])
    holds = (F.col("rule") == F.col("begins")) | _rule_holds(F.col("place"), F.col("rule"))
    best = (
        met.filter(holds)
        .groupBy("origin", "place")
        .agg(F.max(F.struct(F.length("rule").alias("size"), "allow")).alias("best"))
        .select("origin", "place", F.col("best.allow").alias("allow"))
    )
    return (
        at.join(best, ["origin", "place"], "left")
        .withColumn("allowed", F.col("origin").isNotNull() & F.coalesce("allow", F.lit(True)))
        .select(*urls.columns, "allowed")
    )


STAGES = {"heuristic": 0, "sitemap": 1, "homepage": 2, "search": 3}


def discovery_winner(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Catalog address of each college, or no row when none is good enough.

    ``candidates``: college_id, via, place, url, status, size, allowed, score. They count in
    order of stage and place; nothing after a page of 70 is looked at, and the search stage
    only opens when no page at all could be read. ``verdicts``: college_id, is_catalog, raw.
    """
    stage = F.create_map(*[F.lit(v) for kv in STAGES.items() for v in kv])
    order = F.struct(stage[F.col("via")].alias("stage"), F.col("place"))
    readable = (
        F.col("allowed")
        & (F.col("status") < 400)
        & (F.coalesce("size", F.lit(0)) >= SHORTEST_PAGE)
    )
    rest = ["via", "place", "status", "size", "allowed", "score"]
    once = candidates.groupBy("college_id", "url").agg(
        F.min_by(F.struct(*rest), order).alias("first")
    )
    pages = (
        once.select("college_id", "url", "first.*")
        .filter(F.coalesce(readable, F.lit(False)))
        .withColumn("order", order)
    )
    searched = F.col("via") == "search"
    stops = pages.groupBy("college_id").agg(
        F.min(F.when(~searched & (F.col("score") >= GOOD_SCORE), F.col("order"))).alias("stop"),
        F.min(F.when(searched & (F.col("score") >= SEARCH_SCORE), F.col("order"))).alias("search_stop"),
        F.bool_and(searched).alias("only_search"),
    )
    looked_at = pages.join(stops, "college_id").filter(
        (~searched & (F.col("stop").isNull() | (F.col("order") <= F.col("stop"))))
        | (
            searched
            & F.col("only_search")
            & (F.col("search_stop").isNull() | (F.col("order") <= F.col("search_stop")))
        )
    )
    best = (
        looked_at.groupBy("college_id")
        .agg(
            F.max_by(
                F.struct("url", "via", "score"),
                F.struct("score", -F.col("order.stage"), -F.col("place")),
            ).alias("best")
        )
        .select("college_id", "best.*")
        .filter(F.col("score") >= LOWEST_SCORE)
    )
    given = web.confidence(F.col("is_catalog"), F.col("raw"))
    return (
        best.join(verdicts, "college_id", "left")
        .withColumn("confidence", F.when(F.col("score") >= SURE_SCORE, 1.0).otherwise(given))
        .filter((F.col("confidence") >= LOW_CONFIDENCE) | (F.col("score") >= TRUSTED_SCORE))
        .select("college_id", "url", "via", "score", "confidence")
    )


def bounded_crawl(
    seeds: DataFrame,
    pages: DataFrame,
    links: DataFrame,
    max_depth: int = MAX_DEPTH,
    max_pages: int = MAX_PAGES,
    seen_per_page: int = SEEN_PER_PAGE,
    include: str | None = None,
) -> DataFrame:
    """Breadth-first walk from each seed over stored links, one join per level.

    ``seeds``: seed. ``pages``: url of every page that can be read. ``links``: url, n, href in
    page order. Pages count in the order the walk meets them, up to ``max_pages`` a seed;
    addresses stay on the seed's host and are met once, up to ``seen_per_page`` per allowed page.
    """
    most_seen = max_pages * seen_per_page + 1
    target = web.drop_fragment(F.col("href"))
    edges = links.select("url", "n", target.alias("href")).filter("href is not null")
    if include:
        edges = edges.filter(F.col("href").rlike(f"(?i){include}"))
    # Reading links costs more than the walk; every level meets them again.
    edges = cut(edges)
    known = pages.select("url").distinct()
    frontier = seeds.select("seed", F.col("seed").alias("url"), F.lit(1).alias("order"))
    seen = frontier.select("seed", "url")
    walked = None
    for depth in range(max_depth + 1):
        readable = frontier.join(known, "url")
        if walked is None:
            room = F.lit(max_pages)
            level = readable
        else:
            used = walked.groupBy("seed").agg(F.count(F.lit(1)).alias("used"))
            level = readable.join(used, "seed", "left")
            room = F.lit(max_pages) - F.coalesce("used", F.lit(0))
        level = first_rows(level, ["seed"], [F.asc("order")], max_pages, "place")
        fetched = cut(level.filter(F.col("place") <= room).select("seed", "url", "order"))
        here = fetched.withColumn("depth", F.lit(depth))
        walked = here if walked is None else walked.unionByName(here)
        if depth == max_depth:
            break
        met = (
            fetched.join(edges, "url")
            .filter(web.host(F.col("href")) == web.host(F.col("seed")))
            .groupBy("seed", F.col("href").alias("url"))
            .agg(F.min(F.struct("order", "n")).alias("first_met"))
            .join(seen, ["seed", "url"], "left_anti")
        )
        placed = first_rows(met, ["seed"], [F.asc("first_met")], most_seen, "order")
        so_far = seen.groupBy("seed").agg(F.count(F.lit(1)).alias("so_far"))
        frontier = cut(
            placed.join(so_far, "seed")
            .filter(F.col("order") <= most_seen - F.col("so_far"))
            .select("seed", "url", "order")
        )
        seen = seen.unionByName(frontier.select("seed", "url"))
    return walked.select("seed", "url", "depth", "order")
