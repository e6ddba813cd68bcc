"""Course search by trigrams, distinctive words and course number."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import (
    GENERIC_TITLE_WORDS,
    SHORTHAND,
    bind,
    content_words,
    coverage,
    expand_shorthand,
    set_similarity,
    similarity,
    squash,
    trigram_sequence,
    trigrams,
    word_similarity_of,
)
from lectern.operators.lineage import cut
from lectern.operators.listing import optional
from lectern.operators.ranks import first_rows

# Thresholds of a match, of a kept row and of the exact-match decision.
SIMILAR, WORDS_SIMILAR = 0.3, 0.6
KEPT_SCORE, KEPT_EXACTNESS = 0.35, 0.5
SAME_COURSE, CERTAIN, MARGIN = 0.60, 0.85, 0.08
# Typed queries that are written into the plan; a longer list becomes a table, with the same result.
MAX_LITERAL_QUERIES = 64


def _python_trigrams(text: str) -> list[str]:
    grams: dict[str, None] = {}
    for word in re.findall(r"[^\W_]+", text.lower()):
        padded = f"  {word} "
        grams.update(dict.fromkeys(padded[i : i + 3] for i in range(len(word) + 1)))
    return list(grams)


def _query_struct(query: str) -> Column:
    term = query.strip()
    grams = [F.lit(g) for g in _python_trigrams(term)]
    words = F.array_sort(F.array(*[F.lit(w) for w in _python_content_words(term)]))
    return F.struct(
        F.lit(query).alias("query"),
        F.lit(term).alias("term"),
        F.lit(re.sub("[^a-zA-Z0-9]", "", term).lower()).alias("number"),
        (F.array(*grams) if grams else _no_text()).alias("grams"),
        words.cast("array<string>").alias("words"),
    )


def _no_text() -> Column:
    return F.array().cast("array<string>")


def _python_content_words(text: str) -> list[str]:
    words = re.split("[^a-z0-9]+", text.lower())
    kept = [w for w in words if len(w) > 1 and not w.isdigit() and w not in GENERIC_TITLE_WORDS]
    return list(dict.fromkeys(kept))


def _query_columns(queries: DataFrame) -> DataFrame:
    """Distinct usable queries as (query, q) with q the struct the tests read."""
    term = F.trim("query")
    return (
        queries.select("query")
        .distinct()
        .filter(F.length(term) >= 2)
        .select(
            "query",
            F.struct(
                F.col("query"),
                term.alias("term"),
                squash(term).alias("number"),
                trigrams(term).alias("grams"),
                content_words(term).alias("words"),
            ).alias("q"),
        )
    )


def _title_columns(rows: DataFrame) -> DataFrame:
    """Add t, the struct of a title the tests read."""
    return rows.withColumn("t", _title_struct(F.col("title")))


def _title_struct(title: Column) -> Column:
    return F.struct(
        title.alias("title"),
        F.lower(title).alias("low"),
        squash(title).alias("squashed"),
        trigrams(title).alias("grams"),
    )


def _could_match_title(q: Column, t: Column) -> Column:
    """A cheap test no matching title fails: enough shared trigrams, or the words themselves."""
    shared = F.size(F.array_intersect(q["grams"], t["grams"]))
    return F.contains(t["low"], F.lower(q["term"])) | (
        (F.size(q["grams"]) > 0) & (shared >= F.size(q["grams"]) * SIMILAR)
    )


def _matches_number(q: Column) -> Column:
    return (squash(F.col("course_number")) == q["number"]) | F.startswith(
        F.lower("course_number"), F.lower(q["term"])
    )


def _title_measures(q: Column, t: Column) -> Column:
    """Every measure of a (query, title) pair, each worked out once.

    No stretch of the title can beat the share of the query's trigrams it holds at all, so the
    search over stretches runs only where that bound could matter.
    """

    def finish(m: Column) -> Column:
        floor_score = F.greatest(m["sim"], F.when(m["has_text"], 0.9).otherwise(0.0))
        word_sim = F.when(
            m["held"] > F.least(floor_score, F.lit(WORDS_SIMILAR - 1e-9)),
            word_similarity_of(q["grams"], trigram_sequence(t["title"])),
        ).otherwise(F.lit(0.0))
        return bind(
            word_sim,
            lambda w: F.struct(
                F.struct(q["query"].alias("query"), q["number"].alias("number")).alias("q"),
                m["sim"].alias("sim"),
                F.greatest(floor_score, w).alias("title_score"),
                ((m["sim"] >= SIMILAR) | (w >= WORDS_SIMILAR) | m["has_text"]).alias("title_match"),
                (t["squashed"] == q["number"]).alias("same_title"),
                coverage(q["words"], content_words(t["title"])).alias("coverage"),
                F.when(
                    F.size(q["words"]) > 0,
                    similarity(
                        F.array_join(q["words"], " "), F.array_join(content_words(t["title"]), " ")
                    ),
                )
                .otherwise(m["sim"])
                .alias("likeness"),
            ),
        )

    first = bind(
        F.size(F.array_intersect(q["grams"], t["grams"])),
        lambda shared: F.struct(
            set_similarity(q["grams"], t["grams"]).alias("sim"),
            F.when(F.size(q["grams"]) > 0, shared / F.size(q["grams"])).otherwise(F.lit(0.0)).alias("held"),
            F.contains(t["low"], F.lower(q["term"])).alias("has_text"),
        ),
    )
    return bind(first, finish)


def _shortlist(courses: DataFrame, same: Sequence[str], needed: int | None) -> DataFrame:
    """The courses that a ranking can still take among those alike in ``same``: ``needed`` of each college.

    Courses of one title (and number) fare alike with every query, so only the first of them in the final order,
    which is by number and id, can be among the best.
    """
    order = [F.asc("course_number"), F.asc("course_id")]
    return courses if needed is None else first_rows(courses, [*same, "college_id"], order, needed, "alike").drop("alike")


def _literal_matches(courses: DataFrame, queries: Sequence[str], needed: int | None) -> DataFrame:
    """Matching (query, course) rows of a short list of typed queries.

    Each distinct title is measured once and only the matching ones come back to the courses;
    a row that matches by its number is measured where it stands.
    """
    usable = [q for q in dict.fromkeys(queries) if len(q.strip()) >= 2]
    if len(usable) > MAX_LITERAL_QUERIES:
        return _table_matches(courses, courses.sparkSession.createDataFrame([(q,) for q in usable], "query string"), needed)
    wanted = F.filter(
        F.array(*[_query_struct(q) for q in usable or ["  "]]), lambda q: F.length(q["term"]) >= 2
    )
    t = F.col("t")

    def measured(possible: Column) -> Column:
        return F.transform(possible, lambda q: _title_measures(q, t))

    near = F.filter(measured(F.filter(wanted, lambda q: _could_match_title(q, t))), lambda m: m["title_match"])
    titles = _title_columns(courses.select("title").distinct()).select(
        "title", F.explode(near).alias("m")
    )
    titled = _shortlist(courses, ["title"], needed).join(titles, "title").select(*courses.columns, "m")
    numbered = _shortlist(courses.filter(F.exists(wanted, _matches_number)), ["title", "course_number"], needed)
    by_number = _title_columns(numbered).select(
        *courses.columns, F.explode(measured(F.filter(wanted, _matches_number))).alias("m")
    )
    return _either(titled, by_number)


def _either(titled: DataFrame, by_number: DataFrame) -> DataFrame:
    """Rows that match by number, and those that match by title alone."""
    known = by_number.select(F.col("m.q.query").alias("query"), "course_id")
    rest = titled.withColumn("query", F.col("m.q.query")).join(known, ["query", "course_id"], "left_anti")
    return rest.select(*titled.columns).unionByName(by_number)


def _measure_pairs(pairs: DataFrame, where: Column | None = None) -> DataFrame:
    """Measures of distinct (query, title) pairs; the generator keeps later tests above them."""
    rows = _title_columns(pairs)
    rows = rows if where is None else rows.filter(where)
    return rows.select(
        "query", "title", F.explode(F.array(_title_measures(F.col("q"), F.col("t")))).alias("m")
    )


def _table_matches(courses: DataFrame, queries: DataFrame, needed: int | None) -> DataFrame:
    """Matching (query, course) rows of a whole table of queries, by equal keys only.

    A title that passes the trigram tests shares at least 0.3 of the query's trigrams, so it
    shares one of the query's ``n - ceil(0.3 n) + 1`` rarest; a title holding the query shares
    each run of its letters; numbers share the whole or a prefix. Pairs of a query and a title that meet are
    tested on the number of their shared trigrams before anything is measured. Queries, titles' keys and measures
    are worked out once; only a title's first few courses come back to it.
    """
    terms = cut(_query_columns(queries))
    keyed_titles = cut(courses.select("title").distinct().select(
        "title",
        F.explode(
            F.concat(
                trigrams(F.col("title")), _raw_runs(F.col("title"), 3), _raw_runs(F.col("title"), 2)
            )
        ).alias("key"),
    ))
    by_title = (
        _title_keys(terms, keyed_titles)
        .join(keyed_titles, "key")
        .select("query", "title")
        .distinct()
        .join(terms, "query")
    )
    measured = cut(_measure_pairs(by_title, _could_match_title(F.col("q"), F.col("t"))).filter("m.title_match"))
    titled = measured.join(_shortlist(courses, ["title"], needed), "title").select(*courses.columns, "m")

    numbers = courses.select("course_number").distinct()
    low = F.lower("course_number")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))),
        lambda i: F.concat(F.lit("p:"), F.substring(low, F.lit(1), i)),
    )
    whole = F.concat(F.lit("n:"), squash(F.col("course_number")))
    keyed_numbers = numbers.select(
        "course_number", F.explode(F.array_append(prefixes, whole)).alias("key")
    )
    number_keys = terms.select(
        "query",
        F.explode(
            F.array(F.concat(F.lit("p:"), F.lower("q.term")), F.concat(F.lit("n:"), "q.number"))
        ).alias("key"),
    )
    numbered = cut(
        number_keys.join(keyed_numbers, "key")
        .select("query", "course_number")
        .distinct()
        .join(_shortlist(courses, ["title", "course_number"], needed), "course_number")
    )
    pairs = numbered.select("query", "title").distinct()
    loose = _measure_pairs(pairs.join(measured.select("query", "title"), ["query", "title"], "left_anti").join(terms, "query"))
    known = measured.join(pairs, ["query", "title"], "left_semi").unionByName(loose)
    by_number = numbered.join(known, ["query", "title"]).select(*courses.columns, "m")
    return _either(titled, by_number)


def _raw_runs(c: Column, n: int) -> Column:
    """Distinct runs of n letters of a text, marked apart from its trigrams."""
    low = F.lower(c)
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))),
        lambda i: F.concat(F.lit("raw:"), F.substring(low, i, F.lit(n))),
    )
    return F.array_distinct(runs)


def _title_keys(terms: DataFrame, keyed_titles: DataFrame) -> DataFrame:
    """Keys to look each query up by: its rarest trigrams and its rarest run of raw letters."""
    seen = keyed_titles.groupBy("key").agg(F.count(F.lit(1)).alias("held_by"))
    grams = F.col("q.grams")
    needed = (F.size(grams) - F.ceil(F.size(grams) * SIMILAR) + 1).cast("int")
    rarest = (
        terms.select("query", F.explode(grams).alias("key"), needed.alias("needed"))
        .join(seen, "key", "left")
        .groupBy("query", "needed")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(F.coalesce("held_by", F.lit(0)).alias("held_by"), "key"))
            ).alias("keys")
        )
        .select("query", F.explode(F.slice("keys", F.lit(1), F.col("needed"))).alias("k"))
        .select("query", F.col("k.key").alias("key"))
    )
    # A title that holds the query holds every run of its letters, so the rarest will do.
    term = F.col("q.term")
    runs = F.when(F.length(term) >= 3, _raw_runs(term, 3)).otherwise(_raw_runs(term, 2))
    raw = (
        terms.select("query", F.explode(runs).alias("key"))
        .join(seen, "key", "left")
        .groupBy("query")
        .agg(F.min_by("key", F.struct(F.coalesce("held_by", F.lit(0)), F.col("key"))).alias("key"))
    )
    return rarest.unionByName(raw)


def _score(matches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Score and exactness of matches, the course number taken in."""
    same_number = squash(F.col("course_number")) == F.col("m.q.number")
    one = F.lit(1.0)
    return matches.select(
        F.col("m.q.query").alias("query"),
        *columns,
        F.greatest("m.title_score", F.when(same_number, one).otherwise(0.0)).alias("score"),
        F.greatest(
            "m.sim", F.when(same_number | F.col("m.same_title"), one).otherwise(0.0)
        ).alias("exactness"),
        F.col("m.coverage").alias("coverage"),
        F.col("m.likeness").alias("likeness"),
    )


def rank_matches(
    scored: DataFrame,
    rank_by: str = "score",
    limit: int | None = 10,
    per_college: int | None = None,
) -> DataFrame:
    """Keep strong rows, cap them per college, and cut each query to its ``limit`` best (None: all)."""
    if rank_by == "exactness":
        loose = F.when(F.col("exactness") >= KEPT_EXACTNESS, 1).otherwise(0)
        strong = F.coalesce(F.col("coverage"), loose) >= 1
        lead = F.col("likeness")
    else:
        strong = (F.col("score") >= KEPT_SCORE) | (F.col("exactness") >= KEPT_SCORE)
        lead = F.col("score")
    order = [lead.desc(), F.desc("exactness"), F.desc("score")]
    tail = [F.asc("course_number"), F.asc("course_id")]
    kept = scored.filter(strong)
    if per_college is not None:
        kept = first_rows(kept, ["query", "college_id"], [*order, *tail], per_college, "college_place")
    rank = [F.asc_nulls_last("college_rank")] if "college_rank" in scored.columns else []
    return first_rows(kept, ["query"], [*order, *rank, *tail], limit, "place")


def search_courses(
    courses: DataFrame,
    queries: Sequence[str] | DataFrame,
    college: object | None = None,
    exclude_college: object | None = None,
    limit: int | None = 10,
    per_college: int | None = None,
    rank_by: str = "score",
) -> DataFrame:
    """Best courses of each query.

    ``courses``: course_id, course_number, title, college_id, and college_rank when known.
    ``queries`` is a short list of typed texts, or a table with a ``query`` column.
    """
    scope = courses.filter(
        optional(F.col("college_id"), college)
        & optional(F.col("college_id"), exclude_college, exclude=True)
    )
    found = _table_matches if isinstance(queries, DataFrame) else _literal_matches
    needed = limit if per_college is None else per_college
    scored = _score(found(scope, queries, needed), courses.columns)
    ranked = rank_matches(scored, rank_by, limit, per_college)
    return ranked.select(
        "query", "place", *courses.columns, "score", "exactness", "coverage", "likeness"
    )


def with_practice(found: DataFrame, sections: DataFrame, complete_sets: DataFrame) -> DataFrame:
    """Whether each found course has sections, and how many complete sets.

    The big tables are cut to the few found courses before they are counted.
    """
    ids = found.select("course_id").distinct()
    held = sections.join(ids, "course_id", "left_semi").select("course_id").distinct()
    counts = (
        complete_sets.join(ids, "course_id", "left_semi")
        .groupBy("course_id")
        .agg(F.count(F.lit(1)).alias("complete_test_sets"))
    )
    return (
        found.join(held.withColumn("has_sections", F.lit(True)), "course_id", "left")
        .join(counts, "course_id", "left")
        .withColumns(
            {
                "has_sections": F.coalesce("has_sections", F.lit(False)),
                "complete_test_sets": F.coalesce("complete_test_sets", F.lit(0).cast("bigint")),
            }
        )
    )


def pick_exact_match(found: DataFrame) -> DataFrame:
    """The one course a query names, or no row when the answer is not clear-cut."""
    eligible = found.filter(F.col("coverage").isNull() | (F.col("coverage") >= 1))
    best = eligible.groupBy("query").agg(
        F.max_by(
            F.struct("course_id", "title", "exactness", "score"),
            F.struct("exactness", "score", -F.col("place")),
        ).alias("best")
    )
    rival = F.when(
        squash(F.col("title")) != squash(F.col("best.title")), F.col("exactness")
    )
    decided = (
        eligible.join(best, "query")
        .groupBy("query", "best")
        .agg(F.max(rival).alias("rival_exactness"))
    )
    top = F.col("best.exactness")
    clear = (top >= CERTAIN) | F.coalesce(top - F.col("rival_exactness") >= MARGIN, F.lit(True))
    return decided.filter((top >= SAME_COURSE) & clear).select(
        "query",
        F.col("best.course_id").alias("course_id"),
        F.col("best.title").alias("title"),
        top.alias("exactness"),
        "rival_exactness",
    )


def merge_lists(
    primary: DataFrame, secondary: DataFrame, keys: Sequence[str], limit: int, per_college: int
) -> DataFrame:
    """Primary rows, then secondary, each course once, capped per college and in all.

    Both lists hold ``place``, course_id, course_number, title and college_id; ``keys`` name
    the request they belong to.
    """
    columns = [*keys, "place", "course_id", "course_number", "title", "college_id"]
    both = (
        primary.select(*columns, F.lit(0).alias("list"))
        .unionByName(secondary.select(*columns, F.lit(1).alias("list")))
        .withColumn("title_key", squash(F.col("title")))
    )
    once = first_rows(
        both,
        [*keys, "college_id", "course_number", "title_key"],
        [F.asc("list"), F.asc("place")],
        1,
        "copy",
    )
    capped = first_rows(
        once, [*keys, "college_id"], [F.asc("list"), F.asc("place")], per_college, "college_place"
    )
    return first_rows(
        capped, list(keys), [F.asc("list"), F.asc("place")], limit, "merged_place"
    ).select(*keys, "merged_place", "list", "course_id", "course_number", "title", "college_id")


def college_check(
    courses: DataFrame,
    query: str,
    college: object,
    embedded: DataFrame,
    vector: Sequence[float] | Column | None = None,
    course_similarity: float = 0.6,
    query_similarity: float = 0.5,
) -> DataFrame:
    """Is a course taught at this college, and where else is one like it?

    Shorthand is written out first. ``here`` rows are the college's own matches without the exact
    one; ``elsewhere`` rows come by words and, where there is a vector to compare, by meaning: with
    the matched course's (``basis`` course, its neighbours lead) or with the query's (``basis``
    query, word matches lead). ``method`` tells whether meaning took part. The match is one row,
    so it decides on the driver which plan is built.
    """
    from lectern.operators.similarity import similar_courses

    asked = written_out(query)
    here = cut(search_courses(courses, [asked], college=college, limit=8))
    best = pick_exact_match(here).first()
    words = search_courses(courses, [asked], exclude_college=college, limit=10, per_college=2, rank_by="exactness")
    near = None
    if best is not None:
        near = similar_courses(embedded, course_id=best.course_id, exclude_college=college, min_similarity=course_similarity)
    elif vector is not None and has_words_in(asked):
        near = similar_courses(embedded, vector=vector, exclude_college=college, min_similarity=query_similarity)
    rows = ["place", "course_id", "course_number", "title", "college_id"]
    if near is None:
        away = words.select(*rows)
    else:
        lists = [near.select(*rows), words.select(*rows)]
        first, second = (x.withColumn("query", F.lit(query)) for x in (lists if best is not None else lists[::-1]))
        away = merge_lists(first, second, ["query"], 10, 2).withColumnRenamed("merged_place", "place").select(*rows)
    matched = None if best is None else best.course_id
    own = here.select(*rows).where(F.lit(True) if best is None else F.col("course_id") != F.lit(matched))
    own = first_rows(own.withColumn("one", F.lit(1)), ["one"], [F.asc("place")], None, "place").select(*rows)
    kind = courses.schema["course_id"].dataType
    return (
        own.withColumn("part", F.lit("here"))
        .unionByName(away.withColumn("part", F.lit("elsewhere")))
        .select(
            F.lit(query).alias("query"),
            "part",
            *rows,
            F.lit(matched).cast(kind).alias("match_id"),
            F.lit("query" if best is None else "course").alias("basis"),
            F.lit("words" if near is None else "meaning").alias("method"),
        )
    )


def search_everywhere(
    courses: DataFrame,
    queries: Sequence[str],
    embedded: DataFrame | None = None,
    vector: Sequence[float] | Column | None = None,
    limit: int = 15,
    per_college: int = 3,
    min_similarity: float = 0.5,
) -> DataFrame:
    """Courses anywhere: word matches of the written-out query lead, neighbours of its vector follow.

    Queries without real words are not compared by meaning.
    """
    from lectern.operators.similarity import similar_courses

    asked = {q: written_out(q) for q in dict.fromkeys(queries)}
    raw = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(e), F.array(*[F.lit(q) for q in asked if asked[q] == e])) for e in dict.fromkeys(asked.values())]))[F.col("query")])
    words = search_courses(courses, list(dict.fromkeys(asked.values())), limit=limit, per_college=per_college)
    words = words.withColumn("query", raw)
    worded = [F.lit(q) for q, e in asked.items() if has_words_in(e)]
    if vector is None or embedded is None or not worded:
        near = words.limit(0)
    else:
        near = similar_courses(embedded, vector=vector, limit=limit, per_college=per_college, min_similarity=min_similarity)
        near = near.withColumn("query", F.explode(F.array(*worded)))
    return merge_lists(words, near, ["query"], limit, per_college)


def written_out(query: str) -> str:
    """A typed query with its shorthand written out, as ``query_text`` does for a column."""
    return re.sub(r"(?i)\b([a-z]+)\b\.?", lambda m: SHORTHAND.get(m[1].lower(), m[0]), query)


def has_words_in(query: str) -> bool:
    """Whether a typed query holds a run of letters worth comparing by meaning."""
    return re.search("[a-zA-Z]{3,}", query) is not None


def query_text(raw: Column) -> Column:
    """A typed query with its shorthand written out."""
    return expand_shorthand(raw)


def coverage_verdict(sourced: Column, departments: Column) -> Column:
    return (
        F.when((departments > 0) & (sourced >= departments), "all")
        .when(sourced > 0, "partial")
        .otherwise("none")
    )


def college_payload(stats: DataFrame) -> DataFrame:
    """Indexed flag and coverage verdict of each college."""
    return stats.select(
        "college_id",
        (F.col("course_count") > 0).alias("indexed"),
        "course_count",
        "department_count",
        "departments_sourced",
        coverage_verdict(F.col("departments_sourced"), F.col("department_count")).alias("coverage"),
    )
