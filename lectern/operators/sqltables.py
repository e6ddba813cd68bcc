"""Search, likeness and the listing as SQL table functions.

Each function is a query over views of the tables it was made for; Catalyst inlines it, so a call with literals is
an ordinary plan, and ``LATERAL`` over a table of parameters becomes joins on the parameters' values
(``search_courses``: on the keys by which a query can match at all). Parameters have the defaults of
the site. Calls give no order beyond the ``place`` column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.sql import spelled
from lectern.functions.text import content_words, squash, trigrams
from lectern.operators import listing, search
from lectern.operators.ranks import deal_out

# Keys of a query and a course: see ``search._table_matches``.
_RAW, _WHOLE, _PREFIX = "raw:", "n:", "p:"


def _create(spark: SparkSession, name: str, given: str, result: list[tuple[str, str]], body: str) -> None:
    columns = ", ".join(f"`{n}` {kind}" for n, kind in result)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS TABLE ({columns}) RETURN {body}")


def _typed(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def search_keys(courses: DataFrame) -> DataFrame:
    """Every key under which a course can be found; to be stored beside a large catalog."""
    low = F.lower("course_number")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.concat(F.lit(_PREFIX), F.substring(low, F.lit(1), i))
    )
    title = F.col("title")
    whole = F.array(F.concat(F.lit(_WHOLE), squash(F.col("course_number"))))
    keys = [trigrams(title), search._raw_runs(title, 3), search._raw_runs(title, 2), prefixes, whole]
    empty = F.array().cast("array<string>")
    return courses.select("course_id", F.explode(F.array_distinct(F.concat(*[F.coalesce(k, empty) for k in keys]))).alias("key"))


def register_search(
    spark: SparkSession, courses: DataFrame, keys: DataFrame | None = None, key_counts: DataFrame | None = None, name: str = "search_courses"
) -> None:
    """``search_courses(q, p_college_id, p_exclude_college_id, p_limit, p_per_college, p_rank_by)``.

    ``courses``: course_id, course_number, title, college_id and columns of its own, all of which come
    back with score, exactness, coverage, likeness and place. ``keys`` and their counts (key, held_by) are worked
    out from the courses unless stored ones are given.
    """
    # Dealt out first: Spark takes exploded keys for as few as the courses and would broadcast them; their size is
    # known once they are dealt.
    keys = search_keys(deal_out(courses)).repartition("course_id") if keys is None else keys
    key_counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("held_by")) if key_counts is None else key_counts
    courses.createOrReplaceTempView(f"{name}_rows")
    keys.createOrReplaceTempView(f"{name}_keys")
    key_counts.createOrReplaceTempView(f"{name}_key_counts")

    q, t, wanted = F.col("q"), F.col("t"), F.col("wanted")
    term = F.trim(q)
    struct = F.struct(
        q.alias("query"), term.alias("term"), squash(term).alias("number"), trigrams(term).alias("grams"), content_words(term).alias("words")
    )
    raw = F.when(F.length(wanted["term"]) >= 3, search._raw_runs(wanted["term"], 3)).otherwise(search._raw_runs(wanted["term"], 2))
    numbers = F.array(F.concat(F.lit(_PREFIX), F.lower(wanted["term"])), F.concat(F.lit(_WHOLE), wanted["number"]))
    grams = F.size(wanted["grams"])
    needed = grams - F.ceil(grams * search.SIMILAR) + 1
    possible = search._could_match_title(wanted, t) | search._matches_number(wanted)
    measured = search._title_measures(wanted, t)
    number_match = search._matches_number(wanted)
    same_number = squash(F.col("course_number")) == wanted["number"]
    score = F.greatest(F.col("m")["title_score"], F.when(same_number, F.lit(1.0)).otherwise(0.0))
    same = same_number | F.col("m")["same_title"]
    exactness = F.greatest(F.col("m")["sim"], F.when(same, F.lit(1.0)).otherwise(0.0))
    ranks = "college_rank ASC NULLS LAST, " if "college_rank" in courses.columns else ""
    own = ", ".join(f"c.`{c}`" for c in courses.columns)
    plain = ", ".join(f"`{c}`" for c in courses.columns)
    college = courses.schema["college_id"].dataType.simpleString()
    lead = "CASE WHEN p_rank_by = 'exactness' THEN likeness ELSE score END DESC, exactness DESC, score DESC"
    body = f"""
      WITH terms AS (SELECT {spelled(struct)} AS wanted WHERE length(trim(q)) >= 2),
      grams AS (SELECT wanted, explode(wanted.grams) AS key FROM terms),
      rarest AS (
        SELECT g.wanted, g.key, row_number() OVER (PARTITION BY g.wanted.query ORDER BY coalesce(f.held_by, 0), g.key) AS rarity
        FROM grams g LEFT JOIN {name}_key_counts f ON f.key = g.key),
      runs AS (SELECT wanted, explode({spelled(raw)}) AS key FROM terms),
      run AS (
        SELECT r.wanted, r.key, row_number() OVER (PARTITION BY r.wanted.query ORDER BY coalesce(f.held_by, 0), r.key) AS rarity
        FROM runs r LEFT JOIN {name}_key_counts f ON f.key = r.key),
      chosen AS (
        SELECT wanted, key FROM rarest WHERE rarity <= {spelled(needed)}
        UNION ALL SELECT wanted, key FROM run WHERE rarity = 1
        UNION ALL SELECT wanted, explode({spelled(numbers)}) FROM terms),
      found AS (SELECT k.course_id, any_value(s.wanted) AS wanted FROM chosen s JOIN {name}_keys k ON k.key = s.key GROUP BY k.course_id),
      near AS (
        SELECT /*+ MERGE(c) */ {own}, {spelled(search._title_struct(F.col("c.title")))} AS t, found.wanted FROM found JOIN {name}_rows c ON c.course_id = found.course_id
        WHERE (p_college_id IS NULL OR c.college_id = p_college_id) AND (p_exclude_college_id IS NULL OR c.college_id <> p_exclude_college_id)),
      measured AS (SELECT {plain}, wanted, explode(array({spelled(measured)})) AS m FROM near WHERE {spelled(possible)}),
      scored AS (
        SELECT {plain}, {spelled(score)} AS score, {spelled(exactness)} AS exactness, m.coverage AS coverage, m.likeness AS likeness
        FROM measured WHERE m.title_match OR {spelled(number_match)}),
      capped AS (
        SELECT *, row_number() OVER (PARTITION BY college_id ORDER BY {lead}, course_number, course_id) AS college_place FROM scored
        WHERE CASE WHEN p_rank_by = 'exactness' THEN coalesce(coverage, CASE WHEN exactness >= {search.KEPT_EXACTNESS} THEN 1 ELSE 0 END) >= 1
          ELSE score >= {search.KEPT_SCORE} OR exactness >= {search.KEPT_SCORE} END),
      placed AS (
        SELECT *, row_number() OVER (ORDER BY {lead}, {ranks}course_number, course_id) AS place FROM capped
        WHERE p_per_college IS NULL OR college_place <= p_per_college)
      SELECT {plain}, score, exactness, coverage, likeness, place FROM placed WHERE place <= greatest(coalesce(p_limit, 10), 1)
    """
    given = (
        f"q STRING, p_college_id {college} DEFAULT NULL, p_exclude_college_id {college} DEFAULT NULL, p_limit INT DEFAULT 10, "
        "p_per_college INT DEFAULT NULL, p_rank_by STRING DEFAULT 'score'"
    )
    measures = [(c, "double") for c in ("score", "exactness", "coverage", "likeness")]
    _create(spark, name, given, [*_typed(courses), *measures, ("place", "int")], body)


def _cosine(a: str, b: str) -> str:
    dot = "aggregate(zip_with({}, {}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)"
    return f"try_divide({dot.format(a, b)}, sqrt({dot.format(a, a)}) * sqrt({dot.format(b, b)}))"


def register_similar(spark: SparkSession, embeddings: DataFrame, name: str = "similar_courses") -> None:
    """``similar_courses(p_embedding, p_course_id, p_exclude_college_id, p_limit, p_per_college, p_min_similarity)``.

    ``embeddings``: course_id, college_id, embedding and columns of its own. One target is one scan; for the
    neighbours of every course use ``similarity.similar_for_all``, as ``LATERAL`` here scans once per target.
    """
    embeddings.createOrReplaceTempView(f"{name}_vectors")
    rest = [c for c in embeddings.columns if c != "embedding"]
    plain = ", ".join(f"`{c}`" for c in rest)
    key, college = (embeddings.schema[c].dataType.simpleString() for c in ("course_id", "college_id"))
    tail = "".join(f"{c} ASC NULLS LAST, " for c in ("college_rank", "course_number") if c in rest)
    body = f"""
      WITH target AS (
        SELECT transform(embedding, x -> double(x)) AS v FROM {name}_vectors WHERE course_id = p_course_id
        UNION ALL SELECT p_embedding WHERE p_course_id IS NULL AND p_embedding IS NOT NULL),
      near AS (
        SELECT {plain}, {_cosine('embedding', 'v')} AS similarity FROM {name}_vectors, target
        WHERE (p_exclude_college_id IS NULL OR college_id <> p_exclude_college_id) AND (p_course_id IS NULL OR course_id <> p_course_id)),
      capped AS (
        SELECT *, row_number() OVER (PARTITION BY college_id ORDER BY similarity DESC, course_id) AS college_place
        FROM near WHERE similarity >= coalesce(p_min_similarity, 0)),
      placed AS (
        SELECT *, row_number() OVER (ORDER BY similarity DESC, {tail}course_id) AS place
        FROM capped WHERE p_per_college IS NULL OR college_place <= p_per_college)
      SELECT {plain}, similarity, place FROM placed WHERE place <= greatest(coalesce(p_limit, 10), 1)
    """
    given = (
        f"p_embedding ARRAY<DOUBLE> DEFAULT NULL, p_course_id {key} DEFAULT NULL, p_exclude_college_id {college} DEFAULT NULL, "
        "p_limit INT DEFAULT 10, p_per_college INT DEFAULT 2, p_min_similarity DOUBLE DEFAULT 0.5D"
    )
    _create(spark, name, given, [*_typed(embeddings.select(*rest)), ("similarity", "double"), ("place", "int")], body)


# Sort keys a caller may name, as in ``listing.sort_columns``: texts and numbers.
_TEXT_SORTS = {"title": "lower(title)", "university": "lower(college_name)", "department": "lower(department_code)"}
_NUMBER_SORTS = {"sections": "section_count", "tests": "complete_test_sets", "taken": "attempts_taken", "cost": "cost"}


def register_listing(spark: SparkSession, courses: DataFrame, counts: DataFrame, costs: DataFrame, name: str = "admin_course_list") -> None:
    """``admin_course_list(p_query, p_tested, p_sort, p_desc, p_limit, p_offset)``, with total_count and place.

    Tables as for ``listing.course_rows``.
    """
    rows = listing.course_rows(courses, counts, costs)
    searched = ["course_number", "title", "department_code", "department_name", "college_name", "college_short_name"]
    texts = courses.select("course_id", F.array(*[F.lower(c) for c in searched]).alias("searched"))
    rows.join(texts, "course_id").createOrReplaceTempView(f"{name}_rows")
    words = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _TEXT_SORTS.items())
    numbers = " ".join(f"WHEN '{k}' THEN double({v})" for k, v in _NUMBER_SORTS.items())
    level = f"WHEN 'level' THEN double({spelled(listing.level_rank(F.col('level')))})"
    others = ", ".join(f"'{k}'" for k in [*_NUMBER_SORTS, "level"])
    plain = ", ".join(f"`{c}`" for c in rows.columns)
    second = "CASE WHEN p_sort = 'tests' THEN test_set_count END"
    keys = [f"CASE p_sort {words} ELSE CASE WHEN p_sort IN ({others}) THEN NULL ELSE lower(course_number) END END", f"CASE p_sort {numbers} {level} END", second]
    ordering = ", ".join(f"CASE WHEN NOT p_desc THEN {k} END ASC NULLS LAST, CASE WHEN p_desc THEN {k} END DESC NULLS LAST" for k in keys)
    needle = "lower(trim(coalesce(p_query, '')))"
    body = f"""
      WITH matching AS (
        SELECT * FROM {name}_rows WHERE ({needle} = '' OR exists(searched, x -> coalesce(contains(x, {needle}), false)))
          AND CASE coalesce(p_tested, 'all') WHEN 'tested' THEN test_set_count > 0 WHEN 'untested' THEN test_set_count = 0 ELSE true END),
      placed AS (SELECT *, row_number() OVER (ORDER BY {ordering}, lower(course_number), course_id) AS place FROM matching)
      SELECT {plain}, (SELECT count(*) FROM matching) AS total_count, place FROM placed
      WHERE place > greatest(coalesce(p_offset, 0), 0) AND place <= greatest(coalesce(p_offset, 0), 0) + greatest(coalesce(p_limit, 500), 1)
    """
    given = (
        "p_query STRING DEFAULT NULL, p_tested STRING DEFAULT 'all', p_sort STRING DEFAULT 'course', p_desc BOOLEAN DEFAULT false, "
        "p_limit INT DEFAULT 500, p_offset INT DEFAULT 0"
    )
    _create(spark, name, given, [*_typed(rows), ("total_count", "bigint"), ("place", "int")], body)
