"""Search, trigram and embedding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import sql, text
from lectern.operators import search, similarity, sqltables
from lectern.operators.ranks import deal_out
from lectern.plans.coverage import COLLEGE_STATS_SQL, college_stats_of
from lectern.plans.registry import query
from lectern.sources.tables import Tables

TYPED = ("red widget", "intro gear", "Brand#17", "ring", "cold blt", "small rings", "  hot  ")

WORDS = ", ".join(f"'{w}'" for w in text.GENERIC_TITLE_WORDS)
STOPS = ", ".join(f"'{w}'" for w in text.STEM_STOP_WORDS)


def _grams(c: str) -> str:
    """SQL for the distinct trigrams of a text."""
    return f"list_distinct({_gram_list(c)})"


def _gram_list(c: str) -> str:
    return (
        f"flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 0), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))"
    )


def _content(c: str) -> str:
    return (
        f"list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'), "
        f"lambda w: length(w) > 1 and not regexp_matches(w, '^[0-9]+$') and w not in ({WORDS}))))"
    )


def _sim(a: str, b: str) -> str:
    """SQL likeness of two distinct lists."""
    both = f"length(list_intersect({a}, {b}))"
    return f"(case when length({a}) + length({b}) = 0 then 0.0 else {both} / (length({a}) + length({b}) - {both}) end)"


def _word_sim(grams: str, sequence: str) -> str:
    hits = f"list_filter(range(1, length({sequence}) + 1), lambda i: list_contains({grams}, {sequence}[i]))"
    part = f"list_distinct({sequence}[s:e])"
    return (
        f"coalesce(list_max(flatten(list_transform({hits}, lambda s: list_transform("
        f"list_filter({hits}, lambda e: e >= s), lambda e: {_sim(grams, part)})))), 0.0)"
    )


def _squash(c: str) -> str:
    return f"lower(regexp_replace({c}, '[^a-zA-Z0-9]', '', 'g'))"


def scored_sql(terms: str, where: str = "true") -> str:
    """CTEs that score every (term, part) pair the plain way, ending in ``scored``."""
    return f"""
    with terms as (select query, term, {_squash('term')} as tn, {_grams('term')} as tg, {_content('term')} as qw
                   from (select query, trim(query) as term from ({terms})) where length(term) >= 2),
    parts as (select p_partkey as course_id, p_brand as course_number, p_name as title, p_type as college_id from part where {where}),
    titles as (select title, {_grams('title')} as gg, {_gram_list('title')} as gs, {_content('title')} as tw
               from (select distinct title from parts)),
    measured as (
      select query, term, tn, qw, title, tw, {_sim('tg', 'gg')} as sim, {_word_sim('tg', 'gs')} as ws,
        contains(lower(title), lower(term)) as has_text
      from terms, titles),
    covered as (
      select *, case when length(qw) > 0 then length(list_filter(qw, lambda a: length(list_filter(tw, lambda b:
            a = b or (length(a) >= 5 and length(b) >= 5 and {_sim(_grams('a'), _grams('b'))} >= 0.6))) > 0)) / length(qw) end as coverage,
        case when length(qw) > 0 then {_sim(_grams("array_to_string(qw, ' ')"), _grams("array_to_string(tw, ' ')"))} else sim end as likeness
      from measured),
    scored as (
      select query, course_id, course_number, title, college_id, coverage, likeness,
        greatest(ws, sim, case when {_squash('course_number')} = tn then 1.0 else 0 end, case when has_text then 0.9 else 0 end) as score,
        greatest(sim, case when {_squash('course_number')} = tn then 1.0 else 0 end, case when {_squash('title')} = tn then 1.0 else 0 end) as exactness
      from covered join parts using (title)
      where sim >= 0.3 or ws >= 0.6 or has_text or {_squash('course_number')} = tn or starts_with(lower(course_number), lower(term)))
    """


def typed_sql(queries=TYPED) -> str:
    return " union all ".join(f"select '{q}' as query" for q in queries)


def ranked_sql(rank_by: str, limit: int, per_college: int | None, prefix: str = "") -> str:
    lead = "likeness" if rank_by == "exactness" else "score"
    keep = (
        "coalesce(coverage, case when exactness >= 0.5 then 1 else 0 end) >= 1"
        if rank_by == "exactness"
        else "(score >= 0.35 or exactness >= 0.35)"
    )
    cap = f"where cp <= {per_college}" if per_college else ""
    return f"""
    , {prefix}capped as (
      select *, row_number() over (partition by query, college_id order by {lead} desc, exactness desc, score desc, course_number, course_id) as cp
      from scored where {keep}),
    {prefix}found as (
      select * from (select *, row_number() over (partition by query order by {lead} desc, exactness desc, score desc, course_number, course_id) as place
        from {prefix}capped {cap}) where place <= {limit})
    """


ROUNDED = "query, place, course_id, course_number, title, college_id, round(score, 6) as score, round(exactness, 6) as exactness, round(coverage, 6) as coverage, round(likeness, 6) as likeness"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: F.round(c, 6) for c in ("score", "exactness", "coverage", "likeness")}
    )


@query(
    "search",
    scored_sql(typed_sql()) + ranked_sql("score", 10, None) + f"select {ROUNDED} from found",
)
def search_typed(t: Tables) -> DataFrame:
    return rounded(search.search_courses(t.parts(), TYPED))


@query(
    "search_similar",
    scored_sql(typed_sql(), "p_type <> 'SMALL'")
    + ranked_sql("exactness", 10, 2)
    + f"select {ROUNDED} from found",
)
def search_similar(t: Tables) -> DataFrame:
    """Like courses at every college but one, two per college."""
    return rounded(
        search.search_courses(
            t.parts(), TYPED, exclude_college="SMALL", per_college=2, rank_by="exactness"
        )
    )


@query(
    "search_batch",
    scored_sql("select distinct p_name as query from part union select distinct p_brand from part")
    + ranked_sql("score", 15, 3)
    + f"select {ROUNDED} from found",
)
def search_batch(t: Tables) -> DataFrame:
    """A whole table of queries: every title and number in the catalog."""
    parts = t.parts()
    queries = (
        parts.select(F.col("title").alias("query"))
        .union(parts.select(F.col("course_number").alias("query")))
        .distinct()
    )
    return rounded(search.search_courses(parts, queries, limit=15, per_college=3))


@query(
    "search_practice",
    scored_sql(typed_sql())
    + ranked_sql("score", 5, None)
    + """
    select query, place, course_id, exists (select 1 from lineitem where l_partkey = course_id) as has_sections,
      (select count(*) from lineitem where l_partkey = course_id and l_returnflag = 'R') as complete_test_sets
    from found
    """,
)
def search_practice(t: Tables) -> DataFrame:
    found = search.search_courses(t.parts(), TYPED, limit=5)
    lines = t.read("lineitem").select(F.col("l_partkey").alias("course_id"), "l_returnflag")
    held = search.with_practice(found, lines.select("course_id"), lines.filter("l_returnflag = 'R'"))
    return held.select("query", "place", "course_id", "has_sections", "complete_test_sets")


@query(
    "exact_match",
    scored_sql("select distinct p_name as query from part union select distinct p_name || 's' from part")
    + ranked_sql("score", 8, None)
    + f""",
    eligible as (select * from found where coverage is null or coverage >= 1),
    best as (select * from (select *, row_number() over (partition by query order by exactness desc, score desc, place) as b from eligible) where b = 1)
    select query, course_id, title, round(exactness, 6) as exactness, round(rival, 6) as rival_exactness from (
      select best.query, best.course_id, best.title, best.exactness,
        (select max(e.exactness) from eligible e where e.query = best.query and {_squash('e.title')} <> {_squash('best.title')}) as rival
      from best)
    where exactness >= 0.6 and (exactness >= 0.85 or rival is null or exactness - rival >= 0.08)
    """,
)
def exact_match(t: Tables) -> DataFrame:
    titles = t.parts().select("title").distinct()
    queries = titles.select(F.col("title").alias("query")).union(
        titles.select(F.concat("title", F.lit("s")).alias("query"))
    )
    found = search.search_courses(t.parts(), queries, limit=8)
    return search.pick_exact_match(found).withColumns(
        {"exactness": F.round("exactness", 6), "rival_exactness": F.round("rival_exactness", 6)}
    )


def embedded_parts(t: Tables) -> DataFrame:
    """Vectors beside the number, title and college of their part."""
    return (
        t.read("embeddings")
        .select(F.col("vec_id").alias("course_id"), "embedding")
        .join(t.parts(), "course_id")
    )


_SIM_TO = "list_cosine_similarity(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = {id}))"


def nearest_sql(where: str, target: int, minimum: float, per_college: int, limit: int) -> str:
    return f"""
      select *, row_number() over (order by similarity desc, course_id) as place from (
        select *, row_number() over (partition by college_id order by similarity desc, course_id) as cp from (
          select * from (
            select vec_id as course_id, label as college_id, {_SIM_TO.format(id=target)} as similarity from embeddings where {where})
         ) where similarity >= {minimum})
      where cp <= {per_college} order by place limit {limit}
    """


@query(
    "similar_by_id",
    f"select course_id, college_id, round(similarity, 6) as similarity, place from ({nearest_sql('vec_id <> 5 and label <> (select label from embeddings where vec_id = 5)', 5, 0.2, 2, 10)})",
)
def similar_by_id(t: Tables) -> DataFrame:
    own = t.embeddings().where("course_id = 5").select("college_id").scalar()
    others = t.embeddings().withColumn("own_college", own)
    found = similarity.similar_courses(
        others.filter((F.col("course_id") == 5) | (F.col("college_id") != F.col("own_college"))).drop("own_college"),
        course_id=5,
        min_similarity=0.2,
    )
    return found.select("course_id", "college_id", F.round("similarity", 6).alias("similarity"), "place")


@query(
    "similar_by_vector",
    f"select course_id, college_id, round(similarity, 6) as similarity, place from ({nearest_sql('label <> 3', 17, 0.1, 3, 15)})",
)
def similar_by_vector(t: Tables) -> DataFrame:
    target = t.embeddings().where("course_id = 17").select("embedding").scalar()
    found = similarity.similar_courses(
        t.embeddings(), vector=target, exclude_college=3, per_college=3, limit=15, min_similarity=0.1
    )
    return found.select("course_id", "college_id", F.round("similarity", 6).alias("similarity"), "place")


@query(
    "similar_for_all",
    """
    with v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
    p as (
      select a.vec_id as course_id, a.label as college_id, b.vec_id as other_id, b.label as other_college,
        list_cosine_similarity(a.e, b.e) as s from v a join v b on a.label <> b.label),
    n as (select *, row_number() over (partition by course_id order by s desc, other_id) as r from p),
    c as (select *, row_number() over (partition by course_id, other_college order by s desc, other_id) as cp from n where s >= 0.3),
    f as (select *, row_number() over (partition by course_id order by s desc, other_id) as place from c where cp <= 2)
    select course_id, college_id, place, other_id, other_college, round(s, 6) as similarity from f where place <= 10
    """,
)
def similar_for_all(t: Tables) -> DataFrame:
    found = similarity.similar_for_all(t.embeddings(), min_similarity=0.3)
    return found.withColumn("similarity", F.round("similarity", 6))


def _meaning_sql(vec: int, limit: int, per_college: int, minimum: float, where: str = "true") -> str:
    return f"""
      select course_id, course_number, title, college_id, similarity, place from (
        select *, row_number() over (order by similarity desc, course_number, course_id) as place from (
          select *, row_number() over (partition by college_id order by similarity desc, course_id) as cp from (
            select * from (
              select vec_id as course_id, p_brand as course_number, p_name as title, p_type as college_id, {_SIM_TO.format(id=vec)} as similarity
              from embeddings join part on p_partkey = vec_id where {where})
           ) where similarity >= {minimum})
        where cp <= {per_college}) where place <= {limit}
    """


def _merge_sql(primary: str, secondary: str, limit: int, per_college: int) -> str:
    return f"""
    , both_lists as (
      select query, place, course_id, course_number, title, college_id, 0 as list from {primary}
      union all select query, place, course_id, course_number, title, college_id, 1 from {secondary}),
    once as (select * from (select *, row_number() over (partition by query, college_id, course_number, {_squash('title')} order by list, place) as k from both_lists) where k = 1),
    few as (select *, row_number() over (partition by query, college_id order by list, place) as cp from once),
    merged as (select *, row_number() over (partition by query order by list, place) as merged_place from few where cp <= {per_college})
    select query, merged_place, list, course_id, course_number, title, college_id from merged where merged_place <= {limit}
    """


@query(
    "search_everywhere",
    scored_sql(typed_sql(q.replace("intro", "introduction") for q in TYPED))
    + ranked_sql("score", 15, 3)
    + f", near as ({_meaning_sql(17, 15, 3, 0.1)}), meaning as (select query, near.* from terms, near)"
    + _merge_sql("found", "meaning", 15, 3).replace("select query, merged_place,", "select replace(query, 'introduction', 'intro') as query, merged_place,"),
)
def search_everywhere(t: Tables) -> DataFrame:
    """Word matches first, then neighbours of the query's vector, three per college."""
    target = t.embeddings().where("course_id = 17").select("embedding").scalar()
    return search.search_everywhere(t.parts(), TYPED, embedded_parts(t), target, min_similarity=0.1)


CHECKED = {"red widget": "red widget", "zzqq": "zzqq", "Intro. red": "introduction red", "7.9": "7.9"}


@query(
    "college_check",
    scored_sql(typed_sql(CHECKED.values()))
    + f""", here as (
      select * from (select *, row_number() over (partition by query order by score desc, exactness desc, score desc, course_number, course_id) as place
        from scored where college_id = 'SMALL' and (score >= 0.35 or exactness >= 0.35)) where place <= 8),
    eligible as (select * from here where coverage is null or coverage >= 1),
    best as (select * from (select *, row_number() over (partition by query order by exactness desc, score desc, place) as b from eligible) where b = 1),
    matched as (
      select query, course_id as match_id from (
        select best.*, (select max(e.exactness) from eligible e where e.query = best.query and {_squash('e.title')} <> {_squash('best.title')}) as rival from best)
      where exactness >= 0.6 and (exactness >= 0.85 or rival is null or exactness - rival >= 0.08)),
    asked as (
      select t.query, match_id, case when match_id is null then 0.1 else 0.05 end as least,
        case when match_id is not null then (select cast(embedding as double[]) from embeddings where vec_id = match_id)
          when regexp_matches(t.query, '[a-zA-Z]{{3,}}') then (select cast(embedding as double[]) from embeddings where vec_id = 17) end as e
      from terms t left join matched m on t.query = m.query),
    away_capped as (
      select *, row_number() over (partition by query, college_id order by likeness desc, exactness desc, score desc, course_number, course_id) as cp
      from scored where college_id <> 'SMALL' and coalesce(coverage, case when exactness >= 0.5 then 1 else 0 end) >= 1),
    away as (select * from (select *, row_number() over (partition by query order by likeness desc, exactness desc, score desc, course_number, course_id) as place
        from away_capped where cp <= 2) where place <= 10),
    near_capped as (
      select *, row_number() over (partition by query, college_id order by similarity desc, course_id) as cp from (
        select query, least, vec_id as course_id, p_brand as course_number, p_name as title, p_type as college_id, list_cosine_similarity(cast(embedding as double[]), e) as similarity
        from asked, embeddings join part on p_partkey = vec_id where e is not null and p_type <> 'SMALL' and vec_id is distinct from match_id) where similarity >= least),
    near as (select * from (select *, row_number() over (partition by query order by similarity desc, course_number, course_id) as place from near_capped where cp <= 2) where place <= 10),
    lists as (
      select a.query, place, course_id, course_number, title, college_id, case when match_id is null then 1 else 0 end as list from near join asked a using (query)
      union all select a.query, place, course_id, course_number, title, college_id, case when match_id is null then 0 else 1 end from away join asked a using (query)),
    once as (select * from (select *, row_number() over (partition by query, college_id, course_number, {_squash('title')} order by list, place) as k from lists) where k = 1),
    few as (select *, row_number() over (partition by query, college_id order by list, place) as cp from once),
    merged as (select *, row_number() over (partition by query order by list, place) as merged_place from few where cp <= 2),
    rows as (
      select h.query, 'here' as part, row_number() over (partition by h.query order by place) as place, course_id, course_number, title, college_id
      from here h left join matched m on h.query = m.query where course_id is distinct from match_id
      union all select query, 'elsewhere', merged_place, course_id, course_number, title, college_id from merged where merged_place <= 10)
    select case r.query when 'introduction red' then 'Intro. red' else r.query end as query, part, place, course_id, course_number, title, college_id, match_id,
      case when match_id is null then 'query' else 'course' end as basis, case when match_id is null and e is null then 'words' else 'meaning' end as method
    from rows r join asked a on r.query = a.query
    """,
)
def college_check(t: Tables) -> DataFrame:
    """A matched, an unmatched, a shorthand and a number query at one college."""
    vectors, target = embedded_parts(t), t.embeddings().where("course_id = 17").select("embedding").scalar()
    out = None
    for typed in CHECKED:
        rows = search.college_check(t.parts(), typed, "SMALL", vectors, target, course_similarity=0.05, query_similarity=0.1)
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "college_payload",
    f"""
    select college_id, course_count > 0 as indexed, course_count, department_count, departments_sourced,
      case when department_count > 0 and departments_sourced >= department_count then 'all'
        when departments_sourced > 0 then 'partial' else 'none' end as coverage
    from ({COLLEGE_STATS_SQL})
    """,
)
def college_payload(t: Tables) -> DataFrame:
    return search.college_payload(college_stats_of(t))


@query(
    "content_words",
    f"select p_partkey, array_to_string({_content('p_name')}, ' ') as words, {_squash('p_brand')} as number_key from part",
)
def content_words(t: Tables) -> DataFrame:
    return t.read("part").select(
        "p_partkey",
        F.array_join(text.content_words(F.col("p_name")), " ").alias("words"),
        text.squash(F.col("p_brand")).alias("number_key"),
    )


@query(
    "trigram_measures",
    f"""
    with m as (select p_partkey, p_name, q from part, (select unnest(['red widget', 'small rings', 'hot gears on', 'introduction to']) as q))
    select p_partkey, q as query, round({_sim(_grams('q'), _grams('p_name'))}, 6) as similarity,
      round({_word_sim(_grams('q'), _gram_list('p_name'))}, 6) as word_similarity,
      round(case when length({_content('q')}) > 0 then length(list_filter({_content('q')}, lambda a: length(list_filter({_content('p_name')}, lambda b:
        a = b or (length(a) >= 5 and length(b) >= 5 and {_sim(_grams('a'), _grams('b'))} >= 0.6))) > 0)) / length({_content('q')}) end, 6) as coverage
    from m
    """,
)
def trigram_measures(t: Tables) -> DataFrame:
    typed = F.array(*[F.lit(q) for q in ("red widget", "small rings", "hot gears on", "introduction to")])
    pairs = deal_out(t.read("part").select("p_partkey", "p_name")).select("*", F.explode(typed).alias("query"))
    q, name = F.col("query"), F.col("p_name")
    return pairs.select(
        "p_partkey",
        "query",
        F.round(text.similarity(q, name), 6).alias("similarity"),
        F.round(text.word_similarity(q, name), 6).alias("word_similarity"),
        F.round(text.coverage(text.content_words(q), text.content_words(name)), 6).alias("coverage"),
    )


@query(
    "query_rewrite",
    r"""
    select p_partkey, regexp_replace(regexp_replace(q, '\blab\b\.?', 'laboratory', 'gi'), '\bintro\b\.?', 'introduction', 'gi') as expanded,
      replace(replace(replace(q, '\', '\\'), '%', '\%'), '_', '\_') as escaped,
      regexp_matches(p_brand, '(?i)[a-z]{3,}') as has_words
    from (select *, 'Intro. 50%_' || p_name || ' lab \ labs' as q from part)
    """,
)
def query_rewrite(t: Tables) -> DataFrame:
    typed = F.concat(F.lit("Intro. 50%_"), "p_name", F.lit(" lab \\ labs"))
    return t.read("part").select(
        "p_partkey",
        search.query_text(typed).alias("expanded"),
        text.escape_like(typed).alias("escaped"),
        text.has_words(F.col("p_brand")).alias("has_words"),
    )


MODEL = "small-model"


def stored_hashes(t: Tables) -> DataFrame:
    """An earlier run's hashes: French documents have changed since, Spanish ones are new."""
    docs = plan_courses(t)
    now = similarity.embedding_text(F.col("title"), F.col("department_name"), F.col("description"))
    changed = F.when(F.col("department_name") == "fr", F.concat(now, F.lit("!"))).otherwise(now)
    return docs.filter("department_name <> 'es'").select(
        "course_id", similarity.content_hash(MODEL, changed).alias("content_hash")
    )


def plan_courses(t: Tables) -> DataFrame:
    thin = F.col("doc_id") % 11 == 0
    return t.read("documents").select(
        F.col("doc_id").alias("course_id"),
        F.col("source").alias("college_id"),
        F.concat(F.lit("DOC "), F.col("doc_id").cast("string")).alias("course_number"),
        F.when(thin, F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).otherwise(F.col("source")).alias("title"),
        F.col("lang").alias("department_name"),
        F.when(~thin, F.col("text")).alias("description"),
    )


_EMBED_TEXT = r"""
      select doc_id, source, lang, doc_id % 11 = 0 as thin,
        case when doc_id % 11 = 0 then 'doc-' || doc_id else source end || chr(10) || lang ||
          case when doc_id % 11 <> 0 and d <> '' then chr(10) || d else '' end as body
      from (select *, substring(regexp_replace(regexp_replace(text, '[\s\x{0b}\x{a0}]+', ' ', 'g'), '^ +| +$', '', 'g'), 1) as d from documents)
"""
PLAN_SQL = f"""
    with b as ({_EMBED_TEXT}),
    h as (select *, sha1('small-model' || chr(10) || body) as new_hash,
        case when lang <> 'es' then sha1('small-model' || chr(10) || body || case when lang = 'fr' then '!' else '' end) end as old_hash from b)
    select doc_id as course_id, source as college_id, new_hash, length(body) as chars,
      case when thin then 'delete' when new_hash = old_hash then 'unchanged' else 'embed' end as action
    from h
"""


@query("embedding_plan", PLAN_SQL)
def embedding_plan(t: Tables) -> DataFrame:
    return similarity.embedding_plan(plan_courses(t), stored_hashes(t), MODEL)


@query(
    "embedding_batches",
    f"""
    select college_id, course_id, (row_number() over (partition by college_id order by course_id) - 1) // 20 as batch
    from ({PLAN_SQL}) where action = 'embed'
    """,
)
def embedding_batches(t: Tables) -> DataFrame:
    plan = similarity.embedding_plan(plan_courses(t), stored_hashes(t), MODEL)
    return similarity.embedding_batches(plan, 20)


@query(
    "embedding_totals",
    f"""
    select *, round(tokens / 1000000.0 * 0.02, 6) as cost from (
      select college_id, count(*) filter (where action = 'embed') as embedded,
        count(*) filter (where action = 'unchanged') as unchanged, count(*) filter (where action = 'delete') as skipped,
        cast(ceil(sum(case when action = 'embed' then chars else 0 end) / 4) as bigint) as tokens
      from ({PLAN_SQL}) group by 1)
    """,
)
def embedding_totals(t: Tables) -> DataFrame:
    plan = similarity.embedding_plan(plan_courses(t), stored_hashes(t), MODEL)
    return similarity.embedding_totals(plan, 0.02)


def _tokens(c: str) -> str:
    """SQL for the content tokens of a stem."""
    space = r"\s\x{0b}\x{a0}"
    plain = f"regexp_replace(lower({c}), '[^a-z0-9{space}]', ' ', 'g')"
    return (
        f"list_distinct(list_filter(regexp_split_to_array({plain}, '[{space}]+'), "
        f"lambda x: length(x) > 2 and x not in ({STOPS})))"
    )


@query(
    "stem_tokens",
    f"select doc_id, array_to_string(list_sort({_tokens('text')}), ' ') as tokens from documents",
)
def stem_tokens(t: Tables) -> DataFrame:
    return t.read("documents").select(
        "doc_id", F.array_join(F.array_sort(text.stem_tokens(F.col("text"))), " ").alias("tokens")
    )


@query(
    "token_jaccard",
    f"""
    with d as (select doc_id, source, {_tokens('text')} as k from documents),
    p as (select doc_id, k, lag(k) over (partition by source order by doc_id) as b, lag(doc_id) over (partition by source order by doc_id) as other from d)
    select doc_id, other, round(case when length(k) = 0 or length(b) = 0 then 0.0
      else length(list_intersect(k, b)) / (length(k) + length(b) - length(list_intersect(k, b))) end, 6) as jaccard
    from p where other is not null
    """,
)
def token_jaccard(t: Tables) -> DataFrame:
    """Likeness of each document to the one before it in its source."""
    from lectern.operators.ranks import number_rows

    docs = t.read("documents").select("doc_id", "source", text.stem_tokens(F.col("text")).alias("tokens"))
    placed = number_rows(
        docs, ["source"], [F.asc("doc_id")], F.floor(F.col("doc_id") / 10_000), "n"
    )
    before = placed.select(
        "source", (F.col("n") + 1).alias("n"), F.col("doc_id").alias("other"), F.col("tokens").alias("b")
    )
    return placed.join(before, ["source", "n"]).select(
        "doc_id", "other", F.round(text.token_jaccard(F.col("tokens"), F.col("b")), 6).alias("jaccard")
    )


# -- the same from SQL -------------------------------------------------------------------------


@query(
    "sql_functions",
    f"""
    select p_partkey, array_to_string({_content('p_name')}, ' ') as words, {_squash('p_brand')} as number_key,
      round({_sim(_grams("'small rings'"), _grams('p_name'))}, 6) as sim, round({_word_sim(_grams("'small rings'"), _gram_list('p_name'))}, 6) as word_sim,
      case when length(list_filter({_content('p_name')}, lambda b: b = 'hot')) > 0 then 1.0 else 0.0 end as coverage,
      case when p_partkey < 50 then 'Introductory' when p_partkey < 100 then 'Undergraduate'
        when floor(p_partkey / case when p_partkey < 1000 then 100 else 1000 end) <= 1 then 'Introductory'
        when floor(p_partkey / case when p_partkey < 1000 then 100 else 1000 end) <= 4 then 'Undergraduate' else 'Graduate' end as level
    from part
    """,
)
def sql_functions(t: Tables) -> DataFrame:
    """The scalar functions called from SQL."""
    sql.register(t.spark)
    return t.spark.sql(
        """
        SELECT p_partkey, array_join(course_content_words(p_name), ' ') AS words, course_number_key(p_brand) AS number_key,
          round(similarity('small rings', p_name), 6) AS sim, round(word_similarity('small rings', p_name), 6) AS word_sim,
          content_coverage(course_content_words('the hot'), course_content_words(p_name)) AS coverage,
          course_level(concat('CS ', p_partkey)) AS level
        FROM {part}
        """,
        part=t.read("part"),
    )


@query(
    "sql_search",
    scored_sql(typed_sql()) + ranked_sql("score", 10, None) + f"select {ROUNDED} from found",
)
def sql_search(t: Tables) -> DataFrame:
    """A table of typed texts, each searched by the table function."""
    sqltables.register_search(t.spark, t.parts())
    typed = t.spark.createDataFrame([(q,) for q in TYPED], "query string")
    found = t.spark.sql(
        """
        SELECT typed.query, place, course_id, course_number, title, college_id, score, exactness, coverage, likeness
        FROM {typed} AS typed, LATERAL search_courses(typed.query)
        """,
        typed=typed,
    )
    return rounded(found)


@query(
    "sql_search_similar",
    scored_sql("select 'hot gear' as query", "p_type <> 'SMALL'")
    + ranked_sql("exactness", 12, 2)
    + f"select {ROUNDED} from found",
)
def sql_search_similar(t: Tables) -> DataFrame:
    """One text with every parameter named."""
    sqltables.register_search(t.spark, t.parts())
    found = t.spark.sql(
        """
        SELECT 'hot gear' AS query, place, course_id, course_number, title, college_id, score, exactness, coverage, likeness
        FROM search_courses('hot gear', p_exclude_college_id => 'SMALL', p_limit => 12, p_per_college => 2, p_rank_by => 'exactness')
        """
    )
    return rounded(found)


@query(
    "sql_similar",
    f"select course_id, college_id, round(similarity, 6) as similarity, place from ({nearest_sql('label <> 3 and vec_id <> 17', 17, 0.1, 3, 15)})",
)
def sql_similar(t: Tables) -> DataFrame:
    """Courses like a stored one, from SQL."""
    sqltables.register_similar(t.spark, t.embeddings())
    return t.spark.sql(
        """
        SELECT course_id, college_id, round(similarity, 6) AS similarity, place
        FROM similar_courses(p_course_id => 17, p_exclude_college_id => 3, p_per_college => 3, p_limit => 15, p_min_similarity => 0.1D)
        """
    )
