"""Grading, report, history and validation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import display, text
from lectern.operators import assessment, listing, quality, stats
from lectern.plans.registry import query
from lectern.sources.tables import Tables

PERCENT = "cast(floor(value / 500 * 100 + 0.5) as bigint)"


def scored(t: Tables) -> DataFrame:
    return assessment.scored_attempts(t.attempts())


@query(
    "history",
    f"""
    select user_id, event_type as test_set_id, count(*) as attempts,
      arg_min({PERCENT}, ts) as first_percent, arg_max({PERCENT}, ts) as latest_percent, max({PERCENT}) as best_percent,
      arg_max({PERCENT}, ts) - arg_min({PERCENT}, ts) as improvement
    from events group by 1, 2
    """,
)
def history(t: Tables) -> DataFrame:
    return assessment.history(scored(t), ["user_id", "test_set_id"])


@query(
    "history_totals",
    f"""
    with p as (select *, {PERCENT} as percent,
        row_number() over (partition by user_id order by ts, event_id) as a,
        row_number() over (partition by user_id order by ts desc, event_id desc) as z from events)
    select user_id, count(*) as attempts_taken, cast(floor(avg(percent) + 0.5) as bigint) as average_percent,
      max(percent) as best_percent, count(distinct event_type) as distinct_tests,
      case when count(*) >= 4 then cast(floor(avg(percent) filter (where z <= 3) - avg(percent) filter (where a <= 3) + 0.5) as bigint) end as trend
    from p group by 1
    """,
)
def history_totals(t: Tables) -> DataFrame:
    return assessment.history_totals(scored(t), "user_id", "test_set_id")


@query(
    "results_numbered",
    f"""
    with p as (select *, {PERCENT} as percent,
        row_number() over (partition by user_id, event_type order by ts, event_id) as attempt_number from events)
    select event_id as attempt_id, user_id, event_type as test_set_id, attempt_number, percent,
      cast(floor(avg(percent) over (partition by user_id, event_type) + 0.5) as bigint) as overall_mean
    from p
    """,
)
def results_numbered(t: Tables) -> DataFrame:
    keys = ["user_id", "test_set_id"]
    numbered = assessment.numbered_attempts(scored(t), keys)
    return assessment.timeline(numbered, keys).select(
        "attempt_id", *keys, "attempt_number", "percent", "overall_mean"
    )


@query(
    "results_summary",
    f"""
    select user_id, event_type as test_set_id, count(*) as attempts, arg_max({PERCENT}, ts) as latest_percent,
      max({PERCENT}) as best_percent, cast(floor(avg({PERCENT}) + 0.5) as bigint) as average_percent,
      case when count(*) > 1 then arg_max({PERCENT}, ts) - arg_min({PERCENT}, ts) end as change
    from events group by 1, 2
    """,
)
def results_summary(t: Tables) -> DataFrame:
    return assessment.result_summary(scored(t), ["user_id", "test_set_id"])


@query(
    "chosen_attempt",
    """
    select user_id, event_type as test_set_id, attempt_id from (
      select *, event_id as attempt_id, row_number() over (
        partition by user_id, event_type
        order by coalesce(event_id = r, false) desc, ts desc, event_id desc) as rn
      from events join (select user_id as u, min(event_id) as r from events group by 1) on u = user_id)
    where rn = 1
    """,
)
def chosen_attempt(t: Tables) -> DataFrame:
    """Each user asks for their very first attempt; other tests show the newest."""
    attempts = t.attempts().select("user_id", "test_set_id", "attempt_id", "submitted_at")
    asked = attempts.groupBy("user_id").agg(F.min("attempt_id").alias("requested"))
    picked = assessment.chosen_attempt(
        attempts.join(asked, "user_id"),
        ["user_id", "test_set_id"],
        F.col("attempt_id") == F.col("requested"),
    )
    return picked.select("user_id", "test_set_id", "attempt_id")


@query(
    "user_rollup",
    """
    with starred as (
      select user_id, n_name as college_name, p_brand || ' ' || p_name as course_name from (
        select user_id, cast(json_extract(props, '$.k') as bigint) as k, value > 250 as college from events where event_type = 'click')
      left join nation on college and n_nationkey = k left join part on not college and p_partkey = k),
    newest as (
      select *, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events)
    select e.user_id, count(*) as attempts_taken,
      cast(floor(avg(value / 500 * 100) + 0.5) as bigint) as average_score,
      cast(floor(max(value / 500 * 100) + 0.5) as bigint) as best_score,
      count(*) filter (where event_type = 'signup') as sets_created,
      count(*) filter (where event_type = 'click') as favorites,
      count(*) as call_count, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as total_tokens,
      cast(sum(cast(value as decimal(12,6))) as double) as cost,
      coalesce((select string_agg(college_name, '; ' order by college_name) from starred s where s.user_id = e.user_id), '') as favorite_colleges,
      coalesce((select string_agg(course_name, '; ' order by course_name) from starred s where s.user_id = e.user_id), '') as favorite_courses,
      (select string_agg(event_id || ' ' || event_type || ' of ' || 500, '; ' order by place) from newest n where n.user_id = e.user_id and place <= 5) as recent_results
    from events e group by e.user_id
    """,
)
def user_rollup(t: Tables) -> DataFrame:
    """Clicks are favourites: valuable ones of a college, others of a course; every event is an attempt."""
    events = t.read("events")
    spend = t.ledger().groupBy(F.col("college_id").alias("user_id")).agg(
        F.count(F.lit(1)).alias("call_count"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("cost").cast("double").alias("cost"),
    )
    target, valuable = F.get_json_object("props", "$.k").cast("bigint"), F.col("value") > 250
    starred = events.filter("event_type = 'click'").select(
        "user_id", F.when(valuable, target).alias("college_id"), F.when(~valuable, target).alias("course_id")
    )
    colleges = t.read("nation").select(F.col("n_nationkey").cast("bigint").alias("college_id"), F.col("n_name").alias("college_name"))
    rolled = assessment.user_rollup(
        events.select("user_id").distinct(),
        assessment.named_favorites(starred, colleges, t.parts()),
        events.filter("event_type = 'signup'").select("user_id"),
        t.attempts().withColumn("section_title", F.col("test_set_id")),
        spend,
    )
    shown = F.transform(
        "recent_results", lambda r: F.concat_ws(" ", r["attempt_id"], r["section_title"], F.lit("of"), r["total_questions"])
    )
    return rolled.withColumns(
        {
            "favorite_colleges": F.array_join("favorite_colleges", "; "),
            "favorite_courses": F.array_join("favorite_courses", "; "),
            "recent_results": F.array_join(shown, "; "),
        }
    )


@query(
    "recent_results",
    """
    select user_id, event_id as attempt_id, place from (
      select *, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events)
    where place <= 5
    """,
)
def recent_results(t: Tables) -> DataFrame:
    recent = assessment.recent_results(t.attempts(), "user_id")
    return recent.select("user_id", "attempt_id", "place")


def question_rows(t: Tables) -> DataFrame:
    """Labelled documents as answered questions: topic is the language, right is the quality flag."""
    docs = t.read("documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(t.read("labels"), "doc_id", "left").select(
        "doc_id",
        F.col("source").alias("attempt_id"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("topic"),
        F.when(F.col("n_chars") < 1000, "easy").when(F.col("n_chars") < 3000, "medium").otherwise("hard").alias("difficulty"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_correct"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("flagged"),
    )


REPORT_SQL = """
    select d.doc_id, source as attempt_id, case when lang <> 'es' then lang end as topic,
      case when n_chars < 1000 then 'easy' when n_chars < 3000 then 'medium' else 'hard' end as difficulty,
      coalesce(quality = 1, false) as is_correct, coalesce(toxic = 1, false) as flagged
    from documents d left join labels l on l.doc_id = d.doc_id
"""


@query(
    "topic_accuracy",
    f"""
    select coalesce(topic, 'Untagged') as topic, count(*) filter (where is_correct) as correct, count(*) as total,
      cast(floor(count(*) filter (where is_correct) / count(*) * 100 + 0.5) as bigint) as percent
    from ({REPORT_SQL}) group by 1
    """,
)
def topic_accuracy(t: Tables) -> DataFrame:
    return assessment.topic_accuracy(question_rows(t))


@query(
    "difficulty_accuracy",
    f"""
    select difficulty, count(*) filter (where is_correct) as correct, count(*) as total,
      cast(floor(count(*) filter (where is_correct) / count(*) * 100 + 0.5) as bigint) as percent,
      count(*) filter (where not is_correct) as incorrect,
      case difficulty when 'easy' then 1 when 'medium' then 2 else 3 end as place
    from ({REPORT_SQL}) group by 1
    """,
)
def difficulty_accuracy(t: Tables) -> DataFrame:
    return assessment.difficulty_accuracy(question_rows(t))


@query(
    "attempt_report",
    f"""
    select attempt_id, case when attempt_id like '%1' then 3 else count(*) filter (where is_correct) end as score,
      case when attempt_id like '%1' then 50 else count(*) end as total, count(*) as questions,
      count(*) filter (where not is_correct) as incorrect, count(*) filter (where flagged) as flagged
    from ({REPORT_SQL}) group by 1
    """,
)
def attempt_report(t: Tables) -> DataFrame:
    """Totals per attempt; only sources ending in 1 have a stored score."""
    rows = question_rows(t)
    stored = F.col("attempt_id").like("%1")
    attempts = rows.select("attempt_id").distinct().select(
        "attempt_id",
        F.when(stored, F.lit(3)).alias("score"),
        F.when(stored, 50).otherwise(0).alias("total_questions"),
    )
    return assessment.report_totals(rows, attempts, "attempt_id")


@query(
    "report_filter",
    f"select doc_id, 'incorrect' as shown from ({REPORT_SQL}) where not is_correct union all select doc_id, 'flagged' from ({REPORT_SQL}) where flagged",
)
def report_filter(t: Tables) -> DataFrame:
    rows = question_rows(t)
    shown = [
        assessment.report_filter(rows, s).select("doc_id", F.lit(s).alias("shown"))
        for s in ("incorrect", "flagged")
    ]
    return shown[0].unionByName(shown[1])


def answered(t: Tables) -> tuple[DataFrame, DataFrame]:
    """User turns as questions keyed by the next turn's text; types cycle with the turn."""
    talk = t.read("conversations").select("conv_id", "turn", "text")
    kind = F.element_at(
        F.array(F.lit("mcq"), F.lit("true_false"), F.lit("short_answer")), (F.col("turn") % 3 + 1).cast("int")
    )
    key = talk.select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"),
        F.col("conv_id").alias("test_set_id"),
        kind.alias("type"),
        F.col("text").alias("correct_answer"),
    )
    # The answer is the turn before, or the key itself in capitals on every fourth turn.
    before = talk.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("earlier"))
    answers = (
        talk.filter("turn > 0")
        .join(before, ["conv_id", "turn"], "left")
        .select(
            F.col("conv_id").alias("attempt_id"),
            F.concat_ws("-", "conv_id", "turn").alias("question_id"),
            F.when(F.col("turn") % 4 == 1, F.concat(F.lit("  "), F.translate("text", "aeiou", "AEIOU"), F.lit(" ")))
            .otherwise(F.col("earlier"))
            .alias("answer"),
        )
    )
    return answers, key


_SPACES = r"[\s\x{0b}\x{a0}]"
GRADED_SQL = rf"""
    with talk as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as earlier from conversations),
    answers as (
      select conv_id, turn, text as correct, case when turn % 4 = 1 then '  ' || translate(text, 'aeiou', 'AEIOU') || ' ' else earlier end as given
      from talk where turn > 0),
    norm as (
      select *, case turn % 3 when 0 then 'mcq' when 1 then 'true_false' else 'short_answer' end as type,
        regexp_replace(regexp_replace(lower(correct), '^{_SPACES}+|{_SPACES}+$', '', 'g'), '{_SPACES}+', ' ', 'g') as c,
        regexp_replace(regexp_replace(lower(given), '^{_SPACES}+|{_SPACES}+$', '', 'g'), '{_SPACES}+', ' ', 'g') as g
      from answers),
    toks as (
      select *, list_distinct(list_filter(regexp_split_to_array(regexp_replace(c, '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: length(x) > 3)) as ct,
        list_distinct(list_filter(regexp_split_to_array(regexp_replace(g, '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: length(x) > 3)) as gt
      from norm),
    graded as (
      select conv_id as attempt_id, conv_id || '-' || turn as question_id,
        case when coalesce(g, '') = '' then false when type in ('mcq', 'true_false') then c = g
          when length(ct) = 0 then false
          else length(list_intersect(ct, gt)) / length(ct) >= 0.6 end as is_correct
      from toks)
"""


@query("grade_answers", GRADED_SQL + " select * from graded")
def grade_answers(t: Tables) -> DataFrame:
    return assessment.grade_answers(*answered(t)).select("attempt_id", "question_id", "is_correct")


@query(
    "attempt_scores",
    GRADED_SQL
    + """
    select c.conv_id as attempt_id, c.conv_id as test_set_id,
      (select count(*) from graded g where g.attempt_id = c.conv_id and is_correct) as score, count(*) as total_questions
    from conversations c group by 1, 2
    """,
)
def attempt_scores(t: Tables) -> DataFrame:
    answers, key = answered(t)
    attempts = t.read("conversations").select(
        F.col("conv_id").alias("attempt_id"), F.col("conv_id").alias("test_set_id")
    ).distinct()
    return assessment.attempt_scores(attempts, assessment.grade_answers(answers, key), key)


def question_candidates(t: Tables) -> DataFrame:
    """Documents as proposed questions, some of them broken in every way the rules look for."""
    n = F.col("doc_id")
    options: Column = F.array(
        F.lit("alpha"),
        F.when(n % 7 == 0, " Alpha ").otherwise("beta"),
        F.col("lang"),
        F.col("source"),
    )
    return t.read("documents").select(
        "doc_id",
        F.when(n % 3 == 0, "mcq").when(n % 3 == 1, "true_false").otherwise("short_answer").alias("type"),
        F.when(n % 11 == 0, "brutal").otherwise("hard").alias("difficulty"),
        F.col("text").alias("question"),
        F.when(n % 5 == 0, F.slice(options, 1, 3)).otherwise(options).alias("options"),
        F.when(n % 3 == 0, F.when(n % 4 == 0, F.lit("gamma")).otherwise(F.upper("lang")))
        .when(n % 3 == 1, F.when(n % 2 == 0, " TRUE ").otherwise("maybe"))
        .otherwise(F.col("text"))
        .alias("correct_answer"),
        F.lit("because it is so").alias("explanation"),
        F.col("lang").alias("topic"),
    )


@query(
    "validate_questions",
    r"""
    with s as (
      select doc_id, lang, source, doc_id % 3 as kind,
        regexp_replace(text, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') as q from documents),
    r as (
      select doc_id, case
        when doc_id % 11 = 0 then 'unknown difficulty'
        when length(q) not between 10 and 1200 then 'question must be 10 to 1200 long'
        when kind = 2 and length(q) not between 1 and 1200 then 'correct_answer must be 1 to 1200 long'
        when kind = 0 and doc_id % 5 = 0 then 'exactly 4 options needed'
        when kind = 0 and doc_id % 4 = 0 then 'answer not among options'
        when kind = 0 and doc_id % 7 = 0 then 'options not distinct'
        when kind = 1 and doc_id % 2 = 1 then 'answer must be true or false' end as reject_reason from s)
    select coalesce(reject_reason, 'accepted') as verdict, count(*) as questions, min(doc_id) as first_id from r group by 1
    """,
)
def validate_questions(t: Tables) -> DataFrame:
    checked = quality.validate_questions(question_candidates(t))
    return checked.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("verdict")).agg(
        F.count(F.lit(1)).alias("questions"), F.min("doc_id").alias("first_id")
    )


@query(
    "validate_departments",
    """
    select c_custkey as department_id, upper(trim(code)) as code, trim(name) as name,
      case when length(trim(code)) not between 1 and 24 then 'code must be 1 to 24 long'
        when length(trim(name)) not between 1 and 200 then 'name must be 1 to 200 long' end as reject_reason
    from (select c_custkey, case when c_custkey % 9 = 0 then '  ' when c_custkey % 9 = 1 then c_name || ' of the school'
              else ' ' || lower(c_name) || ' ' end as code,
            case when c_custkey % 13 = 0 then '' else c_mktsegment || ' ' end as name from customer)
    """,
)
def validate_departments(t: Tables) -> DataFrame:
    n = F.col("c_custkey")
    raw = t.read("customer").select(
        n.alias("department_id"),
        F.when(n % 9 == 0, "  ")
        .when(n % 9 == 1, F.concat("c_name", F.lit(" of the school")))
        .otherwise(F.concat(F.lit(" "), F.lower("c_name"), F.lit(" ")))
        .alias("code"),
        F.when(n % 13 == 0, "").otherwise(F.concat("c_mktsegment", F.lit(" "))).alias("name"),
    )
    return quality.validate_departments(raw)


@query(
    "validate_courses",
    r"""
    select doc_id, length(d) as description_length,
      case when length(d) > 8000 then 'description longer than 8000' end as reject_reason
    from (select doc_id, regexp_replace(text, '^[\s\x{0b}\x{a0}]+|[\s\x{0b}\x{a0}]+$', '', 'g') as d from documents)
    """,
)
def validate_courses(t: Tables) -> DataFrame:
    raw = t.read("documents").select(
        "doc_id",
        F.concat(F.lit(" DOC "), F.col("doc_id").cast("string")).alias("course_number"),
        F.col("source").alias("title"),
        F.col("text").alias("description"),
        F.array("source").alias("instructors"),
    )
    return quality.validate_courses(raw).select(
        "doc_id", F.length("description").alias("description_length"), "reject_reason"
    )


@query(
    "validate_outline",
    """
    select p_partkey, 'book' as kind, nullif(regexp_replace(p_brand || 'x', '[^0-9Xx]', '', 'g'), '') as value,
      case when length(trim(substring(p_name, 1, p_size % 4))) < 2 then 'title must be 2 to 400 long' end as reject_reason
    from part
    union all
    select p_partkey, 'section', p_name,
      case when p_size > 45 then '1 to 20 topics needed' when p_size % 10 = 0 then 'topic must be 1 to 200 long' end
    from part
    """,
)
def validate_outline(t: Tables) -> DataFrame:
    """Parts as textbooks and as sections."""
    part = t.read("part")
    books = quality.validate_textbooks(
        part.select(
            "p_partkey",
            F.substring("p_name", F.lit(1), F.col("p_size") % 4).alias("title"),
            F.lit(None).cast("string").alias("authors"),
            F.lit(None).cast("string").alias("edition"),
            F.concat("p_brand", F.lit("x")).alias("isbn"),
            F.lit(None).cast("boolean").alias("required"),
        )
    )
    topics = F.when(F.col("p_size") > 45, F.array().cast("array<string>")).otherwise(
        F.array("p_name", F.when(F.col("p_size") % 10 == 0, " ").otherwise("p_type"))
    )
    sections = quality.validate_sections(
        part.select("p_partkey", F.col("p_name").alias("title"), topics.alias("topics"))
    )
    return books.select(
        "p_partkey", F.lit("book").alias("kind"), F.col("isbn").alias("value"), "reject_reason"
    ).unionByName(
        sections.select(
            "p_partkey", F.lit("section").alias("kind"), F.col("title").alias("value"), "reject_reason"
        )
    )


@query(
    "validate_messages",
    r"""
    with m as (
      select conv_id, turn, regexp_replace(text, '^[\s\x{0b}\x{a0}]+|[\s\x{0b}\x{a0}]+$', '', 'g') as message from conversations where turn % 7 <> 6)
    select conv_id, turn,
      case when turn = 3 then 'email not valid' when turn = 4 then 'topic not offered'
        when length(message) not between 10 and 5000 then 'message must be 10 to 5000 long' end as reject_reason
    from m
    """,
)
def validate_messages(t: Tables) -> DataFrame:
    turn = F.col("turn")
    raw = t.read("conversations").select(
        "conv_id",
        "turn",
        F.col("role").alias("name"),
        F.when(turn == 3, "nobody at home").otherwise("a.b@school.edu").alias("email"),
        F.when(turn == 4, "Spam").otherwise("Partnerships").alias("topic"),
        F.col("text").alias("message"),
        F.when(turn % 7 == 6, "Bot Inc").alias("company"),
    )
    return quality.validate_messages(raw).select("conv_id", "turn", "reject_reason")


@query(
    "constraint_audit",
    """
    select 'order status in O, F' as rule, (select count(*) from orders where o_orderstatus not in ('O', 'F')) as violations
    union all select 'order key unique', (select count(*) from (select 1 from orders group by o_orderkey having count(*) > 1))
    union all select 'line position unique', (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1))
    union all select 'line has an order', (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders))
    union all select 'label has a document', (select count(*) from labels where doc_id not in (select doc_id from documents))
    union all select 'event has a customer', (select count(*) from events where event_id not in (select c_custkey from customer))
    union all select 'exactly one star target', (select count(*) from events where event_type not in ('view', 'click'))
    union all select 'document text given', (select count(*) from documents where text is null)
    """,
)
def constraint_audit(t: Tables) -> DataFrame:
    orders, lines, events = t.read("orders"), t.read("lineitem"), t.read("events")
    stars = events.select(
        F.when(F.col("event_type") == "view", F.col("user_id")).alias("college_id"),
        F.when(F.col("event_type") == "click", F.col("event_id")).alias("course_id"),
    )
    return quality.audit(
        [
            ("order status in O, F", quality.not_in(orders, "o_orderstatus", ["O", "F"])),
            ("order key unique", quality.repeated(orders, ["o_orderkey"])),
            ("line position unique", quality.repeated(lines, ["l_orderkey", "l_linenumber"])),
            ("line has an order", quality.orphans(lines, "l_orderkey", orders, "o_orderkey")),
            ("label has a document", quality.orphans(t.read("labels"), "doc_id", t.read("documents"), "doc_id")),
            ("event has a customer", quality.orphans(events, "event_id", t.read("customer"), "c_custkey")),
            ("exactly one star target", quality.not_exactly_one(stars, ["college_id", "course_id"])),
            ("document text given", quality.missing(t.read("documents"), "text")),
        ]
    )


@query(
    "owner_scope",
    """
    select 'course' as kind, o_orderkey as id, cast(null as integer) as position from orders where o_custkey = 7
    union all
    select 'section', l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_custkey = 7)
    """,
)
def owner_scope(t: Tables) -> DataFrame:
    orders = t.read("orders").select("o_orderkey", "o_custkey")
    own = quality.owned_by(orders, "o_custkey", 7)
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    through = quality.owned_through(lines, orders, "o_orderkey", "o_custkey", 7)
    return own.select(
        F.lit("course").alias("kind"), F.col("o_orderkey").alias("id"), F.lit(None).cast("int").alias("position")
    ).unionByName(
        through.select(
            F.lit("section").alias("kind"), F.col("o_orderkey").alias("id"), F.col("l_linenumber").alias("position")
        )
    )


@query(
    "attempt_requests",
    """
    select event_id, case when p_partkey is null then 'unknown test' when p_size % 5 = 0 then 'no questions yet' end as reject_reason
    from events left join part on p_partkey = event_id
    """,
)
def attempt_requests(t: Tables) -> DataFrame:
    requests = t.read("events").select("event_id", F.col("event_id").alias("test_set_id"))
    sets = t.read("part").select(
        F.col("p_partkey").alias("test_set_id"), (F.col("p_size") % 5).alias("question_count")
    )
    return assessment.attempt_requests(requests, sets).select("event_id", "reject_reason")


@query(
    "set_requests",
    """
    with recent as (select user_id, count(*) as created from events where ts >= timestamp '2024-01-14' and ts <= timestamp '2024-01-15' group by 1)
    select event_id, case when event_id % 4 = 0 then 'length not offered'
      when event_id not in (select o_orderkey from orders where o_orderstatus <> 'P') then 'unknown section'
      when created >= 3 then 'daily limit reached' end as reject_reason
    from events left join recent using (user_id)
    """,
)
def set_requests(t: Tables) -> DataFrame:
    from lectern.operators.planning import trailing_count

    events = t.read("events")
    n = F.col("event_id")
    requests = events.select(
        "event_id",
        "user_id",
        n.alias("section_id"),
        F.when(n % 4 == 0, 33).when(n % 4 == 1, 25).otherwise(100).alias("length"),
    )
    sections = t.read("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("section_id"))
    recent = trailing_count(events, "user_id", "ts", F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")))
    return assessment.test_set_requests(requests, sections, recent, cap=3).select("event_id", "reject_reason")


@query(
    "owner_deletes",
    "select event_id as test_set_id, user_id from events where user_id % 3 <> 0",
)
def owner_deletes(t: Tables) -> DataFrame:
    """Delete requests, a third of them made by somebody else."""
    sets = t.read("events").select(F.col("event_id").alias("test_set_id"), "user_id")
    asked = sets.withColumn(
        "user_id", F.when(F.col("user_id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    )
    return assessment.owner_deletes(asked, sets)


@query(
    "export_sets",
    """
    select o_orderkey as test_set_id,
      '{"test_set_id":' || o_orderkey || ',"section":"' || o_orderpriority || '","status":"complete","questions":['
        || string_agg('{"position":' || (l_linenumber + 1) || ',"question":' || l_partkey || ',"difficulty":"' || l_returnflag || '"}', ','
             order by l_linenumber, l_partkey, l_returnflag) || ']}' as document
    from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'F' group by o_orderkey, o_orderpriority
    """,
)
def export_sets(t: Tables) -> DataFrame:
    """Finished orders as JSON documents of their line items in order."""
    return assessment.export_sets(*_exported(t), "test_set_id", ["question", "difficulty"])


def _exported(t: Tables) -> tuple[DataFrame, DataFrame]:
    sets = t.read("orders").select(
        F.col("o_orderkey").alias("test_set_id"),
        F.col("o_orderpriority").alias("section"),
        F.when(F.col("o_orderstatus") == "F", "complete").otherwise("generating").alias("status"),
    )
    questions = t.read("lineitem").select(
        F.col("l_orderkey").alias("test_set_id"),
        F.col("l_linenumber").alias("position"),
        F.col("l_partkey").alias("question"),
        F.col("l_returnflag").alias("difficulty"),
    )
    return sets, questions


@query(
    "export_pieces",
    """
    with q as (
      select l_orderkey as test_set_id, l_linenumber // 3 as piece, string_agg(
          '{"position":' || (l_linenumber + 1) || ',"question":' || l_partkey || ',"difficulty":"' || l_returnflag || '"}', ','
          order by l_linenumber, l_partkey, l_returnflag) as body
      from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') group by 1, 2),
    e as (select *, min(piece) over w as first, max(piece) over w as last, count(*) over w as pieces from q window w as (partition by test_set_id))
    select test_set_id, piece, pieces,
      case when piece = first then '{"test_set_id":' || test_set_id || ',"section":"' || o_orderpriority || '","status":"complete","questions":[' else ',' end
        || body || case when piece = last then ']}' else '' end as text
    from e join orders on o_orderkey = test_set_id
    """,
)
def export_pieces(t: Tables) -> DataFrame:
    """The same documents in pieces of three places."""
    return assessment.export_pieces(*_exported(t), "test_set_id", ["question", "difficulty"], per_piece=3)


@query(
    "question_mix",
    """
    with q as (
      select source, lang as topic, lower(trim(text)) as stem,
        doc_id % 3 as kind, doc_id % 11 as level, doc_id from documents)
    select source, count(*) as questions, count(*) filter (where kind = 0) as mcq, count(*) filter (where kind = 1) as true_false,
      count(*) filter (where kind = 2) as short_answer, 0::bigint as easy, 0::bigint as medium, count(*) filter (where level <> 0) as hard,
      count(*) filter (where kind = 0) as bad_choices, count(distinct topic) as topics, count(*) - count(distinct stem) as repeated_stems
    from q group by 1
    """,
)
def question_mix(t: Tables) -> DataFrame:
    """Mix of the proposed questions of each source; answers never match an option as written."""
    source = t.read("documents").select("doc_id", "source")
    return stats.question_mix(question_candidates(t).join(source, "doc_id"), "source")


@query(
    "attempt_report_lines",
    """
    select user_id, event_id, case when event_type <> 'view' then event_type end as answer,
      event_type = 'purchase' as is_correct, event_type = 'error' as flagged from events
    """,
)
def attempt_report_lines(t: Tables) -> DataFrame:
    """Every event of a user as a question; views have no answer."""
    events, keys = t.read("events"), ["user_id", "event_id"]
    given = events.filter("event_type <> 'view'").select(
        *keys,
        F.col("event_type").alias("answer"),
        (F.col("event_type") == "purchase").alias("is_correct"),
        (F.col("event_type") == "error").alias("flagged"),
    )
    return assessment.report_rows(events.select(*keys), given, keys)


@query(
    "appended_positions",
    """
    select event_id, user_id, (select count(*) from events h where h.user_id = e.user_id and h.event_type = 'purchase')
      + row_number() over (partition by user_id order by event_id) - 1 as position
    from events e where event_type = 'click'
    """,
)
def appended_positions(t: Tables) -> DataFrame:
    """Clicks appended to a list that holds a user's purchases already."""
    events = t.read("events").select("event_id", "user_id", "event_type")
    new, held = events.filter("event_type = 'click'"), events.filter("event_type = 'purchase'")
    return assessment.number_from_count(new.drop("event_type"), held, ["user_id"], "event_id")


# Conversations as attempts: long ones were submitted before, those of five turns are sent by another user.
_SUBMITTED = (
    GRADED_SQL
    + """,
    attempts as (
      select conv_id as attempt_id, conv_id % 7 as user_id, count(*) as turns,
        case when count(*) > 7 then timestamp '2024-01-01' end as submitted_at from conversations group by 1),
    taken as (select * from attempts where submitted_at is null and turns <> 5),
    fresh as (
      select attempt_id, question_id, given as answer, is_correct, turn % 2 = 0 as flagged
      from graded join answers on conv_id = attempt_id and question_id = conv_id || '-' || turn
      where attempt_id in (select attempt_id from taken)),
    stored as (
      select conv_id as attempt_id, conv_id || '-' || turn as question_id, role as answer, false as is_correct, true as flagged
      from conversations where turn <= 1)
"""
)


@query(
    "recorded_answers",
    _SUBMITTED
    + """
    select * from fresh union all
    select * from stored where not exists (select 1 from fresh where fresh.attempt_id = stored.attempt_id and fresh.question_id = stored.question_id)
    """,
)
def recorded_answers(t: Tables) -> DataFrame:
    return _submitted(t)[0]


@query(
    "graded_attempts",
    _SUBMITTED
    + """
    select a.attempt_id, a.user_id, case when k.attempt_id is not null then timestamp '2024-02-01' else a.submitted_at end as submitted_at,
      case when k.attempt_id is not null then (select count(*) from fresh f where f.attempt_id = a.attempt_id and is_correct) end as score,
      case when k.attempt_id is not null then a.turns end as total_questions
    from attempts a left join taken k on k.attempt_id = a.attempt_id
    """,
)
def graded_attempts(t: Tables) -> DataFrame:
    return _submitted(t)[1].drop("test_set_id")


@query(
    "submission_verdicts",
    _SUBMITTED
    + """
    select coalesce(reject_reason, 'taken') as verdict, count(*) as submissions, min(attempt_id) as first_id from (
      select attempt_id, case when turns = 5 then 'someone else''s attempt' when submitted_at is not null then 'already submitted' end as reject_reason from attempts
      union all select -1 - attempt_id, 'unknown attempt' from attempts) group by 1
    """,
)
def submission_verdicts(t: Tables) -> DataFrame:
    attempts, submissions = _submissions(t)
    unknown = submissions.withColumn("attempt_id", -1 - F.col("attempt_id"))
    judged = assessment.submission_verdicts(submissions.unionByName(unknown), attempts)
    return judged.groupBy(F.coalesce("reject_reason", F.lit("taken")).alias("verdict")).agg(
        F.count(F.lit(1)).alias("submissions"), F.min("attempt_id").alias("first_id")
    )


def _submissions(t: Tables) -> tuple[DataFrame, DataFrame]:
    talks = t.read("conversations").groupBy(F.col("conv_id").alias("attempt_id")).agg(F.count(F.lit(1)).alias("turns"))
    user = F.col("attempt_id") % 7
    before = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    attempts = talks.select(
        "attempt_id",
        user.alias("user_id"),
        F.col("attempt_id").alias("test_set_id"),
        F.when(F.col("turns") > 7, before).alias("submitted_at"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("score", "total_questions")],
    )
    submissions = talks.select(
        "attempt_id",
        F.when(F.col("turns") == 5, user + 1).otherwise(user).alias("user_id"),
        F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")).alias("at"),
    )
    return attempts, submissions


def _submitted(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Every conversation handed in, with answers to questions of another test among the sent ones."""
    attempts, submissions = _submissions(t)
    answers, key = answered(t)
    turn = F.element_at(F.split("question_id", "-"), -1).cast("int")
    sent = answers.withColumn("flagged", turn % 2 == 0)
    foreign = sent.withColumn("attempt_id", F.col("attempt_id") + 1)
    stored = t.read("conversations").filter("turn <= 1").select(
        F.col("conv_id").alias("attempt_id"),
        F.concat_ws("-", "conv_id", "turn").alias("question_id"),
        F.col("role").alias("answer"),
        F.lit(False).alias("is_correct"),
        F.lit(True).alias("flagged"),
    )
    return assessment.submit_attempts(attempts, stored, submissions, sent.unionByName(foreign), key)


@query(
    "text_focus",
    """
    with d as (select doc_id, text, source, text || chr(10) || 'Required Texts: ' || source || chr(10) || text as t from documents)
    select doc_id, length(t) - strpos(t, 'Required Texts: ') + 1 as textbook_length, 'CS 7x ' || text as focused, length(text) as whole_length,
      case when doc_id % 2 = 0 then source || '|b' end as options
    from d
    """,
)
def text_focus(t: Tables) -> DataFrame:
    """Passages from a heading and from a course number on, over whole texts, and option lists."""
    docs = t.read("documents")
    page = F.concat("text", F.lit("\nRequired Texts: "), "source", F.lit("\n"), "text")
    options = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('["'), "source", F.lit('", "b"]')))
    options = options.when(F.col("doc_id") % 3 == 0, '{"a": "b"}').when(F.col("doc_id") % 5 == 0, "plain")
    return docs.select(
        "doc_id",
        F.length(text.focus(page, "textbooks")).alias("textbook_length"),
        text.focus_on_number(F.concat(F.lit("front matter CS 7x "), "text"), F.lit("CS 7x")).alias("focused"),
        F.length(text.focus_on_number(F.col("text"), F.lit("ZZ 999"))).alias("whole_length"),
        F.array_join(text.string_list(options), "|").alias("options"),
    )


@query(
    "provenance",
    """
    with p as (select p_partkey, ['kuali', 'generic', 'banner', 'acalog', 'other'][p_size % 5 + 1] as platform, ['manual', 'search', 'sitemap', 'homepage'][p_partkey % 4 + 1] as source from part)
    select p_partkey,
      case when source = 'manual' then 'Direct URL' else map {'generic': 'Scraped', 'kuali': 'Kuali', 'banner': 'Banner', 'acalog': 'Acalog'}[platform] end as label,
      case when source = 'manual' then 'manual' when platform = 'generic' then 'scraped' when platform <> 'other' then 'platform' end as kind,
      map {'search': 'Catalog found via web search.', 'sitemap': 'Catalog found in the site’s sitemap.xml.',
        'homepage': 'Catalog found by following links from the homepage.'}[source] as found
    from p
    """,
)
def provenance(t: Tables) -> DataFrame:
    """Where a catalog came from: label, kind and how it was found."""
    platforms, sources = ("kuali", "generic", "banner", "acalog", "other"), ("manual", "search", "sitemap", "homepage")
    platform = F.get(F.array(*[F.lit(p) for p in platforms]), F.col("p_size") % 5)
    source = F.get(F.array(*[F.lit(s) for s in sources]), (F.col("p_partkey") % 4).cast("int"))
    return t.read("part").select(
        "p_partkey",
        display.provenance_label(platform, source).alias("label"),
        display.provenance_kind(platform, source).alias("kind"),
        display.discovery_text(source).alias("found"),
    )


@query(
    "search_departments",
    "select c_custkey, c_name, c_mktsegment from customer where contains(lower(c_name), 'mach') or contains(lower(c_mktsegment), 'mach')",
)
def search_departments(t: Tables) -> DataFrame:
    rows = t.read("customer").select("c_custkey", "c_name", "c_mktsegment")
    return listing.containing(rows, ["c_name", "c_mktsegment"], " Mach ")


@query(
    "search_colleges",
    "select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey where contains(lower(n_name), 'ia') or contains(lower(r_name), 'ia')",
)
def search_colleges(t: Tables) -> DataFrame:
    rows = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return listing.containing(rows.select("n_nationkey", "n_name", "r_name"), ["n_name", "r_name"], "iA")
