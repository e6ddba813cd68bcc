"""Question-set planning and near-duplicate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import stem_tokens
from lectern.operators import dedupe, quota
from lectern.plans.finder import _sim, _tokens
from lectern.plans.registry import query
from lectern.sources.tables import Tables

_MIX = {"mcq": 70, "true_false": 15, "short_answer": 15}
_LEVELS = {"easy": 30, "medium": 45, "hard": 25}


def _share_sql(weights: dict[str, int], total: str) -> str:
    """Largest-remainder shares written as sums over ranked remainders."""
    names = list(weights)
    left = f"({total} - " + " - ".join(f"{total} * {w} // 100" for w in weights.values()) + ")"
    out = []
    for i, k in enumerate(names):
        ahead = " + ".join(
            f"case when {total} * {weights[o]} % 100 {'>=' if j < i else '>'} {total} * {weights[k]} % 100 then 1 else 0 end"
            for j, o in enumerate(names)
            if o != k
        )
        out.append(f"cast({total} * {weights[k]} // 100 + case when {ahead} < {left} then 1 else 0 end as integer) as {k}")
    return ", ".join(out)


_TARGETS_SQL = f"select o_orderkey as set_id, total, {_share_sql(_MIX, 'total')}, {_share_sql(_LEVELS, 'total')} from (select *, [10, 25, 40, 70, 100][1 + o_orderkey % 5] as total from orders)"


def set_lengths(t: Tables) -> DataFrame:
    """Every order as a set of one of the offered lengths."""
    lengths = F.array(*[F.lit(n) for n in (10, 25, 40, 70, 100)])
    return t.read("orders").select(
        F.col("o_orderkey").alias("set_id"),
        F.get(lengths, (F.col("o_orderkey") % 5).cast("int")).alias("total"),
    )


@query("apportion", _TARGETS_SQL)
def apportion(t: Tables) -> DataFrame:
    return quota.with_mix(set_lengths(t), "total")


@query(
    "batch_plans",
    f"""
    with t as ({_TARGETS_SQL}),
    slots as (select *, (total + 24) // 25 as batches, unnest(range(total)) as slot from t),
    dealt as (
      select set_id, row_number() over (partition by set_id order by slot % batches, slot) - 1 as place,
        case when slot < mcq then 'mcq' when slot < mcq + true_false then 'true_false' else 'short_answer' end as type,
        case when slot < easy then 'easy' when slot < easy + medium then 'medium' else 'hard' end as difficulty
      from slots)
    select set_id, cast(place // 25 as integer) as batch, count(*) as count,
      {', '.join(f"count(*) filter (where type = '{k}') as {k}" for k in _MIX)},
      {', '.join(f"count(*) filter (where difficulty = '{k}') as {k}" for k in _LEVELS)}
    from dealt group by 1, 2
    """,
)
def batch_plans(t: Tables) -> DataFrame:
    return quota.batch_plans(set_lengths(t), "set_id", "total")


_HELD_SQL = """
    select l_orderkey as set_id, case when l_returnflag = 'R' then 'mcq' when l_returnflag = 'A' then 'true_false' else 'short_answer' end as type,
      case when l_quantity < 15 then 'easy' when l_quantity < 35 then 'medium' else 'hard' end as difficulty from lineitem
"""


def held_questions(t: Tables) -> DataFrame:
    """Line items as the questions a set already holds."""
    flag = F.col("l_returnflag")
    return t.read("lineitem").select(
        F.col("l_orderkey").alias("set_id"),
        F.when(flag == "R", "mcq").when(flag == "A", "true_false").otherwise("short_answer").alias("type"),
        F.when(F.col("l_quantity") < 15, "easy")
        .when(F.col("l_quantity") < 35, "medium")
        .otherwise("hard")
        .alias("difficulty"),
    )


@query(
    "shortfall",
    f"""
    with t as ({_TARGETS_SQL}), h as ({_HELD_SQL}),
    g as (select set_id, count(*) as have,
            {', '.join(f"count(*) filter (where type = '{k}') as h_{k}" for k in _MIX)},
            {', '.join(f"count(*) filter (where difficulty = '{k}') as h_{k}" for k in _LEVELS)}
          from h group by 1)
    select set_id, greatest(1, total - coalesce(have, 0)) as ask,
      {', '.join(f"greatest(0, {k} - coalesce(h_{k}, 0)) as {k}" for k in [*_MIX, *_LEVELS])}
    from t left join g using (set_id)
    """,
)
def shortfall(t: Tables) -> DataFrame:
    targets = quota.with_mix(set_lengths(t), "total")
    return quota.shortfall(targets, held_questions(t), "set_id", "total")


@query(
    "set_status",
    f"""
    with t as ({_TARGETS_SQL}), g as (select set_id, count(*) as n from ({_HELD_SQL}) group by 1)
    select set_id, coalesce(n, 0) as question_count, case when coalesce(n, 0) >= total - 8 then 'complete' else 'failed' end as status,
      case when coalesce(n, 0) < total - 8 then 'Only ' || coalesce(n, 0) || ' of ' || (total - 8) || ' questions could be generated.' end as error
    from t left join g using (set_id)
    """,
)
def set_status(t: Tables) -> DataFrame:
    sets = set_lengths(t).withColumn("target", F.col("total") - 8)
    return quota.set_status(sets, held_questions(t), "set_id", "target")


@query(
    "batches_to_run",
    f"""
    with t as ({_TARGETS_SQL}), b as (select set_id, unnest(range((total + 24) // 25)) as batch from t),
    g as (select set_id, count(*) * 6 as n from ({_HELD_SQL}) group by 1)
    select set_id, cast(batch as integer) as batch from b left join g using (set_id) where coalesce(n, 0) < (batch + 1) * 25
    """,
)
def batches_to_run(t: Tables) -> DataFrame:
    """Batches left when every line item stands for six questions."""
    plans = quota.batch_plans(set_lengths(t), "set_id", "total")
    copies = held_questions(t).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(6))))
    return quota.batches_to_run(plans, copies, "set_id").select("set_id", "batch")


def stems(t: Tables) -> DataFrame:
    """Whole documents as question stems, in order inside their source."""
    return t.read("documents").select(
        "doc_id", "source", "lang", "n_chars", stem_tokens(F.col("text")).alias("tokens")
    )


def greedy_sql(group: str, seeds: str) -> str:
    """One document of every group per step, carrying the token lists kept so far."""
    return f"""
    with recursive k as (select doc_id, {group} as g, list_sort({_tokens('text')}) as tokens from documents),
    d as (select *, row_number() over (partition by g order by doc_id) as n,
            row_number() over (partition by g, tokens order by doc_id) as copy from k),
    s as ({seeds}),
    r as (
      select distinct g, 0::bigint as n, coalesce((select list(tokens) from s where s.g = d.g), []) as kept, null::bigint as doc_id, '' as verdict from d
      union all
      select g, n, case when verdict = 'kept' then list_append(kept, tokens) else kept end, doc_id, verdict
      from (
        select d.g, d.n, r.kept, d.tokens, d.doc_id,
          case when length(d.tokens) = 0 then 'empty'
            when d.copy > 1 or exists (select 1 from s where s.g = d.g and s.tokens = d.tokens) then 'repeat'
            when length(list_filter(r.kept, lambda x: {_sim('x', 'd.tokens')} > 0.8)) > 0 then 'near' else 'kept' end as verdict
        from r join d on d.g = r.g and d.n = r.n + 1))
    select g as {group}, doc_id, verdict from r where n > 0
    """


@query("greedy_dedupe", greedy_sql("source", "select '' as g, ['']::varchar[] as tokens where false"))
def greedy_dedupe(t: Tables) -> DataFrame:
    """Documents kept in their source, near copies of those kept before them dropped."""
    return dedupe.greedy_filter(stems(t), "source", "doc_id", "tokens")


@query(
    "greedy_dedupe_by_language",
    greedy_sql("lang", f"select 'en' as g, list_sort({_tokens('text')}) as tokens from benchmark"),
)
def greedy_dedupe_by_language(t: Tables) -> DataFrame:
    """The same over languages, one of which holds most documents; benchmark texts count as seen."""
    seeds = t.read("benchmark").select(
        F.lit("en").alias("lang"), stem_tokens(F.col("text")).alias("tokens")
    )
    return dedupe.greedy_filter(stems(t), "lang", "doc_id", "tokens", seeds)


@query(
    "quota_select",
    f"""
    with recursive k as (
      select source, doc_id as pos, case doc_id % 4 when 0 then 3 when 1 then 2 else 1 end as attempt,
        case when n_chars % 10 < 5 then 'mcq' when n_chars % 10 < 8 then 'true_false' else 'short_answer' end as type,
        case lang when 'en' then 'medium' when 'fr' then 'easy' else 'hard' end as difficulty, {_tokens('text')} as tokens
      from documents),
    d as (select *, row_number() over (partition by source order by attempt, pos) as n from k where length(tokens) > 0),
    r as (
      select distinct source, 0::bigint as n, []::varchar[][] as held,
        {{'mcq': 17, 'true_false': 4, 'short_answer': 4}} as types, {{'easy': 8, 'medium': 11, 'hard': 6}} as levels,
        0 as attempt, null::bigint as pos, '' as type, '' as difficulty, false as taken
      from d
      union all
      select source, n, case when taken then list_append(held, tokens) else held end,
        {{'mcq': types.mcq - (taken and type = 'mcq')::int, 'true_false': types.true_false - (taken and type = 'true_false')::int,
          'short_answer': types.short_answer - (taken and type = 'short_answer')::int}},
        {{'easy': levels.easy - (taken and difficulty = 'easy')::int, 'medium': levels.medium - (taken and difficulty = 'medium')::int,
          'hard': levels.hard - (taken and difficulty = 'hard')::int}},
        attempt, pos, type, difficulty, taken
      from (
        select d.source, d.n, r.held, r.types, r.levels, d.attempt, d.pos, d.type, d.difficulty, d.tokens,
          length(r.held) < 25 and length(list_filter(r.held, lambda x: {_sim('x', 'd.tokens')} > 0.8)) = 0
            and (d.attempt = 3 or (case d.type when 'mcq' then r.types.mcq when 'true_false' then r.types.true_false else r.types.short_answer end > 0
              and case d.difficulty when 'easy' then r.levels.easy when 'medium' then r.levels.medium else r.levels.hard end > 0)) as taken
        from r join d on d.source = r.source and d.n = r.n + 1))
    select source, attempt, pos, type, difficulty from r where taken
    """,
)
def quota_select(t: Tables) -> DataFrame:
    """Documents accepted into one 25-question set per source, held to its mix."""
    n = F.col("doc_id")
    offered = stems(t).select(
        "source",
        F.when(n % 4 == 0, 3).when(n % 4 == 1, 2).otherwise(1).alias("attempt"),
        n.alias("pos"),
        F.when(F.col("n_chars") % 10 < 5, "mcq").when(F.col("n_chars") % 10 < 8, "true_false").otherwise("short_answer").alias("type"),
        F.when(F.col("lang") == "en", "medium").when(F.col("lang") == "fr", "easy").otherwise("hard").alias("difficulty"),
        "tokens",
    )
    sets = t.read("documents").select("source").distinct().withColumn("count", F.lit(25))
    plans = quota.with_mix(sets, "count")
    return quota.accept_by_quota(offered, plans, "source").drop("tokens")
