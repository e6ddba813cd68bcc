"""Question-set planning: exact mixes, batches, shortfalls and quota-bound selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import token_jaccard
from lectern.operators.dedupe import THRESHOLD
from lectern.operators.lineage import cut
from lectern.operators.ranks import first_rows

# The mix of a set in hundredths, in the order ties are broken.
TYPE_MIX = {"mcq": 70, "true_false": 15, "short_answer": 15}
DIFFICULTY_MIX = {"easy": 30, "medium": 45, "hard": 25}
BATCH_SIZE = 25
LAST_ATTEMPT = 3

# Candidates of one set looked at in one round of the selection.
ROUND_CANDIDATES = 500


def apportion(total: Column, weights: dict[str, int]) -> dict[str, Column]:
    """Whole shares of a total that add up to it, the largest remainders rounded up first."""
    floors = {k: F.floor(total * w / 100) for k, w in weights.items()}
    remainders = {k: (total * w) % 100 for k, w in weights.items()}
    left = total - sum(floors.values(), F.lit(0))
    names = list(weights)
    shares = {}
    for i, k in enumerate(names):
        ahead = F.lit(0)
        for j, other in enumerate(names):
            if other == k:
                continue
            before = remainders[other] > remainders[k]
            if j < i:
                before = before | (remainders[other] == remainders[k])
            ahead = ahead + before.cast("int")
        shares[k] = (floors[k] + (ahead < left).cast("int")).cast("int")
    return shares


def with_mix(df: DataFrame, total: str) -> DataFrame:
    """Target counts of each type and difficulty beside a total."""
    targets = {**apportion(F.col(total), TYPE_MIX), **apportion(F.col(total), DIFFICULTY_MIX)}
    return df.withColumns(targets)


def _slot_value(slot: Column, weights: dict[str, int]) -> Column:
    """Value of the n-th slot when values are laid out one after another."""
    value, bound = F.lit(None).cast("string"), F.lit(0)
    bounds = []
    for name in weights:
        bound = bound + F.col(name)
        bounds.append((name, bound))
    for name, upto in reversed(bounds):
        value = F.when(slot < upto, name).otherwise(value)
    return value


def batch_plans(sets: DataFrame, key: str, total: str, size: int = BATCH_SIZE) -> DataFrame:
    """Count per type and difficulty of each batch of each set.

    Slots are dealt round-robin over the batches and cut by size. Where a slot lands follows
    from its number alone, so there is no sort and no window.
    """
    planned = with_mix(sets, total).withColumn("batches", F.ceil(F.col(total) / size))
    slots = planned.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col(total) - 1)))
    bucket = F.col("slot") % F.col("batches")
    place = (
        bucket * F.floor(F.col(total) / F.col("batches"))
        + F.least(bucket, F.col(total) % F.col("batches"))
        + F.floor(F.col("slot") / F.col("batches"))
    )
    dealt = slots.select(
        key,
        F.floor(place / size).cast("int").alias("batch"),
        _slot_value(F.col("slot"), TYPE_MIX).alias("type"),
        _slot_value(F.col("slot"), DIFFICULTY_MIX).alias("difficulty"),
    )
    return dealt.groupBy(key, "batch").agg(
        F.count(F.lit(1)).alias("count"),
        *[F.count_if(F.col("type") == t).alias(t) for t in TYPE_MIX],
        *[F.count_if(F.col("difficulty") == d).alias(d) for d in DIFFICULTY_MIX],
    )


def shortfall(targets: DataFrame, held: DataFrame, key: str, total: str) -> DataFrame:
    """What each set still owes per type and difficulty.

    ``targets``: key, total and the mix columns; ``held``: key, type, difficulty per question.
    """
    names = [*TYPE_MIX, *DIFFICULTY_MIX]
    have = held.groupBy(key).agg(
        F.count(F.lit(1)).alias("have"),
        *[F.count_if(F.col("type") == t).alias(f"have_{t}") for t in TYPE_MIX],
        *[F.count_if(F.col("difficulty") == d).alias(f"have_{d}") for d in DIFFICULTY_MIX],
    )
    zero = F.lit(0)
    return targets.join(have, key, "left").select(
        key,
        F.greatest(F.lit(1), F.col(total) - F.coalesce("have", zero)).alias("ask"),
        *[
            F.greatest(zero, F.col(n) - F.coalesce(f"have_{n}", zero)).alias(n)
            for n in names
        ],
    )


def set_status(sets: DataFrame, held: DataFrame, key: str, target: str) -> DataFrame:
    """Complete when the target is met, else failed with what was reached."""
    counts = held.groupBy(key).agg(F.count(F.lit(1)).alias("question_count"))
    count = F.coalesce("question_count", F.lit(0).cast("bigint"))
    done = count >= F.col(target)
    return sets.join(counts, key, "left").select(
        key,
        count.alias("question_count"),
        F.when(done, "complete").otherwise("failed").alias("status"),
        F.when(
            ~done,
            F.concat(
                F.lit("Only "),
                count.cast("string"),
                F.lit(" of "),
                F.col(target).cast("string"),
                F.lit(" questions could be generated."),
            ),
        ).alias("error"),
    )


def batches_to_run(plans: DataFrame, held: DataFrame, key: str, size: int = BATCH_SIZE) -> DataFrame:
    """Batches a resumed run has not filled yet."""
    counts = held.groupBy(key).agg(F.count(F.lit(1)).alias("have"))
    return plans.join(counts, key, "left").filter(
        F.coalesce("have", F.lit(0)) < (F.col("batch") + 1) * size
    ).drop("have")


def accept_by_quota(
    candidates: DataFrame, plans: DataFrame, key: str, last_attempt: int = LAST_ATTEMPT
) -> DataFrame:
    """Candidates a set accepts in arrival order, held to its mix and free of near copies.

    ``candidates``: key, attempt, pos, type, difficulty, tokens. ``plans``: key, count and the
    mix columns. The mix is waived on the last attempt. A set accepts at most ``count`` rows
    however many are offered, so each round hands one bounded slice of the still possible
    candidates per set to a short loop; what the slice rules out leaves before the next round.
    """
    columns = [key, "attempt", "pos", "type", "difficulty", "tokens"]
    mix = [*TYPE_MIX, *DIFFICULTY_MIX]
    targets = plans.select(key, "count", *mix)
    open_rows = cut(candidates.select(*columns).filter(F.size("tokens") > 0))
    schema = open_rows.schema
    key_type = schema[key].dataType.simpleString()
    accepted = open_rows.limit(0)

    def pick(_key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        return _take_in_order(new, old, mix, last_attempt)

    while True:
        state = accepted.groupBy(key).agg(
            F.count(F.lit(1)).alias("taken"),
            F.max(F.struct("attempt", "pos")).alias("upto"),
            F.collect_list("tokens").alias("taken_tokens"),  # at most ``count`` arrays
            *[F.count_if(F.col("type") == t).alias(f"has_{t}") for t in TYPE_MIX],
            *[F.count_if(F.col("difficulty") == d).alias(f"has_{d}") for d in DIFFICULTY_MIX],
        )
        viable = open_rows.join(targets, key).join(state, key, "left")
        room = F.col("attempt") == last_attempt
        type_room, level_room = F.lit(False), F.lit(False)
        for t in TYPE_MIX:
            type_room = type_room | (
                (F.col("type") == t) & (F.coalesce(f"has_{t}", F.lit(0)) < F.col(t))
            )
        for d in DIFFICULTY_MIX:
            level_room = level_room | (
                (F.col("difficulty") == d) & (F.coalesce(f"has_{d}", F.lit(0)) < F.col(d))
            )
        viable = viable.filter(
            (F.coalesce("taken", F.lit(0)) < F.col("count")) & (room | (type_room & level_room))
        ).filter(
            F.coalesce(
                ~F.exists(
                    "taken_tokens", lambda t: token_jaccard(F.col("tokens"), t) > THRESHOLD
                ),
                F.lit(True),
            )
        )
        turn = first_rows(
            viable.select(*columns, "count", *mix),
            [key],
            [F.asc("attempt"), F.asc("pos")],
            ROUND_CANDIDATES,
            "turn",
        ).drop("turn")
        turn = cut(turn)
        if turn.isEmpty():
            return accepted
        picked = (
            turn.groupBy(key)
            .cogroup(accepted.groupBy(key))
            .applyInPandas(
                pick,
                f"{key} {key_type}, attempt {schema['attempt'].dataType.simpleString()}, "
                f"pos {schema['pos'].dataType.simpleString()}",
            )
        )
        done = cut(picked)
        chosen = open_rows.join(done, [key, "attempt", "pos"], "left_semi")
        # Everything up to the end of the slice has been decided.
        seen = turn.groupBy(key).agg(F.max(F.struct("attempt", "pos")).alias("seen"))
        rest = (
            open_rows.join(seen, key)
            .filter(F.struct("attempt", "pos") > F.col("seen"))
            .select(*columns)
        )
        accepted = cut(accepted.unionByName(chosen.select(*columns)))
        open_rows = cut(rest)


def _take_in_order(
    new: pd.DataFrame, old: pd.DataFrame, mix: list[str], last_attempt: int
) -> pd.DataFrame:
    """Walk one bounded slice of a set's candidates, carrying what it holds already."""
    kept = []
    if not new.empty:
        room = {m: int(new[m].iloc[0]) for m in mix}
        held = [frozenset(t) for t in old["tokens"]]
        for name in [*old["type"], *old["difficulty"]]:
            room[name] -= 1
        needed = int(new["count"].iloc[0]) - len(held)
        for row in new.sort_values(["attempt", "pos"]).itertuples(index=False):
            if len(kept) >= needed:
                break
            tokens = frozenset(row.tokens)
            if any(len(tokens & h) / len(tokens | h) > THRESHOLD for h in held):
                continue
            fits = room[row.type] > 0 and room[row.difficulty] > 0
            if row.attempt != last_attempt and not fits:
                continue
            room[row.type] -= 1
            room[row.difficulty] -= 1
            held.append(tokens)
            kept.append((getattr(row, new.columns[0]), row.attempt, row.pos))
    return pd.DataFrame(kept, columns=[new.columns[0] if len(new.columns) else "key", "attempt", "pos"])
