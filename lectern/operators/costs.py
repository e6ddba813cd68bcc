"""Usage ledger: rates, cost, roll-ups and the cost of a run."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(12,6)"
RATE = "decimal(10,4)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


def usage_cost(input_tokens: Column, output_tokens: Column, rate_in: Column, rate_out: Column) -> Column:
    """Dollars at a rate per million tokens, summed as exact decimals."""
    million = F.lit(Decimal(1_000_000))
    return money((input_tokens * rate_in + output_tokens * rate_out) / million)


def with_rates(usage: DataFrame, rates: dict[str, tuple[str, str]]) -> DataFrame:
    """Stamp the rate of each model: its exact id, else the id without its provider, else zero.

    The rate card is a fixed list, so it is a literal map and no join.
    """
    entries = []
    for model, (rate_in, rate_out) in rates.items():
        pair = F.struct(
            F.lit(rate_in).cast(RATE).alias("input_rate"),
            F.lit(rate_out).cast(RATE).alias("output_rate"),
        )
        entries += [F.lit(model), pair]
    card = F.create_map(*entries)
    zero = F.struct(
        F.lit("0").cast(RATE).alias("input_rate"), F.lit("0").cast(RATE).alias("output_rate")
    )
    plain = F.regexp_replace("model", "^[^/]+/", "")
    return (
        usage.withColumn("rate", F.coalesce(F.try_element_at(card, "model"), F.try_element_at(card, plain), zero))
        .withColumn("input_rate", F.col("rate.input_rate"))
        .withColumn("output_rate", F.col("rate.output_rate"))
        .drop("rate")
    )


def ledger_rows(usage: DataFrame, rates: dict[str, tuple[str, str]]) -> DataFrame:
    """Ledger rows to append: whole non-negative tokens, totals, stamped rates and cost."""

    def whole(name: str) -> Column:
        rounded = F.floor(F.coalesce(F.col(name), F.lit(0)) + F.lit(0.5)).cast("bigint")
        return F.greatest(F.lit(0).cast("bigint"), rounded)

    counted = usage.withColumn("input_tokens", whole("input_tokens")).withColumn(
        "output_tokens", whole("output_tokens")
    )
    return (
        with_rates(counted, rates)
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
        .withColumn(
            "cost",
            usage_cost(
                F.col("input_tokens"), F.col("output_tokens"), F.col("input_rate"), F.col("output_rate")
            ),
        )
    )


def rollup_by(ledger: DataFrame, key: str, sums: Sequence[str]) -> DataFrame:
    """Calls and sums per key; rows without the key are left out."""
    return (
        ledger.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("call_count"), *[F.sum(c).alias(c) for c in sums])
    )


def ledger_total(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count(F.lit(1)).alias("call_count"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"),
    )


SCOPES = ("test_set", "course", "college")


def run_costs(runs: DataFrame, ledger: DataFrame, bucket_hours: int = 24) -> DataFrame:
    """Cost of each run: ledger rows of its narrowest scope inside [started_at, finished_at].

    ``runs`` and ``ledger`` hold test_set_id, course_id and college_id; a run is charged by the
    first of these it has, one without any by the whole ledger. The ledger, summed per scope and
    instant, and the runs' ends stand in one order; a run's cost is the running sum at its finish
    less that before its start, so no run meets ledger rows one by one. Sums run inside buckets of
    time and are shifted by the buckets before, which spreads a busy scope over many tasks.
    """
    hour = 3600 * bucket_hours
    kinds = [
        F.struct(F.lit(s).alias("kind"), F.col(f"{s}_id").cast("string").alias("id")) for s in SCOPES
    ]
    everyone = F.struct(F.lit("all").alias("kind"), F.lit("").alias("id"))
    scope = F.coalesce(*[F.when(k["id"].isNotNull(), k) for k in kinds], everyone)
    charged = (
        ledger.select(
            F.explode(F.filter(F.array(*kinds, everyone), lambda e: e["id"].isNotNull())).alias("scope"),
            F.col("created_at").alias("at"),
            "cost",
            "total_tokens",
        )
        .groupBy("scope", "at")
        .agg(F.sum("cost").alias("cost"), F.sum("total_tokens").alias("total_tokens"))
        .withColumns({"turn": F.lit(1), "run_id": F.lit(None).cast(runs.schema["run_id"].dataType)})
    )
    spans = runs.filter("started_at <= finished_at").withColumn("scope", scope)

    def ends(at: str, turn: int) -> DataFrame:
        """A start stands before the ledger of its instant, a finish after it."""
        nothing = [F.lit(0).cast(charged.schema[c].dataType).alias(c) for c in ("cost", "total_tokens")]
        return spans.select("scope", F.col(at).alias("at"), *nothing, F.lit(turn).alias("turn"), "run_id")

    marks = charged.unionByName(ends("started_at", 0)).unionByName(ends("finished_at", 2))
    marks = marks.withColumn("bucket", F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / hour))
    values = ("cost", "total_tokens")
    buckets = marks.groupBy("scope", "bucket").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy("scope").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = buckets.select(
        "scope", "bucket", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_before") for v in values]
    )
    inside = Window.partitionBy("scope", "bucket").orderBy("at", "turn")
    running = marks.select(
        "scope", "bucket", "turn", "run_id", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(v) for v in values]
    ).filter("turn <> 1")
    sign = F.when(F.col("turn") == 2, 1).otherwise(-1)
    sums = (
        running.join(shifts, ["scope", "bucket"])
        .groupBy("run_id")
        .agg(*[F.sum(sign * (F.col(v) + F.col(f"{v}_before"))).alias(n) for v, n in zip(values, ("run_cost", "run_tokens"))])
    )
    return runs.join(sums, "run_id", "left").withColumns(
        {
            "run_cost": F.coalesce("run_cost", F.lit(0)),
            "run_tokens": F.coalesce("run_tokens", F.lit(0)),
        }
    )
