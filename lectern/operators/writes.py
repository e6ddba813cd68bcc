"""Keyed writes as DataFrame results: upsert, patch, replace, prune, cascade, toggle.

Each returns the table as it stands after the write; the caller stores it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key with the greatest order values, found by a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("kept"))
        .select(*keys, *[F.col("kept")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def _both(target: DataFrame, source: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    t = target.select(F.struct(*target.columns).alias("t"), *[F.col(k) for k in keys])
    # Rows that repeat a key would double the target's row; the greatest of them stands for all.
    s = source.groupBy(*keys).agg(F.max(F.struct(*source.columns)).alias("s"))
    return t.join(s, list(keys), how)


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Sequence[str],
) -> DataFrame:
    """Insert new keys whole; on known keys overwrite only the ``update`` columns.

    Of several source rows with one key the greatest counts (see ``one_per_key`` for other choices).
    """
    given, known = F.col("s").isNotNull(), F.col("t").isNotNull()
    out = []
    for c in target.columns:
        mine = F.col("t")[c]
        theirs = F.col("s")[c] if c in source.columns else F.lit(None)
        if c in keys:
            out.append(F.col(c))
        elif c in update:
            out.append(F.when(given, theirs).otherwise(mine).alias(c))
        else:
            out.append(F.when(known, mine).otherwise(theirs).alias(c))
    return _both(target, source, keys, "full_outer").select(*out)


def patch(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    touched: tuple[str, Column] | None = None,
) -> DataFrame:
    """Overwrite columns of known keys; unknown keys are ignored."""
    given = F.col("s").isNotNull()
    out = []
    for c in target.columns:
        mine = F.col("t")[c]
        if touched and c == touched[0]:
            out.append(F.when(given, touched[1]).otherwise(mine).alias(c))
        elif c in columns:
            out.append(F.when(given, F.col("s")[c]).otherwise(mine).alias(c))
        else:
            out.append(mine.alias(c))
    return _both(target, source, keys, "left").select(*out)


def fill_blanks(
    base: DataFrame,
    detail: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    longer: Sequence[str] = (),
) -> DataFrame:
    """Take detail values only where the base has none; ``longer`` columns take the longer text."""
    out = []
    for c in base.columns:
        mine = F.col("t")[c]
        if c in longer:
            other = F.col("s")[c]
            more = F.coalesce(F.length(other), F.lit(0)) > F.coalesce(F.length(mine), F.lit(0))
            out.append(F.when(more, other).otherwise(mine).alias(c))
        elif c in columns:
            out.append(F.coalesce(mine, F.col("s")[c]).alias(c))
        else:
            out.append(mine.alias(c))
    return _both(base, detail, keys, "left").select(*out)


def backfill_from_children(
    parents: DataFrame,
    children: DataFrame,
    parent_key: str,
    child_key: str,
    column: str,
    child_column: str,
) -> DataFrame:
    """Fill a null parent column with the greatest child value."""
    newest = children.groupBy(F.col(child_key).alias(parent_key)).agg(
        F.max(child_column).alias("child_value")
    )
    return (
        parents.join(newest, parent_key, "left")
        .withColumn(column, F.coalesce(column, "child_value"))
        .select(*parents.columns)
    )


def replace_children(
    target: DataFrame, parents: DataFrame, new_rows: DataFrame, parent_key: str
) -> DataFrame:
    """Drop every row of the listed parents and put the new rows in their place."""
    kept = target.join(parents.select(parent_key).distinct(), parent_key, "left_anti")
    return kept.select(*target.columns).unionByName(new_rows.select(*target.columns))


def prune_trailing(
    sections: DataFrame,
    outline_sizes: DataFrame,
    used: DataFrame,
    parent_key: str,
    position: str,
    key: str,
    size: str,
) -> DataFrame:
    """Drop rows at or past a parent's new length unless something refers to them."""
    marked = sections.join(outline_sizes.select(parent_key, size), parent_key, "left").join(
        used.select(F.col(key), F.lit(True).alias("in_use")).distinct(), key, "left"
    )
    trailing = F.coalesce(F.col(position) >= F.col(size), F.lit(False)) & F.col("in_use").isNull()
    return marked.filter(~trailing).select(*sections.columns)


def prune_childless(
    parents: DataFrame,
    keep: DataFrame,
    children: DataFrame,
    keep_keys: Sequence[str],
    key: str,
    child_key: str,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Drop parents missing from the keep list that have no children.

    Only parents whose ``scope`` appears in the keep list are looked at.
    """
    gone = parents.join(keep.select(*keep_keys).distinct(), list(keep_keys), "left_anti")
    if scope:
        gone = gone.join(keep.select(*scope).distinct(), list(scope), "left_semi")
    held = children.select(F.col(child_key).alias(key)).distinct()
    removable = gone.join(held, key, "left_anti").select(key)
    return parents.join(removable, key, "left_anti").select(*parents.columns)


def cascade_delete(
    tables: dict[str, DataFrame],
    root: str,
    doomed: DataFrame,
    links: Sequence[tuple[str, str, str, str, str]],
    root_key: str,
) -> dict[str, DataFrame]:
    """Delete root rows and follow foreign keys down.

    ``links`` are (child, child column, parent, parent key, action) in parent-first order;
    the action is ``cascade`` or ``null``.
    """
    left = dict(tables)
    gone = {root: tables[root].join(doomed.select(root_key), root_key, "left_semi")}
    left[root] = tables[root].join(doomed.select(root_key), root_key, "left_anti")
    for child, column, parent, parent_key, action in links:
        keys = gone[parent].select(F.col(parent_key).alias(column)).distinct()
        rows = left[child]
        if action == "null":
            hit = rows.join(keys.withColumn("hit", F.lit(True)), column, "left")
            left[child] = hit.withColumn(
                column, F.when(F.col("hit").isNull(), F.col(column))
            ).select(*rows.columns)
            continue
        lost = rows.join(keys, column, "left_semi")
        gone[child] = gone[child].unionByName(lost) if child in gone else lost
        left[child] = rows.join(keys, column, "left_anti").select(*rows.columns)
    return left


def toggle(existing: DataFrame, presses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys starred after a batch of presses: starred before XOR pressed an odd number of times."""
    odd = presses.groupBy(*keys).agg((F.count(F.lit(1)) % 2).alias("flip"))
    starred = existing.select(*keys).distinct().withColumn("was", F.lit(1))
    state = starred.join(odd, list(keys), "full_outer")
    on = (F.coalesce("was", F.lit(0)) + F.coalesce("flip", F.lit(0))) % 2 == 1
    return state.filter(on).select(*keys)
