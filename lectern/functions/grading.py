"""Marking one answer against its key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import collapse_space, not_blank, trim_space

# Fixed value: share of the model answer's tokens a short answer must hold.
SHORT_ANSWER_SHARE = 0.6


def normal_answer(c: Column) -> Column:
    return collapse_space(F.lower(trim_space(c)))


def answer_tokens(c: Column) -> Column:
    words = F.split(F.lower(c), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 3))


def grade(kind: Column, correct: Column, given: Column) -> Column:
    """True when the answer counts as right for its question type."""
    expected = answer_tokens(correct)
    shared = F.size(F.array_intersect(expected, answer_tokens(given)))
    verdict = (
        F.when(kind.isin("mcq", "true_false"), normal_answer(given) == normal_answer(correct))
        .when(F.size(expected) == 0, F.lit(False))
        .otherwise(shared / F.size(expected) >= SHORT_ANSWER_SHARE)
    )
    return F.when(not_blank(given), F.coalesce(verdict, F.lit(False))).otherwise(F.lit(False))
