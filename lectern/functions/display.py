"""Columns that turn numbers, ranks and places into the text people read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOME_COUNTRY = "United States"

# Badge shown for each catalog platform.
PLATFORM_LABELS = {
    "courseleaf": "CourseLeaf",
    "acalog": "Acalog",
    "coursedog": "Coursedog",
    "banner": "Banner",
    "kuali": "Kuali",
}

# How a catalog address was found.
DISCOVERY_TEXT = {
    "heuristic": "Catalog found by probing the usual catalog subdomains and paths.",
    "sitemap": "Catalog found in the site’s sitemap.xml.",
    "homepage": "Catalog found by following links from the homepage.",
    "search": "Catalog found via web search.",
}


def round_half_up(c: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def percentage(score: Column, total: Column) -> Column:
    return round_half_up(F.coalesce(score, F.lit(0)) / total * 100)


def dollars(c: Column) -> Column:
    return (
        F.when(c.isNull() | F.isnan(c) | (c == 0), F.lit("$0.00"))
        .when(c < 0.01, F.format_string("$%.4f", c))
        .when(c < 1, F.format_string("$%.3f", c))
        .otherwise(F.format_string("$%.2f", c))
    )


def token_count(c: Column) -> Column:
    return (
        F.when(c >= 1_000_000, F.format_string("%.1fM", c / 1_000_000))
        .when(c >= 1_000, F.format_string("%.1fk", c / 1_000))
        .otherwise(c.cast("string"))
    )


def grouped_count(c: Column) -> Column:
    return F.format_number(c, 0)


def region(country: Column) -> Column:
    return F.when(F.coalesce(country, F.lit(HOME_COUNTRY)) == HOME_COUNTRY, "us").otherwise("intl")


def place(state: Column, country: Column) -> Column:
    return F.when(region(country) == "us", state).otherwise(country)


def location(city: Column, state: Column, country: Column) -> Column:
    """City and place, a city-state named once."""
    where = F.nullif(place(state, country), F.lit(""))
    return F.when(city.eqNullSafe(where), F.coalesce(where, F.lit(""))).otherwise(
        F.concat_ws(", ", F.nullif(city, F.lit("")), where)
    )


def rank_text(rank: Column, rank_source: Column, country: Column) -> Column:
    scope = F.when(region(country) == "us", "nationally").otherwise("worldwide")
    return F.when(
        rank.isNotNull(),
        F.concat(F.lit("#"), rank.cast("string"), F.lit(" "), scope, F.lit(" ("), rank_source, F.lit(")")),
    )


def matches_region(country: Column, wanted: str = "all") -> Column:
    return F.lit(True) if wanted == "all" else region(country) == wanted


def provenance_label(platform: Column, source: Column) -> Column:
    """Manual entry beats the platform; the generic reader shows as scraped."""
    label = F.when(source == "manual", "Direct URL").when(platform == "generic", "Scraped")
    for key, text in PLATFORM_LABELS.items():
        label = label.when(platform == key, text)
    return label


def provenance_kind(platform: Column, source: Column) -> Column:
    return (
        F.when(source == "manual", "manual")
        .when(platform == "generic", "scraped")
        .when(platform.isin(list(PLATFORM_LABELS)), "platform")
    )


def discovery_text(source: Column) -> Column:
    text = F.lit(None).cast("string")
    for key, sentence in DISCOVERY_TEXT.items():
        text = F.when(source == key, sentence).otherwise(text)
    return text


def age_text(then: Column, now: Column) -> Column:
    """Rounded age in the largest unit that fits: seconds, minutes, hours or days."""
    seconds = F.greatest(F.timestamp_diff("SECOND", then, now), F.lit(0))

    def in_units(size: int, mark: str) -> Column:
        return F.concat(round_half_up(seconds / size).cast("string"), F.lit(f"{mark} ago"))

    return (
        F.when(seconds < 60, in_units(1, "s"))
        .when(seconds < 3600, in_units(60, "m"))
        .when(seconds < 86400, in_units(3600, "h"))
        .otherwise(in_units(86400, "d"))
    )


def retrieval_text(
    departments: Column,
    fetched: Column,
    courses: Column,
    in_store: Column,
    empty: Column,
    failed: Column,
    deferred: Column,
) -> Column:
    """One line on a retrieval; parts that are zero are left out."""

    def count(c: Column, words: str) -> Column:
        return F.concat(c.cast("string"), F.lit(" " + words))

    return F.concat_ws(
        " · ",
        count(departments, "departments"),
        F.concat(count(fetched, "fetched ("), courses.cast("string"), F.lit(" courses)")),
        count(in_store, "already in DB"),
        F.when(empty > 0, count(empty, "with no current courses")),
        F.when(failed > 0, count(failed, "failed")),
        F.when(deferred > 0, count(deferred, "left for later")),
    )
