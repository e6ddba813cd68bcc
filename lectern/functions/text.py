"""Text cleaning, tokens and trigram measures as ``Column`` builders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning of their own in a course title.
GENERIC_TITLE_WORDS = (
    "introduction intro to of the and in for an on with at by "
    "fundamentals fundamental principles principle foundations foundation "
    "advanced adv topics topic special selected seminar survey basic basics "
    "elementary intermediate general studies study course ii iii iv "
    "lab laboratory honors hon part applied practicum independent"
).split()

# Words ignored when two question stems are compared.
STEM_STOP_WORDS = (
    "a an the is are was were be been being of to in on "
    "for with and or but if as at by from that this these "
    "those it its which what how why when where who does do "
    "did can could would should will following best most true false"
).split()

# Course-title shorthand with one clear expansion.
SHORTHAND = {
    "intro": "introduction",
    "adv": "advanced",
    "prin": "principles",
    "fund": "fundamentals",
    "lab": "laboratory",
}

# Every character a browser regex treats as white space: the plain ones and the odd ones.
ODD_SPACE = r"[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SPACE_CHARACTERS = " \t\n\x0b\f\r" + "".join(
    map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Work ``value`` out once and hand it to an expression that uses it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squash(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", ""))


def not_blank(c: Column) -> Column:
    return F.coalesce(c.rlike(f"[^{SPACE[1:]}"), F.lit(False))


def trim_space(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE_CHARACTERS))


def collapse_space(c: Column) -> Column:
    """Each run of white space to one blank.

    The class with the odd spaces is several times slower to match than the plain one, so it is
    used only on the rare text that holds any.
    """
    odd = c.rlike(r"[^\x00-\x7f]") & c.rlike(ODD_SPACE)
    return F.when(odd, F.regexp_replace(c, f"{SPACE}+", " ")).otherwise(
        F.regexp_replace(c, r"\s+", " ")
    )


def clean(c: Column) -> Column:
    """Collapse white space; null becomes the empty string."""
    return F.trim(collapse_space(F.coalesce(c, F.lit(""))))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def content_words(c: Column) -> Column:
    """Sorted distinct words of a title that tell it apart from other titles."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    kept = F.filter(
        words,
        lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$") & ~w.isin(GENERIC_TITLE_WORDS),
    )
    return F.array_sort(F.array_distinct(kept))


def trigrams(c: Column) -> Column:
    """Distinct three-letter runs of each word, padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    return F.array_distinct(F.flatten(F.transform(words, _word_grams)))


def trigram_sequence(c: Column) -> Column:
    """The same three-letter runs in order of appearance, repeats kept."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    return F.flatten(F.transform(words, _word_grams))


def _word_grams(word: Column) -> Column:
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.transform(
        F.sequence(F.lit(1), F.length(word) + 1),
        lambda i: F.substring(padded, i, F.lit(3)),
    )


def set_similarity(a: Column, b: Column) -> Column:
    """Shared share of two distinct arrays; 0 when both are empty."""
    return bind(
        F.size(F.array_intersect(a, b)),
        lambda shared: F.when(
            F.size(a) + F.size(b) > 0, shared / (F.size(a) + F.size(b) - shared)
        ).otherwise(F.lit(0.0)),
    )


def similarity(a: Column, b: Column) -> Column:
    pair = F.struct(trigrams(a).alias("a"), trigrams(b).alias("b"))
    return bind(pair, lambda g: set_similarity(g["a"], g["b"]))


def word_similarity_of(query_grams: Column, title_sequence: Column) -> Column:
    """Best similarity of the query's trigrams to any unbroken stretch of the title's.

    Only stretches that start and end on a shared trigram can be best.
    """
    hits = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(title_sequence), F.lit(1))),
        lambda i: F.array_contains(query_grams, F.get(title_sequence, i - 1)),
    )

    def stretch(start: Column, end: Column) -> Column:
        part = F.array_distinct(F.slice(title_sequence, start, end - start + 1))
        return bind(part, lambda p: set_similarity(query_grams, p))

    def best(found: Column) -> Column:
        scores = F.transform(
            found,
            lambda start: F.array_max(
                F.transform(
                    F.filter(found, lambda end: end >= start), lambda end: stretch(start, end)
                )
            ),
        )
        return F.coalesce(F.array_max(scores), F.lit(0.0))

    return bind(hits, best)


def word_similarity(query: Column, title: Column) -> Column:
    pair = F.struct(trigrams(query).alias("q"), trigram_sequence(title).alias("t"))
    return bind(pair, lambda g: word_similarity_of(g["q"], g["t"]))


def coverage(query_words: Column, title_words: Column) -> Column:
    """Share of the query's distinctive words present in the title; null when it has none."""

    def present(q: Column) -> Column:
        return F.exists(
            title_words,
            lambda t: (t == q)
            | ((F.length(q) >= 5) & (F.length(t) >= 5) & (similarity(q, t) >= 0.6)),
        )

    return F.when(
        F.size(query_words) > 0,
        F.size(F.filter(query_words, present)) / F.size(query_words),
    )


def escape_like(c: Column) -> Column:
    """Make backslash, percent and underscore literal inside a LIKE pattern."""
    for mark in ("\\", "%", "_"):
        c = F.replace(c, F.lit(mark), F.lit("\\" + mark))
    return c


def contains_ci(c: Column, needle: Column) -> Column:
    return F.contains(F.lower(c), F.lower(needle))


def any_contains(columns: Sequence[Column], needle: str) -> Column:
    """True when any column holds the text, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(contains_ci(c, F.lit(needle)), F.lit(False))
    return hit


def expand_shorthand(c: Column) -> Column:
    for short, full in SHORTHAND.items():
        c = F.regexp_replace(c, rf"(?i)\b{short}\b\.?", full)
    return c


def has_words(c: Column) -> Column:
    return c.rlike("(?i)[a-z]{3,}")


def stem_tokens(c: Column) -> Column:
    """Distinct content tokens of a question stem."""
    return F.array_distinct(
        F.filter(
            F.split(F.lower(c), "[^a-z0-9]+"),
            lambda t: (F.length(t) > 2) & ~t.isin(STEM_STOP_WORDS),
        )
    )


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared share of two distinct token arrays; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(set_similarity(a, b))


def snap_topic(topic: Column, topics: Column) -> Column:
    """Move a free topic onto the section's own list where one fits."""
    needle = F.lower(trim_space(topic))
    exact = F.filter(topics, lambda t: F.lower(t) == needle)
    near = F.filter(
        topics,
        lambda t: F.contains(F.lower(t), needle) | F.contains(needle, F.lower(t)),
    )
    fallback = F.coalesce(F.get(topics, F.lit(0)), F.lit("General"))
    return F.when(topic.isNull() | (topic == ""), fallback).otherwise(
        F.coalesce(F.get(exact, F.lit(0)), F.get(near, F.lit(0)), trim_space(topic))
    )


def strip_html(c: Column) -> Column:
    """Markup to plain text with the common entities decoded."""
    steps = [
        (r"(?i)<br\s*/?>", " "),
        (r"(?i)</p>", "\n"),
        (r"<[^>]+>", " "),
        ("&nbsp;", " "),
        ("&amp;", "&"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&#39;|&rsquo;", "'"),
        ("&quot;|&ldquo;|&rdquo;", '"'),
    ]
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


# Markdown marks removed from a written summary.
HEADING_OR_RULE = rf"^{SPACE}*(#{{1,6}}{SPACE}|[-*_]{{3,}}{SPACE}*$)"
BOLD = r"\*\*(.+?)\*\*"
BULLET = rf"(?m)^{SPACE}*[-*+]{SPACE}+"

# Headings that open a passage worth reading.
PASSAGES = {
    "contents": r"(?:table of contents|contents|chapters?)",
    "textbooks": r"(?:required\s+(?:texts?|materials?|readings?)|textbooks?|course\s+materials?|required\s+book)",
}


def tidy_summary(c: Column) -> Column:
    """Drop headings, rules, bold marks and bullets from a written summary; too short is null."""
    lines = F.filter(F.split(c, "\n"), lambda s: ~s.rlike(HEADING_OR_RULE))
    text = F.regexp_replace(F.array_join(lines, "\n"), BOLD, "$1")
    text = F.regexp_replace(text, BULLET, "")
    text = trim_space(F.regexp_replace(text, "\n{3,}", "\n\n"))
    return F.when(F.length(text) >= 60, text)


def focus(c: Column, kind: str, reach: int | None = None, size: int | None = None) -> Column:
    """The text from the first heading of this kind on, else the whole text.

    ``reach`` ends the passage so many characters after the heading, ``size`` cuts the result. The
    site's presets: 8000 and 12000 for contents, 4000 and 12000 for textbooks.
    """
    after = r"[\s\S]*" if reach is None else rf"[\s\S]{{0,{reach}}}"
    found = F.regexp_extract(c, f"(?i){PASSAGES[kind]}{after}", 0)
    passage = F.when(found != "", found).otherwise(c)
    passage = clean(passage) if kind == "contents" else passage
    return passage if size is None else F.substring(passage, 1, size)


def focus_on_number(markdown: Column, course_number: Column, reach: int | None = None, size: int | None = None) -> Column:
    """The page from a course number on, else the whole page.

    ``reach`` ends it so many characters after the number, ``size`` cuts a page without it. The
    site's presets: 4000 and 8000.
    """
    after = r"[\s\S]*" if reach is None else rf"[\s\S]{{0,{reach}}}"
    pattern = F.concat(F.lit("(?i)"), F.regexp_replace(course_number, r"\s+", r"\\s*"), F.lit(after))
    whole = markdown if size is None else F.substring(markdown, 1, size)
    return F.coalesce(F.regexp_substr(markdown, pattern), whole)


def file_slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "(?i)[^a-z0-9]+", "-"), "^-|-$", ""))


def syllabus_link(markdown: Column) -> Column:
    """Target of the first markdown link whose label speaks of a syllabus."""
    return blank_to_null(F.regexp_extract(markdown, r"(?i)\[(?:[^\]]*syllab[^\]]*)\]\(([^)]+)\)", 1))


def string_list(c: Column) -> Column:
    """JSON text to an array of strings; anything but an array is null."""
    return F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))
