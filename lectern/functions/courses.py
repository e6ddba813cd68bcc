"""Course numbers, headings and catalog prose as ``Column`` builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import bind, blank_to_null, clean

NO_BREAK_SPACE = "\u00a0"

# The shapes credits take at the end of a heading, in order of trial.
CREDIT_SHAPES = (
    r"\s*[.,;:—–-]?\s*credits?\s*:\s*([^.]*?(?:credit\s*hours?|hours?|units?|credits?))\s*\.?\s*$",
    r"\s*[.,;—–-]?\s*\(?\s*((?:\d+(?:\.\d+)?)(?:\s*(?:-|–|to)\s*\d+(?:\.\d+)?)?\s*"
    r"(?:credit\s*hours?|credits?|units?|hours?|s\.\s?h\.?))\s*\.?\s*\)?\s*$",
    r"\s*\(\s*(\d+(?:\.\d+)?(?:\s*(?:-|–|to)\s*\d+(?:\.\d+)?)?)\s*\)\s*$",
)

# A course number followed by its title, letter-led then digit-led.
NUMBER_SHAPES = (
    r"^([A-Za-z][A-Za-z&./]{0,9}[\s:-]?\d[\w.\-/]*(?:\s*\[[A-Z]\])?)\s*[-–—:.]?\s+(.+)$",
    r"^(\d+[A-Za-z]?(?:\.[\w.]+)?(?:\[[A-Z]\])?)\s*[-–—:.]?\s+(.+)$",
)

# A course code standing alone.
BARE_CODE = (
    r"^(?:[A-Za-z][A-Za-z&.]{0,9}[\s:]?\d[\w.\-]*(\[[A-Z]\])?"
    r"|\d+[A-Za-z]?(\.[\w.]+)?(\[[A-Z]\])?)$"
)

# Clauses mined from catalog prose.
CREDITS_FIELD = r"(?i)^\d[\d.]*(\s*[-–]\s*\d[\d.]*)?\s*(credits?|credit hours?|hours?|units?|s\.h\.)\.?$"
PREREQUISITE_CLAUSE = r"(?i)(?:pre-?requisites?|prereq(?:uisite)?\(s\)?|prereq)\s*[:\-–]\s*([^.\n]{0,400})"
CREDIT_CLAUSE = r"(?i)(\d+(?:\.\d+)?(?:\s*(?:-|–|to)\s*\d+(?:\.\d+)?)?)\s*(credit|unit|hour)s?"
TERM_CLAUSE = (
    r"(?i)(?:typically offered|offered|terms? offered|when offered)\s*[:\-–]?\s*"
    r"((?:fall|spring|summer|winter|every|annually|alternate)[^.\n]{0,120})"
)
INSTRUCTOR_CLAUSE = r"(?i)(?:instructors?|taught by|faculty)\s*[:\-–]\s*([^.\n]{3,200})"

# Small words left out of an acronym.
ACRONYM_SKIP = ("and", "of", "the", "for", "in", "to", "&")

LEVEL_RANK = {"Introductory": 1, "Undergraduate": 2, "Graduate": 3, "Unspecified": 4}


def course_level(number: Column) -> Column:
    """Class standing read from the digits of a course number."""
    dotted = F.regexp_extract(number, r"\.\s*(\d+)", 1)
    plain = F.regexp_extract(number, r"(\d+)", 1)
    value = blank_to_null(F.coalesce(blank_to_null(dotted), plain)).cast("decimal(38,0)").cast("double")
    tier = (
        F.when(value < 50, 1)
        .when(value < 100, 2)
        .when(value < 1000, F.floor(value / 100))
        .otherwise(F.floor(value / 1000))
    )
    return (
        F.when(value.isNull(), "Unspecified")
        .when(tier <= 1, "Introductory")
        .when(tier <= 4, "Undergraduate")
        .otherwise("Graduate")
    )


def level_rank(level: Column) -> Column:
    rank = F.lit(4)
    for name, place in LEVEL_RANK.items():
        rank = F.when(level == name, place).otherwise(rank)
    return rank


def natural_key(c: Column) -> Column:
    """Text that sorts digits by value and letters without case."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(F.lower(p)),
        ),
        "",
    )


def broken_title(number: Column, title: Column) -> Column:
    """A title that only repeats its number, or a number cut from the front of the title."""
    return (number == title) | ((F.length(number) == 40) & F.startswith(title, number))


def split_heading(raw: Column) -> Column:
    """struct(course_number, title, credits) of a one-line course heading."""
    text = F.regexp_replace(clean(raw), r"\s*[.•]\s*$", "")
    return bind(text, lambda t: bind(_cut_credits(t), _cut_number))


def _cut_credits(text: Column) -> Column:
    cut = F.struct(text.alias("head"), F.lit(None).cast("string").alias("credits"))
    # Built back to front so the first shape that applies is the outermost test.
    for shape in reversed(CREDIT_SHAPES):
        start = F.length(text) - F.length(F.regexp_substr(text, F.lit(f"(?i){shape}")))
        found = F.struct(
            clean(F.substring(text, F.lit(1), start)).alias("head"),
            clean(F.regexp_extract(text, f"(?i){shape}", 1)).alias("credits"),
        )
        cut = F.when(F.coalesce(start > 4, F.lit(False)), found).otherwise(cut)
    return cut


def _cut_number(cut: Column) -> Column:
    head = cut["head"]

    def parts(number: Column, title: Column) -> Column:
        return F.struct(
            number.alias("course_number"), title.alias("title"), cut["credits"].alias("credits")
        )

    result = parts(head, head)
    for shape in reversed(NUMBER_SHAPES):
        number = F.regexp_replace(clean(F.regexp_extract(head, shape, 1)), r"[.,;:]+$", "")
        title = clean(F.regexp_extract(head, shape, 2))
        usable = head.rlike(shape) & (F.length(number) <= 20) & (F.length(title) >= 2)
        result = F.when(usable, parts(number, title)).otherwise(result)
    return result


def person_names(parts: Column, skip_staff: bool) -> Column:
    """The plausible names of an array, null when none is left."""
    names = F.filter(
        F.transform(parts, clean),
        lambda n: (F.length(n) > 2)
        & (F.length(n) < 80)
        & n.rlike("[A-Za-z]")
        & (~n.rlike("(?i)^staff$") if skip_staff else F.lit(True)),
    )
    return F.when(F.size(names) > 0, names)


def split_names(value: Column) -> Column:
    bare = clean(F.regexp_replace(value, r"(?i)^instructors?\s*[:\-–]?\s*", ""))
    return F.when(value != "", person_names(F.split(bare, r"[;,]|\sand\s"), False))


def parse_heading(raw: Column, department: Column) -> Column:
    """struct(course_number, title, credits, instructors), null when it is no course heading.

    White space must not be collapsed beforehand: runs of it part the fields.
    """
    heading = F.translate(raw, NO_BREAK_SPACE, " ")
    heading = F.regexp_replace(heading, r"^[\s*•\[\]]+", "")
    heading = F.trim(F.regexp_replace(heading, r"[\s\[\]]+$", ""))
    return bind(heading, lambda h: _parse_fields(h, department))


def _parse_fields(heading: Column, department: Column) -> Column:
    codes = F.filter(
        F.transform(F.split(F.substring_index(heading, ",", 1), "/"), clean), lambda c: c != ""
    )
    listed = (
        (F.instr(heading, ",") > 1)
        & (F.size(codes) > 0)
        & F.forall(codes, lambda c: c.rlike(BARE_CODE))
    )
    return F.when(listed, _comma_form(heading, codes, department)).otherwise(
        bind(split_heading(heading), _plain_form)
    )


def _plain_form(parts: Column) -> Column:
    number = parts["course_number"]
    return F.when(
        (number != "") & (parts["title"] != "") & ~F.contains(number, F.lit(",")),
        F.struct(
            number.alias("course_number"),
            parts["title"].alias("title"),
            parts["credits"].alias("credits"),
            F.lit(None).cast("array<string>").alias("instructors"),
        ),
    )


def _comma_form(heading: Column, codes: Column, department: Column) -> Column:
    """Codes, then a comma, then title, credits and names parted by runs of blanks."""
    own = F.filter(codes, lambda c: F.startswith(F.upper(c), F.upper(department)))
    number = F.coalesce(F.when(department != "", F.get(own, F.lit(0))), F.get(codes, F.lit(0)))
    after = F.ltrim(F.substring(heading, F.instr(heading, ",") + 1, F.length(heading)))

    def fields_to_row(fields: Column) -> Column:
        label = F.regexp_replace(clean(F.get(fields, F.lit(0))), r"^[+*^#†‡§]+\s*", "")
        label = F.trim(F.regexp_replace(label, r"[,;]+$", ""))
        rest = F.slice(fields, F.lit(2), F.size(fields))
        paid = F.filter(F.transform(rest, clean), lambda c: c.rlike(CREDITS_FIELD))
        people = F.filter(F.transform(rest, clean), lambda c: ~c.rlike(CREDITS_FIELD))
        names = F.flatten(F.transform(people, lambda c: F.split(c, r"\s+and\s+|,")))
        return bind(
            split_heading(label),
            lambda inner: F.when(
                inner["title"] != "",
                F.struct(
                    number.alias("course_number"),
                    inner["title"].alias("title"),
                    F.coalesce(inner["credits"], F.get(paid, F.lit(0))).alias("credits"),
                    person_names(names, True).alias("instructors"),
                ),
            ),
        )

    return bind(F.split(after, r",?\s{2,}"), fields_to_row)


def prerequisites(prose: Column) -> Column:
    value = bind(F.regexp_extract(prose, PREREQUISITE_CLAUSE, 1), clean)
    return bind(
        value, lambda v: F.when((v != "") & ~v.rlike(r"(?i)^(none|n/a|no prerequisites?)$"), v)
    )


def strip_prerequisite_label(tagged: Column) -> Column:
    bare = clean(F.regexp_replace(tagged, r"(?i)^pre-?req(uisite)?s?\s*[:\-–]?\s*", ""))
    kept = F.when(
        (bare != "") & ~bare.rlike(r"(?i)^(none|n/a|no prerequisites?)\.?$"), bare
    )
    return F.regexp_replace(kept, r"^\((.*)\)$", "$1")


def credits_in(prose: Column) -> Column:
    text = clean(prose)
    amount = F.regexp_extract(text, CREDIT_CLAUSE, 1)
    return F.when(
        amount != "",
        F.concat(amount, F.lit(" "), F.regexp_extract(text, CREDIT_CLAUSE, 2), F.lit("s")),
    )


def terms_in(prose: Column) -> Column:
    return blank_to_null(clean(F.regexp_extract(prose, TERM_CLAUSE, 1)))


def instructors_in(prose: Column) -> Column:
    found = clean(F.regexp_extract(prose, INSTRUCTOR_CLAUSE, 1))
    return F.when(found != "", person_names(F.split(found, r"[;,]|\sand\s"), False))


def acronym(name: Column) -> Column:
    """Initials of a name, or the first four letters of a single word."""
    words = F.filter(
        F.split(F.regexp_replace(name, r"[^A-Za-z\s&]", " "), r"\s+"),
        lambda w: (w != "") & ~F.lower(w).isin(*ACRONYM_SKIP),
    )

    def letters(found: Column) -> Column:
        initials = F.array_join(F.transform(found, lambda w: F.substring(w, 1, 1)), "")
        return F.upper(
            F.when(F.size(found) == 0, F.lit(""))
            .when(F.size(found) == 1, F.substring(F.get(found, F.lit(0)), 1, 4))
            .otherwise(F.substring(initials, 1, 6))
        )

    return bind(words, letters)


def derive_subject(label: Column, slug: Column) -> Column:
    """struct(code, name) of a department from its link label and address slug."""
    lead = r"^([A-Z][A-Z&]{1,9})\s*[-–—:]\s*(.{2,})$"
    paren = r"^(.*?)\s*\(([A-Za-z&][A-Za-z&\s]{0,11})\)\s*$"
    bare = F.regexp_replace(label, r"\s*\([^)]*\)\s*$", "")
    bare = F.regexp_replace(bare, r"(?i)^course\s+[\w.]+\s*[-–—:]?\s*", "")
    named = bind(bind(bare, clean), lambda b: F.coalesce(blank_to_null(b), clean(label)))
    code = F.upper(slug)

    def pair(c: Column, n: Column) -> Column:
        return F.struct(c.alias("code"), n.alias("name"))

    def from_name(name: Column) -> Column:
        repeated = F.startswith(F.upper(name), F.concat(code, F.lit(" ")))
        rest = bind(F.substring(name, F.length(code) + 1, F.length(name)), lambda r: blank_to_null(clean(r)))
        short_name = F.coalesce(F.when(repeated, rest), name)
        initials = bind(acronym(name), blank_to_null)
        return F.when(
            (F.length(slug) <= 8) & ~F.contains(slug, F.lit("-")), pair(code, short_name)
        ).otherwise(pair(F.coalesce(initials, F.upper(F.substring(slug, 1, 12))), name))

    return (
        F.when(
            label.rlike(lead),
            pair(clean(F.regexp_extract(label, lead, 1)), clean(F.regexp_extract(label, lead, 2))),
        )
        .when(
            label.rlike(paren),
            pair(
                F.regexp_replace(clean(F.regexp_extract(label, paren, 2)), r"\s+", ""),
                clean(F.regexp_extract(label, paren, 1)),
            ),
        )
        .otherwise(bind(named, from_name))
    )


def leading_token(number: Column) -> Column:
    """Subject code at the front of a course number; null when empty or over ten long."""
    token = F.upper(F.get(F.split(number, r"[\s-]"), F.lit(0)))
    return F.when(F.length(token).between(1, 10), token)


def term_code(day: Column) -> Column:
    """Year followed by 01, 05 or 08 for the running term."""
    month = F.month(day)
    part = F.when(month <= 4, "01").when(month <= 7, "05").otherwise("08")
    return F.concat(F.year(day).cast("string"), part)
