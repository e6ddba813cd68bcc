"""Stored web pages to links, departments, courses and readable text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import courses as c
from lectern.functions import web
from lectern.functions.text import bind, blank_to_null, clean
from lectern.operators.catalog import dedupe_by_number
from lectern.operators.lineage import cut, once
from lectern.operators.ranks import deal_out, first_rows
from lectern.sources import markup

ZERO_WIDTH = chr(0x200B)

# Path folders and page slugs of subject indexes and sub-catalogs.
SUBJECT_FOLDER = (
    r"(?i)/(courses|coursesaz|subjects|subjects-of-instruction|course-descriptions"
    r"|courses-of-instruction|azcourses)/"
)
INDEX_SLUGS = (
    "courses coursesaz subjects course-descriptions courses-of-instruction azcourses index"
).split()
STRONG_INDEX, SMALLEST_INDEX = 12, 5


def spread(pages: DataFrame) -> DataFrame:
    """Deal a small store out to all cores: reading markup costs far more than moving it."""
    return deal_out(pages)


def _explode_pages(
    pages: DataFrame, read: Callable[[str], Iterator[dict]], columns: list[str]
) -> DataFrame:
    """One row per record found in a page, numbered in page order.

    ``pages`` may be what ``read_once`` made of them.
    """
    if "reader" in pages.columns:
        return pages.filter(F.col("reader") == read.__name__).select("page_id", "url", "n", *columns)
    return _records(pages, [read], columns).drop("reader")


def read_once(pages: DataFrame, reads: list[Callable[[str], Iterator[dict]]], columns: list[str]) -> DataFrame:
    """Records of several readers, each page's markup read a single time; stored, as every reader takes its own."""
    return cut(_records(pages, reads, columns))


def _records(pages: DataFrame, reads: list[Callable[[str], Iterator[dict]]], columns: list[str]) -> DataFrame:
    key_type = pages.schema["page_id"].dataType.simpleString()
    fields = ", ".join(f"{name} string" for name in columns)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rows = ["reader", "page_id", "url", "n", *columns], []
        for pdf in batches:
            for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                root = markup.tree(html)
                for read in reads:
                    for n, record in enumerate(read(root)):
                        rows.append((read.__name__, page_id, url, n, *[record.get(name) for name in columns]))
                        if len(rows) >= 2000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
        yield pd.DataFrame(rows, columns=names)

    return spread(pages.select("page_id", "url", "html")).mapInPandas(
        task, f"reader string, page_id {key_type}, url string, n int, {fields}"
    )


def links(pages: DataFrame) -> DataFrame:
    """Every link of every page: place on the page, resolved address and label."""
    seen = F.transform(
        web.anchors(F.col("html")),
        lambda a, n: F.struct(
            n.alias("n"), web.resolve(a["href"], F.col("url")).alias("href"), a["text"].alias("text")
        ),
    )
    usable = F.filter(seen, lambda a: a["href"].isNotNull())
    dealt = spread(pages.select("page_id", "url", "html"))
    return dealt.select("page_id", "url", F.explode(usable).alias("a")).select(
        "page_id", "url", "a.n", "a.href", "a.text"
    )


def block_passages(pages: DataFrame) -> DataFrame:
    """Readable text of each page's course blocks, a row per passage in page order."""
    return _explode_pages(pages, markup.block_passages, ["passage"]).drop("url")


def course_blocks(pages: DataFrame, department: Column) -> DataFrame:
    """Courses of catalog pages that mark each course as a block.

    Tagged fields are trusted over clauses mined from the prose.
    """
    fields = (
        "detail_number detail_title detail_credits heading description extras "
        "prerequisites terms hours instructors href"
    ).split()
    raw = _explode_pages(pages, markup.course_blocks, fields)
    classic = F.when(
        clean(F.col("heading")) != "", c.parse_heading(F.col("heading"), department)
    )
    prose = F.concat_ws("\n\n", blank_to_null(F.col("description")), blank_to_null(F.col("extras")))
    parsed = once(raw.withColumn("prose", prose), "classic", classic)
    detail = F.col("detail_number").isNotNull()
    rows = parsed.select(
        "page_id",
        "n",
        F.when(detail, F.col("detail_number")).otherwise(F.col("classic.course_number")).alias("course_number"),
        F.when(detail, F.col("detail_title")).otherwise(F.col("classic.title")).alias("title"),
        "description",
        F.coalesce(
            F.when(detail, F.col("detail_credits")).otherwise(F.col("classic.credits")), "hours"
        ).alias("credits"),
        F.when(
            F.col("prerequisites").isNotNull(), c.strip_prerequisite_label(F.col("prerequisites"))
        )
        .otherwise(c.prerequisites(F.col("prose")))
        .alias("prerequisites"),
        F.coalesce("terms", c.terms_in(F.col("prose"))).alias("terms_offered"),
        F.coalesce(
            c.split_names(F.col("instructors")), "classic.instructors", c.instructors_in(F.col("prose"))
        ).alias("instructors"),
        F.coalesce(web.resolve(F.col("href"), F.col("url")), "url").alias("source_url"),
    )
    usable = rows.filter(F.col("course_number").isNotNull() & F.col("title").isNotNull())
    return dedupe_by_number(usable, ["page_id"], "n")


def _from_headings(raw: DataFrame, heading: Column) -> DataFrame:
    """Courses of (heading, description, href) records."""
    described = F.coalesce("description", F.lit(""))
    parsed = once(raw, "h", heading)
    return parsed.filter(F.col("h").isNotNull() & (F.col("h.course_number") != "") & (F.col("h.title") != "")).select(
        "page_id",
        "n",
        F.col("h.course_number").alias("course_number"),
        F.col("h.title").alias("title"),
        "description",
        F.coalesce("h.credits", c.credits_in(described)).alias("credits"),
        c.prerequisites(described).alias("prerequisites"),
        F.coalesce(web.resolve(F.col("href"), F.col("url")), "url").alias("source_url"),
    )


RECORD = ["heading", "description", "href"]


def search_results(pages: DataFrame, department: Column) -> DataFrame:
    raw = _explode_pages(pages, markup.search_results, RECORD)
    found = _from_headings(raw, c.parse_heading(F.col("heading"), department))
    return dedupe_by_number(found, ["page_id"], "n")


def listed_courses(pages: DataFrame) -> DataFrame:
    """Courses of list pages that link to a preview of each course."""
    raw = _explode_pages(pages, markup.listed_links, RECORD).filter(F.length("heading") >= 4)
    described = F.coalesce("description", F.lit(""))
    parsed = once(raw, "h", c.split_heading(F.col("heading"))).filter("h.course_number <> '' and h.title <> ''")
    return parsed.select(
        "page_id",
        "n",
        F.col("h.course_number").alias("course_number"),
        F.col("h.title").alias("title"),
        "description",
        F.col("h.credits").alias("credits"),
        c.prerequisites(described).alias("prerequisites"),
        F.coalesce(web.resolve(F.col("href"), F.col("url")), "url").alias("source_url"),
    )


def schedule_courses(pages: DataFrame) -> DataFrame:
    """Courses of class listings that put the title and the text in two table rows."""
    shape = r"^([A-Z][A-Z&\s]{0,9}\s*\d[\w.]*)\s*-\s*(.+)$"
    hours = r"(?i)([\d.]+(?:\s*(?:-|to)\s*[\d.]+)?)\s*Credit hours"
    raw = _explode_pages(pages, markup.title_cells, RECORD).filter(F.col("heading").rlike(shape))
    described = F.coalesce("description", F.lit(""))
    rows = raw.select(
        "page_id",
        "n",
        clean(F.regexp_extract("heading", shape, 1)).alias("course_number"),
        clean(F.regexp_extract("heading", shape, 2)).alias("title"),
        "description",
        blank_to_null(F.regexp_extract(described, hours, 0)).alias("credits"),
        c.prerequisites(described).alias("prerequisites"),
        F.col("url").alias("source_url"),
    )
    return dedupe_by_number(rows, ["page_id"], "n")


def menu_departments(pages: DataFrame) -> DataFrame:
    """Departments offered by a page's menus, entries like 'all' and codeless ones left out."""
    lead, paren = r"^([A-Z][A-Z&]{1,9})\s*[-–—:]\s*(.+)$", r"^(.*?)\s*\(([A-Za-z&\s]{1,12})\)\s*$"
    label = F.col("label")
    raw = _explode_pages(pages, markup.menu_options, ["menu", "value", "label"]).filter(
        (label != "")
        & (F.col("value") != "")
        & ~F.col("value").isin("0", "-1")
        & ~label.rlike("(?i)^(select|all|choose|--)")
    )
    code = F.when(label.rlike(lead), F.regexp_extract(label, lead, 1)).when(
        label.rlike(paren), F.regexp_replace(F.regexp_extract(label, paren, 2), r"\s+", "")
    )
    name = F.when(label.rlike(lead), F.regexp_extract(label, lead, 2)).when(
        label.rlike(paren), F.regexp_extract(label, paren, 1)
    )
    named = raw.select("page_id", "n", F.upper(code).alias("code"), F.trim(name).alias("name"))
    return _first_per_code(named.filter("code is not null and name <> ''"))


def subject_menu(pages: DataFrame) -> DataFrame:
    """Subjects of a class-schedule form."""
    raw = _explode_pages(pages, markup.menu_options, ["menu", "value", "label"])
    rows = raw.filter(
        F.col("menu").isin("sel_subj", "sel_subj_all") & ~F.col("value").isin("", "%", "dummy")
    ).select(
        "page_id",
        "n",
        F.upper("value").alias("code"),
        F.coalesce(blank_to_null(F.col("label")), "value").alias("name"),
    )
    return _first_per_code(rows)


def _first_per_code(rows: DataFrame) -> DataFrame:
    return rows.groupBy("page_id", "code").agg(F.min_by("name", "n").alias("name"), F.min("n").alias("n"))


def labelled_departments(linked: DataFrame) -> DataFrame:
    """Departments named in link labels, first per code: 'Name (CODE)' or 'CODE - Name'."""
    paren, lead = r"^(.*?)\s*\(([A-Z][A-Z&]{1,9})\)\s*$", r"^([A-Z][A-Z&]{1,9})\s*[-–—:]\s*(.{3,})$"
    text = F.col("text")
    rows = linked.filter((text != "") & (F.length(text) <= 100) & (text.rlike(paren) | text.rlike(lead)))

    def pair(shape: str, code: int, name: int) -> Column:
        found = bind(F.regexp_extract(text, shape, name), clean)
        return F.struct(F.regexp_extract(text, shape, code).alias("code"), found.alias("name"))

    read = F.when(text.rlike(paren), pair(paren, 2, 1)).otherwise(pair(lead, 1, 2))
    named = once(rows, "read", read).select("page_id", "n", "read.code", "read.name")
    return _first_per_code(named.filter("code <> '' and name <> ''"))


def subject_index(linked: DataFrame) -> DataFrame:
    """Departments of subject-index pages, codes made unique per page."""
    text = F.translate(F.col("text"), ZERO_WIDTH, "")
    slug = web.last_slug(F.col("href"))
    files = r"(?i)\.(pdf|docx?|xlsx?|csv)(\?|$)"
    indexed = linked.filter(F.col("href").rlike(SUBJECT_FOLDER) & ~F.col("href").rlike(files))
    named = (
        once(indexed, "read", F.struct(text.alias("text"), slug.alias("slug")))
        .select("page_id", "n", "href", "read.text", "read.slug")
        .filter((F.col("text") != "") & (F.length("text") <= 120))
        .filter((F.col("slug") != "") & ~F.lower("slug").isin(*INDEX_SLUGS))
        .filter(~F.col("slug").rlike(r"(?i)\.(html?|php|aspx)$"))
    )
    rows = (
        once(named, "subject", c.derive_subject(F.col("text"), F.col("slug")))
        .select(
            "page_id",
            "n",
            F.upper(F.trim("subject.code")).alias("code"),
            F.trim("subject.name").alias("name"),
            F.col("href").alias("url"),
        )
        .filter(F.length("code").between(1, 24) & F.length("name").between(1, 200))
    )
    # The longest name of a code wins, the first seen on ties.
    return rows.groupBy("page_id", "code").agg(
        F.max_by(F.struct("name", "url"), F.struct(F.length("name"), -F.col("n"))).alias("kept"),
    ).select("page_id", "code", "kept.name", "kept.url")


def best_index(subjects: DataFrame, group: str) -> DataFrame:
    """The page of each group with the most subjects, when it has enough.

    ``subjects`` carry the group beside page_id; a strong index needs no further look.
    """
    sizes = subjects.groupBy(group, "page_id").agg(F.count(F.lit(1)).alias("subjects"))
    top = sizes.groupBy(group).agg(
        F.max_by("page_id", F.struct("subjects", -F.col("page_id"))).alias("page_id"),
        F.max("subjects").alias("subjects"),
    )
    return top.filter(F.col("subjects") >= SMALLEST_INDEX).select(
        group, "page_id", "subjects", (F.col("subjects") >= STRONG_INDEX).alias("strong")
    )


def sub_catalogs(linked: DataFrame, top: int | None = None) -> DataFrame:
    """Same-site sections of a hub page that look like catalogs, best first (``top``: 8 is the site's preset)."""
    slug = web.last_slug(F.col("href"))
    low = F.lower("text")
    inside = web.origin(F.col("href")) == web.origin(F.col("url"))
    at_top = linked.filter(inside & (web.path_depth(F.col("href")) == 1))
    rows = once(at_top, "slug", slug)
    # Slugs that are never a catalog, and what speaks for one.
    rows = (
        rows.filter(~F.col("slug").rlike(r"(?i)\.(pdf|docx?|xlsx?|html?)$"))
        .filter(~F.lower("slug").isin(*INDEX_SLUGS))
        .filter(~F.col("slug").rlike("(?i)^(search|archive|about|help|policies|admission|index)$"))
        .filter(~F.col("slug").rlike("(?i)handbook|policy|policies|calendar|archive|regulation"))
    )

    def points(test: Column, n: int) -> Column:
        return F.when(test, n).otherwise(0)

    score = (
        points(F.col("slug").rlike("(?i)^(ycps|gsas|college|undergraduate|graduate|catalog|bulletin|courses?)$"), 10)
        + points(low.rlike("programs? of study|course|curriculum|catalog|bulletin|subjects"), 6)
        + points(F.col("slug").rlike("(?i)course|program|study|catalog"), 3)
        + points((F.length("slug") <= 6) & ~F.contains("slug", F.lit("-")), 2)
    )
    scored = rows.withColumn("score", score).groupBy(
        "page_id", F.concat(web.origin(F.col("href")), F.lit("/"), "slug", F.lit("/")).alias("target")
    ).agg(F.max("score").alias("score"), F.min("n").alias("n"))
    return first_rows(scored, ["page_id"], [F.desc("score"), F.asc("n")], top, "place")


def sitemap_links(sitemaps: DataFrame, top: int | None = None) -> DataFrame:
    """Catalog-like addresses of each sitemap; of a sitemap index, the sitemaps to read next.

    ``top`` keeps the first ones of each (12 of a map and 1 of an index are the site's presets).
    """
    locations = F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), 1)
    wanted = F.filter(locations, lambda u: u.rlike(web.CATALOG_WORDS))
    kept = wanted if top is None else F.slice(wanted, 1, top)
    nested = F.contains("xml", F.lit("<sitemapindex"))
    return sitemaps.select("site", nested.alias("nested"), F.posexplode(kept).alias("n", "url"))


def homepage_links(linked: DataFrame, top: int | None = None) -> DataFrame:
    """Distinct catalog-like links of a home page that stay on its domain, in page order (12: the site's preset)."""
    worded = F.col("text").rlike(web.CATALOG_WORDS) | F.col("href").rlike(web.CATALOG_WORDS)
    own = F.endswith(web.host(F.col("href")), web.bare_host(F.col("url")))
    rows = linked.filter(worded & own).withColumn("target", web.drop_fragment(F.col("href")))
    once = rows.groupBy("page_id", "target").agg(F.min("n").alias("n"))
    return first_rows(once, ["page_id"], [F.asc("n")], top, "place")


def candidate_urls(domains: DataFrame) -> DataFrame:
    """Addresses to try for each domain, in order; the list of shapes is fixed."""
    shapes = F.array(*[F.lit(a) for a in web.CANDIDATE_ADDRESSES])
    bare = F.regexp_replace("domain", r"^www\.", "")
    return domains.select("domain", F.posexplode(shapes).alias("place", "shape")).select(
        "domain", "place", F.replace("shape", F.lit("%s"), bare).alias("url")
    )


def text_courses(texts: DataFrame) -> DataFrame:
    """Courses of plain text: a line that starts with a code, and the three lines after it.

    ``texts``: page_id, url, text.
    """

    def candidates(lines: Column) -> Column:
        return F.filter(
            F.transform(
                lines,
                lambda line, i: F.struct(
                    i.alias("n"),
                    clean(line).alias("line"),
                    F.array_join(F.slice(lines, i + 2, F.lit(3)), " ").alias("after"),
                ),
            ),
            lambda r: F.length(r["line"]).between(8, 300)
            & r["line"].rlike(r"^[A-Z][A-Z&]{1,9}[\s-]?\d"),
        )

    rows = texts.select(
        "page_id", "url", F.explode(bind(F.split("text", "\n"), candidates)).alias("r")
    )
    parsed = once(rows, "h", c.split_heading(F.col("r.line"))).withColumn(
        "description", blank_to_null(clean(F.col("r.after")))
    )
    found = parsed.filter("h.course_number <> '' and length(h.title) >= 3").select(
        "page_id",
        F.col("r.n").alias("n"),
        F.col("h.course_number").alias("course_number"),
        F.col("h.title").alias("title"),
        "description",
        F.col("h.credits").alias("credits"),
        c.prerequisites(F.coalesce("description", F.lit(""))).alias("prerequisites"),
        F.col("url").alias("source_url"),
    )
    return dedupe_by_number(found, ["page_id"], "n")


