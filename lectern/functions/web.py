"""Addresses, page scores, platform fingerprints and links of stored web pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import bind, clean

# Words and marks that speak for or against a catalog page.
CATALOG_WORDS = r"(?i)catalog|bulletin|course|academics|curriculum|schedule of classes|handbook|module"
CATALOG_HOST = (
    r"(?i)^(catalog|catalogs|catalogue|bulletin|bulletins|coursecatalog|coursecatalogue"
    r"|courses|guide|classes|handbook)\."
)
STRONG_TITLE = (
    r"(?i)course catalog|academic catalog|general catalog|course catalogue|undergraduate bulletin"
    r"|academic bulletin|course guide|course handbook|module catalogue"
)
EXPLICIT_PATH = r"(?i)catalog|bulletin|course|handbook|module"
NEWS_PATH = r"(?i)/(news|blog|events?|stories|story|articles?|posts?|people|profiles?)/"
OFF_TOPIC_TITLE = r"(?i)admission|apply now|give to|athletics|news|alumni"
DATED_ARTICLE = (
    r"(?is)<article\b(?:(?!</article>).)*<time\b"
    r'|class\s*=\s*["\'](?:[^"\']*\s)?post-date[\s"\']'
    r'|property\s*=\s*["\']article:published_time["\']'
)
FINGERPRINT_POINTS = {
    "courseblock": 35,
    "preview_course": 35,
    "/studentregistrationssb/": 30,
    "courseleaf": 30,
    "coursedog": 30,
    "kuali": 25,
}

# Addresses tried for a school, in order; %s is its domain.
CANDIDATE_ADDRESSES = """
https://catalog.%s
https://catalogs.%s
https://catalogue.%s
https://bulletin.%s
https://bulletins.%s
https://coursecatalog.%s
https://courses.%s
https://guide.%s
https://classes.%s
https://%s/catalog
https://%s/courses
https://%s/bulletin
https://%s/course-catalog
https://%s/academics/catalog
https://registrar.%s/catalog
https://registrar.%s/catalogs
https://catalog.%s/courses
https://handbook.%s
https://coursecatalogue.%s
https://%s/handbook
https://%s/module-catalogue
""".split()

ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def origin(url: Column) -> Column:
    return F.lower(F.regexp_substr(url, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+")))


def path_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def drop_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def last_slug(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/$", "")
    return F.element_at(F.split(bare, "/"), -1)


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of a link seen on the page ``base``; unusable links are null."""
    return bind(bind(F.trim(href), lambda link: _absolute(link, base)), _fold_dots)


def _absolute(link: Column, base: Column) -> Column:
    stem = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(path(base) == "/", F.concat(origin(base), F.lit("/"))).otherwise(
        F.regexp_replace(stem, "[^/]*$", "")
    )
    return (
        F.when(link == "", base)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), link))
        .when(link.startswith("/"), F.concat(origin(base), link))
        .when(link.rlike("(?i)^https?://[^/?#]+$"), F.concat(link, F.lit("/")))
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("?"), F.concat(stem, link))
        .when(link.startswith("#"), F.concat(drop_fragment(base), link))
        .otherwise(F.concat(folder, link))
    )


def _fold_dots(url: Column) -> Column:
    """Work ``.`` and ``..`` path steps out of an address."""
    parts = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    steps = F.aggregate(
        F.split(parts, "/"),
        F.array().cast("array<string>"),
        lambda done, step: F.when(step == ".", done)
        .when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(step))),
    )
    closed = F.when(parts.rlike(r"/\.\.?$"), F.concat(F.array_join(steps, "/"), F.lit("/"))).otherwise(
        F.array_join(steps, "/")
    )
    folded = F.concat(
        origin(url), closed, F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*([?#].*)$", 1)
    )
    return F.when(F.contains(url, F.lit("/.")) & parts.rlike(r"/\.\.?(/|$)"), folded).otherwise(url)


def page_title(html: Column) -> Column:
    return clean(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def link_targets(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"']"), 1)


def anchors(html: Column) -> Column:
    """Array of struct(href, text) of the links of a page, in page order."""
    hrefs, labels = (F.regexp_extract_all(html, F.lit(ANCHOR), i) for i in (1, 2))
    return F.zip_with(
        hrefs,
        labels,
        lambda href, label: F.struct(
            href.alias("href"), bind(F.regexp_replace(label, "<[^>]*>", ""), clean).alias("text")
        ),
    )


def page_score(url: Column, html: Column) -> Column:
    """How much a page looks like the root of a course catalog."""

    def points(test: Column, n: int) -> Column:
        return F.when(test, n).otherwise(0)

    def total(page: Column) -> Column:
        low, title, site, where = page["low"], page["title"], page["site"], page["path"]
        marked = F.lit(False)
        score = points(site.rlike(CATALOG_HOST), 40)
        score += points(where.rlike(CATALOG_WORDS), 15)
        score += F.greatest(F.lit(0), F.lit(12) - path_depth(url) * 4)
        score += points(title.rlike(CATALOG_WORDS), 20) + points(title.rlike(STRONG_TITLE), 20)
        for mark, worth in FINGERPRINT_POINTS.items():
            seen = F.contains(low, F.lit(mark))
            marked = marked | seen
            score += points(seen, worth)
        score += F.least(
            F.lit(25), F.size(F.filter(link_targets(html), lambda h: h.rlike(CATALOG_WORDS)))
        )
        # A page on the school's plain host is marketing unless something says otherwise.
        domain = F.regexp_replace(site, r"^www\.", "")
        plain_host = (site == domain) | (site == F.concat(F.lit("www."), domain))
        score += points(plain_host & ~marked & ~where.rlike(EXPLICIT_PATH), -45)
        score += points(where.rlike(NEWS_PATH), -60)
        score += points(html.rlike(DATED_ARTICLE), -25)
        score += points(title.rlike(OFF_TOPIC_TITLE), -15)
        return score + points(F.length(html) < 800, -25)

    page = F.struct(
        F.lower(html).alias("low"),
        page_title(html).alias("title"),
        host(url).alias("site"),
        path(url).alias("path"),
    )
    return F.when(host(url).isNotNull(), bind(page, total)).otherwise(0)


def platform(url: Column, html: Column) -> Column:
    """Catalog product a page was made with, first match in priority order."""

    def choose(low: Column) -> Column:
        def has(*marks: str) -> Column:
            hit = F.lit(False)
            for m in marks:
                hit = hit | F.contains(low, F.lit(m))
            return hit

        # Marks of each catalog product.
        return (
            F.when(
                has("courseleaf", "/ribbit/", "lfjsobjects", 'class="courseblock', "class='courseblock")
                | url.rlike(r"(?i)catalog\.[^/]+/(?:courses|coursesaz)"),
                "courseleaf",
            )
            .when(
                has("acalog", "content.php?catoid=", "preview_course_nopop.php")
                | url.rlike(r"(?i)/(content|catalog)\.php\?"),
                "acalog",
            )
            .when(has("coursedog") | url.rlike("(?i)coursedog"), "coursedog")
            .when(
                has("/studentregistrationssb/ssb/", "bwckctlg.p_", "bwckschd.p_")
                | url.rlike(r"(?i)/StudentRegistrationSsb/ssb/|bwckctlg\.p_"),
                "banner",
            )
            .when(
                has("kuali")
                | url.rlike(r"(?i)kuali\.co")
                | (has('id="root"') & has("/api/v1/catalog")),
                "kuali",
            )
            .otherwise("generic")
        )

    return bind(F.lower(html), choose)


def private_host(name: Column) -> Column:
    h = F.lower(name)
    quad = h.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")
    first = F.split(h, r"\.")[0].cast("int")
    second = F.get(F.split(h, r"\."), F.lit(1)).cast("int")
    inner = (
        first.isin(127, 10, 0, 169)
        | ((first == 172) & second.between(16, 31))
        | ((first == 192) & (second == 168))
    )
    return (
        (h == "localhost")
        | h.endswith(".localhost")
        | h.endswith(".internal")
        | h.isin("::1", "[::1]")
        | F.when(quad, inner).otherwise(False)
    )


def public_url(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return F.coalesce(scheme.isin("http", "https") & ~private_host(host(url)), F.lit(False))


def school_slugs(name: Column, domain: Column) -> Column:
    from_domain = F.split(F.regexp_replace(domain, r"^www\.", ""), r"\.")[0]
    short = F.regexp_replace(F.lower(name), r"^(the|university of|college of)\s+", "")
    from_name = F.regexp_replace(short, "[^a-z0-9]+", "")
    return F.array_distinct(F.filter(F.array(from_domain, from_name), lambda s: s != ""))


def confidence(is_catalog: Column, raw: Column) -> Column:
    """A supplied verdict as a share between 0 and 1."""
    share = F.when(raw > 1, raw / 100).otherwise(raw)
    odd = raw.isNull() | F.isnan(raw) | (F.abs(raw) == float("inf"))
    return (
        F.when(is_catalog.isNull(), 0.5)
        .when(~is_catalog, 0.0)
        .when(odd, 0.5)
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))
    )
