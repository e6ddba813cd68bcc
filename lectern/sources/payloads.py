"""Course, department and term rows of third-party JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.courses import prerequisites
from lectern.functions.text import bind, blank_to_null, clean, strip_html
from lectern.operators.lineage import once
from lectern.operators.ranks import deal_out

COURSEDOG = (
    "struct<status:string,code:string,subjectCode:string,courseNumber:string,name:string,"
    "longName:string,description:string,departments:array<string>,"
    "credits:struct<numberOfCredits:double,creditHours:struct<min:double,max:double>>,"
    "requisites:struct<requisitesFreeform:struct<value:string>>,"
    "customFields:struct<instructorNames:string>>"
)
COURSEDOG_FILTERS = (
    "struct<filters:array<struct<questionId:string,"
    "config:struct<options:array<struct<value:string,label:string>>>>>>"
)
BANNER = (
    "struct<subject:string,subjectCode:string,courseNumber:string,courseNumberDisplay:string,"
    "courseTitle:string,title:string,courseDescription:string,creditHourHigh:string,"
    "creditHours:string,creditHourLow:string,termDesc:string>"
)
CODED = "array<struct<code:string,description:string>>"

# Where a captured payload keeps its list of courses.
LIST_KEYS = ("courses", "data", "items", "results")


def plain_number(c: Column) -> Column:
    """A number without a needless decimal point."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def coursedog_courses(payloads: DataFrame) -> DataFrame:
    """Active courses of (payload_id, json) rows."""
    p = F.from_json("json", COURSEDOG)
    rows = payloads.select("payload_id", p.alias("p")).filter(
        F.coalesce(F.col("p.status"), F.lit("")).isin("") | (F.lower("p.status") == "active")
    )
    code, subject, number = (clean(F.col(f"p.{n}")) for n in ("code", "subjectCode", "courseNumber"))
    course_number = F.coalesce(
        blank_to_null(code),
        F.when((subject != "") & (number != ""), F.concat(subject, F.lit(" "), number)),
    )
    low, high = F.col("p.credits.creditHours.min"), F.col("p.credits.creditHours.max")
    value = F.coalesce("p.credits.numberOfCredits", low)
    credits = F.when(
        low.isNotNull() & high.isNotNull() & (low != high),
        F.concat(plain_number(low), F.lit("-"), plain_number(high), F.lit(" credits")),
    ).when(
        value.isNotNull(),
        F.concat(plain_number(value), F.when(value == 1, " credit").otherwise(" credits")),
    )
    names = F.filter(
        F.transform(F.split("p.customFields.instructorNames", "[;,]"), clean),
        lambda n: (F.length(n) > 2) & (F.upper(n) != "STAFF"),
    )
    out = rows.select(
        "payload_id",
        course_number.alias("course_number"),
        clean(F.coalesce("p.name", "p.longName", course_number)).alias("title"),
        blank_to_null(clean(strip_html(F.col("p.description")))).alias("description"),
        credits.alias("credits"),
        blank_to_null(clean(strip_html(F.col("p.requisites.requisitesFreeform.value")))).alias("prerequisites"),
        F.when(F.size(names) > 0, names).alias("instructors"),
    )
    return out.filter("course_number is not null and title <> ''")


def coursedog_departments(configs: DataFrame, courses: DataFrame) -> DataFrame:
    """Departments a site's search filter offers, else the distinct codes of its courses.

    ``configs``: site, json. ``courses``: site, json.
    """
    filters = F.from_json("json", COURSEDOG_FILTERS)["filters"]
    own = F.get(F.filter(filters, lambda f: f["questionId"] == "departments"), F.lit(0))
    options = configs.select("site", F.explode(own["config"]["options"]).alias("o")).select(
        "site",
        F.upper(F.trim("o.value")).alias("code"),
        F.trim(F.coalesce("o.label", "o.value")).alias("name"),
    )
    offered = options.filter(F.length("code").between(1, 24) & F.length("name").between(1, 200))
    bare = courses.join(offered.select("site").distinct(), "site", "left_anti")
    used = bare.select("site", F.explode(F.from_json("json", COURSEDOG)["departments"]).alias("raw"))
    derived = used.select("site", F.upper(F.trim("raw")).alias("code")).filter(
        F.length("code").between(1, 24)
    ).distinct().withColumn("name", F.col("code"))
    return offered.dropDuplicates(["site", "code"]).unionByName(derived)


def banner_courses(payloads: DataFrame) -> DataFrame:
    """Courses of (payload_id, department, json) rows."""
    p = F.from_json("json", BANNER)
    rows = payloads.select("payload_id", "department", p.alias("p"))
    subject = F.coalesce("p.subject", "p.subjectCode", "department")
    number = F.coalesce("p.courseNumber", "p.courseNumberDisplay")

    def given(c: Column) -> Column:
        return F.coalesce(c.isNotNull() & ~c.isin("", "0", "0.0"), F.lit(False))

    high, low = F.coalesce("p.creditHourHigh", "p.creditHours"), F.col("p.creditHourLow")
    credits = F.when(
        given(low) & given(high) & (low != high), F.concat(low, F.lit("-"), high, F.lit(" credits"))
    ).when(given(high), F.concat(high, F.lit(" credits")))
    description = F.when(F.col("p.courseDescription").isNotNull(), clean(F.col("p.courseDescription")))
    return rows.filter(F.coalesce(number, F.lit("")) != "").select(
        "payload_id",
        F.concat(subject, F.lit(" "), number).alias("course_number"),
        clean(F.coalesce("p.courseTitle", "p.title", number)).alias("title"),
        description.alias("description"),
        credits.alias("credits"),
        prerequisites(description).alias("prerequisites"),
        F.col("p.termDesc").alias("terms_offered"),
    )


def latest_terms(payloads: DataFrame) -> DataFrame:
    """Newest term of each site that is not view-only, else the newest of all."""
    terms = payloads.select("site", F.explode(F.from_json("json", CODED)).alias("t"))
    live = ~F.coalesce(F.col("t.description"), F.lit("")).rlike("(?i)view only")
    return terms.groupBy("site").agg(
        F.max_by("t.code", F.struct(live, F.col("t.code").try_cast("bigint"))).alias("term")
    )


def coded_subjects(payloads: DataFrame) -> DataFrame:
    """Subject list of each site as departments."""
    rows = payloads.select("site", F.explode(F.from_json("json", CODED)).alias("s")).select(
        "site",
        F.upper(F.trim("s.code")).alias("code"),
        F.trim(F.coalesce("s.description", "s.code")).alias("name"),
    )
    return rows.filter(F.length("code").between(1, 24) & F.length("name").between(1, 200))


def kuali_courses(captures: DataFrame) -> DataFrame:
    """Courses of the largest list each site sent.

    ``captures``: site, n, json. Subjects, credits and numbers come in several shapes, so
    fields are read from a variant.
    """
    body = F.try_parse_json("json")
    lists = [F.try_variant_get(body, "$", "array<variant>")]
    lists += [F.try_variant_get(body, f"$.{k}", "array<variant>") for k in LIST_KEYS]
    rows = F.filter(
        F.coalesce(*lists, F.array().cast("array<variant>")),
        lambda v: F.schema_of_variant(v).startswith("OBJECT"),
    )
    # Parsed once: the choice of a list and the reading of its courses share the exchange.
    found = deal_out(captures).select("site", "n", rows.alias("rows")).repartition("site", "n")
    sizes = found.groupBy("site").agg(
        F.max_by("n", F.struct(F.size("rows"), -F.col("n"))).alias("n")
    )
    largest = found.join(sizes.hint("merge"), ["site", "n"]).select("site", "rows")
    items = deal_out(largest).select("site", F.posexplode("rows").alias("place", "v"))
    return once(items, "c", kuali_course(F.col("v"))).filter("c.course_number is not null").select(
        "site", "place", "c.*"
    )


def _text(v: Column, path: str) -> Column:
    """A field only when it is a JSON string."""
    raw = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(v, path, "string"))


def kuali_course(v: Column) -> Column:
    from_field = F.coalesce(_text(v, "$.subjectCode"), F.try_variant_get(v, "$.subjectCode.name", "string"))
    code = _text(v, "$.code")
    leading = blank_to_null(F.upper(F.regexp_extract(code, r"^([A-Za-z&]{2,10})", 1)))
    subject = bind(
        from_field,
        lambda f: F.when(F.coalesce(f, F.lit("")) != "", blank_to_null(F.upper(clean(f)))).otherwise(leading),
    )
    raw_number = F.coalesce(_text(v, "$.number"), code)
    kind = F.schema_of_variant(F.try_variant_get(v, "$.credits", "variant"))
    simple = F.try_variant_get(v, "$.credits", "string")

    def part(name: str) -> Column:
        return F.try_variant_get(v, f"$.credits.{name}", "string")

    credits = F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), simple).otherwise(
        F.coalesce(
            part("value"),
            F.concat(part("min"), F.lit("-"), part("max")),
            part("chosen"),
        )
    )

    def row(parts: Column) -> Column:
        number = clean(parts["number"])
        named = parts["subject"].isNotNull() & ~F.startswith(F.upper(number), parts["subject"])
        course_number = F.when(
            parts["number"].isNotNull(),
            F.when(named, F.concat(parts["subject"], F.lit(" "), number)).otherwise(number),
        )
        read = F.struct(
            course_number.alias("course_number"),
            strip_html(F.coalesce(parts["description"], F.lit(""))).alias("described"),
            strip_html(F.coalesce(parts["requisites"], F.lit(""))).alias("needs"),
        )
        return bind(read, lambda r: course(parts, r))

    def course(parts: Column, read: Column) -> Column:
        return F.struct(
            blank_to_null(read["course_number"]).alias("course_number"),
            clean(F.coalesce(parts["title"], read["course_number"])).alias("title"),
            blank_to_null(F.trim(read["described"])).alias("description"),
            parts["credits"].alias("credits"),
            F.coalesce(blank_to_null(F.trim(read["needs"])), prerequisites(read["described"])).alias("prerequisites"),
        )

    return bind(
        F.struct(
            subject.alias("subject"),
            raw_number.alias("number"),
            F.try_variant_get(v, "$.title", "string").alias("title"),
            F.try_variant_get(v, "$.description", "string").alias("description"),
            F.try_variant_get(v, "$.requisites", "string").alias("requisites"),
            credits.alias("credits"),
        ),
        row,
    )
