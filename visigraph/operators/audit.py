"""Page audit: each rule is a function of page columns that gives an array of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ranked
from ..functions.text import blank, rtrim_slash, stripped, word_count

TITLE, DESCRIPTION, H1, THIN = (30, 60), (50, 160), (10, 70), 300
ISSUE = "struct<category:string,rule:string,severity:string,message:string>"
SECURITY_HEADERS = {
    "strict-transport-security": "Strict-Transport-Security",
    "x-content-type-options": "X-Content-Type-Options",
    "x-frame-options": "X-Frame-Options",
    "content-security-policy": "Content-Security-Policy",
}


def issue(category: str, rule: str, severity: str, message: str | Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(category).alias("category"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), text.alias("message"))


def issues(*some: Column) -> Column:
    """The issues that are not null, in order."""
    return F.array_compact(F.array(*some))


def format_text(pattern: str, *args: Column) -> Column:
    return F.format_string(pattern, *args)


def _length_rule(category: str, field: Column, name: str, missing: str, bounds: tuple[int, int]) -> Column:
    n = F.length(stripped(field))
    note = format_text(f"{name} is %d chars (recommended {bounds[0]}-{bounds[1]}).", n)
    return issues(F.when(n == 0, issue(category, "missing", "error", missing)).when(n < bounds[0], issue(category, "too_short", "warning", note)).when(n > bounds[1], issue(category, "too_long", "warning", note)))


def title(p: dict) -> Column:
    return _length_rule("title", p["title"], "Title", "Page title is missing.", TITLE)


def meta_description(p: dict) -> Column:
    return _length_rule("meta_description", p["meta_description"], "Meta description", "Meta description is missing.", DESCRIPTION)


def h1(p: dict) -> Column:
    some = F.filter(F.coalesce(p["h1"], F.array().cast("array<string>")), lambda h: ~blank(h))
    n, first = F.size(some), F.length(F.get(some, F.lit(0)))
    note = format_text(f"H1 is %d chars (recommended {H1[0]}-{H1[1]}).", first)
    return issues(
        F.when(n == 0, issue("h1", "missing", "error", "No H1 tag found.")),
        F.when(n > 1, issue("h1", "multiple", "warning", format_text("%d H1 tags found; use only one.", n))),
        F.when(first < H1[0], issue("h1", "too_short", "warning", note)).when(first > H1[1], issue("h1", "too_long", "warning", note)),
    )


def h2(p: dict) -> Column:
    none = F.size(F.filter(F.coalesce(p["h2"], F.array().cast("array<string>")), lambda h: ~blank(h))) == 0
    tags = F.transform(p["heading_structure"], lambda h: h["tag"])
    first_h1, first_h2 = F.coalesce(F.array_position(tags, "h1"), F.lit(0)), F.coalesce(F.array_position(tags, "h2"), F.lit(0))
    early = (first_h2 > 0) & ((first_h1 == 0) | (first_h2 < first_h1))
    return issues(F.when(none, issue("h2", "missing", "warning", "No H2 tags found.")).when(early, issue("h2", "poor_structure", "warning", "An H2 appears before the H1 in document order.")))


def image_alt(p: dict) -> Column:
    missing, empty = (F.coalesce(F.size(F.filter(p["image_alts"], f)), F.lit(0)) for f in (lambda i: i["alt"].isNull(), lambda i: i["alt"] == ""))
    return issues(
        F.when(missing > 0, issue("image_alt", "missing", "warning", format_text("%d image(s) missing the alt attribute.", missing))),
        F.when(empty > 0, issue("image_alt", "empty", "warning", format_text("%d image(s) have empty alt text.", empty))),
    )


def schema_items(p: dict) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(p["domain_schema"], none), F.coalesce(p["page_schemas"], none))


def schema_type(item: Column) -> Column:
    return F.get_json_object(item, "$['@type']")


def schema(p: dict) -> Column:
    items = schema_items(p)
    invalid = F.size(F.filter(items, lambda i: F.coalesce(schema_type(i), F.lit("")) == ""))
    return issues(F.when(F.size(items) == 0, issue("schema", "missing", "error", "No structured data (JSON-LD) found.")).when(invalid > 0, issue("schema", "invalid", "warning", format_text("%d schema item(s) missing @type.", invalid))))


def canonical(p: dict) -> Column:
    return issues(F.when(blank(p["canonical"]), issue("canonical", "missing", "warning", "Canonical link is missing.")))


def opengraph(p: dict) -> Column:
    missing = F.concat_ws(", ", *(F.when(blank(p[f]), f) for f in ("og_title", "og_description")))
    return issues(F.when(missing != "", issue("opengraph", "missing", "warning", format_text("Missing OpenGraph field(s): %s.", missing))))


def twitter(p: dict) -> Column:
    return issues(F.when(blank(p["twitter_card"]), issue("twitter", "missing", "warning", "Twitter card meta tag is missing.")))


def lang(p: dict) -> Column:
    return issues(F.when(blank(p["lang"]), issue("lang", "missing", "error", "HTML lang attribute is missing.")))


def content(p: dict) -> Column:
    note = lambda n: issue("content", "thin", "warning", format_text(f"Page has only %d words (recommended {THIN}+).", n))
    # as the one item of an array, the number is counted once, whatever reads it
    return F.array_compact(F.transform(F.array(word_count(p["custom_content"])), lambda n: F.when(n < THIN, note(n))))


#: The rules in report order; a user may pass others, or more.
RULES = {"title": title, "meta_description": meta_description, "h1": h1, "h2": h2, "image_alt": image_alt, "schema": schema, "canonical": canonical, "opengraph": opengraph, "twitter": twitter, "lang": lang, "content": content}
KEEP = ["project_id", "page_id"]


def fields(pages: DataFrame) -> dict:
    return {c: F.col(c) for c in pages.columns}


def audited(pages: DataFrame) -> DataFrame:
    return pages.where(F.coalesce("error", F.lit("")) == "")


def apply_rules(pages: DataFrame, rules: list | None = None) -> DataFrame:
    """A row for each issue of the pages that could be fetched: project_id, page_id and the issue. What an explode makes is first filtered by its
    size, for which Spark would run all rules once more; the outer one has no such filter, so a page without issues has a null instead."""
    p = fields(pages)
    found = F.concat(*(rule(p) for rule in (rules or RULES.values())))
    return audited(pages).select(*KEEP, F.explode_outer(found).alias("i")).where("i IS NOT NULL").select(*KEEP, "i.*")


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """Pages whose title, case aside, another page of the project has. Counts are joined back, so a title of very many pages is
    counted before it is shuffled."""
    titled = audited(pages).select(*KEEP, F.lower(stripped(F.col("title"))).alias("_t")).where("_t <> ''")
    many = titled.groupBy("project_id", "_t").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return titled.join(many, ["project_id", "_t"]).select(*KEEP, issue("title", "duplicate", "warning", "Title is duplicated across multiple pages.").alias("i")).select(*KEEP, "i.*")


def run_audit(pages: DataFrame, rules: list | None = None) -> DataFrame:
    return apply_rules(pages, rules).unionByName(duplicate_titles(pages))


def page_scores(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(project_id, page_id, score): 100 less 15 for each error and 5 for each other issue, at least 0; null for failed pages."""
    loss = found.groupBy("page_id").agg(F.sum(F.when(F.col("severity") == "error", 15).otherwise(5)).alias("_loss"))
    score = F.greatest(100 - F.coalesce("_loss", F.lit(0)), F.lit(0)).cast("int")
    return pages.select(*KEEP, "error").join(loss, "page_id", "left").select(*KEEP, F.when(F.coalesce("error", F.lit("")) == "", score).alias("score"))


def title_checklist(pages: DataFrame, found: DataFrame) -> DataFrame:
    twice = found.where("category = 'title' AND rule = 'duplicate'").select("page_id").distinct().withColumn("_twice", F.lit(True))
    n = F.length(stripped(F.col("title")))
    return pages.join(twice, "page_id", "left").select("page_id", (n > 0).alias("present"), ((n == 0) | n.between(*TITLE)).alias("length_ok"), F.col("_twice").isNull().alias("not_duplicated"))


# Provider reports in the same vocabulary.

CHECKS = [
    ("no_description", "meta_description", "missing", "error", "Meta description is missing."),
    ("no_h1_tag", "h1", "missing", "error", "No H1 tag found."),
    ("no_image_alt", "image_alt", "missing", "warning", "One or more images are missing alt text."),
    ("low_content_rate", "content", "thin", "warning", "Page has a low ratio of text content to page size."),
    ("irrelevant_title", "title", "irrelevant", "warning", "Title does not appear relevant to the page content."),
    ("irrelevant_description", "meta_description", "irrelevant", "warning", "Meta description does not appear relevant to the page content."),
]


def issues_from_checks(items: DataFrame) -> DataFrame:
    """items(page_id, checks map, social map) to a row per issue. Checks that need an explicit false: canonical and is_https."""
    on = lambda k: F.coalesce(F.element_at("checks", F.lit(k)), F.lit(False))
    off = lambda k: ~F.coalesce(F.element_at("checks", F.lit(k)), F.lit(True))
    unset = lambda k: F.coalesce(F.element_at("social", F.lit(k)), F.lit("")) == ""
    titled = ~on("no_title")
    simple = {key: F.when(on(key), issue(*rest)) for key, *rest in CHECKS}
    found = issues(
        F.when(~titled, issue("title", "missing", "error", "Page title is missing.")),
        F.when(titled & on("title_too_short"), issue("title", "too_short", "warning", "Title tag is shorter than recommended.")),
        F.when(titled & on("title_too_long"), issue("title", "too_long", "warning", "Title tag is longer than recommended.")),
        F.when(titled & on("duplicate_title_tag"), issue("title", "duplicate", "warning", "Title tag is duplicated on another crawled page.")),
        simple["no_description"],
        F.when(~on("no_description") & on("duplicate_meta_tags"), issue("meta_description", "duplicate", "warning", "Meta tags are duplicated on another crawled page.")),
        simple["no_h1_tag"],
        simple["no_image_alt"],
        F.when(off("canonical"), issue("canonical", "missing", "warning", "Canonical link is missing.")),
        F.when(off("is_https"), issue("security", "no_ssl", "error", "Page is not served over HTTPS.")),
        simple["low_content_rate"],
        simple["irrelevant_title"],
        simple["irrelevant_description"],
        F.when(unset("og:title") & unset("og:description"), issue("opengraph", "missing", "warning", "OpenGraph title/description tags are missing.")),
        F.when(unset("twitter:card"), issue("twitter", "missing", "warning", "Twitter card meta tag is missing.")),
    )
    return items.select("page_id", F.explode(found).alias("i")).select("page_id", "i.*")


#: The provider's issue numbers with our category, severity and name.
REPORT_ISSUES = [
    (3, "title", "error", "Title tag is missing or empty"),
    (6, "title", "error", "Duplicate title tag"),
    (101, "title", "warning", "Title element is too short"),
    (102, "title", "warning", "Title element is too long"),
    (106, "meta_description", "warning", "Missing meta description"),
    (15, "meta_description", "error", "Duplicate meta descriptions"),
    (103, "h1", "error", "Missing H1"),
    (104, "h1", "warning", "Multiple H1 tags"),
    (110, "image_alt", "warning", "Missing ALT attributes"),
    (7, "content", "error", "Duplicate content"),
]


def report_dimension(spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame(REPORT_ISSUES, "issue_id int, category string, severity string, message string")


def report_totals(reports: DataFrame) -> DataFrame:
    """reports(project_id, issue_id, total, error) to totals per project; what could not be fetched is not counted but named, by the first error in the
    order of the map that is not empty. Texts are aggregated by sorting, so the reports are dealt by project first: else each task would sort all that it
    reads, of which hardly any rows combine."""
    dealt = reports.select("project_id", "issue_id", "total", "error").repartition("project_id")
    known = dealt.join(F.broadcast(report_dimension(reports.sparkSession)), "issue_id")
    ok = F.col("error").isNull()
    n = F.when(ok, F.coalesce("total", F.lit(0))).otherwise(0)
    place = F.array_position(F.array(*(F.lit(i) for i, *_ in REPORT_ISSUES)), F.col("issue_id"))
    failed = F.when(~ok, F.struct((F.col("error") == "").alias("empty"), place.alias("place"), "error"))
    by = known.groupBy("project_id", "category").agg(F.sum(n).alias("n"), F.sum(F.when(F.col("severity") == "error", n).otherwise(0)).alias("critical"), F.min(failed).alias("failed"), F.count_if(ok).alias("fetched"))
    return by.groupBy("project_id").agg(F.sum("n").alias("total"), F.sum("critical").alias("critical"), F.sum(F.col("n") - F.col("critical")).alias("warnings"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("fetched") > 0, F.struct("category", "n"))))).alias("by_category"), F.min("failed")["error"].alias("error"))


def report_rows(reports: DataFrame) -> DataFrame:
    """A row per page of each fetched issue: source_url, else target_url, else empty. reports(..., pages array<struct>)."""
    known = reports.where("error IS NULL").join(F.broadcast(report_dimension(reports.sparkSession)), "issue_id")
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return known.select("project_id", "category", "severity", "message", F.explode("pages").alias("p")).select("project_id", "category", "severity", "message", F.coalesce(filled("p.source_url"), filled("p.target_url"), F.lit("")).alias("url"))


def security_report(responses: DataFrame) -> DataFrame:
    """responses(project_id, base_url, headers map, robots_status, error) to the passed checks and int(passed / 4 * 100)."""
    has = [F.array_contains(F.map_keys("headers"), k) for k in SECURITY_HEADERS]
    reachable = F.col("error").isNull()
    every = reachable & F.coalesce(has[0] & has[1] & has[2] & has[3], F.lit(False))
    robots = F.coalesce(F.col("robots_status") == 200, F.lit(False))
    https = F.lower("base_url").startswith("https://")
    passed = sum((c.cast("int") for c in (https, reachable, every, robots)), F.lit(0))
    return responses.select("project_id", https.alias("https"), reachable.alias("reachable"), every.alias("all_headers"), robots.alias("robots"), F.floor(passed * 25).cast("int").alias("score"))


def security_issues(responses: DataFrame, pages: DataFrame) -> DataFrame:
    """Issues of a site, on its crawled home page; sites whose home page is not there are left out."""
    https = F.lower("base_url").startswith("https://")
    missing = F.concat_ws(", ", *(F.when(~F.array_contains(F.map_keys("headers"), k), label) for k, label in SECURITY_HEADERS.items()))
    found = issues(
        F.when(~https, issue("security", "no_ssl", "error", "Site is not served over HTTPS.")).when(F.col("error").isNotNull(), issue("security", "ssl_error", "error", F.concat(F.lit("HTTPS connection failed: "), "error"))),
        F.when(F.col("error").isNull() & (missing != ""), issue("security", "missing_headers", "warning", format_text("Missing security header(s): %s.", missing))),
        F.when(F.col("robots_status").isNull(), issue("security", "robots_missing", "warning", "Could not fetch robots.txt: no answer")).when(F.col("robots_status") != 200, issue("security", "robots_missing", "warning", format_text("robots.txt returned HTTP %d.", F.col("robots_status")))),
    )
    home = audited(pages).groupBy("project_id", rtrim_slash(F.col("url")).alias("_home")).agg(F.min("page_id").alias("page_id"))
    sites = responses.withColumn("_home", rtrim_slash(F.col("base_url")))
    return sites.join(home, ["project_id", "_home"]).select("project_id", "page_id", F.explode(found).alias("i")).select("project_id", "page_id", "i.*")


VALIDATED = ("title", "meta_description", "h1", "h2", "canonical", "lang")


def validate_values(candidates: DataFrame) -> DataFrame:
    """candidates(category, value, ...) with applicable, passed and issues: would the value pass the rule of its category?"""
    value = stripped(F.col("value"))
    one = F.when(value != "", F.array(value)).otherwise(F.array().cast("array<string>"))
    heading = lambda tag: F.struct(F.lit(tag).alias("tag"), value.alias("text"))
    p = {"title": value, "meta_description": value, "canonical": value, "lang": value, "h1": one, "h2": one, "heading_structure": F.when(value != "", F.array(heading("h1"), heading("h2"))).otherwise(F.array(heading("h1")))}
    found = F.lit(None).cast(f"array<{ISSUE}>")
    for c in VALIDATED:
        found = F.when(F.col("category") == c, RULES[c](p)).otherwise(found)
    known = F.col("category").isin(*VALIDATED)
    return candidates.withColumn("applicable", known).withColumn("issues", F.when(known, found).otherwise(F.array().cast(f"array<{ISSUE}>"))).withColumn("passed", F.when(F.col("applicable"), F.size("issues") == 0))


CATEGORIES = ("title", "meta_description", "h1", "h2", "canonical", "opengraph", "twitter", "lang", "image_alt", "schema", "content")


def current_values(pages: DataFrame, limit: int = 80) -> DataFrame:
    """(page_id, category, value): one line for what the page has now; -Blank- for nothing, cut with an ellipsis beyond the limit."""
    p = fields(pages)
    listed = lambda c: F.array_join(F.filter(p[c], lambda h: F.coalesce(h, F.lit("")) != ""), ", ")
    pairs = lambda some: F.concat_ws("; ", *(F.when(F.coalesce(p[c], F.lit("")) != "", F.concat(F.lit(f"{label}: "), p[c])) for label, c in some if c in p))
    unset = F.size(F.filter(p["image_alts"], lambda i: blank(i["alt"])))
    images = F.when(F.size("image_alts") > 0, format_text("%d image(s), %d missing alt", F.size("image_alts"), unset))
    types = F.array_sort(F.array_distinct(F.filter(F.transform(schema_items(p), schema_type), lambda t: F.coalesce(t, F.lit("")) != "")))
    values = {
        "title": stripped(p["title"]), "meta_description": stripped(p["meta_description"]), "h1": listed("h1"), "h2": listed("h2"), "canonical": stripped(p["canonical"]),
        "opengraph": pairs([("OG Title", "og_title"), ("OG Description", "og_description"), ("OG URL", "og_url")]),
        "twitter": pairs([("Twitter Card", "twitter_card"), ("Twitter Title", "twitter_title"), ("Twitter Description", "twitter_description")]),
        "lang": stripped(p["lang"]), "image_alt": images, "schema": F.array_join(types, ", "), "content": stripped(excerpt(p, 400)),
    }
    rows = pages.select("page_id", F.explode(F.array(*(F.struct(F.lit(k).alias("category"), F.coalesce(v, F.lit("")).alias("value")) for k, v in values.items()))).alias("x")).select("page_id", "x.*")
    shown = F.when(F.col("value") == "", "-Blank-").when(F.length("value") > limit, F.concat(F.substring("value", 1, limit), F.lit("…"))).otherwise(F.col("value"))
    return rows.withColumn("value", shown)


def excerpt(p: dict, n: int) -> Column:
    fit = F.when(p["fit_markdown"] != "", p["fit_markdown"]) if "fit_markdown" in p else F.lit(None).cast("string")
    return F.substring(F.coalesce(fit, p["custom_content"], F.lit("")), 1, n)


# Roll-ups.

SOURCES = ("dataforseo", "semrush", "crawler")


def active_source(pages: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """(project_id, active_source): the preferred source that the project has pages of; else its own type if that is one, else manual."""
    chosen = F.coalesce(*(F.max(F.when(F.col("source") == s, s)) for s in SOURCES))
    by = pages.groupBy("project_id").agg(chosen.alias("active_source"))
    if projects is None:
        return by.withColumn("active_source", F.coalesce("active_source", F.lit("manual")))
    own = F.when(F.col("project_type").isin("dataforseo", "semrush", "manual", "connected"), F.col("project_type"))
    return projects.join(by, "project_id", "left").select("project_id", F.coalesce("active_source", own, F.lit("manual")).alias("active_source"))


#: The providers of page audits, the preferred one first.
PROVIDERS = ("dataforseo", "semrush")


def project_provider(pages: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, provider) of projects(project_id, project_type): the preferred provider that the project has pages of, whatever its type says; without
    such pages its type, if that is a provider, else the preferred one. Pages of a crawler don't count."""
    has = pages.where(F.col("source").isin(*PROVIDERS)).groupBy("project_id").agg(F.min_by("source", F.array_position(F.array(*map(F.lit, PROVIDERS)), F.col("source"))).alias("_has"))
    own = F.when(F.col("project_type").isin(*PROVIDERS), F.col("project_type"))
    return projects.join(has, "project_id", "left").select("project_id", F.coalesce("_has", own, F.lit(PROVIDERS[0])).alias("provider"))


def active_pages(pages: DataFrame) -> DataFrame:
    source = active_source(pages)
    return pages.join(source, "project_id").where(F.col("source") == F.col("active_source")).drop("active_source")


def project_cards(pages: DataFrame, found: DataFrame, jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per project over the pages(..., updated_at) of its active source: pages, errors, warnings, total, last_checked, health, is_fetching. A
    project is fetching while a job(project_id, status) is queued or running, or an on-page task(project_id, status) is posted."""
    busy = jobs.where("status IN ('queued', 'running')").select("project_id").union(tasks.where("status = 'posted'").select("project_id"))
    own = active_pages(pages)
    per_page = found.groupBy("page_id").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"), F.count("*").alias("t"))
    by = own.join(per_page, "page_id", "left").groupBy("project_id").agg(F.count("*").alias("pages"), F.coalesce(F.sum("e"), F.lit(0)).alias("errors"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"), F.coalesce(F.sum("t"), F.lit(0)).alias("total"), F.max("updated_at").alias("last_checked"))
    health = F.greatest(100 - 4 * F.col("errors") - F.least("warnings", F.lit(40)), F.lit(0))
    flag = busy.select("project_id").distinct().withColumn("is_fetching", F.lit(True))
    return by.withColumn("health", health).join(flag, "project_id", "left").withColumn("is_fetching", F.coalesce("is_fetching", F.lit(False)))


KNOWN_CATEGORIES = ("title", "meta_description", "h1", "image_alt", "canonical", "security", "content", "opengraph", "twitter")


def issues_by_category(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(project_id, category, errors, total, place) with zeros for the known categories of a project that has pages."""
    counts = found.groupBy("project_id", "category").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count("*").alias("total"))
    zero = pages.select("project_id").distinct().select("project_id", F.explode(F.array(*map(F.lit, KNOWN_CATEGORIES))).alias("category"))
    both = zero.join(counts, ["project_id", "category"], "full").select("project_id", "category", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("total", F.lit(0)).alias("total"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("errors"), "category")))


def issue_board(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Issues of the active source in board order: severity falling as text (warnings first), then page and rule."""
    own = active_pages(pages).select("page_id", "url")
    return ranked(found.join(own, "page_id"), ["project_id"], [F.desc("severity"), F.desc("page_id"), F.col("category"), F.col("rule")])


def board_totals(pages: DataFrame, found: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Per project over the pages of its active source: pages, issues, errors, warnings, suggestions. suggestions(page_id)."""
    per_page = found.groupBy("page_id").agg(F.count("*").alias("i"), F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    own = active_pages(pages).join(per_page, "page_id", "left").join(suggestions.groupBy("page_id").agg(F.count("*").alias("s")), "page_id", "left")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return own.groupBy("project_id").agg(F.count("*").alias("pages"), total("i", "issues"), total("e", "errors"), total("w", "warnings"), total("s", "suggestions"))


def page_issue_paging(found: DataFrame, size: int = 10) -> DataFrame:
    """Issues other than of titles with their page of the list, by page."""
    order = Window.partitionBy("page_id").orderBy("category", "rule")
    return found.where("category <> 'title'").withColumn("_n", F.row_number().over(order)).withColumn("list_page", F.ceil(F.col("_n") / size).cast("int")).drop("_n")


def page_issue_tree(found: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(page_id, issues array<struct<..., suggestions>>): suggestions(page_id, category, rank, content) in rank order below each issue."""
    own = suggestions.groupBy("page_id", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda s: s["content"]).alias("suggestions"))
    rows = found.join(own, ["page_id", "category"], "left").withColumn("suggestions", F.coalesce("suggestions", F.array().cast("array<string>")))
    return rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("category", "rule", "severity", "message", "suggestions"))).alias("issues"))


def time_ago(at: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    part = lambda by, unit: F.concat(F.floor(s / by).cast("string"), F.lit(unit))
    return F.when(s < 60, "just now").when(s < 3_600, part(60, "m ago")).when(s < 86_400, part(3_600, "h ago")).otherwise(part(86_400, "d ago"))


def audit_refresh_eligibility(tasks: DataFrame, now_s: Column, cooldown_hours: float = 24.0) -> DataFrame:
    """tasks(project_id, status, finished_s) to allowed, reason and hours left (one decimal)."""
    by = tasks.groupBy("project_id").agg(F.bool_or(F.col("status") == "posted").alias("_busy"), F.max(F.when(F.col("status") == "fetched", F.col("finished_s"))).alias("_last"))
    hours = (now_s - F.col("_last")) / 3600.0
    wait = (F.lit(cooldown_hours) > 0) & F.coalesce(hours < cooldown_hours, F.lit(False))
    reason = F.when(F.col("_busy"), "in_flight").when(wait, "cooldown")
    return by.select("project_id", reason.isNull().alias("allowed"), reason.alias("reason"), F.when(~F.col("_busy") & wait, F.bround(F.lit(cooldown_hours) - hours, 1)).alias("hours_left"))
