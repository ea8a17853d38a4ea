"""Jobs over pages: rules, scores, roll-ups, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count as words_in
from ..operators import audit, suggestions, upserts
from ..sources import html, reports
from .scratch import scratch
from .sql import strip, using, words
from .views import pages as as_pages
from .views import view

JOBS: dict = {}


def job(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        JOBS[name] = (f, sql)
        return f

    return add


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return as_pages(view(spark, sf, "page_facts"))


ISSUES = "project_id, page_id, category, rule, severity, message"
_P = f""", p AS (
    SELECT *, length({strip('title')}) AS tl, length({strip('meta_description')}) AS dl, {strip('h1_1')} <> '' AS a, {strip('h1_2')} <> '' AS b, {strip('h2_1')} = '' AS no_h2,
           len({words('custom_content')}) AS words FROM page_facts WHERE error IS NULL
), h AS (SELECT *, CAST(a AS INT) + CAST(b AS INT) AS n_h1, length(CASE WHEN a THEN h1_1 WHEN b THEN h1_2 END) AS h1l FROM p)"""


def _sized(category: str, name: str, n: str, low: int, high: int, where: str = "") -> str:
    return f"SELECT project_id, page_id, '{category}' AS category, CASE WHEN {n} < {low} THEN 'too_short' ELSE 'too_long' END AS rule, 'warning' AS severity, '{name} is ' || {n} || ' chars (recommended {low}-{high}).' AS message FROM h WHERE {n} > 0 AND ({n} < {low} OR {n} > {high}) {where}"


def _plain(category: str, rule: str, severity: str, message: str, where: str) -> str:
    return f"SELECT project_id, page_id, '{category}' AS category, '{rule}' AS rule, '{severity}' AS severity, {message} AS message FROM h WHERE {where}"


_EARLY = "h2_1 IS NOT NULL AND (h2_first OR (h1_1 IS NULL AND h1_2 IS NULL))"
_OG = f"list_filter([CASE WHEN {strip('og_title')} = '' THEN 'og_title' END, CASE WHEN {strip('og_description')} = '' THEN 'og_description' END], lambda x: x IS NOT NULL)"
RULE_SQL = {
    "title": [_plain("title", "missing", "error", "'Page title is missing.'", "tl = 0"), _sized("title", "Title", "tl", 30, 60)],
    "meta_description": [_plain("meta_description", "missing", "error", "'Meta description is missing.'", "dl = 0"), _sized("meta_description", "Meta description", "dl", 50, 160)],
    "h1": [_plain("h1", "missing", "error", "'No H1 tag found.'", "n_h1 = 0"), _plain("h1", "multiple", "warning", "n_h1 || ' H1 tags found; use only one.'", "n_h1 > 1"), _sized("h1", "H1", "h1l", 10, 70)],
    "h2": [_plain("h2", "missing", "warning", "'No H2 tags found.'", "no_h2"), _plain("h2", "poor_structure", "warning", "'An H2 appears before the H1 in document order.'", f"NOT no_h2 AND {_EARLY}")],
    "image_alt": [_plain("image_alt", "missing", "warning", "n_img_null_alt || ' image(s) missing the alt attribute.'", "n_img_null_alt > 0"), _plain("image_alt", "empty", "warning", "n_img_empty_alt || ' image(s) have empty alt text.'", "n_img_empty_alt > 0")],
    "schema": [_plain("schema", "missing", "error", "'No structured data (JSON-LD) found.'", "jsonld IS NULL"), _plain("schema", "invalid", "warning", "'1 schema item(s) missing @type.'", "jsonld IS NOT NULL AND NOT contains(jsonld, '@type')")],
    "canonical": [_plain("canonical", "missing", "warning", "'Canonical link is missing.'", f"{strip('canonical')} = ''")],
    "opengraph": [_plain("opengraph", "missing", "warning", f"'Missing OpenGraph field(s): ' || array_to_string({_OG}, ', ') || '.'", f"len({_OG}) > 0")],
    "twitter": [_plain("twitter", "missing", "warning", "'Twitter card meta tag is missing.'", f"{strip('twitter_card')} = ''")],
    "lang": [_plain("lang", "missing", "error", "'HTML lang attribute is missing.'", f"{strip('lang')} = ''")],
    "content": [_plain("content", "thin", "warning", "'Page has only ' || words || ' words (recommended 300+).'", "words < 300")],
}
_DUPLICATES = f"SELECT project_id, page_id, 'title' AS category, 'duplicate' AS rule, 'warning' AS severity, 'Title is duplicated across multiple pages.' AS message FROM (SELECT *, count(*) OVER (PARTITION BY project_id, lower({strip('title')})) AS n FROM h WHERE tl > 0) WHERE n > 1"


def rules_sql(*names: str) -> str:
    return using("page_facts", _P + "\n" + "\nUNION ALL ".join(x for n in names for x in RULE_SQL[n]))


_ALL = "\nUNION ALL ".join([x for some in RULE_SQL.values() for x in some] + [_DUPLICATES])
_FOUND = f"{_P}, found AS ({_ALL})"


def _rule_job(name: str, *rules: str) -> None:
    JOBS[name] = (lambda s, d: audit.apply_rules(facts(s, d), [audit.RULES[r] for r in rules]), rules_sql(*rules))


for _n in ("title", "meta_description", "h1", "h2", "image_alt", "schema"):
    _rule_job(f"audit_{_n}", _n)
_rule_job("audit_social_canonical_lang", "canonical", "opengraph", "twitter", "lang")
_rule_job("audit_content_thin", "content")


@job("word_count", using("page_facts", f"SELECT page_id, CAST(len({words('custom_content')}) AS BIGINT) AS words FROM page_facts"))
def word_count(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "page_facts").select("page_id", words_in(F.col("custom_content")).cast("long").alias("words"))


@job("page_content_excerpt", using("page_facts", "SELECT page_id, substr(custom_content, 1, 400) AS shown, substr(custom_content, 1, 3000) AS prompt, substr(custom_content, 1, 12000) AS context FROM page_facts"))
def page_content_excerpt(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "page_facts")
    return p.select("page_id", *(audit.excerpt(audit.fields(p), n).alias(c) for c, n in (("shown", 400), ("prompt", 3_000), ("context", 12_000))))


@job("duplicate_titles", using("page_facts", _P + _DUPLICATES))
def duplicate_titles(s: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_titles(facts(s, d))


@job("run_audit", using("page_facts", f"{_FOUND} SELECT * FROM found"))
def run_audit(s: SparkSession, d: str) -> DataFrame:
    return audit.run_audit(facts(s, d))


_SCORE = f"{_FOUND}, scores AS (SELECT f.project_id, f.page_id, CASE WHEN f.error IS NULL THEN CAST(greatest(0, 100 - coalesce((SELECT sum(CASE severity WHEN 'error' THEN 15 ELSE 5 END) FROM found WHERE found.page_id = f.page_id), 0)) AS INT) END AS score FROM page_facts f)"


@job("page_score", using("page_facts", f"{_SCORE} SELECT * FROM scores"))
def page_score(s: SparkSession, d: str) -> DataFrame:
    p = facts(s, d)
    return audit.page_scores(p, audit.run_audit(p))


@job("page_score_by_project", using("page_facts", f"{_SCORE} SELECT project_id, count(*) AS pages, count(score) AS audited, CAST(sum(score) AS BIGINT) AS points, min(score) AS worst FROM scores GROUP BY project_id"))
def page_score_by_project(s: SparkSession, d: str) -> DataFrame:
    return page_score(s, d).groupBy("project_id").agg(F.count("*").alias("pages"), F.count("score").alias("audited"), F.sum("score").alias("points"), F.min("score").alias("worst"))


@job("title_checklist", using("page_facts", f""", t AS (SELECT page_id, length({strip('title')}) AS n FROM page_facts){_P}, dup AS ({_DUPLICATES})
SELECT page_id, n > 0 AS present, n = 0 OR n BETWEEN 30 AND 60 AS length_ok, page_id NOT IN (SELECT page_id FROM dup) AS not_duplicated FROM t"""))
def title_checklist(s: SparkSession, d: str) -> DataFrame:
    p = facts(s, d)
    return audit.title_checklist(p, audit.duplicate_titles(p))


# The provider's checks, made of the page facts: a map of flags and of social tags.
_FLAGS = {"no_title": 13, "title_too_short": 5, "title_too_long": 7, "duplicate_title_tag": 11, "no_description": 6, "duplicate_meta_tags": 4, "no_h1_tag": 9, "no_image_alt": 3, "low_content_rate": 8, "irrelevant_title": 17, "irrelevant_description": 19}
_ON = {k: f"page_id % {m} = 0" for k, m in _FLAGS.items()}
_CHECK_SQL = [
    ("title", "missing", "error", "Page title is missing.", _ON["no_title"]),
    ("title", "too_short", "warning", "Title tag is shorter than recommended.", f"NOT {_ON['no_title']} AND {_ON['title_too_short']}"),
    ("title", "too_long", "warning", "Title tag is longer than recommended.", f"NOT {_ON['no_title']} AND {_ON['title_too_long']}"),
    ("title", "duplicate", "warning", "Title tag is duplicated on another crawled page.", f"NOT {_ON['no_title']} AND {_ON['duplicate_title_tag']}"),
    ("meta_description", "missing", "error", "Meta description is missing.", _ON["no_description"]),
    ("meta_description", "duplicate", "warning", "Meta tags are duplicated on another crawled page.", f"NOT {_ON['no_description']} AND {_ON['duplicate_meta_tags']}"),
    ("h1", "missing", "error", "No H1 tag found.", _ON["no_h1_tag"]),
    ("image_alt", "missing", "warning", "One or more images are missing alt text.", _ON["no_image_alt"]),
    ("canonical", "missing", "warning", "Canonical link is missing.", "page_id % 3 = 1"),
    ("security", "no_ssl", "error", "Page is not served over HTTPS.", "page_id % 4 = 1"),
    ("content", "thin", "warning", "Page has a low ratio of text content to page size.", _ON["low_content_rate"]),
    ("title", "irrelevant", "warning", "Title does not appear relevant to the page content.", _ON["irrelevant_title"]),
    ("meta_description", "irrelevant", "warning", "Meta description does not appear relevant to the page content.", _ON["irrelevant_description"]),
    ("opengraph", "missing", "warning", "OpenGraph title/description tags are missing.", "og_title IS NULL AND coalesce(og_description, '') = ''"),
    ("twitter", "missing", "warning", "Twitter card meta tag is missing.", "twitter_card IS NULL"),
]


def checked_items(s: SparkSession, d: str) -> DataFrame:
    flag = lambda m: F.col("page_id") % m == 0
    # canonical and is_https are true, false or absent by turns
    three = lambda m: F.when(F.col("page_id") % m == 0, True).when(F.col("page_id") % m == 1, False)
    checks = F.map_from_arrays(F.array(*map(F.lit, [*_FLAGS, "canonical", "is_https"])), F.array(*map(flag, _FLAGS.values()), three(3), three(4)))
    social = F.create_map(F.lit("og:title"), "og_title", F.lit("og:description"), "og_description", F.lit("twitter:card"), "twitter_card")
    return view(s, d, "page_facts").select("page_id", "url", "title", checks.alias("checks"), social.alias("social"))


@job("issues_from_checks", using("page_facts", "\nUNION ALL ".join(f"SELECT page_id, '{c}' AS category, '{r}' AS rule, '{v}' AS severity, '{m}' AS message FROM page_facts WHERE {w}" for c, r, v, m, w in _CHECK_SQL)))
def issues_from_checks(s: SparkSession, d: str) -> DataFrame:
    return audit.issues_from_checks(checked_items(s, d))


@job("read_onpage_json", using("page_facts", "SELECT page_id AS id, url, title, CAST(page_id % 13 = 0 AS VARCHAR) AS no_title, CASE page_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS canonical_check, CASE WHEN title IS NULL THEN 0 ELSE 1 END AS n_h1, og_title, twitter_card FROM page_facts"))
def read_onpage_json(s: SparkSession, d: str) -> DataFrame:
    item = F.struct("url", "checks", F.col("social").alias("social_media_tags"), F.struct("title", F.struct(F.array_compact(F.array("title")).alias("h1")).alias("htags")).alias("meta"))
    rows = reports.read_onpage_json(checked_items(s, d).select(F.col("page_id").alias("id"), F.to_json(item, {"ignoreNullFields": "false"}).alias("json")))
    flag = lambda k: F.try_element_at("checks", F.lit(k)).cast("string")
    return rows.select("id", "url", "title", flag("no_title").alias("no_title"), flag("canonical").alias("canonical_check"), F.size("h1").alias("n_h1"), "og_title", "twitter_card")


_DIM = ", ".join(f"({i}, '{c}', '{v}', '{m}')" for i, c, v, m in audit.REPORT_ISSUES)
_NUMBERS = [i for i, *_ in audit.REPORT_ISSUES] + [999]
_REPORT = f"SELECT c_custkey AS project_id, unnest({_NUMBERS}) AS issue_id FROM customer"


def issue_reports(s: SparkSession, d: str) -> DataFrame:
    """Report answers by project and issue number, made of customers: a failed fetch now and then, and a number that no map knows."""
    rows = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("project_id"), F.explode(F.array(*map(F.lit, _NUMBERS))).alias("issue_id"))
    x = F.col("project_id") + F.col("issue_id")
    url = lambda p: F.concat(F.lit(p), F.col("project_id").cast("string"))
    page = F.struct(F.when(x % 2 == 0, url("s/")).alias("source_url"), F.when(x % 3 != 0, url("t/")).alias("target_url"))
    return rows.withColumns({"total": x % 7, "error": F.when(x % 11 == 0, "units exhausted"), "pages": F.array_repeat(page, (x % 2 + 1).cast("int"))})


@job("issues_from_report_map", f"""WITH r AS (SELECT *, (project_id + issue_id) % 7 AS total, (project_id + issue_id) % 11 = 0 AS failed FROM ({_REPORT})), dim(issue_id, category, severity, name) AS (VALUES {_DIM}), c AS (SELECT project_id, category, sum(total) AS n FROM r JOIN dim USING (issue_id) WHERE NOT failed GROUP BY ALL), b AS (SELECT project_id, string_agg(category || '=' || n, ',' ORDER BY category) AS by_category FROM c GROUP BY project_id)
SELECT project_id, CAST(sum(CASE WHEN failed THEN 0 ELSE total END) AS BIGINT) AS total, CAST(sum(CASE WHEN failed OR severity <> 'error' THEN 0 ELSE total END) AS BIGINT) AS critical, CAST(sum(CASE WHEN failed OR severity = 'error' THEN 0 ELSE total END) AS BIGINT) AS warnings,
       max(CASE WHEN failed THEN 'units exhausted' END) AS error, coalesce(any_value(by_category), '') AS by_category FROM r JOIN dim USING (issue_id) LEFT JOIN b USING (project_id) GROUP BY project_id""")
def issues_from_report_map(s: SparkSession, d: str) -> DataFrame:
    shown = F.transform(F.map_entries("by_category"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return audit.report_totals(issue_reports(s, d)).withColumn("by_category", F.array_join(shown, ","))


@job("issue_report_rows", f"""WITH r AS (SELECT *, project_id + issue_id AS x FROM ({_REPORT})), dim(issue_id, category, severity, name) AS (VALUES {_DIM})
SELECT project_id, category, severity, name AS message, CASE WHEN x % 2 = 0 THEN 's/' || project_id WHEN x % 3 <> 0 THEN 't/' || project_id ELSE '' END AS url FROM (SELECT *, unnest(range(x % 2 + 1)) FROM r JOIN dim USING (issue_id) WHERE x % 11 <> 0)""")
def issue_report_rows(s: SparkSession, d: str) -> DataFrame:
    return audit.report_rows(issue_reports(s, d))


def responses(s: SparkSession, d: str) -> DataFrame:
    has = {"strict-transport-security": "has_hsts", "x-content-type-options": "has_nosniff", "x-frame-options": "has_frame", "content-security-policy": "has_csp"}
    headers = F.map_from_entries(F.array_compact(F.array(*(F.when(F.col(c), F.struct(F.lit(k), F.lit("x"))) for k, c in has.items()))))
    return view(s, d, "responses").withColumn("error", F.when(~F.col("reachable"), "timeout")).withColumn("headers", F.when(F.col("reachable"), headers))


_EVERY = "reachable AND has_hsts AND has_nosniff AND has_frame AND has_csp"


@job("security_report", using("responses", f"SELECT project_id, base_url LIKE 'https://%' AS https, reachable, {_EVERY} AS all_headers, coalesce(robots_status = 200, false) AS robots, 25 * (CAST(base_url LIKE 'https://%' AS INT) + CAST(reachable AS INT) + CAST({_EVERY} AS INT) + CAST(coalesce(robots_status = 200, false) AS INT)) AS score FROM responses"))
def security_report(s: SparkSession, d: str) -> DataFrame:
    return audit.security_report(responses(s, d))


_MISSING = "list_filter([CASE WHEN NOT has_hsts THEN 'Strict-Transport-Security' END, CASE WHEN NOT has_nosniff THEN 'X-Content-Type-Options' END, CASE WHEN NOT has_frame THEN 'X-Frame-Options' END, CASE WHEN NOT has_csp THEN 'Content-Security-Policy' END], lambda x: x IS NOT NULL)"


@job("security_issues", using("responses", f""", s AS (SELECT * FROM responses WHERE project_id % 4 <> 0), f AS (
    SELECT project_id, 'no_ssl' AS rule, 'error' AS severity, 'Site is not served over HTTPS.' AS message FROM s WHERE base_url LIKE 'http://%'
    UNION ALL SELECT project_id, 'ssl_error', 'error', 'HTTPS connection failed: timeout' FROM s WHERE base_url LIKE 'https://%' AND NOT reachable
    UNION ALL SELECT project_id, 'missing_headers', 'warning', 'Missing security header(s): ' || array_to_string({_MISSING}, ', ') || '.' FROM s WHERE reachable AND len({_MISSING}) > 0
    UNION ALL SELECT project_id, 'robots_missing', 'warning', CASE WHEN robots_status IS NULL THEN 'Could not fetch robots.txt: no answer' ELSE 'robots.txt returned HTTP ' || robots_status || '.' END FROM s WHERE coalesce(robots_status, 0) <> 200
) SELECT project_id, project_id * 10 AS page_id, 'security' AS category, rule, severity, message FROM f"""))
def security_issues(s: SparkSession, d: str) -> DataFrame:
    r = responses(s, d)
    home = r.where("project_id % 4 <> 0").select("project_id", (F.col("project_id") * 10).alias("page_id"), F.regexp_replace("base_url", "/$", "").alias("url"), F.lit(None).cast("string").alias("error"))
    return audit.security_issues(r, home)


_CANDIDATE = "SELECT page_id, list_element(['title', 'meta_description', 'h1', 'h2', 'canonical', 'lang', 'schema'], CAST(page_id % 7 + 1 AS INT)) AS category, title AS value FROM page_facts"


@job("validate_candidate_value", using("page_facts", f""", c AS ({_CANDIDATE}), v AS (SELECT *, length({strip('value')}) AS n FROM c)
SELECT page_id, category, category <> 'schema' AS applicable, CASE category WHEN 'schema' THEN NULL WHEN 'title' THEN n BETWEEN 30 AND 60 WHEN 'meta_description' THEN n BETWEEN 50 AND 160 WHEN 'h1' THEN n BETWEEN 10 AND 70 ELSE n > 0 END AS passed FROM v"""))
def validate_candidate_value(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("title", "meta_description", "h1", "h2", "canonical", "lang", "schema")))
    rows = view(s, d, "page_facts").select("page_id", F.get(names, (F.col("page_id") % 7).cast("int")).alias("category"), F.col("title").alias("value"))
    return audit.validate_values(rows).select("page_id", "category", "applicable", "passed")


def _shown(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN '-Blank-' WHEN length({x}) > 80 THEN substr({x}, 1, 80) || '…' ELSE {x} END"


_VALUES = {
    "title": strip("title"), "meta_description": strip("meta_description"), "h1": "array_to_string(list_filter([h1_1, h1_2], lambda x: coalesce(x, '') <> ''), ', ')", "h2": "coalesce(h2_1, '')", "canonical": strip("canonical"),
    "opengraph": "concat_ws('; ', CASE WHEN coalesce(og_title, '') <> '' THEN 'OG Title: ' || og_title END, CASE WHEN coalesce(og_description, '') <> '' THEN 'OG Description: ' || og_description END)",
    "twitter": "CASE WHEN coalesce(twitter_card, '') <> '' THEN 'Twitter Card: ' || twitter_card ELSE '' END", "lang": strip("lang"),
    "image_alt": "CASE WHEN n_img_null_alt + n_img_empty_alt > 0 THEN (n_img_null_alt + n_img_empty_alt) || ' image(s), ' || (n_img_null_alt + n_img_empty_alt) || ' missing alt' ELSE '' END",
    "schema": "CASE WHEN contains(coalesce(jsonld, ''), 'Article') THEN 'Article' ELSE '' END", "content": strip("substr(custom_content, 1, 400)"),
}


@job("current_value_display", using("page_facts", "\nUNION ALL ".join(f"SELECT page_id, '{k}' AS category, {_shown('v')} AS value FROM (SELECT page_id, {v} AS v FROM page_facts)" for k, v in _VALUES.items())))
def current_value_display(s: SparkSession, d: str) -> DataFrame:
    return audit.current_values(facts(s, d))


_ACTIVE = ", active AS (SELECT project_id, coalesce(max(CASE WHEN source = 'dataforseo' THEN source END), max(CASE WHEN source = 'semrush' THEN source END), max(CASE WHEN source = 'crawler' THEN source END), 'manual') AS active_source FROM page_facts GROUP BY project_id), own AS (SELECT f.* FROM page_facts f JOIN active a ON f.project_id = a.project_id AND f.source = a.active_source)"


@job("project_provider", using("page_facts", """, n AS (SELECT project_id, count(*) FILTER (source = 'dataforseo' AND project_id % 3 = 0) AS d, count(*) FILTER (source = 'semrush' AND project_id % 3 < 2) AS s FROM page_facts GROUP BY project_id)
SELECT project_id, CASE WHEN d > 0 THEN 'dataforseo' WHEN s > 0 THEN 'semrush' WHEN project_id % 4 < 2 THEN 'semrush' ELSE 'dataforseo' END AS provider FROM n"""))
def project_provider(s: SparkSession, d: str) -> DataFrame:
    """Pages of either provider are taken from two thirds of the projects each; types are a provider for three projects of four."""
    p = view(s, d, "page_facts").select("project_id", "source")
    rest = F.col("project_id") % 3
    kept = p.where((F.col("source") == "crawler") | ((F.col("source") == "dataforseo") & (rest == 0)) | ((F.col("source") == "semrush") & (rest < 2)))
    kind = F.when(F.col("project_id") % 4 < 2, "semrush").when(F.col("project_id") % 4 == 2, "dataforseo").otherwise("manual")
    return audit.project_provider(kept, p.select("project_id").distinct().withColumn("project_type", kind))


@job("active_source", using("page_facts", f"{_ACTIVE} SELECT * FROM active"))
def active_source(s: SparkSession, d: str) -> DataFrame:
    return audit.active_source(view(s, d, "page_facts"))


@job("project_cards", using("page_facts jobs onpage_tasks", f"""{_FOUND}{_ACTIVE}, c AS (SELECT own.project_id, count(DISTINCT own.page_id) AS pages, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(severity) AS total FROM own LEFT JOIN found ON found.page_id = own.page_id GROUP BY own.project_id)
SELECT c.*, (SELECT max(page_id * 7919 % 86400) FROM own WHERE own.project_id = c.project_id) AS last_checked, greatest(0, 100 - 4 * errors - least(warnings, 40)) AS health,
       project_id IN (SELECT project_id FROM jobs WHERE status IN ('queued', 'running')) OR project_id IN (SELECT project_id FROM onpage_tasks WHERE status = 'posted') AS is_fetching FROM c"""))
def project_cards(s: SparkSession, d: str) -> DataFrame:
    p = facts(s, d)
    return audit.project_cards(p.withColumn("updated_at", F.col("page_id") * 7919 % 86400), audit.run_audit(p), view(s, d, "jobs"), view(s, d, "onpage_tasks"))


_KNOWN = ", ".join(f"('{c}')" for c in audit.KNOWN_CATEGORIES)


@job("issues_by_category", using("page_facts", f"""{_FOUND}, zero AS (SELECT project_id, category FROM (SELECT DISTINCT project_id FROM page_facts), (VALUES {_KNOWN}) k(category)), n AS (SELECT project_id, category, count(*) FILTER (severity = 'error') AS errors, count(*) AS total FROM found GROUP BY project_id, category),
b AS (SELECT project_id, category, coalesce(errors, 0) AS errors, coalesce(total, 0) AS total FROM zero FULL JOIN n USING (project_id, category)) SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY errors DESC, category) AS INT) AS place FROM b"""))
def issues_by_category(s: SparkSession, d: str) -> DataFrame:
    p = facts(s, d)
    return audit.issues_by_category(p, audit.run_audit(p))


@job("issue_board", using("page_facts", f"""{_FOUND}{_ACTIVE}
SELECT found.project_id, found.page_id, category, rule, severity, message, url, CAST(row_number() OVER (PARTITION BY found.project_id ORDER BY severity DESC, found.page_id DESC, category, rule) AS INT) AS place FROM found JOIN own ON found.page_id = own.page_id"""))
def issue_board(s: SparkSession, d: str) -> DataFrame:
    scratch(s, "ranks")
    p = facts(s, d)
    return audit.issue_board(p, audit.run_audit(p))


@job("page_issue_paging", using("page_facts", f"{_FOUND} SELECT {ISSUES}, CAST(ceil(row_number() OVER (PARTITION BY page_id ORDER BY category, rule) / 10.0) AS INT) AS list_page FROM found WHERE category <> 'title'"))
def page_issue_paging(s: SparkSession, d: str) -> DataFrame:
    return audit.page_issue_paging(audit.run_audit(facts(s, d)))


@job("page_issue_tree", using("page_facts", f"""{_FOUND} SELECT page_id, CAST(count(*) AS INT) AS n_issues, CAST(sum(CASE WHEN category = 'title' THEN 2 ELSE 0 END) AS BIGINT) AS n_suggestions, string_agg(category || '/' || rule, ',' ORDER BY category, rule) AS rules FROM found GROUP BY page_id"""))
def page_issue_tree(s: SparkSession, d: str) -> DataFrame:
    p = facts(s, d)
    found = audit.run_audit(p)
    proposals = p.select("page_id", F.lit("title").alias("category"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("rank"), F.coalesce("h1_1", F.lit("")).alias("content"))
    tree = audit.page_issue_tree(found, proposals)
    sizes = F.aggregate("issues", F.lit(0).cast("long"), lambda a, i: a + F.size(i["suggestions"]))
    return tree.select("page_id", F.size("issues").alias("n_issues"), sizes.alias("n_suggestions"), F.array_join(F.transform("issues", lambda i: F.concat(i["category"], F.lit("/"), i["rule"])), ",").alias("rules"))


@job("audit_refresh_eligibility", using("onpage_tasks", """, t AS (SELECT project_id, bool_or(status = 'posted') AS busy, max(CASE WHEN status = 'fetched' THEN finished_s END) AS last FROM onpage_tasks GROUP BY project_id), h AS (SELECT *, (1600122400 - last) / CAST(3600 AS DOUBLE) AS hours FROM t)
SELECT project_id, NOT busy AND coalesce(hours >= 24, true) AS allowed, CASE WHEN busy THEN 'in_flight' WHEN hours < 24 THEN 'cooldown' END AS reason, CASE WHEN NOT busy AND hours < 24 THEN round_even(24 - hours, 1) END AS hours_left FROM h"""))
def audit_refresh_eligibility(s: SparkSession, d: str) -> DataFrame:
    return audit.audit_refresh_eligibility(view(s, d, "onpage_tasks"), F.lit(1_600_122_400))


_NOW = "(SELECT max(ts) FROM events)"


@job("time_ago_label", f"SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS label FROM (SELECT event_id, CAST(floor(epoch({_NOW})) - floor(epoch(ts)) AS BIGINT) AS s FROM events)")
def time_ago_label(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "ts")
    now = e.agg(F.max("ts").cast("string")).first()[0]
    return e.select("event_id", audit.time_ago(F.col("ts"), F.lit(now).cast("timestamp")).alias("label"))


# Extraction from HTML; the twin of the parser is a regular expression, which these pages allow.
_CLEAN = r"replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


def _tag(name: str) -> str:
    return strip(_CLEAN.format(f"regexp_extract(html, '(?s)<{name}[^>]*>(.*?)</{name}>', 1)"))


def html_facts(s: SparkSession, d: str) -> DataFrame:
    return html.extract_page_facts(s.read.parquet(f"{d}/pages.parquet"))


@job("extract_page_facts", f"""SELECT page_id, {_tag('title')} AS title, {_tag('h1')} AS h1, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang, CAST(len(regexp_extract_all(html, '<a [^>]*href=')) AS INT) AS n_hrefs FROM pages""")
def extract_page_facts(s: SparkSession, d: str) -> DataFrame:
    return html_facts(s, d).select("page_id", "title", F.get("h1", F.lit(0)).alias("h1"), "lang", F.size("hrefs").alias("n_hrefs"))


@job("extract_jsonld", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'domain' ELSE 'page' END AS level, CASE WHEN page_id % 2 = 0 THEN 'WebSite' ELSE 'Article' END AS type FROM pages")
def extract_jsonld(s: SparkSession, d: str) -> DataFrame:
    """The pages hold no JSON-LD, so a script with an item of each page, and one that is no JSON, goes before their body."""
    kind = F.when(F.col("page_id") % 2 == 0, "WebSite").otherwise("Article")
    script = F.concat(F.lit('<script type="application/ld+json">[{"@type":"'), kind, F.lit('","n":1}, 5]</script><script type="application/ld+json">{broken</script>'))
    pages = s.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.concat(script, F.coalesce("html", F.lit(""))).alias("html"))
    return html.jsonld_items(html.extract_page_facts(pages)).select("page_id", "level", "type")


#: A page's links in forms by turns: as they are, up from the page's folder, relative to it, by host, with dots, and four that lead to no page of the site.
_FORMS = """CASE (page_id + n) % 9 WHEN 0 THEN href WHEN 1 THEN '..' || href WHEN 2 THEN substr(href, 2) || '?q=/x' WHEN 3 THEN ' //' || host || href || '/#top'
 WHEN 4 THEN scheme || '://' || host || '/a/./b/../..' || href WHEN 5 THEN 'https://other.example' || href WHEN 6 THEN href || '.PDF?x' WHEN 7 THEN 'mailto:' || substr(href, 2) ELSE '#' || href END"""


@job("discover_links", """WITH a AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS hrefs FROM pages),
h AS (SELECT * EXCLUDE (hrefs), unnest(hrefs) AS href, unnest(range(len(hrefs))) AS n FROM a),
f AS (SELECT *, (page_id + n) % 9 AS form, regexp_replace(path, '[^/]*$', '') AS folder FROM h WHERE href LIKE '/%'),
t AS (SELECT page_id, url, scheme || '://' || host || regexp_replace(CASE form WHEN 1 THEN regexp_replace(folder, '[^/]*/$', '') || substr(href, 2) WHEN 2 THEN folder || substr(href, 2) ELSE href END, '/+$', '') AS link FROM f WHERE form < 5)
SELECT DISTINCT * FROM t""")
def discover_links(s: SparkSession, d: str) -> DataFrame:
    facts = html_facts(s, d).select("page_id", "url", F.posexplode("hrefs").alias("n", "href")).where("href LIKE '/%'")
    parts = facts.withColumns({"scheme": F.regexp_extract("url", "^([a-z]+):", 1), "host": F.regexp_extract("url", "://([^/?#]*)", 1)})
    return html.discover_links(parts.select("page_id", "url", F.array(F.expr(_FORMS)).alias("hrefs")))


# Upserts of pages.


@job("upsert_pages", using("page_facts", """, r AS (SELECT *, 'https://x/' || (page_id % 300) AS u FROM page_facts), l AS (SELECT *, row_number() OVER (PARTITION BY project_id, u ORDER BY page_id DESC) AS rn FROM r)
SELECT project_id, u AS url, title, error FROM l WHERE rn = 1"""))
def upsert_pages(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "page_facts").withColumn("url", F.concat(F.lit("https://x/"), (F.col("page_id") % 300).cast("string"))).select("project_id", "url", "title", "error", F.col("page_id").alias("seq"))
    stored = upserts.upsert_pages(rows.limit(0).drop("seq"), rows.where("seq % 2 = 0"))
    return upserts.upsert_pages(stored.where("url IS NOT NULL"), rows)


@job("crawl_counts", using("page_facts", "SELECT project_id, count(*) FILTER (error IS NULL) AS ok, count(error) AS errors FROM page_facts GROUP BY project_id"))
def crawl_counts(s: SparkSession, d: str) -> DataFrame:
    return upserts.crawl_counts(view(s, d, "page_facts"))


@job("upsert_onpage_pages", using("page_facts", "SELECT project_id, url, source, CASE WHEN page_id % 2 = 0 THEN 'new ' || coalesce(title, '') ELSE title END AS title, custom_content FROM page_facts"))
def upsert_onpage_pages(s: SparkSession, d: str) -> DataFrame:
    stored = view(s, d, "page_facts").select("project_id", "url", "source", "title", "custom_content", "page_id")
    fresh = stored.where("page_id % 2 = 0").select("project_id", "url", "source", F.concat(F.lit("new "), F.coalesce("title", F.lit(""))).alias("title"), F.col("page_id").alias("seq"))
    return upserts.upsert_onpage(stored.drop("page_id"), fresh)


_AUDITED = ", audited AS (SELECT * FROM page_facts WHERE project_id % 2 = 0), fresh AS (SELECT * FROM found WHERE project_id % 4 = 0)"


def reaudited(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(issues, fresh ones, audited pages): projects of even number are audited again, and those that 4 doesn't divide turn out clean."""
    p = facts(s, d)
    found = audit.run_audit(p)
    return found, found.where("project_id % 4 = 0"), p.where("project_id % 2 = 0")


@job("replace_project_issues", using("page_facts", f"{_FOUND}{_AUDITED} SELECT {ISSUES} FROM found WHERE category = 'title' AND project_id NOT IN (SELECT project_id FROM audited WHERE project_id IS NOT NULL) UNION ALL SELECT {ISSUES} FROM fresh"))
def replace_project_issues(s: SparkSession, d: str) -> DataFrame:
    found, fresh, audited = reaudited(s, d)
    return upserts.replace_issues(found.where("category = 'title'"), fresh, audited)


@job("audit_summary", using("page_facts", f"{_FOUND}{_AUDITED} SELECT project_id, count(*) AS pages_audited, coalesce((SELECT count(*) FROM fresh WHERE fresh.project_id = audited.project_id), 0) AS issues_found FROM audited GROUP BY project_id"))
def audit_summary(s: SparkSession, d: str) -> DataFrame:
    _, fresh, audited = reaudited(s, d)
    return upserts.audit_summary(audited, fresh)


@job("replace_page_issues", using("page_facts", f"{_FOUND} SELECT {ISSUES} FROM found WHERE page_id % 2 = 1 OR category = 'title'"))
def replace_page_issues(s: SparkSession, d: str) -> DataFrame:
    """An on-page upsert replaces the issues of its own pages only."""
    p = facts(s, d)
    found = audit.run_audit(p)
    return upserts.replace_issues(found, found.where("page_id % 2 = 0 AND category = 'title'"), p.where("page_id % 2 = 0"), ("page_id",))


@job("crawl_snapshots", using("page_facts", "SELECT project_id, 'https://x/' || (page_id % 300) AS url, page_id AS seq, title, error FROM page_facts"))
def crawl_snapshots(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "page_facts").withColumn("url", F.concat(F.lit("https://x/"), (F.col("page_id") % 300).cast("string"))).select("project_id", "url", "title", "error", F.col("page_id").alias("seq"))
    return upserts.crawl_snapshots(rows).select("project_id", "url", "seq", "data.title", "data.error")


@job("issue_board_totals", using("page_facts", f"{_FOUND}{_ACTIVE}, i AS (SELECT own.project_id, severity FROM found JOIN own ON found.page_id = own.page_id) SELECT project_id, count(*) AS pages, (SELECT count(*) FROM i WHERE i.project_id = own.project_id) AS issues, (SELECT count(*) FROM i WHERE i.project_id = own.project_id AND severity = 'error') AS errors, (SELECT count(*) FROM i WHERE i.project_id = own.project_id AND severity = 'warning') AS warnings, (SELECT count(*) FROM own o WHERE o.project_id = own.project_id AND o.page_id % 3 = 0) AS suggestions FROM own GROUP BY project_id"))
def issue_board_totals(s: SparkSession, d: str) -> DataFrame:
    p = facts(s, d)
    return audit.board_totals(p, audit.run_audit(p), p.where("page_id % 3 = 0").select("page_id"))


@job("suggestion_context", using("page_facts", f"""{_FOUND}, i AS (SELECT project_id, page_id, category, message FROM found WHERE category = 'title')
SELECT i.page_id, f.url, i.category, i.message, {_shown(strip('f.title'))} AS current_value, CASE WHEN i.page_id % 2 = 0 THEN 'Lyon' END AS location FROM i JOIN page_facts f USING (page_id)"""))
def suggestion_context(s: SparkSession, d: str) -> DataFrame:
    p = facts(s, d)
    found = audit.run_audit(p).where("category = 'title'").join(p.select("page_id", "url"), "page_id")
    local = F.when(F.col("page_id") % 2 == 0, "local").otherwise("global")
    u = F.struct(F.col("h1_1").alias("main_topic"), F.lit("informational").alias("search_intent"), F.col("h2_1").alias("primary_keyword"), F.lit("s").alias("relevant_service"), F.lit("Lyon").alias("relevant_location"), F.lit("a").alias("relevant_audience"), local.alias("geo_relevance"))
    profiles = p.select("project_id").distinct().select("project_id", F.lit("Brand").alias("brand"), F.lit("plain").alias("tone"))
    rows = suggestions.suggestion_context(found, audit.current_values(p), p.select("page_id", u.alias("u")), profiles)
    return rows.select("page_id", "url", "category", "message", "current_value", F.col("profile.relevant_location").alias("location"))


@job("understanding_worklist", using("page_facts", "SELECT page_id, page_id * 10 + 1 AS snapshot_id FROM page_facts WHERE page_id % 3 <> 0 AND page_id % 4 <> 0"))
def understanding_worklist(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "page_facts")
    crawls = p.where("page_id % 3 <> 0").select("page_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).select((F.col("page_id") * 10 + F.col("n")).alias("id"), "page_id", F.col("n").alias("crawled_at"))
    cached = p.select("page_id", (F.col("page_id") * 10 + F.when(F.col("page_id") % 4 == 0, 1).otherwise(0)).alias("snapshot_id"))
    return suggestions.understanding_worklist(p, crawls, cached)
