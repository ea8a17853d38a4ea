"""Each rule at its bounds, and what null, blank and odd values do."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from visigraph.functions.text import word_count
from visigraph.operators import audit
from visigraph.sources import html
from visigraph.sources.html import parse

PAGE = (
    "project_id int, page_id int, url string, error string, title string, meta_description string, h1 array<string>, h2 array<string>, heading_structure array<struct<tag:string,text:string>>, "
    "image_alts array<struct<src:string,alt:string>>, domain_schema array<string>, page_schemas array<string>, canonical string, og_title string, og_description string, twitter_card string, lang string, custom_content string, source string"
)
GOOD = {
    "project_id": 1, "page_id": 1, "url": "https://a.example/", "error": None, "title": "t" * 40, "meta_description": "d" * 80, "h1": ["h" * 20], "h2": ["b"], "heading_structure": [("h1", "h"), ("h2", "b")],
    "image_alts": [("x", "words")], "domain_schema": ['{"@type":"WebSite"}'], "page_schemas": None, "canonical": "c", "og_title": "o", "og_description": "d", "twitter_card": "s", "lang": "en", "custom_content": "w " * 300, "source": "crawler",
}


def page(spark, **changes):
    return spark.createDataFrame([tuple((GOOD | changes).values())], PAGE)


def found(spark, **changes):
    return sorted(f"{r.category}/{r.rule}/{r.severity}" for r in audit.apply_rules(page(spark, **changes)).collect())


@pytest.mark.parametrize(
    ("changes", "want"),
    [
        ({}, []),
        ({"title": None}, ["title/missing/error"]),
        ({"title": " 　\t"}, ["title/missing/error"]),
        ({"title": "t" * 29}, ["title/too_short/warning"]),
        ({"title": "t" * 30}, []),
        ({"title": "  " + "t" * 60 + "\n"}, []),
        ({"title": "t" * 61}, ["title/too_long/warning"]),
        ({"meta_description": "d" * 49}, ["meta_description/too_short/warning"]),
        ({"meta_description": "d" * 50}, []),
        ({"meta_description": "d" * 160}, []),
        ({"meta_description": "d" * 161}, ["meta_description/too_long/warning"]),
        ({"meta_description": ""}, ["meta_description/missing/error"]),
        ({"h1": None}, ["h1/missing/error"]),
        ({"h1": [" ", None]}, ["h1/missing/error"]),
        ({"h1": ["h" * 9]}, ["h1/too_short/warning"]),
        ({"h1": ["h" * 10]}, []),
        ({"h1": ["h" * 70]}, []),
        ({"h1": ["h" * 71, "x"]}, ["h1/multiple/warning", "h1/too_long/warning"]),
        ({"h1": ["  ", "h" * 5]}, ["h1/too_short/warning"]),
        ({"h2": []}, ["h2/missing/warning"]),
        ({"heading_structure": [("h2", "b"), ("h1", "h")]}, ["h2/poor_structure/warning"]),
        ({"heading_structure": [("h2", "b")]}, ["h2/poor_structure/warning"]),
        ({"heading_structure": None}, []),
        ({"image_alts": [("x", None), ("y", ""), ("z", " ")]}, ["image_alt/empty/warning", "image_alt/missing/warning"]),
        ({"image_alts": None}, []),
        ({"domain_schema": None}, ["schema/missing/error"]),
        ({"page_schemas": ['{"a":1}', '{"@type":""}']}, ["schema/invalid/warning"]),
        ({"canonical": " "}, ["canonical/missing/warning"]),
        ({"og_title": ""}, ["opengraph/missing/warning"]),
        ({"twitter_card": None}, ["twitter/missing/warning"]),
        ({"lang": None}, ["lang/missing/error"]),
        ({"custom_content": "w " * 299}, ["content/thin/warning"]),
        ({"custom_content": None}, ["content/thin/warning"]),
        ({"error": "timeout", "title": None}, []),
    ],
)
def test_rules(spark, changes, want):
    assert found(spark, **changes) == want


def test_messages(spark):
    rows = audit.apply_rules(page(spark, title="abc", og_title=None, og_description="", image_alts=[("x", None)] * 2)).collect()
    assert {r.message for r in rows} == {"Title is 3 chars (recommended 30-60).", "Missing OpenGraph field(s): og_title, og_description.", "2 image(s) missing the alt attribute."}


def test_duplicates_are_per_project_and_skip_failed_pages(spark):
    rows = page(spark, page_id=1, title="Same").union(page(spark, page_id=2, title=" sAME ")).union(page(spark, page_id=3, project_id=2, title="Same")).union(page(spark, page_id=4, title="same", error="x"))
    assert sorted(r.page_id for r in audit.duplicate_titles(rows).collect()) == [1, 2]


def test_scores(spark):
    rows = page(spark, title=None).union(page(spark, page_id=2, error="x")).union(page(spark, page_id=3, title=None, meta_description=None, h1=None, lang=None, domain_schema=None, custom_content=None, h2=None, canonical=None, twitter_card=None, og_title=None))
    assert {r.page_id: r.score for r in audit.page_scores(rows, audit.run_audit(rows)).collect()} == {1: 85, 2: None, 3: 0}


def test_checks_need_an_explicit_false(spark):
    schema = "page_id int, checks map<string,boolean>, social map<string,string>"
    social = {"og:title": "x", "twitter:card": "s"}
    rows = [(1, {"no_title": True, "title_too_short": True}, social), (2, {"canonical": False, "is_https": None}, social), (3, {"canonical": True}, {"og:description": "d"}), (4, {}, {}), (5, {"no_description": True, "duplicate_meta_tags": True}, social)]
    got = {}
    for r in audit.issues_from_checks(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.page_id, set()).add(f"{r.category}/{r.rule}")
    assert got == {1: {"title/missing"}, 2: {"canonical/missing"}, 3: {"twitter/missing"}, 4: {"opengraph/missing", "twitter/missing"}, 5: {"meta_description/missing"}}


def test_security(spark):
    headers = dict.fromkeys(audit.SECURITY_HEADERS, "x")
    rows = [(1, "https://a.example/", headers, 200, None), (2, "http://b.example", {}, 404, None), (3, "https://c.example", None, None, "timeout")]
    sites = spark.createDataFrame(rows, "project_id int, base_url string, headers map<string,string>, robots_status int, error string")
    assert {r.project_id: r.score for r in audit.security_report(sites).collect()} == {1: 100, 2: 25, 3: 25}
    homes = page(spark, project_id=2, page_id=7, url="http://b.example//").union(page(spark, project_id=3, page_id=8, url="https://c.example/"))
    got = sorted((r.page_id, r.rule, r.message) for r in audit.security_issues(sites, homes).collect())
    assert got == [(7, "missing_headers", "Missing security header(s): Strict-Transport-Security, X-Content-Type-Options, X-Frame-Options, Content-Security-Policy."), (7, "no_ssl", "Site is not served over HTTPS."), (7, "robots_missing", "robots.txt returned HTTP 404."), (8, "robots_missing", "Could not fetch robots.txt: no answer"), (8, "ssl_error", "HTTPS connection failed: timeout")]


def test_display(spark):
    rows = audit.current_values(page(spark, title="x" * 81, lang=" ", image_alts=[("a", None), ("b", " "), ("c", "ok")], page_schemas=['{"@type":"B"}', '{"@type":"A"}', "{}"])).collect()
    got = {r.category: r.value for r in rows}
    assert got["title"] == "x" * 80 + "…" and got["lang"] == "-Blank-" and got["image_alt"] == "3 image(s), 2 missing alt" and got["schema"] == "A, B, WebSite" and got["opengraph"] == "OG Title: o; OG Description: d"


def test_validation(spark):
    rows = spark.createDataFrame([("title", " " + "t" * 30), ("h2", "x"), ("h2", None), ("image_alt", "x"), ("h1", "short"), ("canonical", "")], "category string, value string")
    assert [(r.applicable, r.passed) for r in audit.validate_values(rows).collect()] == [(True, True), (True, True), (True, False), (False, None), (True, False), (True, False)]


def test_time_ago(spark):
    from pyspark.sql import functions as F

    now = F.lit("2026-07-14 12:00:00").cast("timestamp")
    rows = spark.createDataFrame([(59,), (60,), (3_599,), (3_600,), (86_399,), (86_400,)], "s int")
    got = [r[0] for r in rows.select(audit.time_ago(F.timestamp_seconds(F.unix_timestamp(now) - F.col("s")), now)).collect()]
    assert got == ["just now", "1m ago", "59m ago", "1h ago", "23h ago", "1d ago"]


def test_project_provider(spark):
    pages = spark.createDataFrame([(1, "semrush"), (1, "dataforseo"), (2, "semrush"), (3, "crawler"), (4, "crawler"), (5, None)], "project_id int, source string")
    projects = spark.createDataFrame([(1, "semrush"), (2, "dataforseo"), (3, "semrush"), (4, "manual"), (5, None), (6, "dataforseo")], "project_id int, project_type string")
    assert {r.project_id: r.provider for r in audit.project_provider(pages, projects).collect()} == {1: "dataforseo", 2: "semrush", 3: "semrush", 4: "dataforseo", 5: "dataforseo", 6: "dataforseo"}


@pytest.mark.parametrize(
    "page, content, headings",
    [
        ("", None, []),
        (" <title>t</title> <meta name=x>", None, []),
        ("plain text", "plain text", []),
        ("<title>t</title><p>one<p>two", "one two", []),
        ("<html><head><title>t</title><div>in</div></head>rest", "in rest", []),
        ("before<body class=x>inside</body>after</html>end", "before inside after end", []),
        ("<body><p>a<main>b</p>c</main>d", "b c", []),
        ("<h1>One<h2>Two</h2>three", "One Two three", [("h1", "One"), ("h2", "Two")]),
        ("<ul><li><h3>a<li>b<ul><li>c</ul></ul>", "a b c", [("h3", "a")]),
        ("<table><tr><td><h4>x<td>y<tr><td>z</table>", "x y z", [("h4", "x")]),
        ("<script>var a</script><style>b{}</style><article>only</article>", "only", []),
    ],
)
def test_elements_that_a_page_leaves_out(page, content, headings):
    facts = parse(page)
    assert facts["custom_content"] == content and [(h["tag"], h["text"]) for h in facts["heading_structure"]] == headings


def test_the_audit_counts_words_once(spark):
    pages = spark.createDataFrame([(1, 1, "a b")], "project_id int, page_id long, custom_content string").withColumn("error", F.lit(None).cast("string"))
    found = audit.apply_rules(pages, [audit.content])
    assert [r.message for r in found.collect()] == ["Page has only 2 words (recommended 300+)."]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_words_by_the_white_space_between_them(spark):
    texts = ["", " ", "a", " a", "a ", " a　\x1c b\n", "\r\n", "a\n\n", "​a ﻿b", "\U0001f600 \U0001f600", "a\x85b\xa0c", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [0, 0, 1, 1, 1, 2, 0, 1, 2, 2, 3, 0]


def test_report_totals_deal_the_reports_by_project(spark):
    reports = spark.createDataFrame([(1, 3, 4, None), (1, 101, 2, None), (1, 106, 9, "down"), (2, 999, 1, None), (2, 3, None, None)], "project_id int, issue_id int, total int, error string")
    totals = audit.report_totals(reports)
    # both aggregates follow the one exchange by project
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(project_id") == 1 and plan.index("REPARTITION_BY_COL") > plan.rindex("Aggregate")
    assert sorted((r.project_id, r.total, r.critical, r.warnings, r.error) for r in totals.collect()) == [(1, 6, 4, 2, "down"), (2, 0, 0, 0, None)]


def test_report_totals_name_the_first_error_of_the_map(spark):
    reports = spark.createDataFrame([(1, 15, 1, "a"), (1, 106, 1, "b"), (1, 101, 1, ""), (1, 7, 5, None), (1, 3, 2, None), (1, 102, 1, None), (2, 6, 1, ""), (3, 7, None, None)], "project_id int, issue_id int, total int, error string")
    got = {r.project_id: (r.error, r.by_category) for r in audit.report_totals(reports).collect()}
    assert got == {1: ("b", {"content": 5, "title": 3}), 2: ("", {}), 3: (None, {"content": 0})}


def test_the_report_query_returns_counts_by_category(spark, same_as_sql):
    from visigraph.plans import registry

    name = "issues_from_report_map"
    got = same_as_sql(registry.QUERIES[name], registry.ORACLE_SQL[name], customer=spark.createDataFrame([(i,) for i in range(1, 40)], "c_custkey long"))
    # counts are the remainders of 1 + number by 7: of the titles 3, 6, 101 and 102 4 + 0 + 4 + 5
    assert {r.project_id: r.by_category for r in got.collect()}[1] == "content=1,h1=6,image_alt=6,meta_description=4,title=13"


@pytest.mark.parametrize("text, want", [("a &amp; b&amp", "a & b&amp"), ("&lt;&lt&gt", "<&lt&gt"), ("R&D;&ampx;&#39;&#39", "R&D;&ampx;''"), ("say &quot;x&quot;", 'say "x"'), ("é&eacute;", "éé")])
def test_named_references_need_their_semicolon(text, want):
    page = f"""<html lang="{text.replace('"', "")}"><title>{text}</title><h1>{text}</h1><a href="/?x=1&copy=2&amp;y&ampz">l</a><script type="application/ld+json">{{"@type": "A", "u": "?a&amp;b&copy=1"}}</script>"""
    facts = parse(page)
    assert (facts["title"], facts["h1"], facts["lang"], facts["hrefs"]) == (want, [want], want, ["/?x=1&copy=2&y&ampz"])
    assert "?a&amp;b&copy=1" in facts["page_schemas"][0]


def test_page_facts_are_held_for_some_pages_at_once(spark):
    class Pages:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    n = 2 * html.STEP + 1
    pages = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["u"] * n), pa.array([None, *(f"<title>{i}</title>" for i in range(1, n))])], names=["page_id", "url", "html"])
    out = list(html.extract_page_facts(Pages())(iter([pages])))
    assert [b.num_rows for b in out] == [html.STEP, html.STEP, 1]
    assert pa.Table.from_batches(out).select(["page_id", "title"]).to_pylist() == [{"page_id": i, "title": str(i) if i else None} for i in range(n)]
