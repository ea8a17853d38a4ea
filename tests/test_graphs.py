import random
from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows_of
from visigraph.functions import frames, graph
from visigraph.functions.text import casefold, content_hash, normalize_content, normalize_domain, split_list
from visigraph.operators import backlinks, clusters, competitors, links, suggestions, upserts
from visigraph.plans import graphs
from visigraph.plans.scratch import scratch
from visigraph.plans.views import view
from visigraph.sources import html, reports
from visigraph.streaming import pages as stream
from visigraph.streaming.pages import stream_upsert_pages

RECORD = "project_id int, source_url string, target_url string, anchor string, is_follow boolean, domain_rank int, spam_score int, first_seen int, last_seen int, lost_at int"
PULL = "project_id int, source_url string, target_url string, seq int, anchor string, nofollow string, domain_rank int, spam_score int"


def test_backlink_diff(spark):
    stored = [(1, "a", "t", "old", True, 5, 1, 1, 1, None), (1, "b", "t", "x", True, 5, 1, 1, 1, None), (1, "c", "t", "x", True, 5, 1, 1, 1, 2), (2, "d", "t", "x", True, 5, 1, 1, 1, None), (1, "e", "t", "x", True, 5, 1, 1, 1, 2)]
    pull = [(1, "a", "t", 1, "new", "true", None, 9, ), (1, "c", "t", 2, "y", None, 7, None), (1, "n", "t", 3, "q", "false", 1, 1), (1, "n", "t", 4, "z", "TRUE", 2, 2), (1, "", "t", 5, "q", None, 1, 1), (1, None, "t", 6, "q", None, 1, 1)]
    got = {r.source_url: r for r in backlinks.backlink_diff(spark.createDataFrame(stored, RECORD), spark.createDataFrame(pull, PULL), spark.createDataFrame([(1,)], "project_id int"), F.lit(9)).collect()}
    assert {k: r.change for k, r in got.items()} == {"a": "active", "b": "lost", "c": "active", "d": "gone", "e": "gone", "n": "new"}
    assert (got["a"].anchor, got["a"].domain_rank, got["a"].spam_score, got["a"].last_seen) == ("old", 5, 9, 9)
    assert (got["b"].lost_at, got["b"].last_seen, got["c"].lost_at, got["d"].lost_at, got["e"].lost_at) == (9, 1, None, None, 2)
    assert (got["n"].anchor, got["n"].is_follow, got["n"].domain_rank, got["n"].first_seen) == ("z", False, 2, 9)


def test_an_empty_pull_loses_all_links(spark):
    stored = spark.createDataFrame([(1, "a", "t", "x", True, 5, 1, 1, 1, None), (2, "a", "t", "x", True, 5, 1, 1, 1, None)], RECORD)
    got = {r.project_id: (r.change, r.lost_at) for r in backlinks.backlink_diff(stored, spark.createDataFrame([], PULL), spark.createDataFrame([(1,)], "project_id int"), F.lit(9)).collect()}
    assert got == {1: ("lost", 9), 2: ("gone", None)}


def test_a_clean_audit_removes_issues(spark):
    issues = spark.createDataFrame([(1, 10, "title"), (2, 20, "h1"), (3, 30, "lang")], "project_id int, page_id int, category string")
    audited = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "project_id int, page_id int")
    fresh = issues.where("project_id = 2")
    assert {r.project_id for r in upserts.replace_issues(issues, fresh, audited).collect()} == {2, 3}
    assert {(r.project_id, r.pages_audited, r.issues_found) for r in upserts.audit_summary(audited, fresh).collect()} == {(1, 2, 0), (2, 1, 1)}


def test_export_and_report_files(spark, tmp_path):
    view = spark.createDataFrame([("shoes, red", 10, None, "commercial", "rising")], "keyword string, volume int, difficulty int, intent string, trend string")
    reports.write_keyword_export(view, f"{tmp_path}/x", single_file=True)
    [part] = tmp_path.glob("x/part-*")
    assert part.read_bytes().decode("utf-8-sig").splitlines() == ["Keyword,Volume,Difficulty,Intent,Trend", '"shoes, red",10,"",commercial,rising'] and part.read_bytes().startswith(b"\xef\xbb\xbf")
    (tmp_path / "r.csv").write_text("Keyword;Search Volume\nred \"shoes\";5\n")
    [row] = reports.read_report_files(spark, f"{tmp_path}/r.csv").collect()
    assert (row.Ph, row.Nq) == ('red "shoes"', "5")


def test_history_is_repeated_diffs(spark):
    r = random.Random(4)
    pulls = [(p, f"s{s}", "t", n, r.choice([None, 1, 2])) for p in (1, 2) for n in range(1, 6) for s in range(8) if r.random() < 0.5 and n != 3]
    df = spark.createDataFrame(pulls, "project_id int, source_url string, target_url string, pull_no int, domain_rank int")
    calendar = spark.createDataFrame([(p, n) for p in (1, 2) for n in range(1, 6)], "project_id int, pull_no int")
    state = {}
    for p in (1, 2):
        for n in range(1, 6):
            now = {(a, b): rank for q, a, b, m, rank in pulls if q == p and m == n}
            for key, rank in now.items():
                old = state.get((p, *key))
                state[p, *key] = [old[0] if old else n, n, None, rank if rank is not None else old and old[3], (old[4] if old else 0) + (not old or old[1] != n - 1)]
            for key, row in state.items():
                if key[0] == p and key[1:] not in now and row[2] is None:
                    row[2] = n
    got = {(x.project_id, x.source_url, x.target_url): [x.first_seen, x.last_seen, x.lost_at, x.domain_rank, x.episodes] for x in backlinks.backlink_history(df, calendar).collect()}
    assert got == state


def test_history_folds_from_any_parts(spark):
    r = random.Random(11)
    pulls = [(p, r.choice(["s", None]) if s == 0 else f"s{s}", "t", n, r.choice([None, 1, 2]), f"a{n}", bool(n % 2), r.choice([None, n])) for p in (1, 2, 3) for n in range(1, 9) for s in range(7) if r.random() < 0.5 and n != 3 and (p, n) != (2, 6) and (p < 3 or n > 4)]
    df = spark.createDataFrame(pulls, "project_id int, source_url string, target_url string, pull_no int, domain_rank int, anchor string, is_follow boolean, spam_score int").dropDuplicates(["project_id", "source_url", "pull_no"]).cache()
    days = spark.createDataFrame([(p, n) for p in (1, 2, 3) for n in range(1, 9) if p < 3 or n > 4], "project_id int, pull_no int")
    want = sorted(map(str, backlinks.backlink_history(df, days).collect()))
    for cuts in ([4], [1, 2, 3], sorted(r.sample(range(1, 8), 2))):
        history = None
        for low, high in zip([0, *cuts], [*cuts, 8]):
            part = f"pull_no > {low} AND pull_no <= {high}"
            later = backlinks.backlink_history(df.where(part), days.where(part))
            history = later if history is None else backlinks.fold_history(history, later, days.where(part))
        assert sorted(map(str, history.collect())) == want


def test_anchors_and_toxic_links(spark):
    rows = [(1, "https://a.xyz/1", "t", a, 3) for a in ("Brand shoes", "buy shoes", "click here", "https://x.com", "x.com", None, "odd")]
    df = spark.createDataFrame(rows, "project_id int, source_url string, target_url string, anchor string, domain_rank int")
    brands, words = spark.createDataFrame([(1, "brand")], "project_id int, brand string"), spark.createDataFrame([(1, "Buy Shoes")], "project_id int, keyword string")
    assert [r.kind for r in backlinks.anchors(df, brands, words).orderBy("anchor").collect()].count("naked_url") == 2
    kinds = {r.kind: r.n for r in backlinks.anchor_distribution(df, brands, words).collect()}
    assert kinds == {"branded": 1, "exact_match": 1, "generic": 1, "naked_url": 2, "other": 2}
    toxic = {r.anchor: r.reasons for r in backlinks.toxic_links(df, brands, words, repeats=0).collect()}
    assert toxic["buy shoes"] == ["low_authority_exact_match", "spam_tld", "repeated_anchor"]


LINK = "project_id int, task_id int, url_from string, url_to string, direction string, dofollow boolean, is_broken boolean, status_code int, is_link_relation_conflict boolean"


def test_links(spark, tmp_path):
    rows = [(1, 1, "a", "b/", "internal", True, None, 200, None), (1, 1, "b", "b", "internal", False, True, 404, True), (1, 1, "a", "x", "external", None, False, None, False), (1, 1, "", "b", "internal", True, None, 200, None)]
    kept = links.store_links(spark.createDataFrame(rows, LINK))
    mix = links.link_mix(kept).first()
    assert (mix.total, mix.broken, mix.dofollow, mix.nofollow, mix.conflicts, mix.internal) == (3, 1, 1, 1, 1, 2)
    pages = spark.createDataFrame([(1, "a"), (1, "b")], "project_id int, url string")
    assert [r.url for r in links.orphan_pages(pages, kept).collect()] == ["a"]
    assert links.link_health(kept, pages).first().health == 0
    links.write_links(kept, f"{tmp_path}/l")
    links.write_links(kept.withColumn("task_id", F.lit(2)).limit(1), f"{tmp_path}/l")
    links.write_links(kept.where("is_broken"), f"{tmp_path}/l")
    assert {r.task_id: r.n for r in spark.read.parquet(f"{tmp_path}/l").groupBy("task_id").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 1}


def test_frontier_and_plan(spark):
    scratch(spark, "x")
    edges = spark.createDataFrame([(1, "h", "a"), (1, "a", "b"), (1, "b", "h"), (1, "z", "y"), (2, "h", "c")], "project_id int, url_from string, url_to string")
    starts = spark.createDataFrame([(1, "h"), (2, "h")], "project_id int, url string")
    found = links.crawl_frontier(edges, starts, scratch(spark, "g"))
    assert {(r.project_id, r.url, r.depth) for r in found.collect()} == {(1, "h", 0), (1, "a", 1), (1, "b", 2), (2, "h", 0), (2, "c", 1)}
    sitemap = spark.createDataFrame([(1, 0, "h"), (1, 1, "s1"), (1, 2, "s2")], "project_id int, pos int, url string")
    plan = {}
    for r in links.plan_crawl(starts, sitemap, found, 2).orderBy("project_id", "place").collect():
        plan.setdefault(r.project_id, []).append(r.url)
    assert plan == {1: ["h", "s1"], 2: ["h", "c"]}


def test_frontier_of_a_long_chain(spark):
    edges = spark.createDataFrame([(1, f"p{i}", f"p{i + 1}") for i in range(12)], "project_id int, url_from string, url_to string")
    starts = spark.createDataFrame([(1, "p0")], "project_id int, url string")
    search = lambda rows, **more: links.crawl_frontier(rows, starts, scratch(spark, "g"), **more)
    assert {r.url: r.depth for r in search(edges).collect()} == {f"p{i}": i for i in range(13)}
    assert search(edges, max_depth=3).count() == 4
    assert {r.url for r in search(edges.union(spark.createDataFrame([(1, "p1", "a")], edges.schema)), max_pages=3).collect()} == {"p0", "p1", "a"}


def test_frontier_of_a_hub(spark):
    """A page of 100,000 links, all of which link back and to a page of their own; more pages than a bitmap holds."""
    n, url = 100_000, lambda c: F.concat(F.lit(c), F.col("id").cast("string"))
    ids = spark.range(n)
    edge = lambda a, b: ids.select(F.lit(1).alias("project_id"), a.alias("url_from"), b.alias("url_to"))
    edges = edge(F.lit("hub"), url("p")).union(edge(url("p"), F.lit("hub"))).union(edge(url("p"), url("q")))
    found = links.crawl_frontier(edges, spark.createDataFrame([(1, "hub")], "project_id int, url string"), scratch(spark, "g"))
    assert {r.depth: r.n for r in found.groupBy("depth").agg(F.countDistinct("url").alias("n")).collect()} == {0: 1, 1: n, 2: n}
    assert found.count() == 2 * n + 1


def test_a_level_does_not_move_the_edges(spark):
    edges = spark.createDataFrame([(1, f"p{i}", f"p{i * 7 % 500}") for i in range(500)], "project_id int, url_from string, url_to string")
    starts = spark.createDataFrame([(1, f"p{i}") for i in range(100)], "project_id int, url string")
    graph = links.Graph(edges, starts, scratch(spark, "g"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph.starts.select(F.col("id").alias("src")).join(graph.edges, "src")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        graph.close()
    scan = plan[plan.index("FileScan") :]
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in scan
    # the exchange is on the side of the level
    assert plan.index("Exchange") < plan.index("FileScan") and "Exchange" not in scan


def test_sitemaps(spark):
    o = "https://a.example"
    rows = [
        (f"{o}/robots.txt", f"x\r\nSITEMAP: {o}/i.xml\n", 200), (f"{o}/i.xml", f"<sitemapindex><loc>{o}/i.xml</loc><loc>{o}/u1.xml</loc><loc>{o}/gone.xml</loc><loc>{o}/u2.xml</loc></sitemapindex>", 200),
        (f"{o}/u1.xml", f"<urlset><loc> {o}/p1/?x=1 </loc><loc>https://b.example/x</loc><loc>{o}/p2</loc></urlset>", 200), (f"{o}/u2.xml", f"<urlset><loc>{o}/p1</loc><loc>{o}/p3</loc></urlset>", 200), (f"{o}/gone.xml", "<urlset></urlset>", 404),
        (f"{o}/sitemap.xml", f"<urlset><loc>{o}/never</loc></urlset>", 200), ("https://c.example/sitemap.xml", "<urlset><loc>https://c.example/</loc></urlset>", 200),
    ]
    scratch(spark, "x")
    origins = spark.createDataFrame([(o,), ("https://c.example",), ("https://d.example",)], "origin string")
    got = {}
    for r in reports.extract_sitemap_urls(spark.createDataFrame(rows, "url string, body string, status int"), origins, 3).orderBy("origin", "pos").collect():
        got.setdefault(r.origin, []).append(r.url)
    assert got == {o: [f"{o}/p1", f"{o}/p2", f"{o}/p3"], "https://c.example": ["https://c.example"]}


PAGE = """<!DOCTYPE html><html lang=fr><head><title> A &amp; B </title><meta name="description" content=" d "><meta property="og:title" content=""><link rel="canonical" href="/c">
<script type="application/ld+json">{"@type":"Organization"}</script><script type="application/ld+json">[{"@type":"Article"},3]</script><script type="application/ld+json">{bad</script></head>
<body>out<h2>First</h2><main>in <b>bold</b><script>var x="<h1>no</h1>";</script><h1>One</h1><h1>T<i>w</i>o</h1></main><img src=a><img src=b alt=""><img src=c alt="x"><a href="/p?q#f">l</a><a href="#x">m</a></body></html>"""


def test_html(spark):
    f = html.parse(PAGE)
    assert (f["title"], f["meta_description"], f["og_title"], f["canonical"], f["lang"]) == ("A & B", "d", None, "/c", "fr")
    assert f["h1"] == ["One", "Two"] and f["h2"] == ["First"] and [h["tag"] for h in f["heading_structure"]] == ["h2", "h1", "h1"]
    assert f["custom_content"] == "in bold One T w o" and [i["alt"] for i in f["image_alts"]] == [None, "", "x"]
    assert len(f["domain_schema"]) == 1 and len(f["page_schemas"]) == 1
    rows = html.extract_page_facts(spark.createDataFrame([(1, "https://a.example/x/", PAGE), (2, None, None), (3, "u", "<p>un<closed")], "page_id long, url string, html string"))
    assert {(r.page_id, r.link) for r in html.discover_links(rows).collect()} == {(1, "https://a.example/p")}
    assert {(r.level, r.type) for r in html.jsonld_items(rows).collect()} == {("domain", "Organization"), ("page", "Article")}


def test_domains(spark):
    rows = ["example.com", "http://example.com", " https://www.Example.com/a?b#c", "WWW.EXAMPLE.COM/", "  ", None, "example.com.", "a.com?x"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "v string").select(normalize_domain(F.col("v"))).collect()]
    assert got == ["example.com"] * 4 + ["", "", "example.com", "a.com"]
    lists = spark.createDataFrame([(" a, b\n\n c ,,",), (None,)], "v string").select(split_list(F.col("v"))).collect()
    assert [r[0] for r in lists] == [["a", "b", "c"], []]


def test_suggestions(spark):
    texts = spark.createDataFrame([("  Hello   World  ",), ("Hello\nWorld",), ("STRASSE",), ("straße",), ("",), (" 　",), (None,)], "t string")
    h = [r[0] for r in texts.select(content_hash(F.col("t"))).collect()]
    assert h[0] == h[1] and h[2] == h[3] and h[4] == h[5] == h[6] and texts.select(normalize_content(F.col("t"))).first()[0] == "Hello World"
    stored = spark.createDataFrame([(1, 1, "a", None, "accepted", 1), (2, 1, "b", "c", "edited", 2), (3, 1, "d", None, "pending", 3), (4, 2, "e", None, "pending", 1)], "id int, issue_id int, content string, edited_content string, status string, rank int")
    fresh = spark.createDataFrame([(1, 0, "A "), (1, 1, "x"), (1, 2, "b"), (1, 3, "X"), (1, 4, "C")], "issue_id int, pos int, content string")
    got = sorted((r.issue_id, r.status, r.content, r.rank) for r in suggestions.merge_suggestions(stored, fresh).collect())
    assert got == [(1, "accepted", "a", 1), (1, "edited", "b", 2), (1, "pending", "b", 2), (1, "pending", "x", 1), (2, "pending", "e", 1)]


def test_lifecycle(spark):
    log = [(1, "accept", None), (1, "deploy", None), (2, "edit", " new "), (2, "deploy", None), (1, "reject", None), (2, "accept", None), (2, "rollback", None), (2, "edit", " "), (3, "deploy", None)]
    rows = spark.createDataFrame([(7, s, datetime(2026, 1, 1), i, a, c) for i, (s, a, c) in enumerate(log)], "issue_id long, suggestion_id long, ts timestamp, seq int, action string, content string")
    got = {r.suggestion_id: (r.status, r.content, r.applied, r.refused) for r in suggestions.suggestion_lifecycle(rows).collect()}
    assert got == {1: ("rejected", None, 3, 0), 2: ("accepted", "new", 3, 2), 3: ("pending", None, 0, 1)}


def test_model_answers(spark):
    rows = spark.createDataFrame([(1, "x\n1. a\r\n 2.b\n3. c\n4. d\n1. e"), (2, None)], "id int, text string")
    assert [r.suggestion for r in suggestions.parse_numbered(rows).orderBy("pos").collect()] == ["a", "b", "c"]
    good = '{"page_type":"p","main_topic":"m","search_intent":"s","primary_keyword":"k","geo_relevance":"local","context_confidence":0.5}'
    rows = spark.createDataFrame([(1, good), (2, f"```json\n{good}\n```"), (3, "{}"), (4, "no"), (5, None), (6, good[:-1])], "id int, text string")
    assert [r.valid for r in suggestions.parse_understanding(rows).orderBy("id").collect()] == [True, True, False, False, False, False]


def test_upserts(spark):
    stored = spark.createDataFrame([(1, "a", "t1", None), (1, "b", "t2", "x")], "project_id int, url string, title string, error string")
    results = spark.createDataFrame([(1, "a", 1, "n1"), (1, "a", 2, None), (1, "c", 3, "n3")], "project_id int, url string, seq int, title string")
    got = sorted((r.url, str(r.title), str(r.error)) for r in upserts.upsert_pages(stored, results).collect())
    assert got == [("a", "None", "None"), ("b", "t2", "x"), ("c", "n3", "None")]


def test_stream_gives_the_state_of_one_upsert(spark, tmp_path):
    rows = spark.createDataFrame([(1, f"u{i % 5}", f"t{i}", i) for i in range(20)], "project_id int, url string, title string, seq long")
    for i in range(4):
        rows.where(f"seq DIV 5 = {i}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    out = lambda ck="ck": stream_upsert_pages(spark, f"{tmp_path}/in/*", rows.schema, f"{tmp_path}/pages", f"{tmp_path}/{ck}")
    want = sorted(map(str, upserts.upsert_pages(rows.limit(0).drop("seq"), rows).collect()))
    assert sorted(map(str, out().collect())) == want
    # every batch once more, as after a lost checkpoint, and a result that comes late
    assert sorted(map(str, out("other").collect())) == want
    spark.createDataFrame([(1, "u0", "old", 3), (1, None, "no url", None)], rows.schema).coalesce(1).write.parquet(f"{tmp_path}/in/8")
    assert {r.url: r.title for r in out().collect()} == {**{f"u{i}": f"t{15 + i}" for i in range(5)}, None: "no url"}
    spark.createDataFrame([(1, "u0", "late", 99)], rows.schema).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    assert {r.url: r.title for r in out().collect()}["u0"] == "late"


def test_stream_writes_what_a_batch_holds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "FAN", 4)
    schema = spark.createDataFrame([], "project_id int, url string, title string, seq long").schema
    pages = stream.Pages(spark, str(tmp_path / "p"), schema)
    size = lambda: {p.parent.name: 0 for p in tmp_path.glob("p/*/_SUCCESS")} | {n: sum(f.stat().st_size for f in tmp_path.glob(f"p/{n}/*.parquet")) for n in {p.parent.name for p in tmp_path.glob("p/*/_SUCCESS")}}
    pages.add(spark.range(20_000).selectExpr("1 project_id", "concat('u', id) url", "uuid() title", "id seq"), 0)
    before = size()
    pages.add(spark.createDataFrame([(1, "u7", "new", 1_000_000)], schema), 1)
    after = size()
    assert after["l0-0"] == before["l0-0"] > 100 * after["l0-1"] and len(after) == 2
    for n in range(2, 18):
        pages.add(spark.createDataFrame([(1, f"u{n}", f"n{n}", 1_000_000 + n)], schema), n)
    assert pages.parts() == [(0, 16), (0, 17), (2, 15)] and pages.read().count() == 20_000
    # a merge that ended before it removed its parts, and a part that was never finished
    pages.add(spark.createDataFrame([(1, "u3", "stale", 5)], schema), 3)
    (tmp_path / "p/l0-99").mkdir()
    got = {r.url: r.title for r in pages.read().where("title LIKE 'n%' OR title = 'stale'").collect()}
    assert got == {"u7": "n7", **{f"u{n}": f"n{n}" for n in range(2, 18)}}


def test_competitors(spark):
    rows = spark.createDataFrame([(1, "https://A.com/x", None, 1), (1, "a.com", "n", 2), (1, " ", None, 3), (1, "b.com", " B ", 4), (1, "c.com", None, 5)], "project_id int, value string, display_name string, seq int")
    ok, bad = competitors.register_competitors(rows, spark.createDataFrame([(1, "c.com")], "project_id int, domain string"))
    assert sorted(map(tuple, ok.collect())) == [(1, "a.com", "a.com"), (1, "b.com", "B")] and {r.seq: r.reason for r in bad.collect()} == {2: "duplicate", 3: "blank", 5: "duplicate"}
    scratch(spark, "x")
    items = spark.createDataFrame([(k, i, "organic", d) for k, ds in {1: "abcd", 2: "abce", 3: "abef", 9: "xyz"}.items() for i, d in enumerate(ds)], "keyword_id int, pos int, item_type string, url string")
    assert {r.keyword_id: (r.cluster, r.n_keywords, r.shared_urls) for r in clusters.serp_overlap_clusters(items, 0.5).collect()} == {1: (1, 3, ["a", "b", "c"]), 2: (1, 3, ["a", "b", "c", "e"]), 3: (1, 3, ["a", "b", "e"]), 9: (9, 1, [])}


def brute_overlaps(sets, least):
    return {(a, b): len(x & y) for a, x in sets.items() for b, y in sets.items() if a < b and x & y and len(x & y) / len(x | y) >= least}


@pytest.mark.parametrize(("block", "pages"), [(1_000, 12), (5, 12), (5, 60)])
def test_overlaps_of_results_on_many_pages(spark, monkeypatch, block, pages):
    """Results that many keywords have, and keys of more keywords than are compared directly."""
    scratch(spark, "x")
    r = random.Random(pages)
    sets = {k: {f"d{r.randrange(pages) if r.random() < 0.8 else r.randrange(4)}.example/p" for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9]))} for k in range(600)}
    items = spark.createDataFrame([(k, i, "organic", d) for k, ds in sets.items() for i, d in enumerate(ds)] + [(5_000, 1, "paid", "d1.example"), (5_001, 1, "organic", None)], "keyword_id int, pos int, item_type string, url string")
    monkeypatch.setattr(clusters, "BLOCK", block)
    for least in (0.4, 0.7):
        want, root = brute_overlaps(sets, least), {k: k for k in [*sets, 5_000, 5_001]}
        got = [(row.a, row.b, row.shared) for row in clusters.serp_overlap(items, least).collect()]
        assert sorted(got) == sorted((a, b, n) for (a, b), n in want.items())

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in want:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        mates = {}
        for k in root:
            mates.setdefault(find(k), []).append(k)
        shared = {k: sorted(u for u in sets.get(k, ()) if sum(u in sets.get(m, ()) for m in mates[find(k)]) > 1) for k in root}
        assert {row.keyword_id: (row.cluster, row.n_keywords, row.shared_urls) for row in clusters.serp_overlap_clusters(items, least).collect()} == {k: (find(k), len(mates[find(k)]), shared[k]) for k in root}


def test_components_lay_ids_with_one_link_aside(spark):
    """Paths, stars, single links and random links; and roots follow what they are joined to."""
    from visigraph.functions.graph import components, moved

    scratch(spark, "x")
    r = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(30)] + [(200, 201), (205, 204), (204, 205), (210, 210)] + [(300 + r.randrange(90), 300 + r.randrange(90)) for _ in range(70)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len({x.id for x in got}) and {x.id: x.root for x in got} == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    rows = spark.createDataFrame([(5, 3), (6, 4)], "id long, root long")
    assert sorted(map(tuple, moved(rows, spark.createDataFrame([(3, 1)], "id long, root long")).collect())) == [(5, 1), (6, 4)]


def test_overlaps_rewrite_a_url_once_and_keep_shared_keys_only(spark):
    """Rows of items are joined to numbers of their URLs as given, and keys of one keyword go before anything is joined to them."""
    scratch(spark, "x")
    rows = [(k, i, "organic", u) for k in range(40) for i, u in enumerate(["https://www.A.example/x/", "a.example/x", "a.example/x", f"b{k}.example", f"c{k}.example"])]
    odd = [(50, 1, "organic", "#top"), (51, 1, None, "a.example/x"), (52, 1, "paid", "a.example/x"), (None, 1, "organic", "a.example/x"), (53, 1, "organic", "a.example/x"), (54, 1, "organic", "https://A.example/x#y")]
    items = spark.createDataFrame(rows + odd, "keyword_id int, pos int, item_type string, url string")
    numbers = clusters.numbered(items)
    assert numbers.count() == 84 and numbers.where("no IS NOT NULL").select("no").distinct().count() == 81
    sets = clusters.result_sets(items, numbers)
    assert "regexp" not in sets._jdf.queryExecution().toString() and {r.keyword_id: len(r.results) for r in sets.collect()} == {**dict.fromkeys(range(40), 3), 50: 0, 51: 0, 52: 0, None: 1, 53: 1, 54: 1}
    ids = sets.where("size(results) > 0 AND keyword_id < 40").select(F.col("keyword_id").alias("id"), F.size("results").alias("n"), "results").withColumn("at", F.lit(0))
    first = clusters.longer(ids, 0, 0.4)
    assert clusters.met(clusters.longer(first, 1, 0.1), 2).count() == 0
    assert {(r.b is not None, r.n_b) for r in clusters.met(clusters.longer(ids, 0, 0.1), 1).collect()} == {(True, 3)}
    got = {r.keyword_id: (r.cluster, r.n_keywords, r.shared_urls) for r in clusters.serp_overlap_clusters(items, 0.4).collect()}
    assert got == {**{k: (k, 1, []) for k in [*range(40), 50, 51, 52]}, None: (None, 1, []), 53: (53, 3, ["a.example/x"]), 54: (53, 3, ["a.example/x"])}


def test_result_urls(spark):
    rows = spark.createDataFrame([("https://WWW.A.example/B/?q=1#x",), ("A.example/B//",), (" http://a.example ",), ("#top",), (None,)], "url string")
    assert [r[0] for r in rows.select(clusters.result_url(F.col("url"))).collect()] == ["a.example/B/?q=1", "a.example/B", "a.example", "", None]


def test_ranks_of_a_large_key(spark):
    """A key of nearly all rows is ranked in many tasks, with ties of keys, nulls and clashing columns."""
    scratch(spark, "x")
    rows = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, F.col("id") % 3).when(F.col("id") % 51 != 0, F.lit(9)).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), F.col("id").alias("_n"))
    got = frames.ranked(rows, ["k"], [F.desc("v"), F.col("_n")])
    want = rows.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "_n")))
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and got.count() == 20_000
    assert frames.ranked(rows.limit(0), ["k"], [F.col("v")]).collect() == []


def test_folding_equals_casefold_for_every_character(spark):
    points = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(map(chr, points[i : i + 512])) for i in range(0, len(points), 512)] + ["Straße ŉ İ ΐ ﬃ Ǆ", "", "plain ASCII Text"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r[0]: r[1] for r in rows.select("t", casefold(F.col("t"))).collect()}
    assert all(got[t] == t.casefold() for t in texts) and got[None] is None


def test_lifecycle_equals_replay(spark):
    """Random logs, of all actions and more, with texts that are blank or null, equal times, and many suggestions of an issue."""
    r = random.Random(8)
    log = [(r.randrange(12), r.randrange(4), r.randrange(6), i, r.choice(["accept", "reject", "edit", "deploy", "deploy", "rollback", "nothing"]), r.choice([None, "", " \t ", " new text ", "x"])) for i in range(1_500)]
    want = {}
    for issue in range(12):
        events = sorted((e for e in log if e[0] == issue), key=lambda e: (e[2], e[3]))
        want |= {(issue, s): x for s, x in replayed([(e[1], e[4], e[5]) for e in events]).items()}
    r.shuffle(log)
    rows = spark.createDataFrame(log, "issue_id long, suggestion_id long, ts long, seq long, action string, content string")
    got = {(x.issue_id, x.suggestion_id): {"status": x.status, "content": x.content, "applied": x.applied, "refused": x.refused} for x in suggestions.suggestion_lifecycle(rows).collect()}
    assert got == want
    assert suggestions.suggestion_lifecycle(rows.limit(0)).collect() == []


def replayed(events):
    """Statuses after the events (suggestion_id, action, content) of one issue in order, one event after the other."""
    state = {}
    for s, action, content in events:
        own = state.setdefault(s, {"status": "pending", "content": None, "applied": 0, "refused": 0})
        deployed, text = own["status"] == "deployed", (content or "").strip()
        ok = {"deploy": own["status"] in ("accepted", "edited"), "rollback": deployed, "edit": not deployed and text != "", "accept": not deployed, "reject": not deployed}.get(action, False)
        own["applied" if ok else "refused"] += 1
        if ok and action == "deploy":
            for other in state.values():
                other["status"] = "accepted" if other["status"] == "deployed" else other["status"]
        if ok:
            own["status"] = {"accept": "accepted", "reject": "rejected", "edit": "edited", "deploy": "deployed", "rollback": "accepted"}[action]
        if ok and action == "edit":
            own["content"] = text
    return state


def test_components(spark):
    scratch(spark, "x")
    links = [(i, i + 1) for i in range(100, 300)] + [(5, 9), (9, 5), (7, 7), (2**40, 9)] + [(1000, 1000 + i) for i in range(1, 400)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 301)}, 9: 5, 2**40: 5, **{1000 + i: 1000 for i in range(1, 400)}}


def test_relative_references(spark):
    """The examples of RFC 3986, section 5.4 (normal and abnormal), as far as they lead to a page of the same host, and more."""
    base = "http://a/b/c/d;p?q"
    rfc = {"g": "/b/c/g", "./g": "/b/c/g", "g/": "/b/c/g", "/g": "/g", "?y": "/b/c/d;p", "g?y": "/b/c/g", "g#s": "/b/c/g", ";x": "/b/c/;x", "g;x?y#s": "/b/c/g;x", ".": "/b/c", "./": "/b/c", "..": "/b", "../": "/b", "../g": "/b/g", "../..": "", "../../g": "/g",
           "../../../g": "/g", "../../../../g": "/g", "/./g": "/g", "/../g": "/g", "g.": "/b/c/g.", ".g": "/b/c/.g", "g..": "/b/c/g..", "..g": "/b/c/..g", "./../g": "/b/g", "./g/.": "/b/c/g", "g/./h": "/b/c/g/h", "g/../h": "/b/c/h", "g;x=1/./y": "/b/c/g;x=1/y", "g;x=1/../y": "/b/c/y", "g?y/./x": "/b/c/g", "http:g": "/b/c/g",
           "http://a/x//": "/x", "//a/y?z": "/y", " \tg\n": "/b/c/g", "x//y": "/b/c/x/y"}
    none = ["g:h", "//g", "", "#s", None, "mailto:a@b", "TEL:1", "javascript:x()", "https:g", "http://a.b/x", "http:///x", "p.PNG", "q.pdf?x=1", "/r/t.woff2#a"]
    rows = spark.createDataFrame([(base, h) for h in [*rfc, *none]] + [(None, "/x"), ("http://a", "x"), ("https://A.example/p/", "q")], "url string, href string")
    got = {(r.url, r.href): r.link for r in rows.select("url", "href", html.page_link(F.col("url"), F.col("href")).alias("link")).collect()}
    assert {h: got[base, h] for h in rfc} == {h: f"http://a{p}" for h, p in rfc.items()}
    assert {h: got[base, h] for h in none} == dict.fromkeys(none)
    assert (got[None, "/x"], got["http://a", "x"], got["https://A.example/p/", "q"]) == (None, "http://a/x", "https://A.example/p/q")


def test_posts(spark):
    pages = spark.createDataFrame([(1, 1, "https://s/a/one/"), (2, 1, "https://s/two?x"), (3, 1, "https://s/"), (4, 1, "https://s/three")], "page_id int, project_id int, url string")
    posts = spark.createDataFrame([(1, "posts", "one", 42), (1, "pages", "two", 7), (1, "posts", "two", 8), (1, "posts", "two", 9), (1, "media", "three", 1), (1, "posts", "", 5)], "project_id int, post_type string, slug string, post_id int")
    assert {r.page_id: (r.status, r.post_id, r.post_type) for r in suggestions.resolve_posts(pages, posts).collect()} == {1: ("ok", 42, "posts"), 2: ("ok", 7, "pages"), 3: ("no_data", None, None), 4: ("no_data", None, None)}


def test_stream_upsert_pages_has_a_file_from_each_task(spark, tmp_path, monkeypatch):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "concat('text of a page ', id) AS text", "'en' AS lang").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}

    def run(s, source, schema, target, checkpoint, files_per_batch=1):
        seen.update(files=s.read.schema(schema).parquet(source).inputFiles(), batch=files_per_batch)
        return stream_upsert_pages(s, source, schema, target, checkpoint, files_per_batch)

    monkeypatch.setattr(graphs, "stream_upsert_pages", run)
    got = rows_of(graphs.stream_upsert_pages_(spark, str(tmp_path)))
    assert len(seen["files"]) > 4 and seen["batch"] == -(-len(seen["files"]) // 4)
    want = view(spark, str(tmp_path), "page_facts").selectExpr("project_id", "'https://x/' || (page_id % 300) AS url", "coalesce(title, chr(0)) AS title", "page_id AS seq")
    assert got == rows_of(stream.last_results(want).drop("seq"))


def test_pulls_that_are_dealt_by_project_stay_where_they_are(spark, tmp_path):
    rows = spark.range(300).selectExpr("id % 7 AS l_suppkey", "id AS l_partkey", "id % 3 AS l_linenumber", "make_date(1992 + int(id % 5), 1, 1) AS l_shipdate")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = graphs.backlink_history(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_suppkey" in plan and "source_url#" not in "".join(x for x in plan.splitlines() if "Exchange hash" in x)
