from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from visigraph.operators import keywords, serp
from visigraph.sources import reports

NOW = datetime(2026, 7, 14, 12)
SNAP = "tracked_keyword_id int, id int, fetched_at timestamp, volume int, position int"


@pytest.mark.parametrize(
    ("snaps", "want"),
    [
        ([(0, 100, None)], ("stable", "insufficient_data")),
        ([(0, 200, None), (3, 100, None)], ("stable", "insufficient_data")),
        ([(0, 150, None), (8, 100, None)], ("rising", "computed")),
        ([(0, 80, None), (8, 100, None)], ("falling", "computed")),
        ([(0, 110, None), (8, 100, None)], ("stable", "computed")),
        ([(0, 95, None), (8, 100, None)], ("stable", "computed")),
        ([(0, None, 10), (8, None, 20)], ("rising", "computed")),
        ([(0, None, 20), (8, None, 10)], ("falling", "computed")),
        ([(0, None, None), (8, None, None)], ("stable", "insufficient_data")),
        ([(30, 1000, None), (8, 100, None), (0, 150, None)], ("rising", "computed")),
        ([(0, 50, 3), (8, 0, 9)], ("rising", "computed")),
        ([(0, 150, None), (7, 100, None)], ("rising", "computed")),
    ],
)
def test_trend(spark, snaps, want):
    for rows in (snaps, snaps[::-1]):
        df = spark.createDataFrame([(1, i, NOW - timedelta(days=d), v, p) for i, (d, v, p) in enumerate(rows)], SNAP)
        assert tuple(keywords.trends(df).first())[1:] == want


SERP = "ai_overview boolean, ads int, featured_snippet boolean, local_pack boolean"


def score(spark, volume, difficulty, intent, features=None):
    df = spark.createDataFrame([(volume, difficulty, intent, features)], f"v int, d int, i string, s struct<{SERP.replace(' boolean', ':boolean').replace(' int', ':int')}>")
    return df.select(keywords.worth_it(F.col("v"), F.col("d"), F.col("i"), F.col("s")).alias("w")).first().w


def test_worth_it(spark):
    assert score(spark, 30, 92, "navigational").band == "avoid"
    assert score(spark, 5000, 20, "commercial").score > score(spark, 5000, 80, "commercial").score
    assert score(spark, 5000, 40, "transactional").score > score(spark, 5000, 40, "navigational").score
    clean, crowded = score(spark, 5000, 40, "commercial", (False, 0, None, None)), score(spark, 5000, 40, "commercial", (True, 4, None, None))
    assert clean.score > crowded.score and any("AI Overview" in x for x in crowded.factors) and any(x.startswith("4 ads") for x in crowded.factors)
    assert any("not checked" in x for x in score(spark, 1, 1, None).factors)
    none = score(spark, None, None, None)
    assert none.score <= 4.0 and none.factors[0].startswith("No search volume")
    assert 0 <= score(spark, 2_000_000, 0, "transactional").score <= 10
    assert score(spark, 1000, 50, "odd intent").factors[2] == "Odd Intent intent" and score(spark, 12345, 5, None).factors[0] == "Strong volume (12,345/mo)"


def test_report_bodies(spark):
    bodies = [(1, "Keyword;Search Volume;CPC;Competition;Intent\r\ndentist near me;90500;0;0.33;3"), (2, "Keyword;Keyword Difficulty Index\r\ndentist near me;27"), (3, "Keyword;Search Volume\r\n\r\na;1\r\nb;2\r\n"), (4, "ERROR 50 :: NOTHING FOUND\n"), (5, None), (6, "Domain;Url\r\nx.com;https://x.com/a")]
    rows = reports.parse_reports(spark.createDataFrame(bodies, "id int, body string")).orderBy("id", "line").collect()
    assert [(r.id, r.Ph, r.Nq, r.Kd, r.In, r.Ur) for r in rows] == [(1, "dentist near me", "90500", None, "3", None), (2, "dentist near me", None, "27", None, None), (3, "a", "1", None, None, None), (3, "b", "2", None, None, None), (6, None, None, None, None, "https://x.com/a")]


def test_normalised_rows(spark):
    rows = [("k", "Kw", "90500", "27", "0", "3", "1.00,0.82,0.67,0.81"), ("k", "", "n/a", None, "x", None, None), ("k", None, "12.9", "", "", "1,0", "1,x")]
    got = keywords.normalize_report_keywords(spark.createDataFrame(rows, "keyword string, Ph string, Nq string, Kd string, Cp string, In string, Td string")).collect()
    assert [tuple(r) for r in got] == [("Kw", 90500, 27, "transactional", 0.0, [1.0, 0.82, 0.67, 0.81]), ("k", None, None, None, None, None), ("k", 12, None, "informational", None, None)]


def test_routing(spark):
    side = "keyword string, status string, volume int, difficulty int, intent string"
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "keyword string")
    primary = spark.createDataFrame([("a", "error", 1, 1, None), ("b", "ok", 2, 2, None), ("c", "no_data", None, None, None), ("d", "no_data", None, None, None), ("e", "error", None, None, None)], side)
    secondary = spark.createDataFrame([("a", "ok", 9, 9, "x"), ("c", "no_data", None, None, None), ("d", "error", None, None, None), ("e", "error", None, None, None)], side)
    got = {r.keyword: (r.status, r.answered_by, r.volume) for r in keywords.route_keyword_bulk(asked, primary, secondary, ("keyword",)).collect()}
    assert got == {"a": ("ok", "secondary", 9), "b": ("ok", "primary", 2), "c": ("no_data", "none", None), "d": ("no_data", "none", None), "e": ("error", "none", None)}


def test_unsupported_location(spark):
    rows = keywords.resolve_location(spark.createDataFrame([("xx",), ("gb",)], "location string")).collect()
    assert {r.location: (r.error, r.code) for r in rows} == {"XX": ("Unsupported location: XX", None), "GB": (None, 2826)}


def test_roots_and_words(spark):
    rows = spark.createDataFrame([("how to plan a Garden",), ("the a an",), ("best cars",), ("",)], "k string")
    assert [r[0] for r in rows.select(keywords.root_of(F.col("k"))).collect()] == ["garden", "the", "best", ""]


def test_result_pages(spark):
    items = spark.createDataFrame([(1, 1, "paid", "x.com", 1, 1), (1, 2, "ai_overview", "a", 2, 1), (1, 3, "organic", "WWW.Own.com", 0, 4), (1, 4, "organic", "own.com", 9, 9), (1, 5, "organic", "rival.com", 5, 5), (2, 1, "map", None, 1, 1)], "keyword_id int, pos int, item_type string, domain string, rank_absolute int, rank_group int")
    features = {r.keyword_id: r for r in serp.serp_features(items).collect()}
    assert features[1].ads == 1 and features[1].ai_overview and not features[1].local_pack and features[2].local_pack
    targets = spark.createDataFrame([(1, 7, "www.own.com"), (2, 7, "own.com")], "keyword_id int, project_id int, domain string")
    assert {r.keyword_id: r.position for r in serp.serp_position(items, targets).collect()} == {1: 4, 2: None}
    seen = items.withColumn("refs", F.when(F.col("item_type") == "ai_overview", F.array(F.lit("www.z.com"), F.lit("Own.com"), F.lit("a.com"))))
    got = {r.keyword_id: r for r in serp.visibility_check(seen, targets).collect()}
    assert got[1].brand_in_ai_overview and got[1].organic_rank == 0 and got[1].competitor_domains == ["a.com", "z.com", "rival.com"] and not got[2].ai_overview_present


def test_suggested_queries(spark):
    rows = [(1, ["SEO, PPC, ads"], ["Local", "Paris", "Rome,Nice"], ["shops", "x"]), (2, ["SEO"], None, []), (3, None, ["Paris"], ["a"])]
    got = {}
    for r in serp.suggested_queries(spark.createDataFrame(rows, "project_id int, services array<string>, locations array<string>, audiences array<string>")).orderBy("project_id", "pos").collect():
        got.setdefault(r.project_id, []).append(r["query"])
    assert got == {1: ["best SEO in Paris", "best SEO in Rome", "SEO for shops", "best PPC in Paris", "best PPC in Rome"], 2: ["best SEO"]}


def test_saved_keywords_stay(spark):
    saved = spark.createDataFrame([(1, "a", 5)], "workspace_id int, keyword string, volume int")
    asked = spark.createDataFrame([(1, " A ", 1, 9), (1, "B", 3, 7), (1, "b ", 2, None), (2, "a", 4, 8), (1, "  ", 5, 1), (1, None, 6, 1)], "workspace_id int, keyword string, seq int, volume int")
    assert {(r.workspace_id, r.keyword): r.volume for r in keywords.save_keywords(saved, asked).collect()} == {(1, "a"): 5, (1, "b"): None, (2, "a"): 8}
