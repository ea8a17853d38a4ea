import numpy as np
from pyspark.sql import functions as F

from visigraph.llm import urls

PAGES = "page_id long, url string, host string, path string, rule string, verdict string, key string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "p", "r", "v", "k") for i, u in rows], PAGES)


URLS = ["http://a.example.org/es/x?y#z", "HTTPS://EXAMPLE.ORG/en/1066.html", "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/a", "http://x.com/de/a", "http://com/de/", "nothing", None, "", "://", "http://", "http://b.net", "http://b.net/", "http://www.b.net/index.html", "http://É.org/de/?://q", "http://u:p@x.org:80/a", "http://.org/x", "http://a..org/x", "http://x.org", "ftp://y.com/fr"]


def test_edge_rows_as_sql(spark, same_as_sql):
    same_as_sql(urls.op9_urls, urls.SQL, pages=pages(spark, [*enumerate(URLS), (5, URLS[5]), (None, URLS[0]), (99, "http://long.org/" + "a" * 50_000)]))


def test_empty_lists(spark):
    some = pages(spark, enumerate(URLS))
    none = spark.createDataFrame([], "host string, path string, verdict string")
    got = urls.judge(some, none, spark.createDataFrame([(None,)], "key string")).collect()
    assert len(got) == len(URLS) and {r.verdict for r in got} == {"allow"} and {r.rule for r in got} == {None}
    assert urls.judge(some.limit(0), urls.rules_of(spark), urls.repeated(some)).count() == 0


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    bloom = urls.build(keys, 20_000)
    assert bloom.shape == (urls.blocks_of(20_000), urls.WORDS) and bloom.dtype == np.uint64
    assert keys.where(~urls.passes(F.col("key"), bloom, spark)).count() == 0
    others = spark.range(20_000).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("key"))
    assert others.where(urls.passes(F.col("key"), bloom, spark)).count() < 400


def test_exact_join_removes_false_positives(spark, monkeypatch):
    monkeypatch.setattr(urls, "passes", lambda key, bloom, spark: F.lit(True))
    some = pages(spark, enumerate(URLS))
    loose = urls.judge(some, urls.rules_of(spark), urls.repeated(some))
    monkeypatch.undo()
    tight = urls.judge(some, urls.rules_of(spark), urls.repeated(some))
    columns = ["page_id", "rule", "verdict"]
    assert sorted(map(str, loose.select(columns).collect())) == sorted(map(str, tight.select(columns).collect()))


def test_a_filter_that_stays_a_table(spark, monkeypatch):
    some = pages(spark, enumerate(URLS))
    columns = ["page_id", "rule", "verdict"]
    small = sorted(map(str, urls.judge(some, urls.rules_of(spark), urls.repeated(some)).select(columns).collect()))
    monkeypatch.setattr(urls, "FILTER_BYTES", 0)
    monkeypatch.setattr(urls, "passes", None)
    assert sorted(map(str, urls.judge(some, urls.rules_of(spark), urls.repeated(some)).select(columns).collect())) == small
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    others = spark.range(20_000).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("key"))
    assert urls.possible(keys, keys, 20_000).count() == 20_000 and urls.possible(others, keys, 20_000).count() < 400
