"""Sources and sinks: provider reports as text, JSON items, sitemaps, and the keyword export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import rtrim_slash, strip

#: The report's column names and the short codes that jobs use.
HEADERS = {
    "Keyword": "Ph", "Search Volume": "Nq", "CPC": "Cp", "Competition": "Co", "Keyword Difficulty Index": "Kd", "Intent": "In", "Trends": "Td",
    "Number of Results": "Nr", "Domain": "Dn", "Url": "Ur", "Rank": "Rk", "Organic Keywords": "Or", "Organic Traffic": "Ot", "Organic Cost": "Oc",
}
CODES = tuple(HEADERS.values())


def read_report_files(spark: SparkSession, path: str) -> DataFrame:
    """Report files with a header each, columns by code; the format has no quoting."""
    rows = spark.read.csv(path, sep=";", header=True, quote="", escape="")
    return rows.withColumnsRenamed({c: HEADERS.get(c.strip(), c.strip()) for c in rows.columns})


def parse_reports(bodies: DataFrame) -> DataFrame:
    """bodies(id, body) to (id, line, a column for each code): ; without quoting, CRLF or LF, blank lines dropped, a body of fewer than two lines
    (an error message) is empty."""
    lines = F.filter(F.transform(F.split(F.coalesce("body", F.lit("")), r"\r\n|\n|\r"), strip), lambda x: x != "")
    rows = bodies.select("id", lines.alias("_l")).where(F.size("_l") >= 2)
    codes = F.create_map(*(F.lit(x) for pair in HEADERS.items() for x in pair))
    head = F.transform(F.split(F.col("_l")[0], ";"), lambda h: F.coalesce(F.try_element_at(codes, strip(h)), strip(h)))
    exploded = rows.select("id", head.alias("_h"), F.posexplode(F.slice("_l", 2, 1_000_000_000)).alias("line", "_x"))
    cells = F.split("_x", ";")
    value = lambda c: F.get(cells, (F.array_position("_h", c) - 1).cast("int"))
    return exploded.select("id", "line", *(F.when(F.array_contains("_h", c), value(c)).alias(c) for c in CODES))


KEYWORD_ITEM = "keyword string, keyword_info struct<search_volume:long,cpc:double>, keyword_properties struct<keyword_difficulty:int>, search_intent_info struct<main_intent:string>"


def read_keyword_json(rows: DataFrame) -> DataFrame:
    """rows(keyword, json) to keyword, volume, difficulty, intent, cpc; the item's keyword counts before the asked one."""
    item = rows.withColumn("j", F.from_json("json", KEYWORD_ITEM))
    return item.select(F.coalesce("j.keyword", "keyword").alias("keyword"), F.col("j.keyword_info.search_volume").alias("volume"), F.col("j.keyword_properties.keyword_difficulty").alias("difficulty"), F.col("j.search_intent_info.main_intent").alias("intent"), F.col("j.keyword_info.cpc").alias("cpc"))


ONPAGE_ITEM = "url string, onpage_score double, checks map<string,boolean>, content struct<plain_text_word_count:int>, social_media_tags map<string,string>, meta struct<title:string,description:string,meta_keywords:string,canonical:string,htags:struct<h1:array<string>,h2:array<string>>,images:array<struct<src:string,alt:string>>>"


def read_onpage_json(rows: DataFrame) -> DataFrame:
    """rows(id, json) of on-page items to page columns, checks and social tags."""
    j = rows.withColumn("j", F.from_json("json", ONPAGE_ITEM))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    tag = lambda k: F.try_element_at(F.col("j.social_media_tags"), F.lit(k))
    return j.select(
        "id", "j.url", "j.meta.title", F.col("j.meta.description").alias("meta_description"), "j.meta.meta_keywords", "j.meta.canonical",
        none(F.col("j.meta.htags.h1"), "array<string>").alias("h1"), none(F.col("j.meta.htags.h2"), "array<string>").alias("h2"), none(F.col("j.meta.images"), "array<struct<src:string,alt:string>>").alias("image_alts"),
        tag("og:title").alias("og_title"), tag("og:description").alias("og_description"), tag("twitter:card").alias("twitter_card"),
        F.col("j.content.plain_text_word_count").alias("word_count"), "j.onpage_score",
        F.coalesce("j.checks", F.create_map().cast("map<string,boolean>")).alias("checks"), F.coalesce("j.social_media_tags", F.create_map().cast("map<string,string>")).alias("social"),
    )


BACKLINK_ITEMS = "items array<struct<url_from:string,url_to:string,anchor:string,dofollow:boolean,domain_from_rank:int,backlink_spam_score:int,first_seen:string>>"


def read_backlink_json(rows: DataFrame) -> DataFrame:
    """rows(project_id, json) to a row for each link of the items; nofollow is what is not dofollow."""
    items = rows.select("project_id", F.posexplode(F.from_json("json", BACKLINK_ITEMS)["items"]).alias("seq", "i"))
    return items.select("project_id", "seq", F.col("i.url_from").alias("source_url"), F.col("i.url_to").alias("target_url"), "i.anchor", (~F.coalesce("i.dofollow", F.lit(False))).cast("string").alias("nofollow"), F.col("i.domain_from_rank").alias("domain_rank"), F.col("i.backlink_spam_score").alias("spam_score"), "i.first_seen")


#: Where sitemaps are looked for, in this order.
COMMON_PATHS = ("sitemap.xml", "sitemap_index.xml", "sitemap-index.xml", "wp-sitemap.xml", "sitemap1.xml", "post-sitemap.xml", "page-sitemap.xml")
DEEPEST = 4


def _order(path: Column, pos: Column) -> Column:
    return F.concat(path, F.lpad(pos.cast("string"), 9, "0"), F.lit("/"))


def extract_sitemap_urls(bodies: DataFrame, origins: DataFrame, max_pages: int = 100) -> DataFrame:
    """(origin, pos, url) from fetched bodies(url, body, status) for origins(origin): sitemaps that robots.txt names, then common paths; the first that
    yields any URL of the origin counts. Indexes are followed to a depth of 4 by joins; URLs lose query and end slashes, repeats and
    other origins are left out. Each level is checkpointed, so the session needs a folder for that."""
    ok = bodies.where("status = 200 AND body <> ''").dropDuplicates(["url"])
    robots = origins.join(ok, ok.url == F.concat("origin", F.lit("/robots.txt"))).select("origin", F.posexplode(F.split("body", r"\r\n|\n|\r")).alias("pos", "line"))
    named = robots.select("origin", "pos", F.regexp_extract("line", r"^(?i:Sitemap):\s*(.+)$", 1).alias("url")).where("url <> ''").withColumn("url", strip(F.col("url")))
    common = origins.select("origin", F.posexplode(F.array(*map(F.lit, COMMON_PATHS))).alias("pos", "p")).select("origin", (F.col("pos") + 1_000_000).alias("pos"), F.concat("origin", F.lit("/"), "p").alias("url"))
    candidates = named.unionByName(common).groupBy("origin", "url").agg(F.min("pos").alias("candidate"))
    locs = F.transform(F.regexp_extract_all("body", F.lit(r"(?s)<loc>(.*?)</loc>"), F.lit(1)), lambda x: F.regexp_replace(strip(x), "&amp;", "&"))
    parsed = ok.select("url", F.contains("body", F.lit("<sitemapindex")).alias("index"), (F.contains("body", F.lit("<urlset")) | F.contains("body", F.lit("<url>"))).alias("list"), locs.alias("locs")).where("index OR list").checkpoint()
    level = candidates.select("origin", "candidate", "url", F.lit("").alias("path")).checkpoint()
    visited, found = level.select("origin", "candidate", "url"), None
    for _ in range(DEEPEST + 1):
        read = level.join(parsed, "url").select("origin", "candidate", "path", "index", "list", F.posexplode("locs").alias("pos", "loc")).checkpoint()
        urls = read.where("list AND NOT index").select("origin", "candidate", _order(F.col("path"), F.col("pos")).alias("path"), F.col("loc").alias("url"))
        found = urls if found is None else found.unionByName(urls)
        below = read.where("index").select("origin", "candidate", F.col("loc").alias("url"), _order(F.col("path"), F.col("pos")).alias("path"))
        level = below.join(visited, ["origin", "candidate", "url"], "left_anti").groupBy("origin", "candidate", "url").agg(F.min("path").alias("path")).checkpoint()
        if level.isEmpty():
            break
        visited = visited.unionByName(level.select("origin", "candidate", "url"))
    clean = found.withColumn("url", rtrim_slash(F.regexp_replace("url", r"\?.*$", "")))
    own = clean.where(F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*", 0) == F.col("origin")).groupBy("origin", "candidate", "url").agg(F.min("path").alias("path"))
    first = own.groupBy("origin").agg(F.min("candidate").alias("candidate"))
    n = F.row_number().over(Window.partitionBy("origin").orderBy("path", "url"))
    return own.join(first, ["origin", "candidate"]).withColumn("pos", n).where(F.col("pos") <= max_pages).select("origin", "pos", "url")


def keyword_export(view: DataFrame) -> DataFrame:
    """The columns of the export, empty for unknown values."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return view.select(F.col("keyword").alias("Keyword"), text("volume").alias("Volume"), text("difficulty").alias("Difficulty"), text("intent").alias("Intent"), F.col("trend").alias("Trend"))


def write_keyword_export(view: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header; one file with a byte order mark for spreadsheets where it is asked for, which one task then writes."""
    rows = keyword_export(view)
    if single_file:
        rows = rows.coalesce(1).withColumnRenamed("Keyword", "﻿Keyword")
    rows.write.mode("overwrite").option("header", True).csv(path)
