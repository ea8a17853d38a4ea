"""The link graph of crawled sites."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import count_if, first_rows, latest_by
from ..functions.text import rtrim_slash


def store_links(links: DataFrame) -> DataFrame:
    """Links with both ends, flags without null; to be written over the partition of their task."""
    false = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    both = (F.coalesce("url_from", F.lit("")) != "") & (F.coalesce("url_to", F.lit("")) != "")
    return links.where(both).withColumns({"is_broken": false("is_broken"), "is_link_relation_conflict": false("is_link_relation_conflict")})


def write_links(links: DataFrame, path: str) -> None:
    """Replaces the rows of the tasks that links holds, and no others."""
    links.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(path)


def latest_fetched_task(tasks: DataFrame) -> DataFrame:
    return latest_by(tasks.where("status = 'fetched'"), ["project_id"], "finished_s", "task_id").select("project_id", "task_id")


def of_latest(links: DataFrame, tasks: DataFrame) -> DataFrame:
    return links.join(latest_fetched_task(tasks), ["project_id", "task_id"])


def link_mix(links: DataFrame) -> DataFrame:
    is_ = lambda c: count_if(c)
    return links.groupBy("project_id").agg(
        F.count("*").alias("total"), is_(F.col("is_broken")).alias("broken"), is_(F.col("direction") == "internal").alias("internal"), is_(F.col("direction") == "external").alias("external"),
        is_(F.col("dofollow")).alias("dofollow"), is_(~F.col("dofollow")).alias("nofollow"), is_(F.col("is_link_relation_conflict")).alias("conflicts"),
    )


def orphan_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """pages(project_id, url) that no internal link leads to, slashes at the end aside. Links of a page to itself count."""
    targets = links.where("direction = 'internal'").select("project_id", rtrim_slash(F.col("url_to")).alias("_u")).distinct()
    return pages.withColumn("_u", rtrim_slash(F.col("url"))).join(targets, ["project_id", "_u"], "left_anti").drop("_u")


def inbound_counts(links: DataFrame) -> DataFrame:
    return links.where("direction = 'internal'").groupBy("project_id", rtrim_slash(F.col("url_to")).alias("url")).agg(F.count("*").alias("inbound"))


def top_inbound(links: DataFrame, n: int = 15) -> DataFrame:
    return first_rows(inbound_counts(links), ["project_id"], [F.desc("inbound"), F.col("url")], n, "place")


def link_health(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(project_id, health): 100 less 300 times the share of broken links and 2 for each orphan, at least 0; 100 without links."""
    orphans = orphan_pages(pages, links).groupBy("project_id").agg(F.count("*").alias("orphans"))
    by = links.groupBy("project_id").agg(F.count("*").alias("total"), count_if(F.col("is_broken")).alias("broken")).join(orphans, "project_id", "full")
    n = F.coalesce("orphans", F.lit(0))
    health = F.when(F.col("total") > 0, F.greatest(F.lit(0.0), 100 - F.col("broken") / F.col("total").cast("double") * 300 - 2 * n)).otherwise(100.0)
    return by.select("project_id", F.bround(health, 0).cast("int").alias("health"), n.alias("orphans"))


def broken_links(links: DataFrame) -> DataFrame:
    return links.where("is_broken").withColumn("_s", F.coalesce("status_code", F.lit(0))).orderBy(F.desc("_s"), "url_from", "url_to").drop("_s")


class Graph:
    """Edges between numbered pages, stored once in buckets by where they start, so that a level of a search moves itself to them and not them to it."""

    def __init__(self, edges: DataFrame, starts: DataFrame, path: str):
        """edges(project_id, url_from, url_to) and starts(project_id, url); path is a new folder that all executors share."""
        spark = edges.sparkSession
        ends = edges.select("project_id", F.explode(F.array("url_from", "url_to")).alias("url"))
        self.pages = ends.unionByName(starts.select("project_id", "url")).distinct().withColumn("id", F.monotonically_increasing_id() + 1).checkpoint()
        self.starts = starts.select("project_id", "url").distinct().join(self.pages, ["project_id", "url"]).select("id").checkpoint()
        end = lambda c, name: self.pages.select("project_id", F.col("url").alias(c), F.col("id").alias(name))
        coded = edges.join(end("url_from", "src"), ["project_id", "url_from"]).join(end("url_to", "dst"), ["project_id", "url_to"]).select("src", "dst").distinct()
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"graph_{uuid.uuid4().hex}"
        coded.repartition(buckets, "src").write.bucketBy(buckets, "src").sortBy("src").option("path", path).saveAsTable(self.table)
        self.edges = spark.table(self.table)

    def following(self, level: DataFrame) -> DataFrame:
        """(id) of the pages that links from level(id) lead to."""
        return level.select(F.col("id").alias("src")).join(self.edges, "src").select(F.col("dst").alias("id")).distinct()

    def close(self) -> None:
        self.edges.sparkSession.sql(f"DROP TABLE {self.table}")


def bits(ids: DataFrame) -> DataFrame:
    """(part, bits) of ids(id): bitmaps of 32 768 ids each."""
    return ids.groupBy(F.bitmap_bucket_number("id").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def not_in(ids: DataFrame, seen: DataFrame) -> DataFrame:
    """ids(id) that are in none of the bitmaps seen(part, bits)."""
    place = F.bitmap_bit_position("id")
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, (place % 8).cast("int")) == 1
    met = ids.withColumn("part", F.bitmap_bucket_number("id")).join(seen, "part", "left")
    return met.where(F.col("bits").isNull() | ~held).select("id")


def crawl_frontier(edges: DataFrame, starts: DataFrame, path: str, max_depth: int | None = None, max_pages: int | None = None) -> DataFrame:
    """(project_id, url, depth) reachable from starts(project_id, url) over edges(project_id, url_from, url_to), breadth first; path is a new folder for
    the graph. A level joins the last one with the stored edges, and is checkpointed as numbers; what was seen is kept as bitmaps, a bit a page. It ends with
    an empty level, or at max_depth where that is given. With max_pages a project ends with that many pages; of the level that goes beyond, the first by url stay."""
    graph = Graph(edges, starts, path)
    level, levels = graph.starts, []
    seen, found = bits(level).checkpoint(), level.withColumn("depth", F.lit(0))
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        new = not_in(graph.following(level), seen)
        if max_pages is not None:
            taken = found.join(graph.pages, "id").groupBy("project_id").agg((max_pages - F.count("*")).alias("_room")).where("_room > 0")
            named = new.join(graph.pages, "id").join(taken, "project_id")
            new = first_rows(named, ["project_id"], [F.col("url")], max_pages).where("_n <= _room").select("id")
        level = new.checkpoint()
        if level.isEmpty():
            break
        seen = seen.unionByName(bits(level)).groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits")).checkpoint()
        found = found.unionByName(level.withColumn("depth", F.lit(depth)))
        levels.append(depth)
        if len(levels) % 32 == 0:  # keeps the plan small
            found = found.checkpoint()
    graph.close()
    return found.join(graph.pages, "id").select("project_id", "url", "depth")


def plan_crawl(homes: DataFrame, sitemap: DataFrame, found: DataFrame, max_pages: int = 100) -> DataFrame:
    """(project_id, place, url): the home page first, then sitemap URLs, or those found by links where the sitemap has none.
    sitemap(project_id, pos, url); found(project_id, depth, url)."""
    none = found.join(sitemap.select("project_id").distinct(), "project_id", "left_anti").select("project_id", F.col("depth").alias("pos"), "url")
    rest = sitemap.select("project_id", "pos", "url").unionByName(none)
    own = homes.select("project_id", F.lit(-1).alias("pos"), "url").unionByName(rest.join(homes.select("project_id", "url"), ["project_id", "url"], "left_anti"))
    once = own.groupBy("project_id", "url").agg(F.min("pos").alias("pos"))
    return first_rows(once, ["project_id"], [F.col("pos"), F.col("url")], max_pages, "place").select("project_id", "place", "url")
