"""Upserts and migrations. Plain files have no MERGE: the new state is a DataFrame that is written over the old one's path or partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import first_rows, ranked


def upsert_pages(stored: DataFrame, results: DataFrame) -> DataFrame:
    """The pages after crawl results(project_id, url, seq, ...): the last result of a page replaces all of its columns, and those that it
    lacks become null. stored has the same columns but seq."""
    columns = [c for c in stored.columns if c not in ("project_id", "url")]
    both = stored.withColumn("_o", F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("seq"))).unionByName(results.withColumn("_o", F.struct(F.lit(1).alias("batch"), F.col("seq").cast("long").alias("seq"))).drop("seq"), allowMissingColumns=True)
    return both.groupBy("project_id", "url").agg(F.max_by(F.struct(*columns), "_o").alias("r")).select("project_id", "url", "r.*").select(stored.columns)


def crawl_counts(results: DataFrame) -> DataFrame:
    failed = F.coalesce("error", F.lit("")) != ""
    return results.groupBy("project_id").agg(F.count_if(~failed).alias("ok"), F.count_if(failed).alias("errors"))


NORMALIZED = ("title", "meta_description", "canonical", "h1", "h2", "og_title", "og_description", "twitter_card")


def upsert_onpage(stored: DataFrame, results: DataFrame, columns: tuple = NORMALIZED) -> DataFrame:
    """Pages keyed by project, url and source: only the normalised columns are overwritten, others stay."""
    keys = ["project_id", "url", "source"]
    own = [c for c in columns if c in results.columns and c in stored.columns]
    last = results.groupBy(*keys).agg(F.max_by(F.struct(*own), "seq").alias("_r"))
    out = stored.join(last, keys, "full")
    return out.select(*keys, *(F.when(F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in stored.columns if c not in keys))


def replace_issues(stored: DataFrame, fresh: DataFrame, audited: DataFrame, keys: tuple = ("project_id",)) -> DataFrame:
    """Stored issues without those of the keys that were audited again, and the fresh ones. audited holds the keys, of clean pages too."""
    return stored.join(audited.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def audit_summary(audited: DataFrame, fresh: DataFrame) -> DataFrame:
    """(project_id, pages_audited, issues_found), with 0 for projects that are clean. audited has a row for each page."""
    pages, issues = audited.groupBy("project_id").agg(F.count("*").alias("pages_audited")), fresh.groupBy("project_id").agg(F.count("*").alias("issues_found"))
    return pages.join(issues, "project_id", "left").withColumn("issues_found", F.coalesce("issues_found", F.lit(0)))


def crawl_snapshots(results: DataFrame) -> DataFrame:
    """The rows that a crawl appends to the snapshots: every result(project_id, url, seq, ...), what it found as one struct."""
    return results.select("project_id", "url", "seq", F.struct(*(c for c in results.columns if c not in ("project_id", "url", "seq"))).alias("data"))


def reshape_profiles(flat: DataFrame) -> DataFrame:
    """Flat profile fields as arrays: one service and audience, the place joined by commas, then the primary market."""
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    place = F.concat_ws(", ", given("city"), given("state_region"), given("country"))
    return flat.select("id", F.col("business_name").alias("brand"), F.array_compact(F.array(given("products_services"))).alias("services"), F.array_compact(F.array(F.when(place != "", place), given("primary_market"))).alias("locations"), F.array_compact(F.array(given("target_audience"))).alias("audiences"), F.col("brand_tone").alias("tone"), F.col("business_description").alias("usp"))


def backfill_workspaces(tracked: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(workspaces, tracked, saved): a workspace for each project with keywords, and the keywords under their workspace. Ids are made from
    project ids, so no task numbers all rows; the counts of rows stay, as every project has a workspace."""
    projects = tracked.select("project_id").union(saved.select("project_id")).where("project_id IS NOT NULL").distinct()
    workspaces = projects.select(F.col("project_id").alias("workspace_id"), "project_id")
    key = lambda df: df.join(workspaces, "project_id", "left")
    return workspaces, key(tracked), key(saved)


def job_board(jobs: DataFrame, recent: int = 20) -> DataFrame:
    """Running jobs by newest, queued by oldest, the latest completed and failed, with board and place."""
    board = F.when(F.col("status").isin("failed", "cancelled"), "failed").otherwise(F.col("status"))
    rows = jobs.withColumn("board", board)
    # a queue may be long, so it is ranked by ranges; what runs counts from the newest, what waits from the oldest
    newest = F.when(F.col("board") == "running", F.unix_micros(F.col("created_at").cast("timestamp")))
    live = ranked(rows.where("board IN ('queued', 'running')"), ["project_id", "board"], [F.desc(newest), F.col("created_at"), F.col("id")])
    done = first_rows(rows.where("board IN ('completed', 'failed')"), ["project_id", "board"], [F.desc("created_at"), F.col("id")], recent, "place")
    return live.unionByName(done)


def job_badges(jobs: DataFrame) -> DataFrame:
    """(project_id, badge): how many jobs run or wait."""
    return jobs.groupBy("project_id").agg(F.count_if(F.col("status").isin("running", "queued")).alias("badge"))
