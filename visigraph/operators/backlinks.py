"""Backlinks: one pull against what is stored, the history of many pulls in one pass, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import first_rows, latest_by, ranked
from ..functions.text import to_int, url_domain

KEY = ["project_id", "source_url", "target_url"]


def backlink_diff(stored: DataFrame, pull: DataFrame, pulled: DataFrame, now: Column) -> DataFrame:
    """The records after a pull, with `change` (new, active, lost, gone).

    stored: key, anchor, is_follow, domain_rank, spam_score, first_seen, last_seen, lost_at; pull: key, seq, anchor, nofollow,
    domain_rank, spam_score, of which the last row of a key counts; pulled: the project_id of each pull that succeeded, empty ones too.
    Other projects are left as they are."""
    clean = pull.where((F.coalesce("source_url", F.lit("")) != "") & (F.coalesce("target_url", F.lit("")) != ""))
    fresh = clean.groupBy(*KEY).agg(F.max_by(F.struct("anchor", "nofollow", "domain_rank", "spam_score"), "seq").alias("n"))
    pulled = pulled.select("project_id").distinct().withColumn("_pulled", F.lit(True))
    old = stored.select(*KEY, F.struct(*(c for c in stored.columns if c not in KEY)).alias("o"))
    both = old.join(fresh, KEY, "full").join(pulled, "project_id", "left")
    was, is_, ran = F.col("o").isNotNull(), F.col("n").isNotNull(), F.coalesce("_pulled", F.lit(False))
    live = was & F.col("o.lost_at").isNull()
    lost = ran & live & ~is_
    return both.select(
        *KEY,
        F.when(was, F.col("o.anchor")).otherwise(F.col("n.anchor")).alias("anchor"),
        F.when(was, F.col("o.is_follow")).otherwise(F.coalesce(F.lower("n.nofollow"), F.lit("")) != "true").alias("is_follow"),
        F.coalesce("n.domain_rank", "o.domain_rank").alias("domain_rank"),
        F.coalesce("n.spam_score", "o.spam_score").alias("spam_score"),
        F.when(was, F.col("o.first_seen")).otherwise(now).alias("first_seen"),
        F.when(is_, now).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.when(lost, now).when(~is_, F.col("o.lost_at")).alias("lost_at"),
        F.when(~was, "new").when(is_, "active").when(lost, "lost").otherwise("gone").alias("change"),
    )


def diff_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("project_id").agg(*(F.count_if(F.col("change") == c).alias(n) for c, n in (("new", "new"), ("lost", "lost"), ("active", "still_active"))))


def backlink_history(pulls: DataFrame, calendar: DataFrame) -> DataFrame:
    """The records after all pulls in one pass: pulls(key, pull_no, domain_rank, ...), calendar(project_id, pull_no) of the pulls that
    succeeded, empty ones too. first and last are those of the links; lost is the first pull after the last one that had it; episodes
    counts its runs of consecutive pulls. anchor and is_follow are those of the first pull, spam_score is the latest known; they are given where
    pulls have them."""
    # a project has few pulls, so they are joined as one list, by project alone: pulls that are dealt by project stay where they are
    days = calendar.where("pull_no IS NOT NULL").groupBy("project_id").agg(F.array_sort(F.collect_set("pull_no")).alias("_days"))
    dated = pulls.join(days, "project_id").withColumn("k", F.array_position("_days", F.col("pull_no"))).where("k > 0")
    rows = dated.withColumn("following", F.get("_days", F.col("k").cast("int"))).drop("_days")
    island = rows.withColumn("_new", (F.col("k") - F.coalesce(F.lag("k").over(Window.partitionBy(*KEY).orderBy("k")), F.lit(-1)) > 1).cast("int"))
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pull_no"))).alias(c)
    more = [F.min_by(c, "pull_no").alias(c) for c in ("anchor", "is_follow") if c in pulls.columns] + [known(c) for c in ("spam_score",) if c in pulls.columns]
    return island.groupBy(*KEY).agg(F.min("pull_no").alias("first_seen"), F.max("pull_no").alias("last_seen"), F.max_by("following", "pull_no").alias("lost_at"), F.sum("_new").alias("episodes"), known("domain_rank"), *more)


def fold_history(history: DataFrame, later: DataFrame, calendar: DataFrame) -> DataFrame:
    """The history of all pulls from that of the earlier ones and that of later ones, both as backlink_history gives them; old pulls aren't read again.
    calendar(project_id, pull_no) is that of the later pulls, all of which follow the earlier ones of their project. Folding part after part gives
    what one pass over all pulls gives. A link is still open where lost_at is null: a run goes on if the link is in the first of the later pulls."""
    begins = calendar.groupBy("project_id").agg(F.min("pull_no").alias("_begin"))
    parts = history.withColumn("_part", F.lit(0)).unionByName(later.withColumn("_part", F.lit(1))).join(begins, "project_id", "left")
    old, new = F.col("_part") == 0, F.col("_part") == 1
    goes_on = F.bool_or(old & F.col("lost_at").isNull()) & F.bool_or(new & (F.col("first_seen") == F.col("_begin")))
    lost = F.when(F.max("_part") == 1, F.max(F.when(new, F.col("lost_at")))).otherwise(F.coalesce(F.max(F.when(old, F.col("lost_at"))), F.max("_begin")))
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_part"))).alias(c)
    more = [F.min_by(c, "_part").alias(c) for c in ("anchor", "is_follow") if c in history.columns] + [known(c) for c in ("spam_score",) if c in history.columns]
    return parts.groupBy(*KEY).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), lost.alias("lost_at"), (F.sum("episodes") - F.when(goes_on, 1).otherwise(0)).alias("episodes"), known("domain_rank"), *more)


def backlink_tabs(records: DataFrame, limit: int = 200) -> DataFrame:
    """(project_id, tab, place, ...): active by last_seen, lost by lost_at, new (of the project's latest first_seen) by source."""
    newest = records.groupBy("project_id").agg(F.max("first_seen").alias("_newest"))
    rows = records.join(newest, "project_id")
    tab = lambda name, keep, *order: first_rows(rows.where(keep), ["project_id"], [*order, F.col("source_url"), F.col("target_url")], limit, "place").withColumn("tab", F.lit(name))
    live = F.col("lost_at").isNull()
    return tab("active", live, F.desc("last_seen")).unionByName(tab("lost", ~live, F.desc("lost_at"))).unionByName(tab("new", F.col("first_seen") == F.col("_newest"))).drop("_newest")


def latest_overview(projects: DataFrame, snapshots: DataFrame) -> DataFrame:
    last = latest_by(snapshots, ["project_id"], "fetched_at", "id")
    return projects.join(last, "project_id", "left").withColumn("no_snapshot_yet", F.col("id").isNull())


def normalize_overview(rows: DataFrame) -> DataFrame:
    """rows(project_id, error, no_data, authority, total_backlinks, referring_pages, referring_pages_nofollow strings) to a status and
    whole numbers: error, no_data (said so, or without authority), ok."""
    failed = F.coalesce("error", F.lit("")) != ""
    none = F.coalesce("no_data", F.lit(False)) | to_int(F.col("authority")).isNull()
    status = F.when(failed, "error").when(none, "no_data").otherwise("ok")
    number = lambda c: F.when(status == "ok", to_int(F.col(c))).alias(c)
    follow = F.when(status == "ok", to_int(F.col("referring_pages")) - F.coalesce(to_int(F.col("referring_pages_nofollow")), F.lit(0)))
    return rows.select("project_id", status.alias("status"), number("authority"), number("total_backlinks"), follow.alias("follow_links"), F.when(failed, F.col("error")).alias("error"))


#: Anchors that name nothing.
GENERIC = ("click here", "here", "read more", "learn more", "website", "this site", "visit", "link", "more", "this")


def anchor_kind(anchor: Column, brand: Column, exact: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(anchor, F.lit(""))))
    return F.when((brand != "") & F.contains(text, F.lower(brand)), "branded").when(exact, "exact_match").when(text.isin(*GENERIC), "generic").when(text.rlike(r"^(?:https?://|www\.)|^[a-z0-9-]+(?:\.[a-z0-9-]+)+/?$"), "naked_url").otherwise("other")


def anchors(records: DataFrame, brands: DataFrame, tracked: DataFrame) -> DataFrame:
    """records with `kind`. brands(project_id, brand); tracked(project_id, keyword)."""
    words = tracked.select("project_id", F.lower("keyword").alias("_a")).distinct().withColumn("_exact", F.lit(True))
    rows = records.join(brands, "project_id", "left").withColumn("_a", F.lower(F.trim(F.col("anchor")))).join(words, ["project_id", "_a"], "left")
    return rows.withColumn("kind", anchor_kind(F.col("anchor"), F.coalesce("brand", F.lit("")), F.coalesce("_exact", F.lit(False)))).drop("_a", "_exact", "brand")


def anchor_distribution(records: DataFrame, brands: DataFrame, tracked: DataFrame) -> DataFrame:
    by = anchors(records, brands, tracked).groupBy("project_id", "kind").agg(F.count("*").alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("project_id")))


def toxic_links(records: DataFrame, brands: DataFrame, tracked: DataFrame, spam_tlds: tuple = ("xyz", "top", "click"), repeats: int = 5, low: int = 10) -> DataFrame:
    """Records with reasons to distrust them; repeats are counted by aggregate and joined, so one domain's links don't meet in a window."""
    rows = anchors(records, brands, tracked).withColumn("domain", url_domain(F.col("source_url"))).withColumn("_a", F.lower(F.trim(F.coalesce("anchor", F.lit("")))))
    many = rows.groupBy("project_id", "domain", "_a").agg(F.count("*").alias("_n")).where(F.col("_n") > repeats)
    reasons = F.array_compact(
        F.array(
            F.when((F.coalesce("domain_rank", F.lit(0)) < low) & (F.col("kind") == "exact_match"), "low_authority_exact_match"),
            F.when(F.element_at(F.split("domain", r"\."), -1).isin(*spam_tlds), "spam_tld"),
            F.when(F.col("_n").isNotNull(), "repeated_anchor"),
        )
    )
    return rows.join(many, ["project_id", "domain", "_a"], "left").withColumn("reasons", reasons).drop("_a", "_n").where(F.size("reasons") > 0)


def backlink_gap(own: DataFrame, rivals: DataFrame) -> DataFrame:
    """(project_id, domain, rivals, authority, links) of domains that link to competitors but not to the project, ranked.
    own(project_id, source_url); rivals(project_id, competitor, source_url, domain_rank)."""
    linked = rivals.withColumn("domain", url_domain(F.col("source_url"))).groupBy("project_id", "domain", "competitor").agg(F.max("domain_rank").alias("a"), F.count("*").alias("l"))
    by = linked.groupBy("project_id", "domain").agg(F.count("*").alias("rivals"), F.max("a").alias("authority"), F.sum("l").alias("links"))
    has = own.select("project_id", url_domain(F.col("source_url")).alias("domain")).distinct()
    return ranked(by.join(has, ["project_id", "domain"], "left_anti"), ["project_id"], [F.desc("rivals"), F.desc("authority"), F.desc("links"), F.col("domain")])

