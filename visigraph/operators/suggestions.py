"""Proposed fixes: merging, repair, the replay of decisions, and what is built for and read from a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import latest_by, ranked
from ..functions.text import content_hash, strip, stripped

DECIDED = ("accepted", "edited", "deployed")


def decided() -> Column:
    return F.col("status").isin(*DECIDED)


def merge_suggestions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The suggestions of an issue after new texts came: decided ones stay, undecided ones go, new texts that repeat a decided value (edited
    or not) or each other are left out, and the new ones are ranked from 1. stored: id, issue_id, content, edited_content, status, rank;
    fresh: issue_id, pos, content. Issues without new texts are left as they are."""
    asked = fresh.select("issue_id").distinct()
    kept = stored.where(decided()).unionByName(stored.where(~decided()).join(asked, "issue_id", "left_anti"))
    value = F.when(F.coalesce("edited_content", F.lit("")) != "", F.col("edited_content")).otherwise(F.col("content"))
    taken = stored.where(decided()).select("issue_id", content_hash(value).alias("_h")).distinct()
    new = fresh.withColumn("_h", content_hash(F.col("content"))).join(taken, ["issue_id", "_h"], "left_anti")
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy("issue_id", "_h").orderBy("pos"))).where("_n = 1")
    new = new.withColumn("rank", F.row_number().over(Window.partitionBy("issue_id").orderBy("pos")))
    shape = {f.name: f.dataType for f in stored.schema}
    none = lambda c: F.lit(None).cast(shape[c]).alias(c)
    rows = new.select(none("id"), "issue_id", "content", none("edited_content"), F.lit("pending").alias("status"), F.col("rank").cast(shape["rank"]))
    return kept.select(rows.columns).unionByName(rows)


def dedupe_suggestions(rows: DataFrame) -> DataFrame:
    """rows(id, issue_id, content, status, created_at_s, has_revision) with `fate` keep, delete or protected: of equal texts of an issue the oldest
    decided stays, else the oldest; others go unless they have a revision."""
    hashed = rows.withColumn("_h", content_hash(F.col("content")))
    order = Window.partitionBy("issue_id", "_h").orderBy(decided().desc(), "created_at_s", "id")
    n = F.row_number().over(order)
    return hashed.withColumn("_n", n).withColumn("fate", F.when(F.col("_n") == 1, "keep").when(F.col("has_revision"), "protected").otherwise("delete")).drop("_h", "_n")


def demote_superseded(rows: DataFrame) -> DataFrame:
    """Of several deployed suggestions of an issue only the newest stays deployed. rows(id, issue_id, status, deployed_at)."""
    newest = rows.where("status = 'deployed'").groupBy("issue_id").agg(F.max_by("id", F.struct("deployed_at", "id")).alias("_id"))
    return rows.join(newest, "issue_id", "left").withColumn("status", F.when((F.col("status") == "deployed") & (F.col("id") != F.col("_id")), "accepted").otherwise(F.col("status"))).drop("_id")


#: A suggestion before its first event, and the status that each action leads to.
FRESH = {"status": "pending", "content": None, "applied": 0, "refused": 0}
LEADS_TO = {"accept": "accepted", "reject": "rejected", "edit": "edited", "deploy": "deployed", "rollback": "accepted"}
STATE = "struct<status:string,content:string,applied:int,refused:int>"


def after(state: Column, event: Column) -> Column:
    """The map of suggestions to their state after an event(suggestion_id, action, content). A deployed suggestion takes a rollback only; a deploy
    takes what is accepted or edited, and sends the deployed one of the issue back."""
    fresh = F.struct(*(F.lit(v).alias(k) for k, v in FRESH.items())).cast(STATE)
    key, action, text = event["suggestion_id"], event["action"], stripped(event["content"])
    own = F.coalesce(F.element_at(state, key), fresh)
    deployed = own["status"] == "deployed"
    ok = F.coalesce(F.when(action == "deploy", own["status"].isin("accepted", "edited")).when(action == "rollback", deployed).when(action == "edit", ~deployed & (text != "")).when(action.isin("accept", "reject"), ~deployed), F.lit(False))
    status = F.when(ok, F.element_at(F.create_map(*(F.lit(x) for pair in LEADS_TO.items() for x in pair)), action)).otherwise(own["status"])
    new = F.struct(status.alias("status"), F.when(ok & (action == "edit"), text).otherwise(own["content"]).alias("content"), (own["applied"] + ok.cast("int")).alias("applied"), (own["refused"] + (~ok).cast("int")).alias("refused")).cast(STATE)
    back = lambda x: F.when(ok & (action == "deploy") & (x["status"] == "deployed"), x.withField("status", F.lit("accepted"))).otherwise(x)
    others = F.transform_values(F.map_filter(state, lambda k, _: k != key), lambda _, x: back(x))
    return F.map_concat(others, F.create_map(key, new))


def suggestion_lifecycle(log: DataFrame) -> DataFrame:
    """log(issue_id, suggestion_id, ts, seq, action, content) to (issue_id, suggestion_id, status, content, applied, refused): the final status of each
    suggestion, and how many events were applied and refused. Deploys change siblings, so an issue's events are folded in order; an issue has few."""
    events = F.array_sort(F.collect_list(F.struct("ts", "seq", F.col("suggestion_id").cast("long").alias("suggestion_id"), "action", "content")))
    none = F.create_map().cast(f"map<bigint,{STATE}>")
    folded = log.groupBy("issue_id").agg(events.alias("events")).select("issue_id", F.aggregate("events", none, after).alias("state"))
    return folded.select("issue_id", F.explode("state").alias("suggestion_id", "_s")).select(F.col("issue_id").cast("long").alias("issue_id"), "suggestion_id", "_s.*")


#: The page column that a deployed category changes.
FIELDS = {"title": "title", "meta_description": "meta_description", "h1": "h1", "twitter": "twitter_title", "canonical": "canonical", "opengraph": "og_title"}


def apply_deploys(pages: DataFrame, revisions: DataFrame) -> DataFrame:
    """pages with the newest deployed value of each field. revisions(id, page_id, field_name, after_value, created_at)."""
    last = latest_by(revisions.where(F.col("field_name").isin(*FIELDS)).select("page_id", "field_name", "id", "created_at", "after_value"), ["page_id", "field_name"], "created_at", "id")
    wide = last.groupBy("page_id").pivot("field_name", list(FIELDS)).agg(F.first("after_value")).select("page_id", *(F.col(f).alias(f"_{f}") for f in FIELDS))
    out = pages.join(wide, "page_id", "left")
    for field, column in FIELDS.items():
        if column in pages.columns:
            value = F.when(F.col(f"_{field}").isNotNull(), F.array(f"_{field}")) if column == "h1" else F.col(f"_{field}")
            out = out.withColumn(column, F.coalesce(value, F.col(column)))
    return out.select(pages.columns)


def revision_history(revisions: DataFrame) -> DataFrame:
    """Revisions by project, the newest first, with their place."""
    return ranked(revisions, ["project_id"], [F.desc("created_at"), F.desc("id")])


INTERNAL_TYPES = ("media", "menu-items", "blocks", "templates", "template-parts", "global-styles", "navigation", "font-families")


def resolve_posts(pages: DataFrame, posts: DataFrame) -> DataFrame:
    """pages(page_id, project_id, url) with post_id, post_type and status: the first post type (posts, pages, others by name) that has exactly one
    post of the URL's last part; a home page, no match or only ambiguous ones are no_data. posts(project_id, post_type, slug, post_id)."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    slugged = pages.withColumn("_slug", F.regexp_extract(path, "[^/]*$", 0))
    kind = F.struct(F.when(F.col("post_type") == "posts", 0).when(F.col("post_type") == "pages", 1).otherwise(2).alias("rank"), F.col("post_type").alias("name"))
    single = posts.where(~F.col("post_type").isin(*INTERNAL_TYPES)).groupBy("project_id", "slug", "post_type").agg(F.count("*").alias("n"), F.first("post_id").alias("post_id")).where("n = 1")
    best = single.groupBy("project_id", F.col("slug").alias("_slug")).agg(F.min_by(F.struct("post_id", "post_type"), kind).alias("_b"))
    out = slugged.join(best.where("_slug <> ''"), ["project_id", "_slug"], "left")
    return out.select(*pages.columns, F.col("_b.post_id").alias("post_id"), F.col("_b.post_type").alias("post_type"), F.when(F.col("_b").isNotNull(), "ok").otherwise("no_data").alias("status"))


def parse_numbered(answers: DataFrame, most: int = 3) -> DataFrame:
    """answers(id, text) to (id, pos, suggestion): lines that begin with 1. to 3., without the number, at most three."""
    lines = F.transform(F.split("text", r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"), strip)
    pattern = rf"^[1-{most}]\."
    kept = F.slice(F.transform(F.filter(lines, lambda x: x.rlike(pattern)), lambda x: strip(F.regexp_replace(x, pattern, ""))), 1, most)
    return answers.select("id", F.posexplode(kept).alias("pos", "suggestion"))


UNDERSTANDING = "page_type string, main_topic string, search_intent string, primary_keyword string, secondary_keywords array<string>, relevant_service string, relevant_location string, relevant_audience string, geo_relevance string, context_confidence double, _bad string"
REQUIRED = ("page_type", "main_topic", "search_intent", "primary_keyword", "geo_relevance", "context_confidence")


def parse_understanding(answers: DataFrame) -> DataFrame:
    """answers(id, text) with the typed fields of `u`, and valid: code fences go, what is no object or lacks a required field is to be asked again."""
    text = stripped(F.col("text"))
    inner = strip(F.regexp_replace(F.regexp_replace(text, "^`+|`+$", ""), "^(?i:json)", ""))
    bare = F.when(text.startswith("```"), inner).otherwise(text)
    parsed = answers.withColumn("u", F.from_json(bare, UNDERSTANDING, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    whole = F.col("u._bad").isNull()
    for f in REQUIRED:
        whole = whole & F.col(f"u.{f}").isNotNull()
    return parsed.withColumn("valid", F.coalesce(whole, F.lit(False))).withColumn("u", F.col("u").dropFields("_bad"))


def suggestion_context(found: DataFrame, values: DataFrame, understanding: DataFrame, profiles: DataFrame) -> DataFrame:
    """A prompt's parts for each issue: url, issue, current value, what is understood of the page, and of the profile only what applies;
    the location only for pages of local relevance. found(project_id, page_id, url, category, message); values(page_id, category,
    value); understanding(page_id, u); profiles(project_id, brand, tone)."""
    rows = found.join(values, ["page_id", "category"], "left").join(understanding, "page_id", "left").join(profiles, "project_id", "left")
    local = F.when(F.col("u.geo_relevance") == "local", F.col("u.relevant_location"))
    return rows.select("project_id", "page_id", "url", "category", "message", F.col("value").alias("current_value"), "u.main_topic", "u.search_intent", "u.primary_keyword", F.struct("brand", "u.relevant_service", local.alias("relevant_location"), "u.relevant_audience", "tone").alias("profile"))


def understanding_worklist(pages: DataFrame, snapshots: DataFrame, cached: DataFrame) -> DataFrame:
    """(page_id, snapshot_id) of pages whose newest crawl has no understanding yet. snapshots(id, page_id, crawled_at); cached(page_id, snapshot_id)."""
    last = latest_by(snapshots.select("page_id", "id", "crawled_at"), ["page_id"], "crawled_at", "id").select("page_id", F.col("id").alias("snapshot_id"))
    return pages.select("page_id").join(last, "page_id").join(cached, ["page_id", "snapshot_id"], "left_anti")
