"""Competitors: registration, snapshots and comparisons. A null competitor is the project's own site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import latest_by
from ..functions.text import normalize_domain, stripped, to_int


def register_competitors(requests: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of requests(project_id, value, display_name, seq): blank and known domains are rejected; a name defaults to the domain."""
    rows = requests.withColumn("domain", normalize_domain(F.col("value")))
    known = existing.select("project_id", "domain").distinct().withColumn("_known", F.lit(True))
    first = F.min("seq").over(Window.partitionBy("project_id", "domain"))
    rows = rows.withColumn("_first", first).join(known, ["project_id", "domain"], "left")
    reason = F.when(F.col("domain") == "", "blank").when(F.col("_known").isNotNull() | (F.col("seq") > F.col("_first")), "duplicate")
    rows = rows.withColumn("reason", reason)
    name = F.when(stripped(F.col("display_name")) != "", stripped(F.col("display_name"))).otherwise(F.col("domain"))
    return rows.where("reason IS NULL").select("project_id", "domain", name.alias("display_name")), rows.where("reason IS NOT NULL").select("project_id", "value", "seq", "reason")


def site_metrics(sites: DataFrame, metrics: DataFrame, overviews: DataFrame) -> DataFrame:
    """A snapshot row for each site(project_id, competitor_id, domain) from metrics(domain, organic_keywords, error) and
    overviews(domain, status, referring_domains, total_backlinks, source, error): 0 keywords are null, errors are named together."""
    m = metrics.select("domain", F.struct("organic_keywords", "error").alias("_m"))
    b = overviews.select("domain", F.struct("status", "referring_domains", "total_backlinks", "source", "error").alias("_b"))
    rows = sites.join(m, "domain", "left").join(b, "domain", "left")
    failed = F.col("_m").isNull() | (F.coalesce("_m.error", F.lit("")) != "")
    status = F.coalesce("_b.status", F.lit("error"))
    keywords = to_int(F.col("_m.organic_keywords"))
    errors = F.concat_ws(
        " | ",
        F.when(failed, F.concat(F.lit("organic keywords: "), F.coalesce("_m.error", F.lit("no answer")))),
        F.when(status == "error", F.concat(F.lit("backlinks: "), F.coalesce("_b.error", F.lit("no answer")))).when(status == "no_data", F.concat(F.lit("backlinks: "), F.coalesce("_b.source", F.lit("the active provider")), F.lit(" has no data indexed for this domain"))),
    )
    ok = lambda c: F.when(status == "ok", F.col(f"_b.{c}"))
    return rows.select("project_id", "competitor_id", "domain", F.when(~failed & (keywords != 0), keywords).alias("organic_keywords"), ok("referring_domains").alias("referring_domains"), ok("total_backlinks").alias("total_backlinks"), F.when(errors != "", errors).alias("error"))


def latest_comparison(snapshots: DataFrame, competitors: DataFrame | None = None) -> DataFrame:
    """The newest snapshot of each project's own site and of each competitor; grouping treats null as a key. With
    competitors(project_id, competitor_id), the active ones: no others, and those that were never fetched with nulls."""
    last = latest_by(snapshots, ["project_id", "competitor_id"], "fetched_at", "id")
    if competitors is None:
        return last
    own = competitors.select("project_id").union(last.select("project_id")).distinct().withColumn("competitor_id", F.lit(None).cast("long"))
    sites = own.union(competitors.select("project_id", F.col("competitor_id").cast("long"))).distinct()
    key = lambda df: df.withColumn("_site", F.coalesce(F.col("competitor_id").cast("string"), F.lit("self")))
    return key(sites).join(key(last).drop("competitor_id"), ["project_id", "_site"], "left").select(snapshots.columns)


METRICS = ("organic_keywords", "referring_domains", "total_backlinks")


def comparison_matrix(latest: DataFrame, names: list[str]) -> DataFrame:
    """(project_id, metric, a column for each name) with the own site as `self`."""
    rows = latest.select("project_id", F.coalesce(F.col("competitor_id").cast("string"), F.lit("self")).alias("site"), *(F.col(m).cast("long").alias(m) for m in METRICS))
    long = rows.unpivot(["project_id", "site"], list(METRICS), "metric", "value")
    return long.groupBy("project_id", "metric").pivot("site", names).agg(F.first("value"))


def keyword_gap(ranks: DataFrame, margin: int = 10) -> DataFrame:
    """ranks(project_id, keyword, is_client, position, prior_position) to a class for each keyword: UNTAPPED the client has no position;
    LOST it fell by the margin or more; WEAK the best competitor is better by the margin; STRONG the client is best; else SHARED."""
    own = F.col("is_client")
    by = ranks.groupBy("project_id", "keyword").agg(F.min(F.when(own, F.col("position"))).alias("client"), F.min(F.when(own, F.col("prior_position"))).alias("before"), F.min(F.when(~own, F.col("position"))).alias("best"))
    kind = F.when(F.col("client").isNull() & F.col("before").isNotNull(), "LOST").when(F.col("client").isNull(), "UNTAPPED").when(F.col("client") - F.col("before") >= margin, "LOST").when(F.col("client") - F.col("best") >= margin, "WEAK").when(F.col("best").isNull() | (F.col("client") < F.col("best")), "STRONG").otherwise("SHARED")
    return by.select("project_id", "keyword", "client", "best", kind.alias("class"))
