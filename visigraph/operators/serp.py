"""Search result pages: items(keyword_id, pos, item_type, domain, rank_absolute, rank_group, url, title)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import first_rows
from ..functions.text import bare_domain, split_list

#: Item types and the feature that each stands for.
FEATURES = {"ai_overview": ["ai_overview"], "featured_snippet": ["featured_snippet"], "people_also_ask": ["people_also_ask"], "local_pack": ["local_pack", "map"], "video": ["video"], "images": ["images"], "shopping": ["shopping", "popular_products"]}


def serp_features(items: DataFrame) -> DataFrame:
    """(keyword_id, ads, a flag for each feature)."""
    return items.groupBy("keyword_id").agg(F.count_if(F.col("item_type") == "paid").alias("ads"), *(F.bool_or(F.col("item_type").isin(*types)).alias(name) for name, types in FEATURES.items()))


def serp_position(items: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(keyword_id, project_id, domain) with the position: of the first own organic item, rank_absolute, or rank_group where
    that is null or 0; null without one."""
    own = items.where("item_type = 'organic'").select("keyword_id", "pos", bare_domain(F.col("domain")).alias("domain"), F.coalesce(F.when(F.col("rank_absolute") != 0, F.col("rank_absolute")), F.col("rank_group")).alias("rank"))
    wanted = targets.withColumn("domain", bare_domain(F.col("domain")))
    found = own.join(wanted, ["keyword_id", "domain"]).groupBy("keyword_id", "project_id").agg(F.min_by(F.struct("rank"), "pos")["rank"].alias("position"))
    return targets.join(found, ["keyword_id", "project_id"], "left")


def serp_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """(keyword_id, source, items, error): the primary's result unless it failed, else the secondary's, else both errors."""
    p, s = (df.select("keyword_id", F.struct("items", "error").alias(n)) for df, n in ((primary, "_p"), (secondary, "_s")))
    both = p.join(s, "keyword_id", "full")
    ok = lambda c: F.col(c).isNotNull() & (F.coalesce(F.col(f"{c}.error"), F.lit("")) == "")
    error = lambda c: F.coalesce(F.col(f"{c}.error"), F.lit("no answer"))
    failed = F.concat(F.lit("primary: "), error("_p"), F.lit("; secondary: "), error("_s"))
    return both.select("keyword_id", F.when(ok("_p"), "primary").when(ok("_s"), "secondary").alias("source"), F.when(ok("_p"), F.col("_p.items")).when(ok("_s"), F.col("_s.items")).alias("items"), F.when(~ok("_p") & ~ok("_s"), failed).alias("error"))


def top_organic(items: DataFrame, n: int = 10) -> DataFrame:
    return first_rows(items.where("item_type = 'organic'"), ["keyword_id"], [F.col("pos")], n, "place")


def visibility_check(items: DataFrame, projects: DataFrame, cap: int = 10) -> DataFrame:
    """For each (keyword_id, project_id, domain): is there an AI overview, does its first one refer to the brand, the own organic
    rank, and other domains: those referred to (sorted), then those of the first 10 organic items. items also has `refs`,
    the domains that an AI overview refers to. The lists per keyword are bounded by one result page."""
    domain = bare_domain(F.col("domain"))
    rows = items.withColumn("domain", domain)
    overview = rows.where("item_type = 'ai_overview'").groupBy("keyword_id").agg(F.min_by("refs", "pos").alias("refs"))
    organic = rows.where("item_type = 'organic'").groupBy("keyword_id").agg(F.array_sort(F.collect_list(F.struct("pos", "domain", "rank_absolute"))).alias("organic"))
    all_ = projects.withColumn("domain", domain).join(overview, "keyword_id", "left").join(organic, "keyword_id", "left")
    refs = F.transform(F.coalesce("refs", F.array().cast("array<string>")), bare_domain)
    first = F.filter("organic", lambda o: o["domain"] == F.col("domain"))
    others = F.array_distinct(F.concat(F.array_sort(F.array_distinct(refs)), F.transform(F.slice(F.coalesce("organic", F.array().cast("array<struct<pos:int,domain:string,rank_absolute:int>>")), 1, 10), lambda o: o["domain"])))
    return all_.select(
        "keyword_id",
        "project_id",
        F.col("refs").isNotNull().alias("ai_overview_present"),
        F.when(F.col("refs").isNotNull(), F.array_contains(refs, F.col("domain"))).alias("brand_in_ai_overview"),
        F.get(first, F.lit(0))["rank_absolute"].alias("organic_rank"),
        F.slice(F.filter(others, lambda d: (d != "") & (d != F.col("domain"))), 1, cap).alias("competitor_domains"),
    )


GENERIC = ("local", "unites states", "united states")


def suggested_queries(profiles: DataFrame, cap: int = 5) -> DataFrame:
    """(project_id, pos, query) from services, locations and audiences (array<string>, whose items may hold commas)."""
    flat = lambda c: F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: split_list(x, ",")))
    services = F.slice(flat("services"), 1, 2)
    locations = F.slice(F.filter(flat("locations"), lambda x: ~F.lower(x).isin(*GENERIC)), 1, 2)
    audiences = F.slice(flat("audiences"), 1, 1)

    def of(s: Column) -> Column:
        there = F.transform(F.col("_l"), lambda x: F.concat(F.lit("best "), s, F.lit(" in "), x))
        for_ = F.transform(F.col("_a"), lambda x: F.concat(s, F.lit(" for "), x))
        alone = F.when((F.size("_l") == 0) & (F.size("_a") == 0), F.array(F.concat(F.lit("best "), s))).otherwise(F.array().cast("array<string>"))
        return F.concat(there, for_, alone)

    rows = profiles.select("project_id", services.alias("_s"), locations.alias("_l"), audiences.alias("_a"))
    return rows.select("project_id", F.posexplode(F.slice(F.flatten(F.transform("_s", of)), 1, cap)).alias("pos", "query"))
