"""Keyword metrics: normalising, routing, scores, trends and roll-ups, for all workspaces at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import count_if, latest_by
from ..functions.text import split_list, strip, to_int, words

#: The provider's intent codes.
INTENT_CODES = {"0": "commercial", "1": "informational", "2": "navigational", "3": "transactional"}
#: ISO code, name, database and numeric code of each market.
LOCATIONS = [
    ("IN", "India", "in", 2356),
    ("US", "United States", "us", 2840),
    ("GB", "United Kingdom", "uk", 2826),
    ("AU", "Australia", "au", 2036),
    ("CA", "Canada", "ca", 2124),
    ("AE", "United Arab Emirates", "ae", 2784),
    ("SG", "Singapore", "sg", 2702),
    ("DE", "Germany", "de", 2276),
    ("FR", "France", "fr", 2250),
]


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def trend_points(c: Column) -> Column:
    """array<double> of a comma list; null if it is empty or any part is no number."""
    parts = split_list(c, ",")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when((F.size(parts) > 0) & F.forall(numbers, lambda x: x.isNotNull()), numbers)


def join_points(c: Column) -> Column:
    """The comma list of an array<double>, whole numbers without a fraction."""
    return F.array_join(F.transform(c, lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), ",")


def normalize_report_keywords(rows: DataFrame) -> DataFrame:
    """Rows with the provider's codes (Ph, Nq, Kd, Cp, In, Td strings, and keyword as asked) to typed columns."""
    intent = F.try_element_at(_map(INTENT_CODES), F.split(F.coalesce("In", F.lit("")), ",")[0])
    number = strip(F.col("Cp")).try_cast("double")
    return rows.select(F.coalesce(F.when(F.col("Ph") != "", F.col("Ph")), F.col("keyword")).alias("keyword"), to_int(F.col("Nq")).alias("volume"), to_int(F.col("Kd")).alias("difficulty"), intent.alias("intent"), number.alias("cpc"), trend_points(F.col("Td")).alias("trend_points"))


def route_keyword_bulk(asked: DataFrame, primary: DataFrame, secondary: DataFrame, keys: tuple = ("keyword", "location")) -> DataFrame:
    """A row for each asked keyword: the primary's if ok, else the secondary's if ok, else no_data where either said so, else error.
    primary and secondary: keys, status, volume, difficulty, intent; one row for each key."""
    keys = list(keys)
    side = lambda df, s: df.select(*keys, F.struct("status", "volume", "difficulty", "intent").alias(s))
    both = asked.join(side(primary, "_p"), keys, "left").join(side(secondary, "_s"), keys, "left")
    ok_p, ok_s = (F.coalesce(F.col(f"{s}.status") == "ok", F.lit(False)) for s in ("_p", "_s"))
    none = F.coalesce(F.col("_p.status") == "no_data", F.lit(False)) | F.coalesce(F.col("_s.status") == "no_data", F.lit(False))
    status = F.when(ok_p | ok_s, "ok").when(none, "no_data").otherwise("error")
    pick = lambda f: F.when(ok_p, F.col(f"_p.{f}")).when(ok_s, F.col(f"_s.{f}"))
    return both.select(*asked.columns, status.alias("status"), F.when(ok_p, "primary").when(ok_s, "secondary").otherwise("none").alias("answered_by"), *(pick(f).alias(f) for f in ("volume", "difficulty", "intent")))


def locations(spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame(LOCATIONS, "location string, name string, database string, code int")


def resolve_location(rows: DataFrame) -> DataFrame:
    """rows(location, ...) with name, database, code and error: an unknown market is an error, never a default."""
    upper = rows.withColumn("location", F.upper("location"))
    out = upper.join(F.broadcast(locations(rows.sparkSession)), "location", "left")
    return out.withColumn("error", F.when(F.col("name").isNull(), F.concat(F.lit("Unsupported location: "), F.coalesce("location", F.lit("")))))


EASY, AVOID = 7.5, 4.0
#: What an intent is worth, and how it is explained.
INTENT_VALUE = {"transactional": 1.0, "commercial": 0.85, "local": 1.0, "informational": 0.55, "navigational": 0.25}
INTENT_NOTES = {
    "transactional": "Transactional intent — searcher is ready to act",
    "commercial": "Commercial intent — comparing options, good lead potential",
    "local": "Local intent — high conversion for local businesses",
    "informational": "Informational intent — traffic, but slower to convert",
    "navigational": "Navigational intent — searcher wants a specific site",
}


def worth_it(volume: Column, difficulty: Column, intent: Column, serp: Column | None = None) -> Column:
    """struct<score, points, band, factors>; points is the score before it is rounded. serp: struct<ai_overview, ads, featured_snippet, local_pack>, or null where no page was seen.
    Bands look at the score before it is rounded."""
    measured = F.coalesce(volume > 0, F.lit(False))
    demand = F.when(measured, F.least(F.lit(4.0), F.log10(volume.cast("double")) * (4.0 / 6.0))).otherwise(0.0)
    demand_note = F.when(~measured, "No search volume data — treat as unproven demand").when(volume < 50, F.format_string("Very low volume (%d/mo)", volume)).when(volume < 1_000, F.format_string("Modest volume (%d/mo)", volume)).otherwise(F.format_string("Strong volume (%,d/mo)", volume))
    fight = F.coalesce(4.0 * (1 - difficulty / 100.0), F.lit(2.0))
    fight_note = F.when(difficulty.isNull(), "Difficulty unknown — assume a medium fight").when(difficulty <= 30, F.format_string("Low difficulty (KD %d) — rankable with on-page work", difficulty)).when(difficulty <= 60, F.format_string("Medium difficulty (KD %d) — needs good content + some links", difficulty)).otherwise(F.format_string("High difficulty (KD %d) — established sites dominate", difficulty))
    named = F.coalesce(intent, F.lit("")) != ""
    use = F.when(named, 2.0 * F.coalesce(F.try_element_at(_map(INTENT_VALUE), intent), F.lit(0.6))).otherwise(1.0)
    use_note = F.when(named, F.coalesce(F.try_element_at(_map(INTENT_NOTES), intent), F.concat(F.initcap(intent), F.lit(" intent")))).otherwise("Intent unknown")
    unseen = F.array(F.lit("SERP features not checked yet — score may drop once inspected"))
    if serp is None:
        penalty, notes = F.lit(0.0), unseen
    else:
        on = lambda f: F.coalesce(serp[f], F.lit(False))
        ads = F.coalesce(serp["ads"], F.lit(0))
        penalty = F.when(on("ai_overview"), 1.2).otherwise(0.0) + F.when(ads > 0, F.least(F.lit(0.8), 0.2 * ads)).otherwise(0.0) + F.when(on("featured_snippet"), 0.3).otherwise(0.0) + F.when(on("local_pack"), 0.2).otherwise(0.0)
        penalty = F.when(serp.isNull(), 0.0).otherwise(penalty)
        found = F.array_compact(
            F.array(
                F.when(on("ai_overview"), "AI Overview present — expect fewer organic clicks"),
                F.when(ads > 0, F.format_string("%d ads above/around results", ads)),
                F.when(on("featured_snippet"), "Featured snippet occupies position zero"),
                F.when(on("local_pack"), "Map pack present — local listings matter as much as ranking"),
            )
        )
        clean = F.array(F.lit("Clean SERP — organic results get the clicks"))
        notes = F.when(serp.isNull(), unseen).when(F.size(found) == 0, clean).otherwise(found)
    score = F.greatest(F.lit(0.0), F.least(F.lit(10.0), demand + fight + use - penalty))
    band = F.when(score >= EASY, "easy").when(score < AVOID, "avoid").otherwise("medium")
    return F.struct(F.bround(score, 1).alias("score"), score.alias("points"), band.alias("band"), F.concat(F.array(demand_note, fight_note, use_note), notes).alias("factors"))


GAP_DAYS, THRESHOLD = 7, 0.10


def trends(snapshots: DataFrame, key: str = "tracked_keyword_id", at: str = "fetched_at", tie: str = "id") -> DataFrame:
    """(key, trend, confidence): the latest snapshot against the most recent one at least GAP_DAYS older, by volume, else by
    position. One window for the time of the latest and one aggregate for both rows, over the same partitioning."""
    newest = F.max(at).over(Window.partitionBy(key))
    values = F.struct("volume", "position")
    older = F.col(at) <= F.col("_newest") - F.expr(f"INTERVAL {GAP_DAYS} DAYS")
    both = snapshots.withColumn("_newest", newest).groupBy(key).agg(F.max_by(values, F.struct(F.col(at), -F.col(tie))).alias("l"), F.max_by(F.when(older, values), F.when(older, F.struct(F.col(at), -F.col(tie)))).alias("b"))
    by_volume = F.col("l.volume").isNotNull() & F.coalesce(F.col("b.volume") != 0, F.lit(False))
    by_position = F.col("l.position").isNotNull() & F.coalesce(F.col("b.position") != 0, F.lit(False))
    d = lambda c: F.col(c).cast("double")
    change = F.when(by_volume, (d("l.volume") - d("b.volume")) / d("b.volume")).when(by_position, (d("b.position") - d("l.position")) / d("b.position"))
    trend = F.when(change > THRESHOLD, "rising").when(change < -THRESHOLD, "falling").otherwise("stable")
    return both.select(key, trend.alias("trend"), F.when(change.isNull(), "insufficient_data").otherwise("computed").alias("confidence"))


def latest_view(tracked: DataFrame, snapshots: DataFrame) -> DataFrame:
    """A row for each tracked keyword (workspace_id, tracked_keyword_id): latest values, trend and score; without snapshot no_data."""
    last = latest_by(snapshots.select("tracked_keyword_id", "id", "fetched_at", "volume", "difficulty", "intent", "position", "source"), ["tracked_keyword_id"], "fetched_at", "id")
    out = tracked.join(last.drop("id"), "tracked_keyword_id", "left").join(trends(snapshots), "tracked_keyword_id", "left")
    seen = F.col("fetched_at").isNotNull()
    score = F.when(seen, worth_it(F.col("volume"), F.col("difficulty"), F.col("intent")))
    return out.withColumns({"status": F.when(seen, "ok").otherwise("no_data"), "trend": F.coalesce("trend", F.lit("stable")), "confidence": F.coalesce("confidence", F.lit("insufficient_data")), "source": F.coalesce("source", F.lit("none")), "worth_it": score})


def is_easy_win() -> Column:
    return F.coalesce(F.col("position").between(4, 20) & (F.col("difficulty") < 50), F.lit(False))


def workspace_overview(view: DataFrame) -> DataFrame:
    mean = lambda c: F.sum(c) / F.count(c)
    return view.groupBy("workspace_id").agg(
        F.count("*").alias("tracked_keywords"),
        F.coalesce(F.sum("volume"), F.lit(0)).cast("long").alias("search_volume"),
        F.bround(mean("difficulty"), 0).cast("int").alias("avg_kd"),
        F.bround(mean("position"), 1).alias("avg_position"),
        F.when(F.count("position") > 0, "live").otherwise("position_data_pending").alias("data_quality"),
        count_if(is_easy_win()).alias("easy_wins"),
    )


def keyword_refresh(snapshots: DataFrame, fetched: DataFrame, now: Column) -> DataFrame:
    """The snapshots that a refresh appends: fetched rows with status ok, the position carried on from the latest before; trend_points is the
    text of an array of numbers, null where there are none."""
    prior = latest_by(snapshots.select("tracked_keyword_id", "id", "fetched_at", "position"), ["tracked_keyword_id"], "fetched_at", "id").select("tracked_keyword_id", "position")
    return fetched.where("status = 'ok'").join(prior, "tracked_keyword_id", "left").select("tracked_keyword_id", now.alias("fetched_at"), "volume", "difficulty", "intent", "position", F.when(F.size("trend_points") > 0, join_points(F.col("trend_points"))).alias("trend_points"), "source")


def status_counts(fetched: DataFrame) -> DataFrame:
    return fetched.groupBy("workspace_id").agg(*(F.count_if(F.col("status") == s).alias(name) for s, name in (("ok", "refreshed"), ("no_data", "no_data"), ("error", "errors"))))


def rank_check(snapshots: DataFrame, ranks: DataFrame, now: Column) -> DataFrame:
    """The snapshots that a rank check appends: a new position, other values carried on but trend_points; failed searches write none.
    ranks(tracked_keyword_id, position, error)."""
    prior = latest_by(snapshots.select("tracked_keyword_id", "id", "fetched_at", "volume", "difficulty", "intent"), ["tracked_keyword_id"], "fetched_at", "id").drop("id", "fetched_at")
    return ranks.where("error IS NULL").join(prior, "tracked_keyword_id", "left").select("tracked_keyword_id", now.alias("fetched_at"), "volume", "difficulty", "intent", "position", F.lit(None).cast("array<double>").alias("trend_points"))


def dedupe_tracked(requests: DataFrame) -> DataFrame:
    """requests(workspace_id, keyword, location, seq): one row a stripped lower-case keyword; the last request's location holds."""
    rows = requests.withColumn("keyword", F.lower(strip(F.col("keyword")))).where("keyword <> ''")
    return rows.groupBy("workspace_id", "keyword").agg(F.max_by("location", "seq").alias("location"), F.min("seq").alias("first_seq"))


def save_keywords(saved: DataFrame, requests: DataFrame) -> DataFrame:
    """The saved keywords after requests(workspace_id, keyword, seq, ...): of a keyword, stripped and in lower case, what is saved already stays, else the
    first request holds. saved has the columns of requests but seq."""
    columns = [c for c in saved.columns if c not in ("workspace_id", "keyword")]
    rows = requests.withColumn("keyword", F.lower(strip(F.col("keyword")))).where("keyword <> ''")
    first = rows.groupBy("workspace_id", "keyword").agg(F.min_by(F.struct(*columns), "seq").alias("_r")).select("workspace_id", "keyword", "_r.*")
    return saved.unionByName(first.join(saved.select("workspace_id", "keyword"), ["workspace_id", "keyword"], "left_anti"))


#: The words that make a keyword one of a mode.
PREPOSITIONS = ("for", "with", "without", "near", "to", "in", "on", "at", "under", "before", "after")
COMPARISONS = ("vs", "versus", "or", "best", "top", "alternative", "alternatives", "cheapest", "review", "reviews")
QUESTION_PREFIXES = ("what", "how", "why", "when", "where", "who", "which", "can", "does", "is")
STOPWORDS = ("the", "a", "an", "for", "to", "of", "in", "on", "and", "is", "how", "what", "near", "me", "vs")


def has_word(keyword: Column, some: tuple) -> Column:
    return F.arrays_overlap(words(F.lower(keyword)), F.array(*map(F.lit, some)))


def suggestion_groups(related: DataFrame, questions: DataFrame, broad: DataFrame) -> DataFrame:
    """(seed, mode, pos, keyword): a keyword belongs to the first mode that claims it; within a mode repeats stay.
    related and questions(seed, provider 1 or 2, pos, keyword): provider 2 counts only for seeds that provider 1 has nothing for;
    broad(seed, pos, keyword)."""
    def first_provider(df: DataFrame, mode: int) -> DataFrame:
        least = F.min("provider").over(Window.partitionBy("seed"))
        return df.withColumn("_p", least).where("provider = _p").select("seed", F.lit(mode).alias("mode"), "pos", "keyword")

    pool = lambda mode, some: broad.where(has_word(F.col("keyword"), some)).select("seed", F.lit(mode).alias("mode"), "pos", "keyword")
    every = first_provider(related, 0).unionByName(first_provider(questions, 1)).unionByName(pool(2, PREPOSITIONS)).unionByName(pool(3, COMPARISONS))
    claimed = F.min("mode").over(Window.partitionBy("seed", "keyword"))
    names = F.array(*map(F.lit, ("related", "questions", "prepositions", "comparisons")))
    return every.withColumn("_m", claimed).where("mode = _m").select("seed", names[F.col("mode")].alias("mode"), "pos", "keyword")


def question_keywords(keywords: DataFrame) -> DataFrame:
    return keywords.where(F.lower("keyword").rlike(f"^(?:{'|'.join(QUESTION_PREFIXES)})"))


def root_of(keyword: Column) -> Column:
    """The first of the longest words that are no stopwords; of all words where each is one."""
    every = words(F.lower(keyword))
    kept = F.filter(every, lambda t: ~t.isin(*STOPWORDS))
    return F.aggregate(F.when(F.size(kept) > 0, kept).otherwise(every), F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))


def cluster_keywords(tracked: DataFrame, saved: DataFrame) -> DataFrame:
    rows = tracked.select("workspace_id", "keyword").union(saved.select("workspace_id", "keyword")).distinct()
    return rows.withColumn("root", root_of(F.col("keyword"))).groupBy("workspace_id", "root").agg(F.array_sort(F.collect_list("keyword")).alias("keywords"))


def filter_keywords(rows: DataFrame, intent: str | None = None, min_volume: int | None = None, max_difficulty: int | None = None, include: str | None = None, exclude: str | None = None, easy_only: bool = False) -> DataFrame:
    text = F.lower("keyword")
    some = [
        F.col("intent") == intent if intent else None,
        F.col("volume") >= min_volume if min_volume is not None else None,
        F.col("difficulty") <= max_difficulty if max_difficulty is not None else None,
        F.contains(text, F.lit(include.lower())) if include else None,
        ~F.contains(text, F.lit(exclude.lower())) if exclude else None,
        F.col("worth_it.band") == "easy" if easy_only else None,
    ]
    for c in some:
        if c is not None:
            rows = rows.where(c)
    return rows


BUCKETS = (("0-100", 100), ("100-1K", 1_000), ("1K-10K", 10_000))


def keyword_distributions(rows: DataFrame) -> DataFrame:
    """(workspace_id, kind, bucket, n): counts by intent and by volume; unknown values count as unknown."""
    bucket = F.when(F.col("volume").isNull(), "unknown")
    for name, below in BUCKETS:
        bucket = bucket.when(F.col("volume") < below, name)
    both = F.array(F.struct(F.lit("intent").alias("kind"), F.coalesce("intent", F.lit("unknown")).alias("bucket")), F.struct(F.lit("volume").alias("kind"), bucket.otherwise("10K+").alias("bucket")))
    return rows.select("workspace_id", F.explode(both).alias("x")).select("workspace_id", "x.*").groupBy("workspace_id", "kind", "bucket").agg(F.count("*").alias("n"))
