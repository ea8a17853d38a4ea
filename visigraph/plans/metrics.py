"""Jobs over keywords, result pages, competitors and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, normalize_domain, split_list
from ..operators import clusters, competitors, keywords, serp, suggestions, upserts
from ..sources import reports
from .scratch import scratch
from .sql import strip, using, words
from .views import view

JOBS: dict = {}


def job(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        JOBS[name] = (f, sql)
        return f

    return add


def kw(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "kw_snapshots")


def text(c: str):  # noqa: ANN201
    return F.col(c).cast("string")


# Provider rows made of parts: strings as a report has them.
_INTENT = "CASE keyword_id % 5 WHEN 0 THEN '1,0' WHEN 1 THEN '3' WHEN 2 THEN '2,1' WHEN 3 THEN '' ELSE '0' END"
_INTENT_NAME = "CASE keyword_id % 5 WHEN 0 THEN 'informational' WHEN 1 THEN 'transactional' WHEN 2 THEN 'navigational' WHEN 4 THEN 'commercial' END"


def report_rows(s: SparkSession, d: str) -> DataFrame:
    k = F.col("keyword_id")
    return view(s, d, "keywords").select(
        "keyword_id", "keyword", F.col("keyword").alias("Ph"), F.when(k % 9 == 0, "n/a").otherwise(F.concat((F.col("volume_k") * 10).cast("string"), F.lit(".0"))).alias("Nq"), text("difficulty").alias("Kd"),
        F.when(k % 4 == 0, "").otherwise("1.5").alias("Cp"), F.expr(_INTENT).alias("In"), F.when(k % 6 == 0, "1.00,x").when(k % 6 == 1, "").otherwise("1.00,0.82,0.67").alias("Td"),
    )


_VOLUME = "CASE WHEN keyword_id % 9 <> 0 THEN CAST(volume_k * 10 AS BIGINT) END"


@job("normalize_keyword_semrush", using("keywords", f"SELECT keyword, {_VOLUME} AS volume, CAST(difficulty AS BIGINT) AS difficulty, {_INTENT_NAME} AS intent, CASE WHEN keyword_id % 4 <> 0 THEN CAST(1.5 AS DOUBLE) END AS cpc, CASE WHEN keyword_id % 6 > 1 THEN '1|0.82|0.67' END AS points FROM keywords"))
def normalize_keyword(s: SparkSession, d: str) -> DataFrame:
    return keywords.normalize_report_keywords(report_rows(s, d)).withColumn("points", F.array_join(F.split(keywords.join_points(F.col("trend_points")), ","), "|")).drop("trend_points")


@job("read_provider_csv", using("keywords", "SELECT keyword_id AS id, 0 AS line, keyword AS \"Ph\", CAST(volume_k * 10 AS VARCHAR) AS \"Nq\", CAST(difficulty AS VARCHAR) AS \"Kd\" FROM keywords WHERE keyword_id % 10 <> 0"))
def read_provider_csv(s: SparkSession, d: str) -> DataFrame:
    good = F.concat(F.lit("Keyword;Search Volume;Keyword Difficulty Index\r\n"), "keyword", F.lit(";"), (F.col("volume_k") * 10).cast("string"), F.lit(";"), text("difficulty"), F.lit("\r\n\r\n"))
    bodies = view(s, d, "keywords").select(F.col("keyword_id").alias("id"), F.when(F.col("keyword_id") % 10 == 0, "ERROR 50 :: NOTHING FOUND\n").otherwise(good).alias("body"))
    return reports.parse_reports(bodies).select("id", "line", "Ph", "Nq", "Kd")


@job("read_keyword_json", using("keywords", "SELECT keyword, CAST(volume_k AS BIGINT) AS volume, difficulty, CASE WHEN keyword_id % 2 = 0 THEN 'commercial' END AS intent, CAST(0.5 AS DOUBLE) AS cpc FROM keywords"))
def read_keyword_json(s: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.when(F.col("keyword_id") % 3 == 0, F.col("keyword")).alias("keyword"), F.struct(F.col("volume_k").alias("search_volume"), F.lit(0.5).alias("cpc")).alias("keyword_info"), F.struct(F.col("difficulty").alias("keyword_difficulty")).alias("keyword_properties"), F.struct(F.when(F.col("keyword_id") % 2 == 0, "commercial").alias("main_intent")).alias("search_intent_info"))
    return reports.read_keyword_json(view(s, d, "keywords").select("keyword", F.to_json(item).alias("json")))


_P, _S = "list_element(['ok', 'no_data', 'error'], CAST(keyword_id % 3 + 1 AS INT))", "list_element(['ok', 'no_data', 'error', NULL], CAST(keyword_id % 4 + 1 AS INT))"


@job("route_keyword_bulk", using("keywords", f""", a AS (SELECT keyword_id, {_P} AS p, {_S} AS s, CAST(volume_k AS INT) AS v FROM keywords)
SELECT keyword_id, CASE WHEN p = 'ok' OR s = 'ok' THEN 'ok' WHEN p = 'no_data' OR s = 'no_data' THEN 'no_data' ELSE 'error' END AS status, CASE WHEN p = 'ok' THEN 'primary' WHEN s = 'ok' THEN 'secondary' ELSE 'none' END AS answered_by, CASE WHEN p = 'ok' THEN v WHEN s = 'ok' THEN v + 1 END AS volume FROM a"""))
def route_keyword_bulk(s: SparkSession, d: str) -> DataFrame:
    k, i = view(s, d, "keywords"), F.col("keyword_id")
    side = lambda n, more: k.select("keyword_id", F.get(F.array(*map(F.lit, ("ok", "no_data", "error", None)[:n])), (i % n).cast("int")).alias("status"), (F.col("volume_k") + more).cast("int").alias("volume"), "difficulty", F.lit(None).cast("string").alias("intent")).where("status IS NOT NULL")
    return keywords.route_keyword_bulk(k.select("keyword_id"), side(3, 0), side(4, 1), ("keyword_id",)).select("keyword_id", "status", "answered_by", "volume")


_LOC = ", ".join(f"('{a}', '{b}', '{c}', {n})" for a, b, c, n in keywords.LOCATIONS)


@job("resolve_location", f"""WITH l(location, name, database, code) AS (VALUES {_LOC}), r AS (SELECT c_custkey AS id, list_element(['IN', 'US', 'GB', 'AU', 'CA', 'AE', 'SG', 'DE', 'FR', 'XX'], CAST(c_custkey % 10 + 1 AS INT)) AS location FROM customer)
SELECT id, r.location, name, database, code, CASE WHEN name IS NULL THEN 'Unsupported location: ' || r.location END AS error FROM r LEFT JOIN l USING (location)""")
def resolve_location(s: SparkSession, d: str) -> DataFrame:
    codes = F.array(*map(F.lit, ("in", "us", "gb", "au", "ca", "ae", "sg", "de", "fr", "xx")))
    return keywords.resolve_location(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.get(codes, (F.col("c_custkey") % 10).cast("int")).alias("location")))


_SERP = "id % 3 = 0 AS ai, CAST(id % 7 AS INT) AS ads, id % 5 = 0 AS fs, id % 4 = 0 AS lp, id % 6 = 5 AS unseen"
_PTS = """least(10.0, greatest(0.0, CASE WHEN volume > 0 THEN least(CAST(4.0 AS DOUBLE), log10(volume) * (CAST(4.0 AS DOUBLE) / 6.0)) ELSE CAST(0 AS DOUBLE) END + coalesce(4.0 * (1 - difficulty / CAST(100 AS DOUBLE)), CAST(2 AS DOUBLE))
 + CASE intent WHEN 'transactional' THEN 2.0 WHEN 'commercial' THEN 1.7 WHEN 'informational' THEN CAST(1.1 AS DOUBLE) WHEN 'navigational' THEN 0.5 ELSE 1.0 END {}))"""
_NOTES = """CASE WHEN coalesce(volume, 0) = 0 THEN 'No search volume data — treat as unproven demand' WHEN volume < 50 THEN 'Very low volume (' || volume || '/mo)' WHEN volume < 1000 THEN 'Modest volume (' || volume || '/mo)' ELSE 'Strong volume (' || format('{:,}', volume) || '/mo)' END || '|' ||
CASE WHEN difficulty IS NULL THEN 'Difficulty unknown — assume a medium fight' WHEN difficulty <= 30 THEN 'Low difficulty (KD ' || difficulty || ') — rankable with on-page work' WHEN difficulty <= 60 THEN 'Medium difficulty (KD ' || difficulty || ') — needs good content + some links' ELSE 'High difficulty (KD ' || difficulty || ') — established sites dominate' END"""


@job("worth_it_score", using("kw_snapshots", f""", r AS (SELECT *, {_SERP} FROM kw_snapshots), x AS (SELECT *, CASE WHEN unseen THEN CAST(0 AS DOUBLE) ELSE (CASE WHEN ai THEN CAST(1.2 AS DOUBLE) ELSE 0 END + CASE WHEN ads > 0 THEN least(CAST(0.8 AS DOUBLE), CAST(0.2 AS DOUBLE) * ads) ELSE 0 END + CASE WHEN fs THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CASE WHEN lp THEN CAST(0.2 AS DOUBLE) ELSE 0 END) END AS penalty FROM r), y AS (SELECT *, {_PTS.format('- penalty')} AS pts FROM x)
SELECT id, CASE WHEN pts >= 7.5 THEN 'easy' WHEN pts < 4.0 THEN 'avoid' ELSE 'medium' END AS band, CAST(floor(pts * 1000 + 0.5) AS BIGINT) // 10 AS points, {_NOTES} AS notes FROM y"""))
def worth_it_score(s: SparkSession, d: str) -> DataFrame:
    """Hundredths of the unrounded score are compared too, as its decimal may differ by how an engine rounds halves."""
    i = F.col("id")
    seen = F.struct((i % 3 == 0).alias("ai_overview"), (i % 7).cast("int").alias("ads"), (i % 5 == 0).alias("featured_snippet"), (i % 4 == 0).alias("local_pack"))
    w = keywords.worth_it(F.col("volume"), F.col("difficulty"), F.col("intent"), F.when(i % 6 != 5, seen))
    rows = kw(s, d).select("id", w.alias("w"))
    return rows.select("id", "w.band", F.expr("CAST(floor(w.points * 1000 + 0.5) AS BIGINT) div 10").alias("points"), F.concat_ws("|", F.slice("w.factors", 1, 2)).alias("notes"))


_TREND = """, r AS (SELECT *, max(fetched_at) OVER (PARTITION BY tracked_keyword_id) AS newest FROM kw_snapshots),
l AS (SELECT DISTINCT ON (tracked_keyword_id) * FROM r ORDER BY tracked_keyword_id, fetched_at DESC, id),
b AS (SELECT DISTINCT ON (tracked_keyword_id) * FROM r WHERE fetched_at <= newest - INTERVAL 7 DAYS ORDER BY tracked_keyword_id, fetched_at DESC, id),
c AS (SELECT l.tracked_keyword_id, CASE WHEN l.volume IS NOT NULL AND b.volume <> 0 THEN (CAST(l.volume AS DOUBLE) - b.volume) / b.volume WHEN l.position IS NOT NULL AND b.position <> 0 THEN (CAST(b.position AS DOUBLE) - l.position) / b.position END AS change FROM l LEFT JOIN b USING (tracked_keyword_id)),
trend AS (SELECT tracked_keyword_id, CASE WHEN change > CAST(0.1 AS DOUBLE) THEN 'rising' WHEN change < CAST(-0.1 AS DOUBLE) THEN 'falling' ELSE 'stable' END AS trend, CASE WHEN change IS NULL THEN 'insufficient_data' ELSE 'computed' END AS confidence FROM c)"""


@job("compute_trend", using("kw_snapshots", f"{_TREND} SELECT * FROM trend"))
def compute_trend(s: SparkSession, d: str) -> DataFrame:
    return keywords.trends(kw(s, d))


@job("trend_points_codec", using("kw_snapshots", "SELECT id, CASE WHEN volume IS NULL THEN NULL WHEN id % 7 = 0 THEN NULL ELSE volume || ',0.5' END AS points FROM kw_snapshots"))
def trend_points_codec(s: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("id") % 7 == 0, F.concat(text("volume"), F.lit(",bad"))).otherwise(F.concat(F.lit(" "), text("volume"), F.lit(".0 , 0.50,")))
    return kw(s, d).select("id", keywords.join_points(keywords.trend_points(raw)).alias("points"))


def tracked(s: SparkSession, d: str) -> DataFrame:
    """All keywords with snapshots and, for each, one without."""
    rows = kw(s, d).select("workspace_id", "tracked_keyword_id").distinct()
    return rows.unionByName(rows.withColumn("tracked_keyword_id", -1 - F.col("tracked_keyword_id")))


_TRACKED = ", tracked AS (SELECT DISTINCT workspace_id, tracked_keyword_id FROM kw_snapshots UNION ALL SELECT DISTINCT workspace_id, -1 - tracked_keyword_id FROM kw_snapshots)"
_VIEW = f"{_TREND}{_TRACKED}, v AS (SELECT t.workspace_id, t.tracked_keyword_id, l.volume, l.difficulty, l.intent, l.position, coalesce(l.source, 'none') AS source, CASE WHEN l.id IS NULL THEN 'no_data' ELSE 'ok' END AS status, coalesce(trend, 'stable') AS trend, coalesce(confidence, 'insufficient_data') AS confidence FROM tracked t LEFT JOIN l USING (tracked_keyword_id) LEFT JOIN trend USING (tracked_keyword_id))"
_BAND = f"CASE WHEN status = 'ok' THEN CASE WHEN {_PTS.format('')} >= 7.5 THEN 'easy' WHEN {_PTS.format('')} < 4.0 THEN 'avoid' ELSE 'medium' END END"


def latest(s: SparkSession, d: str) -> DataFrame:
    return keywords.latest_view(tracked(s, d), kw(s, d))


@job("latest_keyword_view", using("kw_snapshots", f"{_VIEW} SELECT *, {_BAND} AS band FROM v"))
def latest_keyword_view(s: SparkSession, d: str) -> DataFrame:
    return latest(s, d).select("workspace_id", "tracked_keyword_id", "volume", "difficulty", "intent", "position", "source", "status", "trend", "confidence", "worth_it.band")


_EASY = "coalesce(position BETWEEN 4 AND 20 AND difficulty < 50, false)"


@job("workspace_overview", using("kw_snapshots", f"""{_VIEW} SELECT workspace_id, count(*) AS tracked_keywords, CAST(coalesce(sum(volume), 0) AS BIGINT) AS search_volume, CAST(round_even(sum(difficulty) / CAST(count(difficulty) AS DOUBLE), 0) AS INT) AS avg_kd, round_even(sum(position) / CAST(count(position) AS DOUBLE), 1) AS avg_position,
CASE WHEN count(position) > 0 THEN 'live' ELSE 'position_data_pending' END AS data_quality, count(*) FILTER ({_EASY}) AS easy_wins FROM v GROUP BY workspace_id"""))
def workspace_overview(s: SparkSession, d: str) -> DataFrame:
    return keywords.workspace_overview(latest(s, d))


@job("easy_wins", using("kw_snapshots", f"{_VIEW} SELECT workspace_id, tracked_keyword_id, position, difficulty FROM v WHERE {_EASY}"))
def easy_wins(s: SparkSession, d: str) -> DataFrame:
    return latest(s, d).where(keywords.is_easy_win()).select("workspace_id", "tracked_keyword_id", "position", "difficulty")


_STATUS = "list_element(['ok', 'no_data', 'error', 'ok'], CAST(abs(tracked_keyword_id) % 4 + 1 AS INT))"


def fetched(s: SparkSession, d: str) -> DataFrame:
    k = F.abs("tracked_keyword_id")
    return tracked(s, d).select("*", F.get(F.array(*map(F.lit, ("ok", "no_data", "error", "ok"))), (k % 4).cast("int")).alias("status"), (k * 3).alias("volume"), (k % 100).cast("int").alias("difficulty"), F.lit("commercial").alias("intent"), F.when(k % 3 == 1, F.array(F.lit(1.0), (k % 7) / 2)).when(k % 3 == 2, F.array().cast("array<double>")).alias("trend_points"), F.lit("p1").alias("source"))


@job("keyword_refresh_append", using("kw_snapshots", f"{_TREND}{_TRACKED} SELECT t.tracked_keyword_id, abs(t.tracked_keyword_id) * 3 AS volume, CAST(abs(t.tracked_keyword_id) % 100 AS INT) AS difficulty, 'commercial' AS intent, l.position, CASE WHEN abs(t.tracked_keyword_id) % 3 = 1 THEN '1,' || CASE WHEN abs(t.tracked_keyword_id) % 7 % 2 = 0 THEN CAST(abs(t.tracked_keyword_id) % 7 // 2 AS VARCHAR) ELSE CAST(abs(t.tracked_keyword_id) % 7 // 2 AS VARCHAR) || '.5' END END AS trend_points, 'p1' AS source FROM tracked t LEFT JOIN l USING (tracked_keyword_id) WHERE {_STATUS.replace('tracked_keyword_id', 't.tracked_keyword_id')} = 'ok'"))
def keyword_refresh_append(s: SparkSession, d: str) -> DataFrame:
    return keywords.keyword_refresh(kw(s, d), fetched(s, d), F.lit("2026-07-14 12:00:00").cast("timestamp")).drop("fetched_at")


@job("keyword_refresh_counts", using("kw_snapshots", f"{_TRACKED} SELECT workspace_id, count(*) FILTER ({_STATUS} = 'ok') AS refreshed, count(*) FILTER ({_STATUS} = 'no_data') AS no_data, count(*) FILTER ({_STATUS} = 'error') AS errors FROM tracked GROUP BY workspace_id"))
def keyword_refresh_counts(s: SparkSession, d: str) -> DataFrame:
    return keywords.status_counts(fetched(s, d))


@job("rank_check_append", using("kw_snapshots", f"{_TREND}{_TRACKED} SELECT t.tracked_keyword_id, l.volume, l.difficulty, l.intent, CAST(abs(t.tracked_keyword_id) % 30 AS INT) AS position FROM tracked t LEFT JOIN l USING (tracked_keyword_id) WHERE t.tracked_keyword_id % 5 <> 0"))
def rank_check_append(s: SparkSession, d: str) -> DataFrame:
    k = F.col("tracked_keyword_id")
    ranks = tracked(s, d).select("tracked_keyword_id", (F.abs(k) % 30).cast("int").alias("position"), F.when(k % 5 == 0, "no result").alias("error"))
    return keywords.rank_check(kw(s, d), ranks, F.lit("2026-07-14 12:00:00").cast("timestamp")).drop("fetched_at", "trend_points")


@job("save_keywords", using("keywords", f""", r AS (SELECT workspace_id, lower({strip("'  K' || (keyword_id % 300) || ' '")}) AS keyword, keyword_id AS seq, difficulty FROM keywords),
old AS (SELECT workspace_id, keyword, min(seq) AS seq FROM r WHERE seq % 3 = 0 GROUP BY ALL), new AS (SELECT workspace_id, keyword, min(seq) AS seq FROM r WHERE seq % 3 <> 0 GROUP BY ALL)
SELECT workspace_id, keyword, r.difficulty FROM (SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.workspace_id = n.workspace_id AND old.keyword = n.keyword)) JOIN r USING (workspace_id, keyword, seq)"""))
def save_keywords(s: SparkSession, d: str) -> DataFrame:
    """A third of the requests comes first and is saved; the others follow."""
    name = F.concat(F.lit("  K"), (F.col("keyword_id") % 300).cast("string"), F.lit(" "))
    rows = view(s, d, "keywords").select("workspace_id", name.alias("keyword"), F.col("keyword_id").alias("seq"), "difficulty")
    none = rows.drop("seq").limit(0)
    return keywords.save_keywords(keywords.save_keywords(none, rows.where("seq % 3 = 0")), rows.where("seq % 3 <> 0"))


@job("dedupe_tracked_keywords", using("keywords", f", r AS (SELECT workspace_id, lower({strip('keyword')}) AS keyword, keyword_id AS seq, CASE WHEN keyword_id % 2 = 0 THEN 'US' ELSE 'GB' END AS location FROM keywords) SELECT workspace_id, keyword, arg_max(location, seq) AS location, min(seq) AS first_seq FROM r GROUP BY workspace_id, keyword"))
def dedupe_tracked_keywords(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "keywords").select("workspace_id", F.concat(F.lit("  "), F.upper("keyword"), F.lit("\n")).alias("keyword"), F.when(F.col("keyword_id") % 2 == 0, "US").otherwise("GB").alias("location"), F.col("keyword_id").alias("seq"))
    return keywords.dedupe_tracked(rows)


def _has(some: tuple) -> str:
    return f"list_has_any({words('lower(keyword)')}, {list(some)})"


@job("suggestion_groups", using("keywords", f""", k AS (SELECT workspace_id AS seed, keyword_id AS pos, keyword FROM keywords), e AS (
SELECT seed, 0 AS mode, pos, keyword FROM k WHERE pos % 4 = 0 AND (CASE WHEN seed % 2 = 0 THEN pos % 8 = 0 ELSE pos % 8 = 4 END) UNION ALL SELECT seed, 1, pos, keyword FROM k WHERE pos % 4 = 1
UNION ALL SELECT seed, 2, pos, keyword FROM k WHERE {_has(keywords.PREPOSITIONS)} UNION ALL SELECT seed, 3, pos, keyword FROM k WHERE {_has(keywords.COMPARISONS)}), m AS (SELECT *, min(mode) OVER (PARTITION BY seed, keyword) AS least FROM e)
SELECT seed, list_element(['related', 'questions', 'prepositions', 'comparisons'], mode + 1) AS mode, pos, keyword FROM m WHERE mode = least"""))
def suggestion_groups(s: SparkSession, d: str) -> DataFrame:
    k = view(s, d, "keywords").select(F.col("workspace_id").alias("seed"), F.col("keyword_id").alias("pos"), "keyword")
    # seeds with an even number have an answer of the first provider, the others only of the second
    related = k.where("pos % 4 = 0 AND (CASE WHEN seed % 2 = 0 THEN true ELSE pos % 8 = 4 END)").withColumn("provider", F.when((F.col("seed") % 2 == 0) & (F.col("pos") % 8 == 0), 1).otherwise(2))
    return keywords.suggestion_groups(related, k.where("pos % 4 = 1").withColumn("provider", F.lit(2)), k)


@job("question_keywords", using("keywords", f"SELECT keyword_id, keyword FROM keywords WHERE {' OR '.join(f'starts_with(lower(keyword), {q!r})' for q in keywords.QUESTION_PREFIXES)}"))
def question_keywords(s: SparkSession, d: str) -> DataFrame:
    return keywords.question_keywords(view(s, d, "keywords")).select("keyword_id", "keyword")


@job("cluster_keywords", using("keywords", f""", k AS (SELECT DISTINCT workspace_id, keyword FROM keywords), w AS (SELECT *, {words('lower(keyword)')} AS every FROM k), t AS (SELECT *, list_filter(every, lambda x: NOT list_contains({list(keywords.STOPWORDS)}, x)) AS kept FROM w),
u AS (SELECT *, CASE WHEN len(kept) > 0 THEN kept ELSE every END AS ts FROM t), r AS (SELECT workspace_id, keyword, ts[list_position(list_transform(ts, lambda x: length(x)), list_max(list_transform(ts, lambda x: length(x))))] AS root FROM u)
SELECT workspace_id, root, string_agg(keyword, '|' ORDER BY keyword) AS keywords FROM r GROUP BY workspace_id, root"""))
def cluster_keywords(s: SparkSession, d: str) -> DataFrame:
    k = view(s, d, "keywords")
    return keywords.cluster_keywords(k.where("keyword_id % 2 = 0"), k.where("keyword_id % 3 <> 0 OR keyword_id % 2 = 1")).withColumn("keywords", F.array_join("keywords", "|"))


@job("filter_keywords", using("keywords", "SELECT keyword_id FROM keywords WHERE volume_k * 10 >= 100 AND difficulty <= 60 AND contains(lower(keyword), 'best') AND NOT contains(lower(keyword), 'small')"))
def filter_keywords(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "keywords").withColumn("volume", F.col("volume_k") * 10).withColumn("intent", F.lit("commercial"))
    return keywords.filter_keywords(rows, "commercial", 100, 60, "best", "small").select("keyword_id")


@job("keyword_distributions", using("kw_snapshots", f"""{_VIEW}, x AS (SELECT workspace_id, 'intent' AS kind, coalesce(intent, 'unknown') AS bucket FROM v UNION ALL SELECT workspace_id, 'volume', CASE WHEN volume IS NULL THEN 'unknown' WHEN volume < 100 THEN '0-100' WHEN volume < 1000 THEN '100-1K' WHEN volume < 10000 THEN '1K-10K' ELSE '10K+' END FROM v)
SELECT workspace_id, kind, bucket, count(*) AS n FROM x GROUP BY ALL"""))
def keyword_distributions(s: SparkSession, d: str) -> DataFrame:
    return keywords.keyword_distributions(latest(s, d))


@job("export_keywords_csv", using("kw_snapshots", f"""{_VIEW} SELECT 'k' || tracked_keyword_id AS "Keyword", coalesce(CAST(volume AS VARCHAR), '') AS "Volume", coalesce(CAST(difficulty AS VARCHAR), '') AS "Difficulty", coalesce(intent, '') AS "Intent", trend AS "Trend" FROM v"""))
def export_keywords_csv(s: SparkSession, d: str) -> DataFrame:
    return reports.keyword_export(latest(s, d).withColumn("keyword", F.concat(F.lit("k"), text("tracked_keyword_id"))))


@job("split_list_field", using("profiles", f"SELECT project_id, array_to_string(list_filter(list_transform(string_split_regex(coalesce(services, ''), '[,\\n]'), lambda x: {strip('x')}), lambda x: x <> ''), '|') AS services FROM profiles"))
def split_list_field(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "profiles").select("project_id", F.array_join(split_list(F.col("services")), "|").alias("services"))


# Result pages.


@job("serp_features", using("serp_items", "SELECT keyword_id, count(*) FILTER (item_type = 'paid') AS ads, bool_or(item_type = 'ai_overview') AS ai_overview, bool_or(item_type = 'featured_snippet') AS featured_snippet, false AS local_pack FROM serp_items GROUP BY keyword_id"))
def serp_features(s: SparkSession, d: str) -> DataFrame:
    return serp.serp_features(view(s, d, "serp_items")).select("keyword_id", "ads", "ai_overview", "featured_snippet", "local_pack")


def targets(s: SparkSession, d: str) -> DataFrame:
    """For each keyword the site of the project that its number names."""
    n = s.read.parquet(f"{d}/supplier.parquet").count()
    ids = view(s, d, "serp_items").select("keyword_id").distinct()
    return ids.select("keyword_id", (F.col("keyword_id") % n + 1).alias("project_id")).withColumn("domain", F.concat(F.lit("www.D"), text("project_id"), F.lit(".example")))


_TARGETS = ", t AS (SELECT keyword_id, keyword_id % (SELECT count(*) FROM supplier) + 1 AS project_id FROM (SELECT DISTINCT keyword_id FROM serp_items)), i AS (SELECT *, regexp_replace(lower(domain), '^www\\.', '') AS dom FROM serp_items)"


@job("serp_position", using("serp_items", f"{_TARGETS} SELECT t.keyword_id, project_id, (SELECT arg_min(rank_absolute, pos) FROM i WHERE i.keyword_id = t.keyword_id AND item_type = 'organic' AND dom = 'd' || project_id || '.example') AS position FROM t"))
def serp_position(s: SparkSession, d: str) -> DataFrame:
    items = view(s, d, "serp_items").withColumn("rank_group", F.col("rank_absolute"))
    return serp.serp_position(items, targets(s, d)).select("keyword_id", "project_id", "position")


@job("serp_fallback", using("serp_items", """, k AS (SELECT keyword_id, CAST(count(*) AS BIGINT) AS n FROM serp_items GROUP BY keyword_id)
SELECT keyword_id, CASE WHEN keyword_id % 3 <> 0 THEN 'primary' WHEN keyword_id % 2 = 0 THEN 'secondary' END AS source, CASE WHEN keyword_id % 3 <> 0 THEN n WHEN keyword_id % 2 = 0 THEN n + 1 END AS items, CASE WHEN keyword_id % 3 = 0 AND keyword_id % 2 = 1 THEN 'primary: limit; secondary: down' END AS error FROM k"""))
def serp_fallback(s: SparkSession, d: str) -> DataFrame:
    n = view(s, d, "serp_items").groupBy("keyword_id").agg(F.count("*").alias("items"))
    return serp.serp_fallback(n.withColumn("error", F.when(F.col("keyword_id") % 3 == 0, "limit")), n.select("keyword_id", (F.col("items") + 1).alias("items"), F.when(F.col("keyword_id") % 2 == 1, "down").alias("error")))


@job("top_organic", using("serp_items", "SELECT keyword_id, pos, domain, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY keyword_id ORDER BY pos) AS INT) AS place FROM serp_items WHERE item_type = 'organic') WHERE place <= 10"))
def top_organic(s: SparkSession, d: str) -> DataFrame:
    return serp.top_organic(view(s, d, "serp_items")).select("keyword_id", "pos", "domain", "place")


@job("visibility_check", using("serp_items", f"""{_TARGETS}, a AS (SELECT keyword_id, arg_min(dom, pos) AS ref FROM i WHERE item_type = 'ai_overview' GROUP BY keyword_id), o AS (SELECT keyword_id, list(dom ORDER BY pos)[1:10] AS doms FROM i WHERE item_type = 'organic' GROUP BY keyword_id), w AS (SELECT t.*, 'd' || project_id || '.example' AS own FROM t)
SELECT w.keyword_id, project_id, ref IS NOT NULL AS ai_overview_present, ref = own AS brand_in_ai_overview, (SELECT arg_min(rank_absolute, pos) FROM i WHERE i.keyword_id = w.keyword_id AND item_type = 'organic' AND dom = own) AS organic_rank,
CAST(least(10, len(list_distinct(list_filter(list_concat(CASE WHEN ref IS NULL THEN [] ELSE [ref] END, coalesce(doms, [])), lambda x: x <> own)))) AS INT) AS n_others FROM w LEFT JOIN a USING (keyword_id) LEFT JOIN o USING (keyword_id)"""))
def visibility_check(s: SparkSession, d: str) -> DataFrame:
    items = view(s, d, "serp_items").withColumn("refs", F.array("domain"))
    return serp.visibility_check(items, targets(s, d)).withColumn("n_others", F.size("competitor_domains")).drop("competitor_domains")


_PARTS = "list_filter(list_transform(string_split(coalesce({}, ''), ','), lambda x: trim(x)), lambda x: x <> '')"


@job("suggested_queries", using("profiles", f""", p AS (SELECT project_id, ({_PARTS.format('services')})[1:2] AS s, (list_filter({_PARTS.format('locations')}, lambda x: lower(x) NOT IN ('local', 'unites states', 'united states')))[1:2] AS l, ({_PARTS.format('audiences')})[1:1] AS a FROM profiles),
q AS (SELECT project_id, flatten(list_transform(s, lambda x: list_concat(list_transform(l, lambda y: 'best ' || x || ' in ' || y), list_transform(a, lambda y: x || ' for ' || y), CASE WHEN len(l) = 0 AND len(a) = 0 THEN ['best ' || x] ELSE [] END)))[1:5] AS qs FROM p)
SELECT project_id, unnest(qs) AS query, CAST(unnest(range(len(qs))) AS INT) AS pos FROM q"""))
def suggested_queries(s: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.array_compact(F.array(c)).alias(c)
    return serp.suggested_queries(view(s, d, "profiles").select("project_id", one("services"), one("locations"), one("audiences")))


# Competitors.

_RAW = "CASE c_custkey % 6 WHEN 0 THEN '  https://WWW.Site' || c_custkey || '.Example/path?q#f ' WHEN 1 THEN 'http://site' || c_custkey || '.example.' WHEN 2 THEN 'site' || c_custkey || '.example#x' WHEN 3 THEN '  ' WHEN 4 THEN NULL ELSE 'www.site' || (c_custkey % 10) || '.example' END"
_DOMAIN = "CASE WHEN c_custkey % 6 IN (3, 4) THEN '' WHEN c_custkey % 6 = 5 THEN 'site' || (c_custkey % 10) || '.example' ELSE 'site' || c_custkey || '.example' END"


def raw_domains(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.expr(_RAW).alias("value"))


@job("normalize_domain", f"SELECT c_custkey AS id, {_DOMAIN} AS domain FROM customer")
def normalize_domain_(s: SparkSession, d: str) -> DataFrame:
    return raw_domains(s, d).select(F.col("c_custkey").alias("id"), normalize_domain(F.col("value")).alias("domain"))


@job("register_competitors", f"""WITH r AS (SELECT c_custkey % 7 AS project_id, c_custkey AS seq, {_DOMAIN} AS domain FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY project_id, domain ORDER BY seq) AS rn FROM r)
SELECT project_id, domain, domain AS display_name FROM n WHERE domain <> '' AND rn = 1 AND domain <> 'site5.example'""")
def register_competitors(s: SparkSession, d: str) -> DataFrame:
    rows = raw_domains(s, d).select((F.col("c_custkey") % 7).alias("project_id"), "value", F.lit(" ").alias("display_name"), F.col("c_custkey").alias("seq"))
    return competitors.register_competitors(rows, rows.select("project_id").distinct().withColumn("domain", F.lit("site5.example")))[0]


@job("site_metrics_snapshot", """WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT k AS project_id, CASE WHEN k % 4 <> 0 AND k % 5 <> 0 THEN k % 100 + 1 END AS organic_keywords, CASE WHEN k % 3 = 0 THEN k * 2 END AS referring_domains,
concat_ws(' | ', CASE WHEN k % 4 = 0 THEN 'organic keywords: limit' END, CASE k % 3 WHEN 1 THEN 'backlinks: p2 has no data indexed for this domain' WHEN 2 THEN 'backlinks: down' END) AS error FROM c""")
def site_metrics_snapshot(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = s.read.parquet(f"{d}/customer.parquet").select(k, text("c_custkey").alias("domain"))
    sites = c.select(k.alias("project_id"), F.lit(None).cast("long").alias("competitor_id"), "domain")
    metrics = c.select("domain", F.when(k % 5 == 0, "0").otherwise(F.concat((k % 100 + 1).cast("string"), F.lit(".0"))).alias("organic_keywords"), F.when(k % 4 == 0, "limit").alias("error"))
    overviews = c.select("domain", F.get(F.array(*map(F.lit, ("ok", "no_data", "error"))), (k % 3).cast("int")).alias("status"), (k * 2).alias("referring_domains"), k.alias("total_backlinks"), F.lit("p2").alias("source"), F.when(k % 3 == 2, "down").alias("error"))
    return competitors.site_metrics(sites, metrics, overviews).select("project_id", "organic_keywords", "referring_domains", F.coalesce("error", F.lit("")).alias("error"))


_LATEST = ", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, competitor_id ORDER BY fetched_at DESC, id) AS rn FROM competitor_snapshots) WHERE rn = 1)"


@job("latest_comparison", using("competitor_snapshots", f"""{_LATEST}, c AS (SELECT project_id, competitor_id FROM competitor_snapshots WHERE (project_id + competitor_id) % 4 <> 0 UNION SELECT project_id, 7 FROM competitor_snapshots UNION SELECT project_id, NULL FROM competitor_snapshots)
SELECT c.project_id, CAST(c.competitor_id AS BIGINT) AS competitor_id, id, organic_keywords, referring_domains, total_backlinks FROM c LEFT JOIN l ON c.project_id = l.project_id AND c.competitor_id IS NOT DISTINCT FROM l.competitor_id"""))
def latest_comparison(s: SparkSession, d: str) -> DataFrame:
    """One competitor in four was deleted since, and number 7 was never fetched."""
    rows = view(s, d, "competitor_snapshots")
    active = rows.where("(project_id + competitor_id) % 4 <> 0").select("project_id", "competitor_id").union(rows.select("project_id", F.lit(7).cast("long")))
    return competitors.latest_comparison(rows, active).drop("fetched_at")


@job("comparison_matrix", using("competitor_snapshots", f"""{_LATEST}, u AS (SELECT project_id, coalesce(CAST(competitor_id AS VARCHAR), 'self') AS site, 'organic_keywords' AS metric, CAST(organic_keywords AS BIGINT) AS v FROM l UNION ALL SELECT project_id, coalesce(CAST(competitor_id AS VARCHAR), 'self'), 'referring_domains', referring_domains FROM l UNION ALL SELECT project_id, coalesce(CAST(competitor_id AS VARCHAR), 'self'), 'total_backlinks', total_backlinks FROM l)
SELECT project_id, metric, max(v) FILTER (site = 'self') AS own, max(v) FILTER (site = '1') AS c1, max(v) FILTER (site = '2') AS c2, max(v) FILTER (site = '3') AS c3, max(v) FILTER (site = '4') AS c4, max(v) FILTER (site = '5') AS c5 FROM u GROUP BY project_id, metric"""))
def comparison_matrix(s: SparkSession, d: str) -> DataFrame:
    m = competitors.comparison_matrix(competitors.latest_comparison(view(s, d, "competitor_snapshots")), ["self", "1", "2", "3", "4", "5"])
    return m.select("project_id", "metric", F.col("self").alias("own"), *(F.col(f"`{i}`").alias(f"c{i}") for i in range(1, 6)))


_RANKS = "SELECT workspace_id AS project_id, tracked_keyword_id AS keyword, id % 3 = 0 AS own, position, CASE WHEN id % 4 = 0 THEN NULL ELSE CAST(1 + (id * 7) % 40 AS INT) END AS prior FROM kw_snapshots"


@job("keyword_gap", using("kw_snapshots", f""", r AS ({_RANKS}), g AS (SELECT project_id, keyword, min(CASE WHEN own THEN position END) AS client, min(CASE WHEN own THEN prior END) AS before, min(CASE WHEN NOT own THEN position END) AS best FROM r GROUP BY project_id, keyword)
SELECT project_id, keyword, client, best, CASE WHEN client IS NULL AND before IS NOT NULL THEN 'LOST' WHEN client IS NULL THEN 'UNTAPPED' WHEN client - before >= 10 THEN 'LOST' WHEN client - best >= 10 THEN 'WEAK' WHEN best IS NULL OR client < best THEN 'STRONG' ELSE 'SHARED' END AS class FROM g"""))
def keyword_gap(s: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    return competitors.keyword_gap(kw(s, d).select(F.col("workspace_id").alias("project_id"), F.col("tracked_keyword_id").alias("keyword"), (i % 3 == 0).alias("is_client"), "position", F.when(i % 4 != 0, (1 + (i * 7) % 40).cast("int")).alias("prior_position")))


_OVERLAPS = """, u AS (SELECT DISTINCT keyword_id, regexp_replace(regexp_replace(lower(url), '^https://(www\\.)?', ''), '/+$', '') AS url FROM serp_items WHERE item_type = 'organic' AND url IS NOT NULL),
s AS (SELECT keyword_id, list(url ORDER BY url) AS urls FROM u GROUP BY keyword_id),
g AS (SELECT urls, min(keyword_id) AS id, len(urls) AS n FROM s GROUP BY urls),
x AS (SELECT id, n, unnest(urls) AS url FROM g),
p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.url = b.url AND a.id <> b.id GROUP BY a.id, b.id HAVING count(*) >= 0.4 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
cc(id, root) USING KEY (id) AS (SELECT id, id FROM g UNION SELECT p.b, min(c.root) FROM cc c JOIN p ON c.id = p.a JOIN recurring.cc r ON r.id = p.b WHERE c.root < r.root GROUP BY p.b),
c AS (SELECT keyword_id, root AS cluster, urls FROM s JOIN g USING (urls) JOIN cc ON cc.id = g.id),
o AS (SELECT cluster, url FROM (SELECT cluster, unnest(urls) AS url FROM c) GROUP BY cluster, url HAVING count(*) > 1),
w AS (SELECT keyword_id, string_agg(url, ' ' ORDER BY url) AS shared_urls FROM (SELECT keyword_id, cluster, unnest(urls) AS url FROM c) JOIN o USING (cluster, url) GROUP BY keyword_id),
m AS (SELECT cluster, count(*) AS n_keywords FROM c GROUP BY cluster)
SELECT k.keyword_id, coalesce(cluster, k.keyword_id) AS cluster, coalesce(n_keywords, 1) AS n_keywords, coalesce(shared_urls, '') AS shared_urls
FROM (SELECT DISTINCT keyword_id FROM serp_items) k LEFT JOIN c USING (keyword_id) LEFT JOIN m USING (cluster) LEFT JOIN w USING (keyword_id)"""


@job("serp_overlap_clusters", using("serp_items", _OVERLAPS).replace("WITH ", "WITH RECURSIVE ", 1))
def serp_overlap_clusters(s: SparkSession, d: str) -> DataFrame:
    scratch(s, "clusters")
    return clusters.serp_overlap_clusters(view(s, d, "serp_items"), 0.4).withColumn("shared_urls", F.array_join("shared_urls", " "))


# Suggestions.

_HASH = f"sha256(replace(lower(regexp_replace({strip('content')}, '[ \\t\\n\\r]+', ' ', 'g')), 'ß', 'ss'))"


@job("content_hash", using("suggestions", f"SELECT id, {_HASH} AS hash FROM suggestions"))
def content_hash_(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "suggestions").select("id", content_hash(F.col("content")).alias("hash"))


_ISSUE = "id % 50"


@job("merge_suggestions", using("suggestions", f""", s AS (SELECT *, {_ISSUE} AS issue, status IN ('accepted', 'edited', 'deployed') AS decided, {_HASH} AS h FROM suggestions), old AS (SELECT * FROM s WHERE id % 2 = 0), fresh AS (SELECT * FROM s WHERE id % 2 = 1 AND {_ISSUE} < 40),
new AS (SELECT issue, h, min(id) AS pos FROM fresh WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.issue = fresh.issue AND old.h = fresh.h AND old.decided) GROUP BY issue, h)
SELECT id, issue AS issue_id, status, CAST(0 AS INT) AS rank FROM old WHERE decided OR issue NOT IN (SELECT issue FROM fresh) UNION ALL SELECT NULL, issue, 'pending', CAST(row_number() OVER (PARTITION BY issue ORDER BY pos) AS INT) FROM new"""))
def merge_suggestions(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "suggestions").withColumn("issue_id", F.col("id") % 50)
    stored = rows.where("id % 2 = 0").select("id", "issue_id", "content", F.lit(None).cast("string").alias("edited_content"), "status", F.lit(0).alias("rank"))
    fresh = rows.where("id % 2 = 1 AND issue_id < 40").select("issue_id", F.col("id").alias("pos"), "content")
    return suggestions.merge_suggestions(stored, fresh).select("id", "issue_id", "status", "rank")


@job("dedupe_suggestions", using("suggestions", f", s AS (SELECT *, row_number() OVER (PARTITION BY issue_id, {_HASH} ORDER BY status IN ('accepted', 'edited', 'deployed') DESC, created_at_s, id) AS rn FROM suggestions) SELECT id, CASE WHEN rn = 1 THEN 'keep' WHEN has_revision THEN 'protected' ELSE 'delete' END AS fate FROM s"))
def dedupe_suggestions(s: SparkSession, d: str) -> DataFrame:
    return suggestions.dedupe_suggestions(view(s, d, "suggestions")).select("id", "fate")


@job("demote_superseded", using("suggestions", ", s AS (SELECT *, row_number() OVER (PARTITION BY issue_id, status ORDER BY created_at_s DESC, id DESC) AS rn FROM suggestions) SELECT id, CASE WHEN status = 'deployed' AND rn > 1 THEN 'accepted' ELSE status END AS status FROM s"))
def demote_superseded(s: SparkSession, d: str) -> DataFrame:
    return suggestions.demote_superseded(view(s, d, "suggestions").withColumn("deployed_at", F.col("created_at_s"))).select("id", "status")


def decision_log(s: SparkSession, d: str) -> DataFrame:
    """Events as decisions: the user is the issue, one of three suggestions each, and the action by turns."""
    e = F.col("event_id")
    actions = F.array(*map(F.lit, ("accept", "deploy", "edit", "reject", "rollback")))
    return s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("long").alias("issue_id"), (e % 3).alias("suggestion_id"), "ts", e.alias("seq"), F.get(actions, ((e * 7 + F.col("user_id")) % 5).cast("int")).alias("action"), F.when(e % 4 != 0, F.col("event_type")).alias("content"))


#: One row an event: the statuses and contents of an issue's three suggestions, and how many events of each were applied and refused.
_LIFECYCLE = """WITH RECURSIVE e AS (SELECT user_id AS issue_id, CAST(event_id % 3 AS INT) + 1 AS k, list_element(['accept', 'deploy', 'edit', 'reject', 'rollback'], CAST((event_id * 7 + user_id) % 5 + 1 AS INT)) AS action,
 CASE WHEN event_id % 4 <> 0 THEN event_type END AS content, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r(issue_id, n, st, ct, ap, re) AS (SELECT DISTINCT issue_id, CAST(0 AS BIGINT), ['pending', 'pending', 'pending'], CAST([NULL, NULL, NULL] AS VARCHAR[]), [0, 0, 0], [0, 0, 0] FROM e UNION ALL
 SELECT issue_id, n, CASE WHEN ok THEN list_transform(st, lambda x, i: CASE WHEN i = k THEN CASE action WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'edit' THEN 'edited' WHEN 'deploy' THEN 'deployed' ELSE 'accepted' END WHEN action = 'deploy' AND x = 'deployed' THEN 'accepted' ELSE x END) ELSE st END,
  CASE WHEN ok AND action = 'edit' THEN list_transform(ct, lambda x, i: CASE WHEN i = k THEN trim(content) ELSE x END) ELSE ct END,
  list_transform(ap, lambda x, i: CASE WHEN i = k AND ok THEN x + 1 ELSE x END), list_transform(re, lambda x, i: CASE WHEN i = k AND NOT ok THEN x + 1 ELSE x END)
 FROM (SELECT e.*, r.st, r.ct, r.ap, r.re, CASE action WHEN 'deploy' THEN r.st[k] IN ('accepted', 'edited') WHEN 'rollback' THEN r.st[k] = 'deployed' WHEN 'edit' THEN r.st[k] <> 'deployed' AND coalesce(trim(content), '') <> '' ELSE r.st[k] <> 'deployed' END AS ok FROM r JOIN e ON e.issue_id = r.issue_id AND e.n = r.n + 1)),
l AS (SELECT * FROM r WHERE n = (SELECT max(n) FROM e WHERE e.issue_id = r.issue_id)), o AS (SELECT issue_id, unnest([1, 2, 3]) AS k, st, ct, ap, re FROM l)
SELECT issue_id, CAST(k - 1 AS BIGINT) AS suggestion_id, st[k] AS status, ct[k] AS content, CAST(ap[k] AS INT) AS applied, CAST(re[k] AS INT) AS refused FROM o WHERE ap[k] + re[k] > 0"""


@job("suggestion_lifecycle", _LIFECYCLE)
def suggestion_lifecycle(s: SparkSession, d: str) -> DataFrame:
    return suggestions.suggestion_lifecycle(decision_log(s, d))


def revisions(s: SparkSession, d: str) -> DataFrame:
    fields = F.array(*map(F.lit, ("title", "h1", "canonical", "lang")))
    i = F.col("id")
    return view(s, d, "suggestions").select("id", (i % 100).alias("page_id"), (i % 7).alias("project_id"), F.get(fields, (i % 4).cast("int")).alias("field_name"), F.concat(F.lit("v"), text("id")).alias("after_value"), F.col("created_at_s").alias("created_at"))


@job("apply_deploys_to_pages", using("suggestions page_facts", """, r AS (SELECT id % 100 AS page_id, list_element(['title', 'h1', 'canonical', 'lang'], CAST(id % 4 + 1 AS INT)) AS field, arg_max('v' || id, created_at_s) AS v FROM suggestions GROUP BY 1, 2)
SELECT page_id, coalesce((SELECT v FROM r WHERE r.page_id = p.page_id AND field = 'title'), title) AS title, coalesce((SELECT v FROM r WHERE r.page_id = p.page_id AND field = 'h1'), h1_1) AS h1, coalesce((SELECT v FROM r WHERE r.page_id = p.page_id AND field = 'canonical'), canonical) AS canonical, lang FROM page_facts p"""))
def apply_deploys_to_pages(s: SparkSession, d: str) -> DataFrame:
    pages = view(s, d, "page_facts").select("page_id", "title", F.array("h1_1").alias("h1"), "canonical", "lang")
    return suggestions.apply_deploys(pages, revisions(s, d)).withColumn("h1", F.get("h1", F.lit(0)))


@job("revision_history", using("suggestions", "SELECT id, id % 7 AS project_id, CAST(row_number() OVER (PARTITION BY id % 7 ORDER BY created_at_s DESC, id DESC) AS INT) AS place FROM suggestions"))
def revision_history(s: SparkSession, d: str) -> DataFrame:
    scratch(s, "ranks")
    return suggestions.revision_history(revisions(s, d)).select("id", "project_id", "place")


@job("resolve_post_ids", using("page_facts", """, p AS (SELECT page_id, project_id, page_id % 400 AS slug FROM page_facts), posts AS (SELECT project_id, CASE page_id % 4 WHEN 0 THEN 'posts' WHEN 1 THEN 'pages' WHEN 2 THEN 'notes' ELSE 'media' END AS kind, page_id % 400 AS slug, page_id FROM page_facts),
one AS (SELECT project_id, slug, kind, min(page_id) AS post_id FROM posts WHERE kind <> 'media' GROUP BY ALL HAVING count(*) = 1), best AS (SELECT DISTINCT ON (project_id, slug) * FROM one ORDER BY project_id, slug, CASE kind WHEN 'posts' THEN 0 WHEN 'pages' THEN 1 ELSE 2 END, kind)
SELECT p.page_id, CASE WHEN p.page_id % 9 <> 0 THEN post_id END AS post_id, CASE WHEN p.page_id % 9 <> 0 THEN kind END AS post_type, CASE WHEN p.page_id % 9 <> 0 AND post_id IS NOT NULL THEN 'ok' ELSE 'no_data' END AS status FROM p LEFT JOIN best b ON p.project_id = b.project_id AND p.slug = b.slug"""))
def resolve_post_ids(s: SparkSession, d: str) -> DataFrame:
    f, i = view(s, d, "page_facts"), F.col("page_id")
    slug = (i % 400).cast("string")
    pages = f.select("page_id", "project_id", F.when(i % 9 == 0, "https://s.example/").otherwise(F.concat(F.lit("https://s.example/a/"), slug, F.lit("/?x=1"))).alias("url"))
    posts = f.select("project_id", F.get(F.array(*map(F.lit, ("posts", "pages", "notes", "media"))), (i % 4).cast("int")).alias("post_type"), slug.alias("slug"), i.alias("post_id"))
    return suggestions.resolve_posts(pages, posts).drop("url", "project_id")


@job("parse_numbered_suggestions", using("page_facts", "SELECT page_id AS id, CAST(k AS INT) AS pos, CASE k WHEN 0 THEN 'first ' || page_id ELSE 'second' END AS suggestion FROM page_facts, (VALUES (0), (1)) t(k)"))
def parse_numbered_suggestions(s: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("Here they are:\n 1. first "), text("page_id"), F.lit("\r\n2.second\n\n4. no\nend"))
    return suggestions.parse_numbered(view(s, d, "page_facts").select(F.col("page_id").alias("id"), body.alias("text")))


@job("parse_understanding_json", using("page_facts", "SELECT page_id AS id, page_id % 3 <> 2 AS valid, CASE WHEN page_id % 3 <> 2 THEN 'topic ' || page_id END AS main_topic FROM page_facts"))
def parse_understanding_json(s: SparkSession, d: str) -> DataFrame:
    fields = F.to_json(F.struct(F.lit("service").alias("page_type"), F.concat(F.lit("topic "), text("page_id")).alias("main_topic"), F.lit("local").alias("search_intent"), F.lit("k").alias("primary_keyword"), F.array(F.lit("a")).alias("secondary_keywords"), F.lit("local").alias("geo_relevance"), F.lit(0.5).alias("context_confidence")))
    body = F.when(F.col("page_id") % 3 == 0, fields).when(F.col("page_id") % 3 == 1, F.concat(F.lit("```json\n"), fields, F.lit("\n```"))).otherwise("not json")
    out = suggestions.parse_understanding(view(s, d, "page_facts").select(F.col("page_id").alias("id"), body.alias("text")))
    return out.select("id", "valid", F.when(F.col("valid"), F.col("u.main_topic")).alias("main_topic"))


# Migrations.


@job("reshape_profiles", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS services, concat_ws(' & ', CASE WHEN concat_ws(', ', CASE WHEN c_custkey % 2 = 0 THEN 'Paris' END, CASE WHEN c_custkey % 5 <> 0 THEN 'France' END) <> '' THEN concat_ws(', ', CASE WHEN c_custkey % 2 = 0 THEN 'Paris' END, CASE WHEN c_custkey % 5 <> 0 THEN 'France' END) END, CASE WHEN c_custkey % 4 = 0 THEN 'EU' END) AS locations FROM customer")
def reshape_profiles(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    flat = s.read.parquet(f"{d}/customer.parquet").select(
        k.alias("id"), F.lit("b").alias("business_name"), F.lit("d").alias("business_description"), F.when(k % 3 != 0, F.col("c_mktsegment")).otherwise("").alias("products_services"), F.lit("").alias("target_audience"),
        F.when(k % 2 == 0, "Paris").alias("city"), F.lit("").alias("state_region"), F.when(k % 5 != 0, "France").alias("country"), F.when(k % 4 == 0, "EU").alias("primary_market"), F.lit("t").alias("brand_tone"),
    )
    return upserts.reshape_profiles(flat).select("id", F.array_join("services", "|").alias("services"), F.array_join("locations", " & ").alias("locations"))


@job("backfill_workspaces", using("keywords", "SELECT workspace_id AS workspace_id, count(*) AS n FROM keywords WHERE keyword_id % 3 <> 2 GROUP BY workspace_id"))
def backfill_workspaces(s: SparkSession, d: str) -> DataFrame:
    k = view(s, d, "keywords").select(F.col("workspace_id").alias("project_id"), "keyword", "keyword_id")
    _, own, saved = upserts.backfill_workspaces(k.where("keyword_id % 3 = 0"), k.where("keyword_id % 3 = 1"))
    return own.unionByName(saved).groupBy("workspace_id").agg(F.count("*").alias("n"))
