"""Jobs over links, backlinks, crawl plans, work queues and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backlinks, links, upserts
from ..sources import reports
from ..streaming.pages import stream_upsert_pages
from .scratch import scratch
from .sql import using
from .views import SQL, view

JOBS: dict = {}


def job(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        JOBS[name] = (f, sql)
        return f

    return add


def of_latest(s: SparkSession, d: str) -> DataFrame:
    return links.of_latest(view(s, d, "page_links"), view(s, d, "onpage_tasks"))


_TASK = ", t AS (SELECT project_id, arg_max(task_id, (finished_s, -task_id)) AS task_id FROM onpage_tasks WHERE status = 'fetched' GROUP BY project_id), k AS (SELECT l.* FROM page_links l JOIN t USING (project_id, task_id)), c AS (SELECT *, regexp_replace(url_to, '/+$', '') AS target FROM k)"
VIEWS = "page_links onpage_tasks"


@job("store_links", using("page_links", "SELECT task_id, count(*) AS n, count(*) FILTER (is_broken) AS broken, count(*) FILTER (is_link_relation_conflict) AS conflicts FROM page_links WHERE is_link_relation_conflict OR task_id % 3 <> 0 GROUP BY task_id"))
def store_links(s: SparkSession, d: str) -> DataFrame:
    raw = view(s, d, "page_links").withColumn("is_broken", F.when(F.col("is_broken"), True)).withColumn("url_from", F.when((F.col("task_id") % 3 == 0) & ~F.col("is_link_relation_conflict"), "").otherwise(F.col("url_from")))
    kept = links.store_links(raw)
    return kept.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if("is_broken").alias("broken"), F.count_if("is_link_relation_conflict").alias("conflicts"))


@job("latest_fetched_task", using(VIEWS, f"{_TASK} SELECT * FROM t"))
def latest_fetched_task(s: SparkSession, d: str) -> DataFrame:
    return links.latest_fetched_task(view(s, d, "onpage_tasks"))


@job("link_mix", using(VIEWS, f"{_TASK} SELECT project_id, count(*) AS total, count(*) FILTER (is_broken) AS broken, count(*) FILTER (direction = 'internal') AS internal, count(*) FILTER (direction = 'external') AS external, count(*) FILTER (dofollow) AS dofollow, count(*) FILTER (NOT dofollow) AS nofollow, count(*) FILTER (is_link_relation_conflict) AS conflicts FROM k GROUP BY project_id"))
def link_mix(s: SparkSession, d: str) -> DataFrame:
    return links.link_mix(of_latest(s, d))


def crawled(rows: DataFrame) -> DataFrame:
    return rows.select("project_id", F.col("url_from").alias("url")).distinct()


_ORPHANS = f"{_TASK}, o AS (SELECT DISTINCT project_id, url_from AS url FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.project_id = k.project_id AND c.direction = 'internal' AND c.target = k.url_from))"


@job("orphan_pages", using(VIEWS, f"{_ORPHANS} SELECT * FROM o"))
def orphan_pages(s: SparkSession, d: str) -> DataFrame:
    rows = of_latest(s, d)
    return links.orphan_pages(crawled(rows), rows)


@job("inbound_link_counts", using(VIEWS, f"{_TASK}, n AS (SELECT project_id, target AS url, count(*) AS inbound FROM c WHERE direction = 'internal' GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY inbound DESC, url) AS INT) AS place FROM n) WHERE place <= 15"))
def inbound_link_counts(s: SparkSession, d: str) -> DataFrame:
    return links.top_inbound(of_latest(s, d))


@job("link_health", using(VIEWS, f"{_ORPHANS}, n AS (SELECT project_id, count(*) AS orphans FROM o GROUP BY project_id), b AS (SELECT project_id, count(*) AS total, count(*) FILTER (is_broken) AS broken FROM k GROUP BY project_id) SELECT project_id, CAST(round_even(greatest(0, 100 - broken / CAST(total AS DOUBLE) * 300 - 2 * coalesce(orphans, 0)), 0) AS INT) AS health, coalesce(orphans, 0) AS orphans FROM b LEFT JOIN n USING (project_id)"))
def link_health(s: SparkSession, d: str) -> DataFrame:
    rows = of_latest(s, d)
    return links.link_health(rows, crawled(rows))


@job("broken_links", using(VIEWS, f"{_TASK} SELECT project_id, url_from, url_to, status_code FROM k WHERE is_broken"))
def broken_links(s: SparkSession, d: str) -> DataFrame:
    return links.broken_links(of_latest(s, d)).select("project_id", "url_from", "url_to", "status_code")


def edges(s: SparkSession, d: str) -> DataFrame:
    """Internal links without the slash at the end, so that targets are pages that link on."""
    return of_latest(s, d).where("direction = 'internal'").select("project_id", "url_from", F.regexp_replace("url_to", "/+$", "").alias("url_to"))


def starts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_id").agg(F.min("url_from").alias("url"))


_REACH = f"""WITH RECURSIVE page_links AS ({SQL["page_links"]}), onpage_tasks AS ({SQL["onpage_tasks"]}){_TASK}, e AS (SELECT DISTINCT project_id, url_from, target FROM c WHERE direction = 'internal'), home AS (SELECT project_id, min(url_from) AS url FROM e GROUP BY project_id),
reach(project_id, url, depth) USING KEY (project_id, url) AS (SELECT project_id, url, 0 FROM home UNION SELECT e.project_id, e.target, min(r.depth) + 1 FROM reach r JOIN e ON e.project_id = r.project_id AND e.url_from = r.url
 WHERE NOT EXISTS (SELECT 1 FROM recurring.reach s WHERE s.project_id = e.project_id AND s.url = e.target) GROUP BY e.project_id, e.target)"""


@job("crawl_frontier", f"{_REACH} SELECT project_id, url, depth FROM reach")
def crawl_frontier(s: SparkSession, d: str) -> DataFrame:
    rows = edges(s, d)
    return links.crawl_frontier(rows, starts(rows), scratch(s, "frontier"))


@job("plan_crawl_urls", f"""{_REACH}, sm AS (SELECT DISTINCT project_id, target AS url, CAST(regexp_extract(target, '([0-9]+)$', 1) AS INT) AS pos FROM e WHERE project_id % 2 = 0),
r AS (SELECT * FROM sm UNION ALL SELECT project_id, url, depth AS pos FROM reach WHERE project_id NOT IN (SELECT project_id FROM sm)),
o AS (SELECT project_id, url, -1 AS pos FROM home UNION ALL SELECT * FROM r WHERE (project_id, url) NOT IN (SELECT (project_id, url) FROM home)),
p AS (SELECT project_id, url, min(pos) AS pos FROM o GROUP BY project_id, url), n AS (SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY pos, url) AS INT) AS place, url FROM p) SELECT * FROM n WHERE place <= 100""")
def plan_crawl_urls(s: SparkSession, d: str) -> DataFrame:
    """The sitemap of every other project lists its targets by the number at their end."""
    rows = edges(s, d)
    found = links.crawl_frontier(rows, starts(rows), scratch(s, "frontier"))
    sitemap = rows.where("project_id % 2 = 0").select("project_id", F.col("url_to").alias("url")).distinct().withColumn("pos", F.regexp_extract("url", "([0-9]+)$", 1).cast("int"))
    return links.plan_crawl(starts(rows), sitemap, found, 100)


@job("extract_sitemap_urls", """WITH p AS (SELECT page_id, page_id // 1000 AS site, 'https://site' || (page_id // 1000) || '.example' AS origin FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS pos FROM p)
SELECT origin, CAST(pos AS INT) AS pos, origin || '/p/' || page_id AS url FROM n WHERE pos <= 100""")
def extract_sitemap_urls(s: SparkSession, d: str) -> DataFrame:
    """Each site of up to a thousand pages has a robots.txt that names an index, which names a list of its pages, with repeats, queries and
    foreign URLs."""
    scratch(s, "sitemaps")
    origin = F.concat(F.lit("https://site"), F.expr("page_id div 1000").cast("string"), F.lit(".example"))
    p = s.read.parquet(f"{d}/pages.parquet").select("page_id", origin.alias("origin"))
    loc = F.concat(F.lit("<url><loc>\n"), "origin", F.lit("/p/"), F.col("page_id").cast("string"), F.lit("/?a=1&amp;b=2</loc></url><url><loc>https://other.example/</loc></url>"))
    lists = p.groupBy("origin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", loc.alias("x")))), lambda r: r["x"]), "").alias("x"))
    body = lambda path, text: lists.select(F.concat("origin", F.lit(path)).alias("url"), text.alias("body"), F.lit(200).alias("status"))
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>"), "origin", F.lit("/list.xml</loc></sitemap><sitemap><loc>"), "origin", F.lit("/index.xml</loc></sitemap></sitemapindex>"))
    bodies = body("/robots.txt", F.concat(F.lit("User-agent: *\r\nsiteMAP:  "), "origin", F.lit("/index.xml\r\n"))).unionByName(body("/index.xml", index)).unionByName(body("/list.xml", F.concat(F.lit("<urlset>"), "x", "x", F.lit("</urlset>"))))
    return reports.extract_sitemap_urls(bodies, lists.select("origin"))


# Backlinks.


def pulls_by_project(s: SparkSession, d: str) -> DataFrame:
    """The pulls of a project lie in one task, so that they are made distinct, ordered and combined there, without a further exchange of their texts."""
    return detailed(view(s, d, "backlink_pulls", "l_suppkey"))


def calendar(pulls: DataFrame) -> DataFrame:
    """Every pull of every project, those without links too; there are few pulls."""
    numbers = sorted(r[0] for r in pulls.select("pull_no").distinct().collect())
    return pulls.select("project_id").distinct().select("project_id", F.explode(F.array(*map(F.lit, numbers))).alias("pull_no"))


_HISTORY = """, years AS (SELECT DISTINCT pull_no FROM backlink_pulls), r AS (SELECT *, dense_rank() OVER (ORDER BY pull_no) AS k FROM years), x AS (SELECT b.*, k, k - lag(k, 1, -1) OVER (PARTITION BY project_id, source_url, target_url ORDER BY k) > 1 AS new FROM backlink_pulls b JOIN r USING (pull_no)),
h AS (SELECT project_id, source_url, target_url, min(pull_no) AS first_seen, max(pull_no) AS last_seen, (SELECT min(pull_no) FROM years WHERE pull_no > max(x.pull_no)) AS lost_at, count(*) FILTER (new) AS episodes, arg_max(domain_rank, pull_no) AS domain_rank, 'a' || min(pull_no) AS anchor, min(pull_no) % 2 = 1 AS is_follow, max(pull_no) FILTER (pull_no % 2 = 1) - 1990 AS spam_score FROM x GROUP BY project_id, source_url, target_url)"""


@job("backlink_history", using("backlink_pulls", f"{_HISTORY} SELECT project_id, source_url, target_url, first_seen, last_seen, lost_at, episodes, domain_rank, anchor, is_follow, CAST(spam_score AS INT) AS spam_score FROM h"))
def backlink_history(s: SparkSession, d: str) -> DataFrame:
    pulls = pulls_by_project(s, d)
    return backlinks.backlink_history(pulls, calendar(pulls))


@job("backlink_history_folded", using("backlink_pulls", f"{_HISTORY} SELECT project_id, source_url, target_url, first_seen, last_seen, lost_at, episodes, domain_rank, anchor, is_follow, CAST(spam_score AS INT) AS spam_score FROM h"))
def backlink_history_folded(s: SparkSession, d: str) -> DataFrame:
    """The same rows from three parts: the pulls up to 1993, those up to 1996 and the rest, each folded into the history before it."""
    pulls = pulls_by_project(s, d)
    days = calendar(pulls)
    history = None
    for part in ("pull_no <= 1993", "pull_no > 1993 AND pull_no <= 1996", "pull_no > 1996"):
        later = backlinks.backlink_history(pulls.where(part), days.where(part))
        history = later if history is None else backlinks.fold_history(history, later, days.where(part))
    return history


def detailed(pulls: DataFrame) -> DataFrame:
    """Pulls with an anchor and flag that change over the pulls, and a spam score that is known every other time."""
    odd = F.pmod("pull_no", F.lit(2)) == 1
    return pulls.withColumns({"anchor": F.concat(F.lit("a"), F.col("pull_no").cast("string")), "is_follow": odd, "spam_score": F.when(odd, F.col("pull_no") - 1990)})


def stored_before(pulls: DataFrame, year: int) -> DataFrame:
    earlier = pulls.where(F.col("pull_no") < year)
    h = backlinks.backlink_history(earlier, calendar(earlier))
    return h.select(*backlinks.KEY, "anchor", "is_follow", "domain_rank", "spam_score", "first_seen", "last_seen", "lost_at")


def diffed(s: SparkSession, d: str) -> DataFrame:
    """The last pull against all before it; it succeeded for every project, also those that it has no links of."""
    pulls = detailed(view(s, d, "backlink_pulls"))
    last = pulls.agg(F.max("pull_no")).first()[0] or 0
    pull = pulls.where(F.col("pull_no") == last).select(*backlinks.KEY, F.lit(0).alias("seq"), "anchor", (~F.col("is_follow")).cast("string").alias("nofollow"), "domain_rank", "spam_score")
    return backlinks.backlink_diff(stored_before(pulls, last), pull, pulls.select("project_id"), F.lit(last))


_DIFF = """, prev AS (SELECT max(pull_no) AS y FROM backlink_pulls), rows AS (SELECT b.*, pull_no % 2 = 1 AS odd FROM backlink_pulls b),
old AS (SELECT project_id, source_url, target_url, min(pull_no) AS first, max(pull_no) AS last, arg_max(domain_rank, pull_no) AS rank, max(pull_no) FILTER (odd) - 1990 AS spam FROM rows WHERE pull_no < (SELECT y FROM prev) GROUP BY project_id, source_url, target_url),
f AS (SELECT project_id, source_url, target_url, pull_no, domain_rank, CASE WHEN odd THEN pull_no - 1990 END AS spam FROM rows WHERE pull_no = (SELECT y FROM prev)),
next AS (SELECT o.last, (SELECT min(pull_no) FROM backlink_pulls WHERE pull_no > o.last) AS gone FROM (SELECT DISTINCT last FROM old) o),
d AS (SELECT project_id, source_url, target_url, 'a' || coalesce(o.first, y) AS anchor, coalesce(o.first, y) % 2 = 1 AS is_follow, coalesce(f.domain_rank, o.rank) AS domain_rank, CAST(coalesce(f.spam, o.spam) AS INT) AS spam_score,
 CAST(coalesce(o.first, y) AS INT) AS first_seen, CAST(CASE WHEN f.pull_no IS NOT NULL THEN y ELSE o.last END AS INT) AS last_seen, CASE WHEN f.pull_no IS NULL THEN next.gone END AS lost_at,
 CASE WHEN o.last IS NULL THEN 'new' WHEN f.pull_no IS NOT NULL THEN 'active' WHEN next.gone = y THEN 'lost' ELSE 'gone' END AS change
 FROM (SELECT * FROM old) o FULL JOIN f USING (project_id, source_url, target_url) LEFT JOIN next ON next.last = o.last CROSS JOIN prev)"""


@job("backlink_diff", using("backlink_pulls", f"{_DIFF} SELECT * FROM d"))
def backlink_diff(s: SparkSession, d: str) -> DataFrame:
    return diffed(s, d)


@job("backlink_diff_counts", using("backlink_pulls", f"{_DIFF} SELECT project_id, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'lost') AS lost, count(*) FILTER (change = 'active') AS still_active FROM d GROUP BY project_id"))
def backlink_diff_counts(s: SparkSession, d: str) -> DataFrame:
    return backlinks.diff_counts(diffed(s, d))


def _tab(name: str, keep: str, order: str) -> str:
    return f"SELECT project_id, '{name}' AS tab, CAST(row_number() OVER (PARTITION BY project_id ORDER BY {order} source_url, target_url) AS INT) AS place, source_url, target_url FROM h2 WHERE {keep}"


@job("backlink_tabs", using("backlink_pulls", f"{_HISTORY}, h2 AS (SELECT *, max(first_seen) OVER (PARTITION BY project_id) AS newest FROM h), t AS ({_tab('active', 'lost_at IS NULL', 'last_seen DESC,')} UNION ALL {_tab('lost', 'lost_at IS NOT NULL', 'lost_at DESC,')} UNION ALL {_tab('new', 'first_seen = newest', '')}) SELECT * FROM t WHERE place <= 200"))
def backlink_tabs(s: SparkSession, d: str) -> DataFrame:
    scratch(s, "history")
    return backlinks.backlink_tabs(backlink_history(s, d).checkpoint()).select("project_id", "tab", "place", "source_url", "target_url")


@job("latest_backlink_overview", using("competitor_snapshots", ", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY fetched_at DESC, id) AS rn FROM competitor_snapshots) WHERE rn = 1), p AS (SELECT DISTINCT o_custkey % 30 AS project_id FROM orders) SELECT p.project_id, id, total_backlinks, id IS NULL AS no_snapshot_yet FROM p LEFT JOIN l USING (project_id)"))
def latest_backlink_overview(s: SparkSession, d: str) -> DataFrame:
    projects = s.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 30).alias("project_id")).distinct()
    return backlinks.latest_overview(projects, view(s, d, "competitor_snapshots")).select("project_id", "id", "total_backlinks", "no_snapshot_yet")


@job("normalize_backlink_overview", "SELECT o_orderkey AS project_id, CASE WHEN o_orderkey % 7 = 0 THEN 'error' WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN 'no_data' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 THEN CAST(50 AS BIGINT) END AS authority, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 THEN CAST(o_orderkey AS BIGINT) - 3 END AS follow_links FROM orders")
def normalize_backlink_overview(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = s.read.parquet(f"{d}/orders.parquet").select(k.alias("project_id"), F.when(k % 7 == 0, "down").alias("error"), (k % 5 == 0).alias("no_data"), F.when(k % 11 != 0, "50.0").alias("authority"), F.lit("9").alias("total_backlinks"), k.cast("string").alias("referring_pages"), F.lit("3.0").alias("referring_pages_nofollow"))
    return backlinks.normalize_overview(rows).select("project_id", "status", "authority", "follow_links")


@job("read_backlink_json", using("backlink_pulls", "SELECT project_id, source_url, target_url, 'false' AS nofollow, domain_rank FROM backlink_pulls WHERE pull_no = 1997"))
def read_backlink_json(s: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("source_url").alias("url_from"), F.col("target_url").alias("url_to"), F.lit(True).alias("dofollow"), F.col("domain_rank").alias("domain_from_rank"))
    bodies = view(s, d, "backlink_pulls").where("pull_no = 1997").groupBy("project_id", "target_url").agg(F.collect_list(item).alias("items")).select("project_id", F.to_json(F.struct("items")).alias("json"))
    return reports.read_backlink_json(bodies).select("project_id", "source_url", "target_url", "nofollow", "domain_rank")


_ANCHOR = "CASE (domain_rank + pull_no) % 6 WHEN 0 THEN 'The SITE' || project_id || ' shop' WHEN 1 THEN ' Keyword' || project_id || ' ' WHEN 2 THEN 'click here' WHEN 3 THEN source_url WHEN 4 THEN NULL ELSE 'some words' END"
_KIND = "CASE (domain_rank + pull_no) % 6 WHEN 0 THEN 'branded' WHEN 1 THEN 'exact_match' WHEN 2 THEN 'generic' WHEN 3 THEN 'naked_url' ELSE 'other' END"


def anchored(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pulls = view(s, d, "backlink_pulls").withColumn("anchor", F.expr(_ANCHOR))
    projects = pulls.select("project_id").distinct()
    name = lambda p: F.concat(F.lit(p), F.col("project_id").cast("string"))
    # a brand that no URL holds, as it has a blank where they have none
    return pulls, projects.withColumn("brand", F.concat(name("Site"), F.lit(" "))), projects.withColumn("keyword", name("keyword"))


@job("anchor_distribution", using("backlink_pulls", f", a AS (SELECT project_id, {_KIND} AS kind FROM backlink_pulls), n AS (SELECT project_id, kind, count(*) AS n FROM a GROUP BY ALL) SELECT *, n / CAST(sum(n) OVER (PARTITION BY project_id) AS DOUBLE) AS share FROM n"))
def anchor_distribution(s: SparkSession, d: str) -> DataFrame:
    return backlinks.anchor_distribution(*anchored(s, d))


@job("toxic_links", using("backlink_pulls", f", a AS (SELECT *, {_KIND} AS kind, count(*) OVER (PARTITION BY project_id, source_url, lower(trim(coalesce({_ANCHOR}, '')))) > 5 AS many FROM backlink_pulls), r AS (SELECT project_id, source_url, target_url, pull_no, concat_ws('|', CASE WHEN domain_rank < 10 AND kind = 'exact_match' THEN 'low_authority_exact_match' END, CASE WHEN many THEN 'repeated_anchor' END) AS reasons FROM a) SELECT * FROM r WHERE reasons <> ''"))
def toxic_links(s: SparkSession, d: str) -> DataFrame:
    return backlinks.toxic_links(*anchored(s, d)).select("project_id", "source_url", "target_url", "pull_no", F.array_join("reasons", "|").alias("reasons"))


@job("backlink_gap", using("backlink_pulls", """, own AS (SELECT DISTINCT project_id, regexp_extract(source_url, '//([^/]*)', 1) AS domain FROM backlink_pulls WHERE pull_no = 1992), x AS (SELECT project_id, regexp_extract(source_url, '//([^/]*)', 1) AS domain, pull_no AS rival, max(domain_rank) AS a, count(*) AS l FROM backlink_pulls WHERE pull_no > 1992 GROUP BY ALL),
g AS (SELECT project_id, domain, count(*) AS rivals, max(a) AS authority, CAST(sum(l) AS BIGINT) AS links FROM x WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.project_id = x.project_id AND own.domain = x.domain) GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY rivals DESC, authority DESC, links DESC, domain) AS INT) AS place FROM g"""))
def backlink_gap(s: SparkSession, d: str) -> DataFrame:
    """The years stand for sites: the first for the project's own, the others for rivals."""
    scratch(s, "ranks")
    pulls = view(s, d, "backlink_pulls")
    return backlinks.backlink_gap(pulls.where("pull_no = 1992"), pulls.where("pull_no > 1992").withColumnRenamed("pull_no", "competitor"))


@job("job_board", using("jobs", """, b AS (SELECT *, CASE WHEN status IN ('failed', 'cancelled') THEN 'failed' ELSE status END AS board FROM jobs), r AS (SELECT *, CASE WHEN board = 'queued' THEN row_number() OVER (PARTITION BY project_id, board ORDER BY created_at, id) ELSE row_number() OVER (PARTITION BY project_id, board ORDER BY created_at DESC, id) END AS place FROM b)
SELECT project_id, board, CAST(place AS INT) AS place, id FROM r WHERE board IN ('queued', 'running') OR place <= 20"""))
def job_board(s: SparkSession, d: str) -> DataFrame:
    scratch(s, "ranks")
    return upserts.job_board(view(s, d, "jobs")).select("project_id", "board", "place", "id")


@job("job_badges", using("jobs", "SELECT project_id, count(*) FILTER (status IN ('running', 'queued')) AS badge FROM jobs GROUP BY project_id"))
def job_badges(s: SparkSession, d: str) -> DataFrame:
    return upserts.job_badges(view(s, d, "jobs"))


# Streams.


@job("stream_upsert_pages", using("page_facts", ", r AS (SELECT project_id, 'https://x/' || (page_id % 300) AS url, title, page_id FROM page_facts) SELECT project_id, url, arg_max(coalesce(title, chr(0)), page_id) AS title FROM r GROUP BY ALL"))
def stream_upsert_pages_(s: SparkSession, d: str) -> DataFrame:
    """The pages in four folders, the later ones with later results, through the stream in about as many batches; the state after it is that of one upsert.
    A folder has a file from each task that reads the pages, so none takes a quarter of them."""
    url = F.concat(F.lit("https://x/"), (F.col("page_id") % 300).cast("string"))
    rows = view(s, d, "page_facts").select("project_id", url.alias("url"), F.coalesce("title", F.lit("\0")).alias("title"), F.col("page_id").alias("seq"))
    out = scratch(s, "stream")
    for i, part in enumerate(_quarters(rows)):
        part.write.parquet(f"{out}/in/{i}")
    files = len(s.read.schema(rows.schema).parquet(f"{out}/in/*").inputFiles())
    return stream_upsert_pages(s, f"{out}/in/*", rows.schema, f"{out}/pages", f"{out}/checkpoint", max(1, -(-files // 4)))


def _quarters(rows: DataFrame) -> list[DataFrame]:
    cuts = rows.stat.approxQuantile("seq", [0.25, 0.5, 0.75], 0.01)
    bounds = [float("-inf"), *cuts, float("inf")]
    return [rows.where((F.col("seq") > a) & (F.col("seq") <= b)) for a, b in zip(bounds, bounds[1:], strict=False)]

