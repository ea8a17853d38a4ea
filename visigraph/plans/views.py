"""Adapter views: the given tables under the names and columns of the domain. The SQL runs in Spark and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "page_facts": """
SELECT doc_id AS page_id, CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) AS project_id,
       'https://site' || regexp_extract(source, '([0-9]+)', 1) || '.example/p/' || CAST(doc_id AS STRING) AS url,
       CASE WHEN doc_id % 41 = 0 THEN 'fetch failed' END AS error,
       CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN '  ' WHEN doc_id % 10 = 1 THEN 'Home page of the Example site'
            ELSE substr(text, 1, CAST(10 + doc_id % 70 AS INT)) END AS title,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE substr(text, 1, CAST(20 + doc_id % 180 AS INT)) END AS meta_description,
       CASE WHEN doc_id % 19 = 0 THEN NULL ELSE substr(text, 1, CAST(5 + doc_id % 80 AS INT)) END AS h1_1,
       CASE WHEN doc_id % 11 = 0 THEN substr(text, 3, 20) END AS h1_2,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE substr(text, 5, 30) END AS h2_1,
       doc_id % 23 = 0 AS h2_first, CAST(doc_id % 4 AS INT) AS n_img_null_alt, CAST(doc_id % 3 AS INT) AS n_img_empty_alt,
       CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '{"name":"x"}' ELSE '{"@type":"Article"}' END AS jsonld,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'c' END AS canonical, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'o' END AS og_title,
       CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'd' END AS og_description, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'summary' END AS twitter_card,
       CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END AS lang, text AS custom_content,
       CASE WHEN doc_id % 8 < 5 THEN 'crawler' WHEN doc_id % 8 < 7 THEN 'dataforseo' ELSE 'semrush' END AS source
FROM documents""",
    "kw_snapshots": """
SELECT event_id AS id, user_id AS tracked_keyword_id, user_id % 10 AS workspace_id, ts AS fetched_at,
       CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 0 ELSE CAST(floor(value * 100) AS INT) END AS volume,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) END AS difficulty,
       CASE event_type WHEN 'purchase' THEN 'transactional' WHEN 'click' THEN 'commercial' WHEN 'view' THEN 'informational' WHEN 'signup' THEN 'navigational' END AS intent,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(1 + event_id % 40 AS INT) END AS position,
       CASE WHEN event_id % 2 = 0 THEN 'semrush' ELSE 'dataforseo' END AS source
FROM events""",
    "keywords": """
SELECT p_partkey AS keyword_id, p_partkey % 10 AS workspace_id,
       CASE p_partkey % 8 WHEN 0 THEN 'how to choose ' || p_name WHEN 1 THEN 'best ' || p_name WHEN 2 THEN p_name || ' for kids'
            WHEN 3 THEN p_name || ' vs ' || lower(p_brand) WHEN 4 THEN 'is a ' || p_name WHEN 5 THEN 'island ' || p_name
            ELSE p_name || ' ' || lower(p_type) END AS keyword,
       p_size AS volume_k, CAST(p_partkey % 101 AS INT) AS difficulty
FROM part""",
    "page_links": """
SELECT l_suppkey % 10 AS project_id, l_suppkey AS task_id,
       'https://site' || CAST(l_suppkey AS STRING) || '.example/' || CAST(l_orderkey % 400 AS STRING) AS url_from,
       'https://site' || CAST(l_suppkey AS STRING) || '.example/' || CAST(l_partkey % 500 AS STRING) || CASE WHEN l_linenumber % 2 = 0 THEN '/' ELSE '' END AS url_to,
       CASE WHEN l_linestatus = 'O' THEN 'internal' ELSE 'external' END AS direction,
       CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS dofollow,
       l_quantity > 45 AS is_broken, CASE WHEN l_quantity > 45 THEN 404 ELSE 200 END AS status_code, l_tax > 0.07 AS is_link_relation_conflict
FROM lineitem""",
    "onpage_tasks": """
SELECT s_suppkey AS task_id, s_suppkey % 10 AS project_id, CASE WHEN s_suppkey % 7 = 0 THEN 'posted' ELSE 'fetched' END AS status,
       1600000000 + (s_suppkey * 7919) % 86400 AS finished_s
FROM supplier""",
    "backlink_pulls": """
SELECT DISTINCT l_suppkey AS project_id, 'https://d' || CAST(l_partkey % 300 AS STRING) || '.example/x' AS source_url,
       'https://site' || CAST(l_suppkey AS STRING) || '.example/' || CAST(l_linenumber AS STRING) AS target_url,
       CAST(year(l_shipdate) AS INT) AS pull_no, CAST(l_partkey % 300 AS INT) AS domain_rank
FROM lineitem""",
    "serp_items": """
SELECT l_orderkey AS keyword_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_shipdate) AS pos,
       CASE WHEN l_returnflag = 'N' AND l_quantity > 40 THEN 'paid' WHEN l_discount > 0.09 THEN 'ai_overview' WHEN l_tax > 0.075 THEN 'featured_snippet' ELSE 'organic' END AS item_type,
       CASE WHEN l_partkey % 3 = 0 THEN 'WWW.' ELSE '' END || 'd' || CAST(l_suppkey AS STRING) || '.example' AS domain, CAST(l_linenumber AS INT) AS rank_absolute,
       'https://' || CASE WHEN l_partkey % 3 = 0 THEN 'WWW.' ELSE '' END || 'd' || CAST(l_suppkey AS STRING) || '.example/' || CAST(l_partkey % 4 AS STRING) || CASE WHEN l_linenumber % 2 = 0 THEN '/' ELSE '' END AS url
FROM lineitem""",
    "suggestions": """
SELECT doc_id AS id, lang AS issue_id, text AS content,
       CASE doc_id % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'edited' WHEN 3 THEN 'deployed' ELSE 'pending' END AS status,
       1000000 - (doc_id * 7919) % 999983 AS created_at_s, doc_id % 12 = 3 AS has_revision
FROM documents""",
    "competitor_snapshots": """
SELECT o_orderkey AS id, o_custkey % 25 AS project_id, CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE o_custkey % 6 END AS competitor_id,
       CAST(floor(o_totalprice / 10) AS INT) AS organic_keywords, CAST(floor(o_totalprice / 100) AS INT) AS referring_domains,
       CAST(floor(o_totalprice) AS BIGINT) AS total_backlinks, o_orderdate AS fetched_at
FROM orders""",
    "jobs": """
SELECT o_orderkey AS id, o_custkey % 50 AS project_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'crawl' WHEN '2-HIGH' THEN 'rank_check' WHEN '3-MEDIUM' THEN 'keyword_refresh' WHEN '5-LOW' THEN 'audit' ELSE 'backlink_pull' END AS job_type,
       CASE WHEN o_orderkey % 97 = 0 THEN 'running' WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END AS status,
       o_orderdate AS created_at
FROM orders""",
    "responses": """
SELECT c_custkey AS project_id, CASE WHEN c_custkey % 3 = 0 THEN 'http://' ELSE 'https://' END || 'site' || CAST(c_custkey AS STRING) || '.example/' AS base_url,
       c_custkey % 11 <> 0 AS reachable, c_custkey % 2 = 0 AS has_hsts, c_custkey % 5 <> 0 AS has_nosniff, c_custkey % 7 <> 0 AS has_frame, c_custkey % 4 = 0 AS has_csp,
       CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 6 = 0 THEN 404 ELSE 200 END AS robots_status
FROM customer""",
    "profiles": """
SELECT c_custkey AS project_id, lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ', repair,, ' || lower(c_name) ELSE '' END AS services,
       CASE c_custkey % 5 WHEN 0 THEN 'Local' WHEN 1 THEN 'Paris, Lyon, Nice' WHEN 2 THEN 'united states,Rome' WHEN 3 THEN '' ELSE NULL END AS locations,
       CASE c_custkey % 3 WHEN 0 THEN 'families, shops' WHEN 1 THEN '' ELSE NULL END AS audiences
FROM customer""",
}
#: The given table behind each view.
OF = {"page_facts": "documents", "kw_snapshots": "events", "keywords": "part", "page_links": "lineitem", "onpage_tasks": "supplier", "backlink_pulls": "lineitem", "serp_items": "lineitem", "suggestions": "documents", "competitor_snapshots": "orders", "jobs": "orders", "responses": "customer", "profiles": "customer"}


#: Rows of a table that one task takes where the table is dealt.
PART = 250_000


def view(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """The view of a table. With `by`, a column of the table, its rows are dealt by that first, to as many tasks as keep to PART rows on average."""
    table = OF[name]
    # braces of JSON literals are no parameters
    sql = SQL[name].replace("{", "{{").replace("}", "}}")
    head, at, tail = sql.rpartition(f"FROM {table}")
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if by:
        rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART)), by)
    return spark.sql(f"{head}FROM {{{table}}}{tail}", **{table: rows})


def pages(facts: DataFrame) -> DataFrame:
    """Flat page facts as pages with arrays and structs."""
    heading = lambda tag, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(tag).alias("tag"), F.col(c).alias("text")))
    h1, h2 = [heading("h1", "h1_1"), heading("h1", "h1_2")], [heading("h2", "h2_1")]
    image = lambda alt: F.struct(F.lit("x.png").alias("src"), alt.cast("string").alias("alt"))
    return facts.withColumns(
        {
            "h1": F.array_compact(F.array("h1_1", "h1_2")),
            "h2": F.array_compact(F.array("h2_1")),
            "heading_structure": F.array_compact(F.when(F.col("h2_first"), F.array(*h2, *h1)).otherwise(F.array(*h1, *h2))),
            "image_alts": F.concat(F.array_repeat(image(F.lit(None)), F.col("n_img_null_alt")), F.array_repeat(image(F.lit("")), F.col("n_img_empty_alt"))),
            "domain_schema": F.array().cast("array<string>"),
            "page_schemas": F.array_compact(F.array("jsonld")),
        }
    )
