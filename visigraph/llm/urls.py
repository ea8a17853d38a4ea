"""Operator 9: URL filters. A blocked Bloom filter of listed keys passes possible hits on to an exact hash join.

Two lists are looked up alike. Rules (host, path, verdict) fit a host and its subdomains where the path starts with the
rule's: a url is probed with those suffixes of its host and starts of its path whose lengths occur among the rules. Listed
urls are probed by their canonical form. The filter is built by Spark, one row of eight words for each block, and grows with the list. It
goes to the executors while it stays under FILTER_BYTES; beyond that it stays a table, and distinct keys are joined with
their blocks, so the share of false positives and the verdicts are the same at any size.

The longest rule wins (host and path together, then the text); where none fits, a url whose canonical form is listed
gets the list's verdict, and the rest the default.

Defined results: a null url, or one without "://", has empty host and path and no rule; null rules and list entries are ignored; of
rules with equal host and path the smaller verdict (allow) holds; rows that repeat stay; an empty table gives no rows; the
columns that are added replace others of the same name.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, join_small, table

FILTER_BYTES = 8 << 20
BITS_PER_KEY = 12
#: Blocks hold eight words of 64 bits; a key sets one bit in each.
WORDS = 8

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    after = F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)
    return F.when(_has(url), ascii_lower(after)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    at = F.locate("/", rest)
    return F.when(_has(url) & (at > 0), rest.substr(at, F.length(rest))).otherwise("")


def _has(url: Column) -> Column:
    return F.coalesce(F.instr(url, "://") > 0, F.lit(False))


def _after(url: Column) -> Column:
    return url.substr(F.instr(url, "://") + 3, F.length(url))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., path without /index.html and trailing slashes; scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(?:/index\.html?)?/*$", ""))


def blocks_of(keys: int) -> int:
    return max(1, -(-keys * BITS_PER_KEY // (64 * WORDS)))


def _bit(h: Column, i: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 6 * i), F.lit(64)).cast("int")


def filter_rows(keys: DataFrame, n: int) -> DataFrame:
    """The filter of keys(key), n of them: (block, w0 to w7) of the blocks that have bits."""
    bits = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks_of(n))).alias("block"), F.xxhash64("key", F.lit(1)).alias("h"))
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("h"), i))).alias(f"w{i}") for i in range(WORDS)]
    return bits.groupBy("block").agg(*words)


def build(keys: DataFrame, n: int) -> np.ndarray:
    """The filter as an array of blocks by eight words."""
    out = np.zeros((blocks_of(n), WORDS), np.uint64)
    for row in filter_rows(keys, n).collect():
        out[row[0]] = np.array(row[1:], np.int64).view(np.uint64)
    return out


def passes(key: Column, filter_: np.ndarray, spark: SparkSession) -> Column:
    """True for each key in the filter, and for a few others."""
    sent, blocks = spark.sparkContext.broadcast(filter_), len(filter_)

    @F.pandas_udf("boolean")
    def test(block, h):  # noqa: ANN001, ANN202
        import pandas as pd

        rows, h = sent.value[block.to_numpy()], h.to_numpy().view(np.uint64)
        found = np.ones(len(h), bool)
        for i in range(WORDS):
            found &= (rows[:, i] >> ((h >> np.uint64(6 * i)) & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(found)

    return test(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), F.xxhash64(key, F.lit(1)))


def possible(probes: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The rows of probes(key, ...) whose key may be among keys(key), n of them."""
    if blocks_of(n) * 8 * WORDS <= FILTER_BYTES:
        return probes.where(passes(F.col("key"), build(keys, n), probes.sparkSession))
    h = F.xxhash64("key", F.lit(1))
    own = probes.select("key").distinct().withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks_of(n)))).join(filter_rows(keys, n), "block")
    set_ = [F.call_function("shiftrightunsigned", F.col(f"w{i}"), _bit(h, i)).bitwiseAND(F.lit(1)) == 1 for i in range(WORDS)]
    return probes.join(own.where(reduce(Column.__and__, set_)).select("key"), "key", "left_semi")


def rule_hits(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the longest rule of each host and path that has one. urls(host, path); rules(host, path, verdict)."""
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    rules = rules.select(F.concat("host", F.lit("\n"), "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("starts"))
    shape = rules.agg(F.collect_set("labels"), F.collect_set("starts"), F.count("*")).first()
    if not shape[2]:
        return urls.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    own = urls.select("host", "path").where("host <> ''").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.array_compact(F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in sorted(shape[0])]))
    starts = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape[1])]))
    probes = own.withColumn("_start", F.explode(starts)).withColumn("_suffix", F.explode(suffixes)).withColumn("key", F.concat("_suffix", F.lit("\n"), "_start"))
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(32)).cast("int")  # all urls of a wide rule's host have its key
    hits = join_small(possible(probes, rules, shape[2]), rules.select("key", "rule", "verdict"), ["key"], "inner", shape[2], salt)
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("_best")
    return hits.groupBy("host", "path").agg(best).select("host", "path", "_best.rule", "_best.verdict")


def judge(urls: DataFrame, rules: DataFrame, listed: DataFrame, listed_verdict: str = "block", default: str = "allow") -> DataFrame:
    """urls(url, ...) with host, path, rule and verdict. rules(host, path, verdict); listed(key): canonical urls."""
    urls = urls.drop("host", "path", "rule", "verdict", "_op9_canonical", "_op9_listed").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    keys = listed.select("key").where("key IS NOT NULL").distinct()
    n = keys.count()
    known = urls.withColumn("_op9_canonical", canonical(F.col("host"), F.col("path")))
    # only what the filter lets through is joined; the exact join decides
    maybe = possible(known.where("host <> ''").select(F.col("_op9_canonical").alias("key")), keys, n).distinct()
    exact = join_small(maybe, keys, ["key"], "left_semi", n).select(F.col("key").alias("_op9_canonical"), F.lit(True).alias("_op9_listed"))
    ruled = rule_hits(urls, rules)
    verdict = F.coalesce("verdict", F.when(F.col("_op9_listed"), listed_verdict), F.lit(default))
    out = known.join(ruled, ["host", "path"], "left").join(exact, "_op9_canonical", "left")
    return out.withColumn("verdict", verdict).drop("_op9_canonical", "_op9_listed")


def rules_of(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    one = spark.range(1)
    return reduce(DataFrame.unionByName, [one.select(*(F.lit(x).alias(k) for k, x in zip(("host", "path", "verdict"), r, strict=True))) for r in rules])


def repeated(pages: DataFrame) -> DataFrame:
    """The list of the query: canonical urls of more than one page, which a crawl should not fetch again."""
    keys = pages.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("key"), F.col("page_id")).where("key <> ''")
    return keys.groupBy("key").agg(F.min("page_id").alias("a"), F.max("page_id").alias("b")).where("a < b").select("key")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules_of(spark), repeated(pages)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH u AS (
    SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), h AS (
    SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM u
), c AS (
    SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '(?:/index\.html?)?/*$', '') AS key FROM h
), listed AS (
    SELECT key FROM c WHERE key <> '' GROUP BY key HAVING min(page_id) < max(page_id)
), rules(host, path, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
    SELECT c.host, c.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM (SELECT DISTINCT host, path FROM c) c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
    GROUP BY c.host, c.path
)
SELECT c.page_id, c.host, c.path, f.rule,
       coalesce(f.verdict, CASE WHEN c.host <> '' AND c.key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fits f ON c.host = f.host AND c.path = f.path
"""
