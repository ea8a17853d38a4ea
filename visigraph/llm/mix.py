"""Operator 1: mixing sources to target weights, in DataFrame functions only.

Words are counted per source, targets follow from the weights with a cap on repetition, and each
document is emitted floor(rate) times plus once more with the fraction as probability, decided by a hash
of its doc_id: a rerun takes the same documents.

Defined results: a null or empty text has size 0; a null source is a source of its own and ranks last; a source of
size 0 has target 0 and rate 0; rows that repeat a doc_id are decided alike; an empty table gives no rows; other
columns are kept by `mix`, whose own columns replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, shared_dir, table

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
OWN = ("size", "source_size", "target", "rate", "copies", "taken")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_REPEATS) -> DataFrame:
    """From (source, source_size): the target of each source.

    Weights repeat along the sources in code point order, null last. Sources share all words by weight, none above
    cap times its size: with sources ordered by capped size per unit of weight, those that are capped come
    first, and the rest share what is left. The windows hold one row for each source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)).withColumn("_cap", cap * F.col("source_size"))
    everything = Window.partitionBy()
    by_room = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    level = weighed.withColumn("_level", left.cast("double") / F.sum("_w").over(onward))
    # the level of the first source that isn't capped holds for all
    free = level.withColumn("_free", F.col("_cap") >= F.col("_level") * F.col("_w"))
    common = free.withColumn("_level", F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"), "_level"))).over(everything)["_level"])
    return common.select("source", "source_size", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap").cast("double"))).alias("target"))


def chance(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from 48 bits of a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_REPEATS, seed: str = "mix") -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target, rate, copies and taken; a row per document,
    also where copies is 0. Totals of the sources are stored in the shared folder and joined by broadcast
    while they are few, else with salted keys."""
    spark = docs.sparkSession
    shared_dir(spark)
    docs = docs.drop(*OWN).withColumn("size", size_of(F.col("text")))
    totals = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap).checkpoint()
    keyed = totals.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("_op1_source"), "source_size", "target")
    docs = docs.withColumn("_op1_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    docs = join_small(docs, keyed, ["_op1_source"], "inner", totals.count(), F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int")).drop("_op1_source")
    docs = docs.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    whole = F.floor("rate")
    more = (chance(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return docs.withColumn("copies", whole + more).withColumn("taken", F.col("copies") * F.col("size"))


def emit(mixed: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, numbered from 1 in `copy`."""
    return mixed.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
           3 * source_size AS cap FROM s
), l AS (
    SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl,
        row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST) AS rn FROM w
), f AS (
    SELECT lvl FROM l WHERE cap >= lvl * w ORDER BY rn LIMIT 1
), t AS (
    SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT lvl FROM f) * w) AS target FROM w
), r AS (
    SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM r
"""
