"""Patterns that recur: the latest or first row of a key, the first n rows of a key, an order-insensitive digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The row of each key with the largest `at`, then the smallest `tie`. An aggregate, so rows of a hot key combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(at), -F.col(tie))).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(df.columns)


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, number: str = "_n") -> DataFrame:
    """The first n rows of each key; Spark ranks within each task before it shuffles."""
    ranked = df.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(number) <= n)


def ranked(df: DataFrame, keys: list[str], order: list[Column], number: str = "place") -> DataFrame:
    """df with the place of each row within its key, from 1, for keys that may be large: no task takes a whole key.

    Rows are dealt to ranges of key and order, and sorted within. A row's place is its own within its range, and as many as its key has in the ranges
    before, which are counted. The sorted rows are checkpointed, as the counts and the places must see the same ranges. Keys of null are one key."""
    spark = df.sparkSession
    own = [F.expr(f"`{k}` AS `_k{i}`") for i, k in enumerate(keys)]
    flat = df.select("*", *own)
    by = [F.col(f"_k{i}") for i in range(len(keys))]
    ranges = flat.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by, *order).sortWithinPartitions(*by, *order)
    # such an id has the number of its partition above its lower 33 bits, which count the partition's rows
    rows = ranges.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).checkpoint()
    held = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a key has a row for each range that it reaches into
    starts = held.select(*(F.col(f"_k{i}").alias(f"_o{i}") for i in range(len(keys))), F.col("_part").alias("_p"), (before - F.col("_first") + 1).alias("_add"))
    same = (rows["_part"] == starts["_p"]) & reduce(lambda a, b: a & b, [F.col(f"_k{i}").eqNullSafe(F.col(f"_o{i}")) for i in range(len(keys))])
    return rows.join(starts, same).select(*df.columns, (F.col("_id") + F.col("_add")).cast("int").alias(number))


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))
