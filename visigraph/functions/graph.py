"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame) -> DataFrame:
    """(id, root) of all ids of links(a, b) but the roots: the smallest id that each one reaches.

    Each round first lays those ids aside whose only link is to a smaller one; their root is that one's. Of the rest, it links the larger
    neighbours of an id to its smallest one, then the smaller ones, so paths shrink to stars in a number of rounds that follows the logarithm
    of their length, and stars are laid aside. So rounds get smaller. They are checkpointed, and end when no link is left."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    aside = []
    while True:
        ends = links.union(links.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")).where("n = 1 AND b < a")
        aside.append(ends.select(F.col("a").alias("id"), F.col("b").alias("root")).checkpoint())
        links = links.join(aside[-1].select(F.col("id").alias("a")), "a", "left_anti").checkpoint()
        if links.isEmpty():
            break
        both = links.union(links.select("b", "a"))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = smaller.union(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
    roots = aside.pop()
    while aside:
        roots = roots.union(moved(aside.pop(), roots).checkpoint())
    return roots


def moved(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows(id, root) with the roots' own roots, where roots(id, root) has one."""
    tops = roots.select(F.col("id").alias("root"), F.col("root").alias("_top"))
    return rows.join(tops, "root", "left").select("id", F.coalesce("_top", "root").alias("root"))
