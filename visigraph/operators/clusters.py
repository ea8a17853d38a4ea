"""Topics: keywords whose result pages overlap, and the URLs that they share as the reason.

Links are never made pair by pair where that is not needed. Two keywords that share exactly the results C are similar enough by their sizes alone,
and then both are so with the smallest keyword that has all of C. So a star of each key of j common results to its smallest keyword joins all pairs
that share exactly j, and what shares more meets under longer keys. Keys are drawn from the rarest results of each keyword, as far as
the least overlap demands. Keys whose keywords are in one component already are done; small ones that are not are compared directly, within bounds
on sizes and positions, and large ones go on to keys of one result more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import components, moved
from ..functions.text import bare_domain

#: Most keywords of a key that are compared with each other.
BLOCK = 1_000
#: Shares are compared with this tolerance, as sizes are small numbers.
NEAR = 1e-9


#: What stands before the host of a URL.
BEFORE = "^[ \\t\\r\\n]*(?:[A-Za-z][A-Za-z0-9+.-]*://)?"


def result_url(c: Column) -> Column:
    """A URL as results are compared: without scheme, www., fragment and end slashes, the host in lower case."""
    part = lambda pattern: F.regexp_extract(c, BEFORE + pattern, 1)
    return F.concat(bare_domain(part("([^/?# \\t\\r\\n]*)")), F.rtrim(F.rtrim(part("[^/?# \\t\\r\\n]*([^#]*)")), F.lit("/")))


#: An item that may have a URL to compare.
ORGANIC = "coalesce(item_type = 'organic' AND url IS NOT NULL, false)"


def numbered(items: DataFrame) -> DataFrame:
    """(raw, url, no), stored: each organic URL as it is given, as it is compared, and the number of the latter, the rarest first.
    A URL is rewritten once, however many items have it; url and no are null where nothing is left of it."""
    urls = items.where(ORGANIC).groupBy(F.col("url").alias("raw")).agg(F.count("*").alias("n")).withColumn("url", result_url(F.col("raw"))).checkpoint()
    counts = urls.where("url <> ''").groupBy("url").agg(F.sum("n").alias("n"))
    numbers = counts.orderBy("n").select("url", F.monotonically_increasing_id().alias("no"))
    return urls.select("raw", "url").join(numbers, "url", "left").select("raw", F.when(F.col("no").isNotNull(), F.col("url")).alias("url"), "no").checkpoint()


def result_sets(items: DataFrame, numbers: DataFrame) -> DataFrame:
    """(keyword_id, results): the keyword's different results as numbers, the rarest first; none where it has no organic result. A task
    hashes the numbers that are dealt to it, so the items need no sort by URL."""
    found = items.where(ORGANIC).select("keyword_id", F.col("url").alias("raw")).join(numbers.select("raw", "no").hint("shuffle_hash"), "raw").select("keyword_id", "no")
    rows = found.unionByName(items.where(f"NOT {ORGANIC}").select("keyword_id", F.lit(None).cast("long").alias("no")))
    return rows.groupBy("keyword_id").agg(F.sort_array(F.collect_set("no")).alias("results"))


def least_shared(n: Column, least: float) -> Column:
    """What a keyword of n results shares at least with any similar one."""
    return F.ceil(n * least - NEAR).cast("int")


def names(length: int) -> list[str]:
    return [f"k{i}" for i in range(1, length + 1)]


def longer(rows: DataFrame, length: int, least: float) -> DataFrame:
    """rows(k1, .., id, n, results, at) with keys of one result more. Of what a keyword shares with a similar one, the result at this
    place of the key has so many places before the end of the list at least."""
    last = F.col("n") - F.greatest(F.lit(length + 1), least_shared(F.col("n"), least)) + length + 1
    places = F.when(last > F.col("at"), F.sequence(F.col("at") + 1, last))
    own = rows.select(*names(length), "id", "n", "results", F.explode(places).alias("at"))
    return own.select(*names(length), F.element_at("results", F.col("at")).alias(f"k{length + 1}"), "id", "n", "results", "at")


def jaccard(a: str, b: str) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def met(rows: DataFrame, length: int) -> DataFrame:
    """Of rows(k1, .., id, n, at), those whose key has further ids, with b, a smallest id of the key, and its size n_b. Most keys have one
    id, so what follows reads few of the rows."""
    heads = rows.groupBy(*names(length)).agg(F.min_by("id", "n").alias("b"), F.min("n").alias("n_b"), F.count("*").alias("_m")).where("_m > 1").drop("_m")
    return rows.select(*names(length), "id", "n", "at").join(heads.hint("shuffle_hash"), names(length))


def stars(shared: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of the ids of shared, rows of `met`, with the smallest one of their key."""
    pairs = shared.where("id <> b").where(F.col("n_b") >= F.col("n") * least - NEAR).select("id", "b").distinct()
    other = sets.select(F.col("id").alias("b"), F.col("results").alias("_other"))
    both = pairs.join(sets.select("id", "results"), "id").join(other, "b")
    return both.where(jaccard("results", "_other") >= least - NEAR).select(F.col("id").alias("a"), "b")


def close_pairs(rows: DataFrame, length: int, least: float, apart: bool) -> DataFrame:
    """The pairs of rows(k1, .., id, n, results, at) that share a key and are similar enough; with `apart`, those of different roots."""
    on = names(length)
    side = lambda x: rows.select(*on, F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("at").alias(f"at_{x}"), F.col("results").alias(f"r_{x}"), *([F.col("root").alias(f"root_{x}")] if apart else []))
    left, right = side("a"), side("b")
    size = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - NEAR
    # besides the key, no more is shared than is left behind it in the shorter rest
    most = length + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    enough = most >= (F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - NEAR
    met = left.join(right, on).where(F.col("a") < F.col("b")).where(size & enough)
    if apart:
        met = met.where("root_a <> root_b")
    return met.where(jaccard("r_a", "r_b") >= least - NEAR)


def linked(sets: DataFrame, least: float) -> DataFrame:
    """(id, root) of the ids of sets(id, n, results), a checkpointed table, that are linked to another one."""
    first = longer(sets.withColumn("at", F.lit(0)), 0, least)
    # one common result is enough between small sets only
    small = first.where(F.col("n") * least <= 1 + NEAR)
    rows, length = met(longer(first, 1, least), 2).checkpoint(), 2
    roots = components(stars(met(small, 1), sets, least).unionByName(stars(rows, sets, least))).checkpoint()
    while True:
        on = names(length)
        rooted = rows.drop("b", "n_b").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = rooted.groupBy(*on).agg(F.count("*").alias("m"), (F.min("root") < F.max("root")).alias("mixed")).where("mixed").drop("mixed")
        rooted = rooted.join(mixed, on).join(sets.select("id", "results"), "id").checkpoint()
        if rooted.isEmpty():
            return roots
        more = close_pairs(rooted.where(F.col("m") <= BLOCK), length, least, apart=True).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
        wide = rooted.where(F.col("m") > BLOCK)
        ended = wide.isEmpty()
        if not ended:
            rows = met(longer(wide, length, least), length + 1).checkpoint()
            length += 1
            ids = stars(rows, sets, least)
            tops = moved(moved(ids.select(F.col("a").alias("id"), F.col("b").alias("root")), roots).select(F.col("root").alias("id"), F.col("id").alias("root")), roots)
            more = more.unionByName(tops.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
        # links between roots only: what they join moves with them
        tops = components(more)
        roots = moved(roots, tops).union(tops).checkpoint()
        if ended:
            return roots


def serp_overlap(items: DataFrame, least: float = 0.4) -> DataFrame:
    """(a, b, shared, jaccard) of all keywords whose organic results overlap so far; a pair that shares the results of several keys is compared at the first."""
    sets = result_sets(items, numbered(items)).where("size(results) > 0").select(F.col("keyword_id").alias("id"), F.size("results").alias("n"), "results").checkpoint()
    first = longer(sets.withColumn("at", F.lit(0)), 0, least)
    common = F.array_intersect("r_a", "r_b")
    one = close_pairs(first.where(F.col("n") * least <= 1 + NEAR), 1, least, apart=False).where(F.size(common) == 1)
    two = close_pairs(longer(first, 1, least), 2, least, apart=False).where((common[0] == F.col("k1")) & (common[1] == F.col("k2")))
    found = one.drop("k1").unionByName(two.drop("k1", "k2"))
    return found.select("a", "b", F.size(common).cast("long").alias("shared"), jaccard("r_a", "r_b").alias("jaccard"))


def serp_overlap_clusters(items: DataFrame, least: float = 0.4) -> DataFrame:
    """(keyword_id, cluster, n_keywords, shared_urls) of items(keyword_id, item_type, url): cluster is the smallest keyword that each reaches over
    overlaps of `least` or more, n_keywords its size, and shared_urls lists the keyword's results that another keyword of the cluster has too. Keywords of
    equal results are compared as one; those without organic results are alone."""
    numbers = numbered(items)
    # the hash stands first, as numbers sort faster than arrays
    sets = result_sets(items, numbers).withColumn("h", F.xxhash64("results")).checkpoint()
    organic = F.size("results") > 0
    same = sets.where(organic).groupBy("h", "results").agg(F.min("keyword_id").alias("id"), F.count("*").alias("held")).withColumn("n", F.size("results")).checkpoint()
    roots = linked(same.select("id", "n", "results"), least)
    found = same.join(roots, "id", "left").withColumn("cluster", F.coalesce("root", "id")).drop("root").checkpoint()
    sizes = found.groupBy("cluster").agg(F.sum("held").alias("n_keywords")).where("n_keywords > 1")
    many = found.join(sizes, "cluster").select("cluster", "n_keywords", "id", "h", "results", "held").checkpoint()
    own = many.select("cluster", "id", "held", F.explode("results").alias("no"))
    shared = own.groupBy("cluster", "no").agg(F.sum("held").alias("_n")).where("_n > 1").drop("_n").join(numbers.where("no IS NOT NULL").select("no", "url").distinct(), "no")
    reasons = own.join(shared, ["cluster", "no"]).groupBy("id").agg(F.array_sort(F.collect_list("url")).alias("shared_urls"))
    topics = many.drop("held").join(reasons, "id").select("h", "results", "cluster", "n_keywords", "shared_urls")
    nothing = F.array().cast("array<string>")
    known = F.col("keyword_id").isNotNull()
    joined = sets.where(organic).join(topics, ["h", "results"], "left").select("keyword_id", *(F.when(known, F.col(c)).alias(c) for c in ("cluster", "n_keywords", "shared_urls")))
    alone = sets.where(~organic).select("keyword_id", F.col("keyword_id").alias("cluster"), F.lit(1).cast("long").alias("n_keywords"), nothing.alias("shared_urls"))
    return joined.select("keyword_id", F.coalesce("cluster", "keyword_id").alias("cluster"), F.coalesce("n_keywords", F.lit(1)).alias("n_keywords"), F.coalesce("shared_urls", nothing).alias("shared_urls")).unionByName(alone)
