"""Operator 11: audit of how sources diverge, with late materialization of strings.

The texts are read once. A task counts terms and sends out fixed-width rows only: a digest of the group (lang and source), a digest of the term,
and counts. All sums, joins and ranks work on these. Each task also leaves its list of distinct terms by digest behind; for digests that
are still candidates after counting, the smallest and the largest string of a digest tell whether several terms share it. Where they
do, these digests are split: their terms are counted once more, by the string. Text is joined back to what is returned, and to nothing else.

The divergence of groups a and b of a language is the sum of f(p_a, p_b) over all kept terms. Most terms are in few groups, so the sum over all terms is
taken as if a and b had no term in common, from how many terms of a have which p, plus a correction for each term that both hold. Tasks add up
corrections by pair of groups before anything is shuffled.

Defined results: null text, lang and source are empty strings; rows that repeat count again; a language without kept terms has the value 0 for all
pairs; a language of one source has no pairs; ties rank by the item's UTF-8 bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Work, join_small, small_batches, table, text_slices, words_of
from .dedup import word_hashes

#: Maps a byte to its lower-case form (A-Z only), or to 0 where it separates terms.
LETTER_BYTES = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0 for b in range(256)], np.uint8)
#: Documents of a language that a kept term is in at least, ranks of terms that are returned, and the whole that shares are parts of.
LEAST_DOCS = 3
MOST_TERMS = 200
WHOLE = 1_000_000_000
#: Rows that a task holds before it adds them up, and before it sends them on; pairs of groups that are corrected at once.
HELD, SENT = 1 << 20, 1 << 19
PAIRS = 1 << 20
CODEC = "zstd"


def digests(terms: pa.LargeBinaryArray, bits: int) -> np.ndarray:
    """A digest of each term, as a long; fewer bits are for tests of what shares a digest."""
    return (word_hashes(terms) >> np.uint64(64 - bits)).view(np.int64)


class Tally:
    """Rows that a task adds up by key, and gives away in tables of bounded size."""

    def __init__(self, keys: list[str], sums: list[str]):
        self.keys, self.sums, self.parts, self.rows = keys, sums, [], 0

    def add(self, part: pa.Table) -> None:
        self.parts.append(part)
        self.rows += part.num_rows
        if self.rows > HELD:
            self.merge()

    def merge(self) -> None:
        if self.parts:
            merged = pa.concat_tables(self.parts).group_by(self.keys, use_threads=False).aggregate([(s, "sum") for s in self.sums])
            self.parts = [merged.select(self.keys + [f"{s}_sum" for s in self.sums]).rename_columns(self.keys + self.sums)]
            self.rows = merged.num_rows

    def take(self, least: int = 0) -> pa.Table | None:
        """All rows, once there are more than `least` of them after adding up."""
        if self.rows <= least:
            return None
        self.merge()
        if self.rows <= least:
            return None
        out, self.parts, self.rows = self.parts[0], [], 0
        return out


COUNTS = pa.schema([("g", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("df", pa.int64()), ("term", pa.large_string())])


def scan(docs: DataFrame, bits: int, by_string: bool) -> DataFrame:
    """docs(g, text) to (g, digest, n, df, term), added up by task: n occurrences in df documents of a group. By string, the key has the term as well; else term
    is null, and rows without g list the terms of each digest."""
    small_batches(docs.sparkSession)
    keys = ["g", "digest", "term"] if by_string else ["g", "digest"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, listed = Tally(keys, ["n", "df"]), Tally(["digest", "term"], [])

        def rows(least: int) -> Iterator[pa.RecordBatch]:
            for tally in (held, listed):
                if (out := tally.take(least)) is not None:
                    full = pa.table([out[f.name].cast(f.type) if f.name in out.column_names else pa.nulls(len(out), f.type) for f in COUNTS], schema=COUNTS)
                    yield from full.to_batches(max_chunksize=1 << 16)

        for part in (p for batch in batches for p in text_slices(batch, 1)):
            words, n = words_of(part.column(1), LETTER_BYTES)
            coded = words.dictionary_encode()
            if not len(coded.dictionary):
                continue
            own = digests(coded.dictionary, bits)
            key, times = np.unique(np.repeat(np.arange(len(n)), n) * len(own) + np.asarray(coded.indices, np.int64), return_counts=True)
            code = key % len(own)
            columns = {"g": part.column(0).take(pa.array(key // len(own))), "digest": pa.array(own[code]), "n": pa.array(times), "df": pa.array(np.ones(len(key), np.int64))}
            terms = coded.dictionary.cast(pa.large_string())
            held.add(pa.table(columns | ({"term": terms.take(pa.array(code))} if by_string else {})))
            if not by_string:
                listed.add(pa.table({"digest": pa.array(own), "term": terms}))
            yield from rows(SENT)
        yield from rows(0)

    return docs.select("g", "text").mapInArrow(count, "g long, digest long, n long, df long, term string")


def named_groups(docs: DataFrame, work: Work) -> tuple[DataFrame, int]:
    """The stored groups (lang, source, g, l) of docs(lang, source), with a digest g of both and l of lang, and the seed with which no two share one."""
    names = work.store(docs.select("lang", "source").distinct(), "names")
    seed = 0
    while True:
        groups = names.select("lang", "source", *keyed(seed))
        shared = [groups.groupBy(key).agg(F.countDistinct(*of).alias("n")).where("n > 1").limit(1).count() for key, of in (("g", ["lang", "source"]), ("l", ["lang"]))]
        if not any(shared):
            return work.store(groups, "groups"), seed
        seed += 1


def keyed(seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(seed), "lang", "source").alias("g"), F.xxhash64(F.lit(seed), "lang").alias("l")


def salt() -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(32)).cast("int")


def counted(docs: DataFrame, groups: DataFrame, n_groups: int, bits: int, work: Work) -> tuple[DataFrame, DataFrame]:
    """(g, l, digest, extra, n, df) of each term that a group holds, and the dictionary (digest, lo, hi) of the candidates. extra is empty but for
    terms that share their digest, for which it is the term."""
    raw = work.store(scan(docs, bits, by_string=False), "raw", codec=CODEC)
    of = groups.select("g", "l")
    with_lang = lambda df: join_small(df, of, ["g"], "inner", n_groups, salt=salt())
    held = work.store(with_lang(raw.where("term IS NULL").groupBy("g", "digest").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))).withColumn("extra", F.lit("")), "held", codec=CODEC)
    candidates = work.store(held.groupBy("l", "digest").agg(F.sum("df").alias("df")).where(F.col("df") >= LEAST_DOCS).select("digest").distinct(), "candidates")
    terms = raw.where("term IS NOT NULL").select("digest", "term").join(candidates, "digest", "left_semi")
    names = work.store(terms.groupBy("digest").agg(F.min("term").alias("lo"), F.max("term").alias("hi")), "terms", codec=CODEC)
    several = work.store(names.where("lo <> hi").select("digest"), "several")
    n = several.count()
    if n:
        again = join_small(scan(docs, bits, by_string=True), several, ["digest"], "left_semi", n).groupBy("g", "digest", F.col("term").alias("extra")).agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        held = work.store(join_small(held, several, ["digest"], "left_anti", n).unionByName(with_lang(again)), "split", codec=CODEC)
    work.drop(raw)
    return held, names


def share(n: str, total: str) -> Column:
    return F.expr(f"1 + CAST(CAST({n} + 1 AS DECIMAL(20, 0)) * {WHOLE} AS DECIMAL(38, 0)) div CAST({total} AS DECIMAL(20, 0))")


def gap(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def corrections(rows: DataFrame, run: int = PAIRS) -> DataFrame:
    """(a, b, value): for each two groups, by how much terms that both hold change the sum that takes each for a term of one of them only.
    rows(l, digest, extra, g, p, p0), p0 being what the group gives a term that it lacks."""
    dealt = rows.repartition("l", "digest", "extra").sortWithinPartitions("l", "digest", "extra").select("l", "digest", "extra", "g", "p", "p0")
    f = lambda p, q: (p - q) * (p - q) // q

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kept = Tally(["a", "b"], ["value"]), None

        def whole_terms(batch: pa.Table, last: bool) -> pa.Table | None:
            """Adds up the terms of batch; but for the last batch, its last term may go on and is given back."""
            if not batch.num_rows:
                return None
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.logical_or.reduce([pc.not_equal(batch[c][1:], batch[c][:-1]).to_numpy() for c in ("l", "digest", "extra")])
            starts = np.flatnonzero(new)
            end = batch.num_rows if last else int(starts[-1])
            g, p, p0 = (batch[c].to_numpy()[:end] for c in ("g", "p", "p0"))
            starts = starts[starts < end]
            sizes = np.diff(np.append(starts, end))
            first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
            names, own = np.unique(g, return_inverse=True)
            upto = np.cumsum(size)
            cuts = np.searchsorted(upto, np.arange(run, int(upto[-1]) + run, run), "left") + 1 if end else ()
            at = 0
            for cut in np.minimum(cuts, end).tolist() if end else ():
                if cut == at:
                    continue
                i = np.repeat(np.arange(at, cut), size[at:cut])
                j = np.arange(len(i)) - np.repeat(np.cumsum(size[at:cut]) - size[at:cut], size[at:cut]) + first[i]
                i, j = i[i != j], j[i != j]
                change = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
                key, inverse = np.unique(own[i] * len(names) + own[j], return_inverse=True)
                value = np.zeros(len(key), np.int64)
                np.add.at(value, inverse, change)
                sums.add(pa.table({"a": names[key // len(names)], "b": names[key % len(names)], "value": value}))
                at = cut
            return None if last else batch[end:]

        for batch in batches:
            more = pa.Table.from_batches([batch])
            kept = whole_terms(pa.concat_tables([kept, more]).combine_chunks() if kept is not None else more, last=False)
            if (out := sums.take(SENT)) is not None:
                yield from out.to_batches()
        if kept is not None:
            whole_terms(kept, last=True)
        if (out := sums.take()) is not None:
            yield from out.to_batches()

    return dealt.mapInArrow(compare, "a long, b long, value long")


def pairs(rows: DataFrame, totals: DataFrame, n_groups: int, run: int = PAIRS) -> DataFrame:
    """(a, b, value) of any two groups of a language. rows(l, digest, extra, g, p, p0, holders): the terms of each group."""
    a, b = (totals.select("l", F.col("g").alias(x), F.col("p0").alias(f"p0_{x}"), F.col("terms").alias(f"terms_{x}"), "v") for x in "ab")
    # groups of a language meet each other, as each two of them are a row of the result; the other side is dealt by salts
    both = join_small(a, b.drop("v"), ["l"], "inner", n_groups, salt=F.pmod(F.xxhash64("a"), F.lit(32)).cast("int")).where("a <> b")
    neither = both.select("a", "b", F.when(F.col("v") == 0, 0).otherwise((F.col("v") - F.col("terms_a") - F.col("terms_b")) * gap("p0_a", "p0_b")).cast("long").alias("value"))
    kinds = rows.groupBy("l", "g", "p").agg(F.count("*").alias("m"))
    met = join_small(kinds, totals.select("l", F.col("g").alias("other"), "p0"), ["l"], "inner", n_groups, salt=F.pmod(F.xxhash64("g", "p"), F.lit(32)).cast("int")).where("g <> other")
    one = met.select(F.explode(F.array(F.struct(F.col("g").alias("a"), F.col("other").alias("b"), (F.col("m") * gap("p", "p0")).alias("value")), F.struct(F.col("other").alias("a"), F.col("g").alias("b"), (F.col("m") * gap("p0", "p")).alias("value")))).alias("x")).select("x.*")
    return reduce(DataFrame.unionByName, [neither, one, corrections(rows.where("holders > 1"), run)]).groupBy("a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, bits: int = 64, run: int = PAIRS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(text, lang, source). bits are those of a term's digest, and run the pairs of groups that a task compares at once."""
    work = Work(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    groups, seed = named_groups(rows, work)
    n_groups = groups.count()
    held, names = counted(rows.select(keyed(seed)[0], "text"), groups, n_groups, bits, work)
    kept = work.store(held.groupBy("l", "digest", "extra").agg(F.sum("df").alias("df"), F.sum("n").alias("n_l"), F.count("*").alias("holders")).where(F.col("df") >= LEAST_DOCS).drop("df"), "kept", codec=CODEC)
    own = work.store(held.drop("df").join(kept, ["l", "digest", "extra"]), "own", codec=CODEC)
    work.drop(held)
    by_lang = kept.groupBy("l").agg(F.count("*").alias("v"), F.sum("n_l").alias("all_l"))
    by_group = own.groupBy("g").agg(F.count("*").alias("terms"), F.sum("n").alias("all_g"))
    totals = groups.join(by_lang, "l", "left").join(by_group, "g", "left").na.fill(0, ["v", "all_l", "terms", "all_g"])
    totals = work.store(totals.withColumn("total_g", F.col("all_g") + F.col("v")).withColumn("total_l", F.col("all_l") + F.col("v")).withColumn("p0", F.when(F.col("v") > 0, share("0", "total_g"))), "totals")
    shares = join_small(own, totals.select("g", "total_g", "total_l", "p0"), ["g"], "inner", n_groups, salt=salt())
    shares = work.store(shares.select("l", "g", "digest", "extra", "holders", share("n", "total_g").alias("p"), share("n_l", "total_l").alias("q"), "p0"), "shares", codec=CODEC)
    work.drop(own, kept)

    # the value of the last rank of each group, then all terms of at least that value; only these get their text
    over = shares.where("p > q").select("g", "digest", "extra", gap("p", "q").alias("value"))
    last = over.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value")))).where(F.col("r") <= MOST_TERMS).groupBy("g").agg(F.min("value").alias("least"))
    top = work.store(join_small(over, last, ["g"], "inner", n_groups, salt=salt()).where("value >= least").drop("least"), "top")
    texts = join_small(names.select("digest", "lo"), top.select("digest").distinct(), ["digest"], "left_semi", top.count())
    worded = top.join(texts, "digest").select("g", F.when(F.col("extra") == "", F.col("lo")).otherwise(F.col("extra")).alias("item"), "value")
    ranked = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("value"), "item")).alias("rank")
    title = totals.select("g", "lang", "source")
    terms = worded.select("*", ranked("g")).where(F.col("rank") <= MOST_TERMS)
    terms = join_small(terms, title, ["g"], "inner", n_groups).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    sums = pairs(shares.drop("q"), totals, n_groups, run)
    named = join_small(sums, title.select(F.col("g").alias("b"), F.col("source").alias("item")), ["b"], "inner", n_groups, salt=F.pmod(F.xxhash64("a"), F.lit(32)).cast("int"))
    named = named.select("a", "item", "value", ranked("a"))
    apart = join_small(named, title.withColumnRenamed("g", "a"), ["a"], "inner", n_groups, salt=F.pmod(F.xxhash64("item"), F.lit(32)).cast("int")).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return apart.unionByName(terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), g AS (
    SELECT DISTINCT lang, source FROM d
), c AS (
    SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df
    FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL
), k AS (
    SELECT lang, term, CAST(sum(n) AS BIGINT) AS n_l FROM c GROUP BY ALL HAVING sum(df) >= {LEAST_DOCS}
), v AS (
    SELECT lang, count(*) AS v, sum(n_l) AS all_l FROM k GROUP BY lang
), t AS (
    SELECT g.lang, g.source, k.term, n_l, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
    SELECT lang, source, sum(n) AS all_g FROM t GROUP BY ALL
), p AS (
    SELECT t.lang, t.source, t.term, t.n, 1 + CAST(({WHOLE}::HUGEINT * (t.n + 1)) // (s.all_g + v.v) AS BIGINT) AS p, 1 + CAST(({WHOLE}::HUGEINT * (t.n_l + 1)) // (v.all_l + v.v) AS BIGINT) AS q
    FROM t JOIN s ON t.lang = s.lang AND t.source = s.source JOIN v ON t.lang = v.lang
), o AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
        SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ) x ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM o) WHERE part = 'pair' OR rank <= {MOST_TERMS}
"""
