"""Operator 5: benchmark decontamination over a distributed positional inverted index.

Documents are dealt to segments of whole documents; a segment stores, for each of its terms, the sorted places of the term in
it. The index knows nothing of a benchmark, so it serves any. Windows are looked up in each segment from the rarest of their terms on: each list is
shifted by the term's offset in the window, and what is left after intersecting all of them is where the window begins. All
windows of a block take a step together. With a slack, terms may stand up to so many words from their offset (proximity); 0 asks
for the exact phrase.

A benchmark of more than BLOCK_BYTES of text is taken in blocks: one at a time is sent out and looked up, its hits are stored, and
then the hits of all blocks are merged by document. So neither the driver nor a task holds more than a block.

Defined results: null or empty text has no words and no hits; an item without words has no windows; items that repeat an
item_id are one item; a null item_id is reported as "null"; documents that repeat a doc_id are judged one by
one; empty tables give no rows or no hits; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, Work, join_small, shared_dir, small_batches, table, words_of

WINDOW = 10
SEGMENT_WORDS = 500_000
BLOCK_BYTES = 8 << 20
MOST_SLACK = 50
#: Places between documents of a segment, so that no window reaches over.
GAP = WINDOW + MOST_SLACK + 1

#: Candidates that a task looks up at once.
CANDIDATES = 1 << 20

SEGMENT = pa.schema([("segment", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int32())), ("size", pa.int64()), ("postings", pa.binary())])
INDEX = "segment string, doc_ids array<long>, n_words array<long>, terms array<binary>, df array<int>, size long, postings binary"
REPORT = "segment string, at int, doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


class Windows:
    """The distinct windows of a block of items: term numbers (-1 behind the end of a short one), and the items of each, as items[starts[i] : starts[i + 1]]."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        words, counts = words_of(pa.array([t for _, t in items], pa.string()), WORD_BYTES)
        coded = words.dictionary_encode()
        self.terms = coded.dictionary
        codes, ends = np.asarray(coded.indices, np.int64), np.cumsum(counts)
        rows, item = [np.zeros((0, window), np.int64)], [np.zeros(0, np.int64)]
        self.names = sorted({i for i, _ in items})
        number = {x: n for n, x in enumerate(self.names)}
        for (name, _), n, end in zip(items, counts, ends, strict=True):
            own = codes[end - n : end]
            if n:
                # a short item has one window, with nothing behind its end
                rows.append(np.lib.stride_tricks.sliding_window_view(np.pad(own, (0, max(0, window - n)), constant_values=-1), window))
                item.append(np.full(len(rows[-1]), number[name]))
        self.rows, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack([of.ravel(), np.concatenate(item)]), axis=0)
        self.items, self.starts = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Broadcast]:
    """The benchmark's windows, a block after the other."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield benchmark.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in part.collect()]))


def pack(places: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(places, np.int32), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.int32)


def segment(name: str, ids: list, texts: pa.Array) -> dict:
    words, counts = words_of(texts, WORD_BYTES)
    counts = np.asarray(counts, np.int64)
    starts = np.cumsum(counts + GAP) - counts - GAP
    place = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(words))
    coded = words.dictionary_encode()
    codes = np.asarray(coded.indices, np.int64)
    order = np.argsort(codes, kind="stable")
    return {"segment": name, "doc_ids": ids, "n_words": counts, "terms": coded.dictionary, "df": np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32), "size": int((counts + GAP).sum()), "postings": pack(place[order])}


def build_index(docs: DataFrame, work: Work, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The stored index of docs(doc_id, text), a row for each segment."""
    small_batches(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            # the name only has to be unique: all that depends on it comes from the stored row
            s = segment(uuid.uuid4().hex, ids, pa.concat_arrays(texts))
            return pa.RecordBatch.from_arrays([pa.array([s[f.name]], f.type) if f.name != "terms" else pa.ListArray.from_arrays(pa.array([0, len(s["terms"])], pa.int32()), s["terms"].cast(pa.binary())) for f in SEGMENT], schema=SEGMENT)

        for batch in batches:
            # a word takes two bytes at least; large batches are cut so that segments keep their size
            text = batch.column(1).cast(pa.large_string())
            sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0), np.int64) // 6 + 1
            cut = np.searchsorted(np.cumsum(sizes) // segment_words, np.arange(1, int(sizes.sum()) // segment_words + 1))
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if b > a:
                    ids += batch.column(0)[a:b].to_pylist()
                    texts.append(text[a:b])
                    size += int(sizes[a:b].sum())
                if size >= segment_words:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()

    return work.store(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, INDEX), "postings")


def find(rows: np.ndarray, df: np.ndarray, places: np.ndarray, size: int, slack: int, run: int = CANDIDATES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, begin) of the windows' hits, of `run` candidates at a time. rows: the segment's term numbers, -2 behind a window's end; places: of all
    terms, one after the other."""
    first = np.cumsum(df) - df
    keys = np.repeat(np.arange(len(df)), df) * size + places  # rising, so that a search for a term and a place meets the term's own list
    order = np.argsort(np.where(rows >= 0, df[np.maximum(rows, 0)], np.iinfo(np.int64).max), axis=1, kind="stable")
    ranked = np.take_along_axis(rows, order, axis=1)
    upto = np.concatenate([[0], np.cumsum(df[ranked[:, 0]])])
    for at in range(0, int(upto[-1]), run):
        # candidate number at and on: which window it is of, and which place of the window's rarest term it takes
        candidate = np.arange(at, min(at + run, int(upto[-1])))
        window = np.searchsorted(upto, candidate, "right") - 1
        begin = places[first[ranked[window, 0]] + candidate - upto[window]].astype(np.int64) - order[window, 0]
        for i in range(1, rows.shape[1]):
            term = ranked[window, i]
            wanted = begin + order[window, i]
            # places before the first and behind the last are no places of the term
            low = np.searchsorted(keys, term * size + np.maximum(wanted - slack, 0))
            met = (low < len(keys)) & (wanted + slack >= 0)
            met &= keys[np.minimum(low, len(keys) - 1)] <= term * size + np.minimum(wanted + slack, size - 1)
            keep = met | (term < 0)
            window, begin = window[keep], begin[keep]
        yield window, begin


def match(row: dict, w: Windows, slack: int = 0) -> list[dict]:
    n_words = np.array(row["n_words"], np.int64)
    starts = np.cumsum(n_words + GAP) - n_words - GAP
    df = np.array(row["df"], np.int64)
    change = np.zeros(row["size"] + 1 + MOST_SLACK + WINDOW, np.int32)
    found: dict[int, list] = {}
    own = np.asarray(pc.fill_null(pc.index_in(w.terms, value_set=pa.array(row["terms"], pa.large_binary())), -1), np.int64) if len(df) else np.full(len(w.terms), -1)
    local = np.where(w.rows >= 0, own[w.rows], -2) if len(own) else w.rows
    live = np.flatnonzero((local != -1).all(axis=1))
    if len(live) and len(df):
        met = [np.zeros(0, np.int64)]
        for window, begin in find(local[live], df, unpack(row["postings"], int(df.sum())), row["size"], slack):
            window, begin = live[window], np.maximum(begin, 0)
            length = (w.rows[window] >= 0).sum(axis=1)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + length, -1)
            docs = np.searchsorted(starts, begin + np.minimum(slack, length - 1), "right") - 1
            met.append(np.unique(docs * len(w.rows) + window))
        # a document and a distinct window once, then the items of the window
        met = np.unique(np.concatenate(met))
        docs, window = met // len(w.rows), met % len(w.rows)
        n = w.starts[window + 1] - w.starts[window]
        items = w.items[np.repeat(w.starts[window] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        for key in np.unique(np.repeat(docs, n) * len(w.names) + items).tolist():
            found.setdefault(key // len(w.names), []).append(w.names[key % len(w.names)])
    hit = np.cumsum(change) > 0
    out = []
    for d, (doc, n, at) in enumerate(zip(row["doc_ids"], n_words, starts, strict=True)):
        own = hit[at : at + n].astype(np.int8) if d in found else ()
        edges = np.flatnonzero(np.diff(own, prepend=0, append=0)) if d in found else []
        out.append({"segment": row["segment"], "at": d, "doc_id": doc, "n_words": int(n), "n_hit": int(np.sum(own)) if d in found else 0, "items": sorted(found.get(d, ())), "spans": [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]})
    return out


def search(index: DataFrame, query: Broadcast, slack: int = 0) -> DataFrame:
    """For each document its words, hit words, the items found and the hit spans in words."""
    if not 0 <= slack <= MOST_SLACK:
        raise ValueError(f"slack is 0 to {MOST_SLACK}")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("segment", pa.string()), ("at", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist(match({n: batch.column(n)[i].values if n == "terms" else batch.column(n)[i].as_py() for n in batch.schema.names}, query.value, slack), kind)

    return index.mapInArrow(look, REPORT)


def merged(reports: DataFrame) -> DataFrame:
    """The report on all blocks from those on each: items and spans together, spans that meet as one."""
    by = reports.groupBy("segment", "at").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def join(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(F.size(done) == 0, F.array(x)).when(x["start"] > last["end"], F.array_append(done, x)).otherwise(F.array_append(F.slice(done, 1, F.size(done) - 1), longer))

    spans = F.aggregate("all", empty, join)
    return by.withColumn("spans", spans).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])).drop("all")


def decontaminate(docs: DataFrame, benchmark: DataFrame, slack: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The report on docs(doc_id, text) against benchmark(item_id, text)."""
    work = Work(docs.sparkSession)
    index = build_index(docs, work)
    before, reports = None, []
    for query in blocks(benchmark, block_bytes):
        if before is not None:
            reports.append(work.store(search(index, before, slack), "hits"))
            before.destroy()
        before = query
    if not reports:
        return search(index, before, slack)
    reports.append(work.store(search(index, before, slack), "hits"))
    before.destroy()
    work.drop(index)
    return merged(reduce(DataFrame.unionByName, reports))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, slack: int = 0) -> DataFrame:
    """docs without those that hold a window of the benchmark. A verdict depends on the text alone, so rows are joined by a hash
    of doc_id and text."""
    shared_dir(docs.sparkSession)
    keyed = docs.drop("_op5_key").withColumn("_op5_key", F.xxhash64("doc_id", F.md5(F.coalesce("text", F.lit("")))))
    bad = decontaminate(keyed.select(F.col("_op5_key").alias("doc_id"), "text"), benchmark, slack).where("n_hit > 0").select(F.col("doc_id").alias("_op5_key")).distinct().checkpoint()
    return join_small(keyed, bad, ["_op5_key"], "left_anti", bad.count()).drop("_op5_key")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(texts: dict, items: dict, window: int = WINDOW) -> dict:
    """The report's columns by comparing everything with everything; for tests on small data."""
    import re

    def words(text: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    out = {}
    for doc, text in texts.items():
        own, hit, found = words(text), set(), set()
        for item, wanted in items.items():
            wanted = words(wanted)
            n = min(window, len(wanted))
            grams = {tuple(wanted[i : i + n]) for i in range(len(wanted) - n + 1)} if n else set()
            at = [i for i in range(len(own) - n + 1) if tuple(own[i : i + n]) in grams] if n else []
            if at:
                found.add(str(item))
                hit |= {j for i in at for j in range(i, i + n)}
        out[doc] = (len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


#: Occurrences of a window are found by joining on all of its words, joined by spaces.
SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), g AS (
    SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[pos : pos + least(10, len(words)) - 1], ' ') AS gram
    FROM (SELECT *, unnest(generate_series(1, greatest(1, len(words) - 9))) AS pos FROM i WHERE len(words) > 0)
), lens AS (
    SELECT DISTINCT n FROM g
), o AS (
    SELECT doc_id, pos, n, array_to_string(words[pos : pos + n - 1], ' ') AS gram
    FROM (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS pos FROM w, lens WHERE len(words) >= n)
), f AS (
    SELECT o.doc_id, o.pos, o.n, g.item_id FROM o JOIN g ON o.gram = g.gram AND o.n = g.n
), h AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(pos, pos + n - 1)) AS p FROM f) GROUP BY doc_id
), m AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM f) GROUP BY doc_id
)
SELECT w.doc_id, CAST(coalesce(len(w.words), 0) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON w.doc_id = h.doc_id LEFT JOIN m ON w.doc_id = m.doc_id
"""
