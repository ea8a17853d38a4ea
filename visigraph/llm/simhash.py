"""Operator 12: near-duplicates by SimHash, found with multi-index hashing.

A text's fingerprint has a bit for each of 64 places: whether over half of the hashes of its three-word shingles have that bit. Two
fingerprints are linked where at most RADIUS bits differ, and documents of linked fingerprints are one component.

A fingerprint is cut into two segments of 32 bits. Where two differ in at most three bits, they differ in at most one bit of one of the segments,
so each fingerprint enumerates the ball of radius one around each of its segments, fetches what the table holds for these keys, and complete
distances decide. Keys that hold more than BUCKET fingerprints are cut again, in segments of 16 and then of 8 bits, by the same rule; with all
but 8 bits fixed a key holds 256 fingerprints at most, so no group grows with the data. Equal fingerprints are one row all along.

Families of close fingerprints would make a link for nearly every pair. So links to the smallest fingerprint of coarse keys (stars) make components
first, and of the exact search only links between different components are kept, each once. That changes no component.

Defined results: a null text is empty; a text without words has the fingerprint zero and is linked like any other; a text of fewer than
three words has one shingle; rows that repeat are of one component; the component of null doc_ids only is null; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dedup
from .common import SPACE_BYTES, Work, join_small, small_batches, table, text_slices, words_of

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 3
#: Most fingerprints of a key that are compared with all that ask for it; beyond it the key is cut again.
BUCKET = 256
#: Shingles whose bits are counted at once.
RUN = 1 << 17
U = np.uint64


#: The primes of XXH64: fixed values of its definition.
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(BITS - by))


def xxh64(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of data; each step takes all slices that are long enough for it."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8, at4 = (np.ndarray((len(data) + 1,), kind, padded, strides=(1,)) for kind in ("<u8", "<u4"))
    size, place = stop - begin, begin.copy()
    seed = U(seed)
    with np.errstate(over="ignore"):
        mixed_in = lambda state, lane: turned(state + lane * P2, 31) * P1
        h = np.full(len(size), seed + P5, U)
        long = np.flatnonzero(size >= 32)
        if len(long):
            state = [np.full(len(long), x, U) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            live = np.arange(len(long))
            while len(live):
                for k in range(4):
                    state[k][live] = mixed_in(state[k][live], at8[place[long[live]] + 8 * k])
                place[long[live]] += 32
                live = live[stop[long[live]] - place[long[live]] >= 32]
            top = turned(state[0], 1) + turned(state[1], 7) + turned(state[2], 12) + turned(state[3], 18)
            for x in state:
                top = (top ^ mixed_in(U(0), x)) * P1 + P4
            h[long] = top
        h += size.astype(U)
        for width, step in ((8, lambda x, i: turned(x ^ mixed_in(U(0), at8[i]), 27) * P1 + P4), (4, lambda x, i: turned(x ^ at4[i].astype(U) * P1, 23) * P2 + P3), (1, lambda x, i: turned(x ^ padded[i].astype(U) * P5, 11) * P1)):
            live = np.flatnonzero(stop - place >= width)
            while len(live):
                h[live] = step(h[live], place[live])
                place[live] += width
                live = live[stop[live] - place[live] >= width]
        h = (h ^ (h >> U(33))) * P2
        h = (h ^ (h >> U(29))) * P3
        return h ^ (h >> U(32))


def add_bits(count: np.ndarray, owner: np.ndarray, h: np.ndarray) -> None:
    """Adds to count[owner] the bits of h. Eight bits at a time are counted in the bytes of a word, over at most 255 hashes."""
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    lengths = np.diff(np.append(starts, len(owner)))
    runs = -(-lengths // 255)
    cuts = np.repeat(starts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    for i in range(8):
        lanes = np.add.reduceat((h >> U(i)) & U(0x0101010101010101), cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
        np.add.at(count[:, i::8], owner[cuts], lanes)


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    words, n = words_of(texts, SPACE_BYTES)
    n = np.asarray(n, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: ends[-1]]
    # with a space behind each word, a shingle is one slice of bytes
    spaced = np.full(len(data) + len(words), 0x20, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(len(words)), np.diff(ends))] = np.where(data == 0xFF, 0, data)
    begins, stops = ends[:-1] + np.arange(len(words)), ends[1:] + np.arange(len(words))
    of = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    first = np.arange(of.sum()) + np.repeat(np.cumsum(n) - n - (np.cumsum(of) - of), of)
    last = first + np.repeat(np.minimum(n, SHINGLE) - 1, of)
    begin, stop, owner = begins[first], stops[last], np.repeat(np.arange(len(n)), of)
    count = np.zeros((len(n), BITS), np.int64)
    for at in range(0, len(owner), RUN):
        add_bits(count, owner[at : at + RUN], xxh64(spaced, begin[at : at + RUN], stop[at : at + RUN]))
    return np.packbits(2 * count > of[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, fp); fp holds the 64 bits as a long."""
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in text_slices(batch, 1)):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part.column(1)).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def segments(width: int) -> list[int]:
    """The first bits of the segments of so many bits."""
    return list(range(0, BITS, width))


def field(at: int, width: int) -> int:
    return ((1 << width) - 1) << at


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def stars(prints: DataFrame, radius: int, work: Work) -> DataFrame:
    """Links (a, b) of fingerprints to the smallest one of each key; keys are the halves of a fingerprint, and all but one quarter of it."""
    masks = [field(at, 32) for at in segments(32)] + [(1 << BITS) - 1 - field(at, 16) for at in segments(16)]
    keyed = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for k, m in enumerate(masks)))).alias("x")).select("fp", "x.*")
    heads = work.store(keyed.groupBy("mask", "value").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"), "heads")
    met = join_small(keyed, heads, ["mask", "value"], "inner", heads.count())
    return met.where((F.col("fp") != F.col("head")) & (distance("fp", "head") <= radius)).select(F.col("fp").alias("a"), F.col("head").alias("b")).distinct()


def ball(fp: Column, at: int, width: int, both: bool) -> list[Column]:
    """fp, and fp with one bit of the segment changed; unless both ways are asked for, only from 0 to 1, else null."""
    bits = [F.lit(signed(1 << (at + i))) for i in range(width)]
    flipped = [fp.bitwiseXOR(b) if both else F.when(fp.bitwiseAND(b) == 0, fp.bitwiseOR(b)) for b in bits]
    return [fp, *flipped]


def cut(rows: DataFrame, width: int, probe: bool, fixed: bool) -> DataFrame:
    """rows(fp, root), or those of keys that are cut again (fixed), with the keys of all segments of so many bits: (mask, value, fp, root).

    mask says which bits of value are the key. A probe has a key for each member of the segment's ball; what a key had before stays."""
    before_mask, before = (F.col("mask"), F.col("value")) if fixed else (F.lit(0).cast("long"), F.lit(0).cast("long"))
    keys = []
    for at in segments(width):
        own = F.lit(signed(field(at, width)))
        # a segment of bits that are already fixed adds nothing
        free = before_mask.bitwiseAND(own) == 0
        for member in ball(F.col("fp"), at, width, fixed) if probe else [F.col("fp")]:
            value = before.bitwiseOR(member.bitwiseAND(own))
            keys.append(F.when(free & value.isNotNull(), F.struct(before_mask.bitwiseOR(own).alias("mask"), value.alias("value"))))
    return rows.select("fp", "root", F.explode(F.array_compact(F.array(*keys))).alias("x")).select("x.mask", "x.value", "fp", "root")


def far_links(rooted: DataFrame, radius: int, work: Work, bucket: int = BUCKET) -> DataFrame:
    """The components (a, b) of rooted(fp, root) that links of at most `radius` bits join."""
    if radius > 3:
        raise ValueError("two segments with balls of radius one are exact up to three bits")
    found, listed, probes = [], cut(rooted, 32, probe=False, fixed=False), cut(rooted, 32, probe=True, fixed=False)
    for width in (16, 8, 0):
        hot = work.store(listed.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("mask", "value"), "hot") if width else None
        n = hot.count() if width else 0
        own, asks = (join_small(x, hot, ["mask", "value"], "left_anti", n) if n else x for x in (listed, probes))
        other = own.select("mask", "value", F.col("fp").alias("fp_b"), F.col("root").alias("root_b"))
        links = asks.join(other, (asks["mask"] == other["mask"]) & (asks["value"] == other["value"]) & (asks["root"] != other["root_b"]) & (distance("fp", "fp_b") <= radius))
        found.append(work.store(links.select(F.greatest("root", "root_b").alias("a"), F.least("root", "root_b").alias("b")).distinct(), "far"))
        if not n:
            break
        # stored: the next level reads both twice
        listed, probes = (work.store(cut(join_small(x, hot, ["mask", "value"], "left_semi", n), width, probe, fixed=True), "again") for x, probe in ((listed, False), (probes, True)))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def components(rows: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """rows(doc_id, fp), a stored table, with component_id."""
    work = Work(rows.sparkSession)
    prints = work.store(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "prints")
    links = work.store(stars(prints, radius, work), "stars")
    roots = dedup.components(links, work)
    rooted = work.store(prints.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    more = work.store(far_links(rooted.select("fp", "root"), radius, work, bucket), "more")
    if more.limit(1).count():
        tops = dedup.components(more, work).select(F.col("id").alias("root"), F.col("root").alias("top"))
        rooted = rooted.join(tops, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
    of = work.store(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1").drop("rows"), "of")
    ids = work.store(rooted.select("fp", "root").join(of, "root").select("fp", "component_id", F.lit(True).alias("several")), "ids")
    joined = join_small(rows, ids, ["fp"], "left", ids.count(), salt=F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int"))
    return joined.select("doc_id", "fp", F.when(F.col("several"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of docs(doc_id, text)."""
    return components(Work(docs.sparkSession).store(fingerprint_rows(docs), "fingerprints"), radius, bucket)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", fingerprint, "component_id")


def plain_fingerprint(text: str | None) -> int:
    """By the definition, for tests."""
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + SHINGLE]).encode(), SEED) for i in range(max(1, len(w) - SHINGLE + 1))] if w else []
    return sum(1 << b for b in range(BITS) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_force(prints: list[tuple[int | None, int]], radius: int = RADIUS) -> list[int | None]:
    """The component_id of each (doc_id, fingerprint) by comparing all with all, for tests."""
    root = list(range(len(prints)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, p) in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (d, _) in enumerate(prints):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(prints))]
