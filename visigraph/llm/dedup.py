"""Operator 6: near-duplicates by BagMinHash over multisets of five-word shingles.

A shingle with count w is a bag of w unit levels. Levels lie in dyadic intervals, and each (shingle, interval) owns a Poisson process
of points: a point has an arrival time, one of the registers and a level of the interval, all from the hash, and counts if its level
is at most w. A register keeps its earliest point, so two texts agree on it with the probability of their weighted Jaccard
similarity. Processes run only up to the time at which all registers of a text of that total weight are filled, with few exceptions
that run on, so a text costs one hash per shingle and some points per register, whatever its length.

Texts of equal words are one content, and bands of registers are keys of contents. First each content is compared with the smallest id of
each of its keys, by the exact overlap of the multisets, and links are joined into classes. Then, in keys whose other members
still are of several classes, all pairs of members of different classes are compared, so no link between contents that share a key is left out. Both
steps read packed multisets ("bags") of those contents only that share a key, and deal large groups to blocks of bounded size.

Defined results: null text is empty; texts without words are copies only where they are equal; texts of fewer than five words have one
shingle; rows that repeat are of one class; a null doc_id is no class id unless all ids of a content are null, when a negative
number made from the content stands for it; an empty table gives no rows; other columns are not read, and `keep_one` returns them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, WORD_BYTES, Work, join_small, mixed, shared_dir, shuffled, small_batches, table, text_slices, words_of

SHINGLE = 5
LEAST = 0.8
REGISTERS = 96
BAND = 4
BANDS = REGISTERS // BAND
#: Members of a group that meet its head in one task, and bytes of bags and members of a block where pairs of blocks meet.
STAR = 128
BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 512
#: A time limit of (log(registers) + SLACK) / weight leaves registers empty in about exp(-SLACK) of the texts.
SLACK = 3.0
U = np.uint64
PRIME = U(0x9E3779B97F4A7C15)


def times(n: int) -> np.uint64:
    return U(n * int(PRIME) & 0xFFFFFFFFFFFFFFFF)


ROW = "doc_id long, same string, content string, weight int, bands array<long>"
#: Bytes of a shingle's hash.
WIDTH = 6
SHORT = U(64 - 8 * WIDTH)


def word_hashes(words: pa.LargeBinaryArray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of its bytes times powers of an odd number."""
    ends = np.frombuffer(words.buffers()[1], np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: ends[-1]]
    powers, inverse = np.full(len(data) + 1, PRIME, U), np.full(len(data) + 1, U(pow(int(PRIME), -1, 1 << 64)), U)
    powers[:1] = inverse[:1] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * powers[:-1], dtype=U)])
    return mixed((sums[ends[1:]] - sums[ends[:-1]]) * inverse[ends[:-1]] + np.diff(ends).astype(U))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of all distinct shingles, sorted by text and shingle, the words of each text and a hash of their sequence."""
    assert len(texts) < 1 << 64 - 8 * WIDTH
    words, n = words_of(texts, WORD_BYTES)
    n = np.asarray(n, np.int64)
    h = word_hashes(words)
    begins = np.cumsum(n) - n
    place = np.arange(len(h)) + np.repeat(np.arange(len(n)) * (SHINGLE - 1), n)
    padded = np.zeros(len(h) + len(n) * (SHINGLE - 1) + SHINGLE, U)
    padded[place] = h
    of = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), of)
    at = np.arange(len(text)) + np.repeat(begins + np.arange(len(n)) * (SHINGLE - 1) - (np.cumsum(of) - of), of)
    s = np.zeros(len(at), U)
    for i in range(SHINGLE):
        s = mixed(s * U(3) + padded[at + i] + U(i + 1))
    # the sequence of words, as a sum of words mixed with their places
    inside = np.arange(len(h), dtype=np.int64) - np.repeat(begins, n)
    cuts = np.concatenate([[0], np.cumsum(n)])
    sums = [np.concatenate([np.zeros(1, U), np.cumsum(mixed(h ^ mixed(inside.astype(U) + U(k))), dtype=U)]) for k in (11, 1_000_003)]
    content = np.column_stack([x[cuts[1:]] - x[cuts[:-1]] for x in sums])
    key = np.sort((text.astype(U) << U(8 * WIDTH)) | (s >> SHORT))
    starts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    text, s = parted(key[starts])
    return text, s, np.diff(np.append(starts, len(key))), n, content


def parted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (key >> U(8 * WIDTH)).astype(np.int64), key & U((1 << 8 * WIDTH) - 1)


def bags(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int) -> list[bytes]:
    """Each text's multiset as a set: the k-th occurrence of a shingle is an element of its own. Elements are sorted, WIDTH bytes each."""
    again = np.flatnonzero(count > 1)
    more = np.repeat(again, count[again] - 1)
    nth = np.arange(len(more)) - np.repeat(np.cumsum(count[again] - 1) - (count[again] - 1), count[again] - 1) + 1
    own = mixed(shingle[more] + nth.astype(U) * PRIME) >> SHORT
    text, element = parted(np.sort(np.concatenate([text.astype(U) << U(8 * WIDTH) | shingle, text[more].astype(U) << U(8 * WIDTH) | own])))
    cuts = np.searchsorted(text, np.arange(texts + 1)) * WIDTH
    packed = np.ascontiguousarray(element.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()
    return [packed[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def elements(bag: bytes) -> np.ndarray:
    out = np.zeros((len(bag) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(bag, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8")[:, 0]


def signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """A row of 64-bit registers for each text; texts without shingles have zeros."""
    weight = np.bincount(text, count, texts)
    out, empty = np.zeros((texts, registers), U), weight > 0
    slack = SLACK
    while empty.any():
        limit = np.where(empty, (np.log(registers) + slack) / np.maximum(weight, 1), 0.0)
        points = list(arrivals(text, shingle, count, limit, registers))
        slot, time, value = (np.concatenate([p[i] for p in points]) for i in range(3))
        best = np.full(texts * registers, np.inf)
        np.minimum.at(best, slot, time)
        won = time == best[slot]
        flat = np.zeros(texts * registers, U)
        flat[slot[won]] = value[won]
        found = np.isfinite(best).reshape(texts, registers)
        done = empty & found.all(axis=1)
        out[done] = flat.reshape(texts, registers)[done]
        empty &= ~done
        slack = 2 * slack + np.log(registers)
    return out


def arrivals(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, limit: np.ndarray, registers: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The points of all processes up to each text's limit, as (text and register, time, value)."""
    top = int(count.max()) if len(count) else 0
    levels = 0
    while True:
        low, size = (0, 1) if levels == 0 else (1 << (levels - 1), 1 << (levels - 1))  # this interval's levels are low + 1 to low + size
        if low >= top:
            return
        own = np.flatnonzero((count > low) & (limit[text] > 0))
        t, w, until = text[own], count[own], limit[text[own]]
        state = mixed(shingle[own] + times(levels + 1))
        time, i = np.zeros(len(own)), 0
        while len(t):
            i += 1
            point = mixed(state + times(i))
            time = time - np.log(((point >> U(11)).astype(np.float64) + 1) * 2.0**-53) / (registers * size)
            live = time <= until
            t, w, until, state, time, point = t[live], w[live], until[live], state[live], time[live], point[live]
            value = mixed(point ^ U(0x5851F42D4C957F2D))
            register = ((value >> U(32)) * U(registers)) >> U(32)
            slot = t * registers + register.astype(np.int64)
            if size > 1:
                inside = low + 1 + ((value & U(0xFFFFFFFF)) * U(size) >> U(32)).astype(np.int64) <= w
                yield slot[inside], time[inside], value[inside]
            else:
                yield slot, time, value
        levels += 1


def band_keys(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    grouped = signature.reshape(len(signature), -1, band)
    out = np.broadcast_to(np.arange(grouped.shape[1], dtype=U), grouped.shape[:2]).copy()
    for i in range(band):
        out = mixed(out * U(5) + grouped[:, :, i])
    return out.view(np.int64)


def similar(a: int, b: int, both: np.ndarray | int, least: float) -> np.ndarray | bool:
    """Whether sets of a and b elements with so many in common reach the weighted Jaccard similarity."""
    return both >= least * (a + b - both)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, BATCH_ROWS):
        yield batch.slice(at, BATCH_ROWS)


def contents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, same, content, weight, bands): same is the text's md5, content names its words, weight counts its
    shingles, and bands are empty without words."""
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            text, shingle, count, n, content = shingles(batch.column(1))
            keys = band_keys(signatures(text, shingle, count, batch.num_rows))
            names = [f"{a:016x}{b:016x}{w}" if w else f"={t}" for (a, b), w, t in zip(content, n, batch.column(2).to_pylist(), strict=True)]
            sizes = np.where(n > 0, BANDS, 0)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys[n > 0].ravel()))
            weight = pa.array(np.bincount(text, count, batch.num_rows).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), weight, bands], names=["doc_id", "same", "content", "weight", "bands"])

    return texts_of(docs).select("doc_id", "text", "same").mapInArrow(write, ROW)


def texts_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("same"))


def row_key(doc_id: str = "doc_id", same: str = "same") -> Column:
    """One string that names a row by its id and text."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), same)


def bags_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, bag) of wanted(id, doc_id, same), whose doc_id and same name the row of docs with the text of an id."""
    rows = wanted.select("id", row_key().alias("_op6_row"))
    texts = join_small(texts_of(docs).withColumn("_op6_row", row_key()), rows, ["_op6_row"], "inner", rows.count()).select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            text, shingle, count, _, _ = shingles(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags(text, shingle, count, batch.num_rows), pa.binary())], names=["id", "bag"])

    return texts.mapInArrow(write, "id long, bag binary").dropDuplicates(["id"])  # rows may repeat


class Multisets:
    """How packed multisets are compared. Other kinds of data have the same four methods; `parts` gives the (token, size) of what two bags can
    share, for `finer`, and near pairs share at least `least` of the size of both together. `rest` is how many members a key has at most outside its
    largest class without being split: up to a block of them makes no more than a copy of each other member, less than many parts do."""

    rest = BLOCK_ROWS

    def __init__(self, least: float = LEAST):
        self.least = least

    load = staticmethod(elements)

    @staticmethod
    def parts(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x.astype(np.int64), np.ones(len(x), np.int64)])

    def near(self, head: np.ndarray, own: np.ndarray) -> bool:
        if min(len(own), len(head)) < self.least * max(len(own), len(head)):
            return False
        place = np.searchsorted(head, own)
        both = np.count_nonzero(head[np.minimum(place, len(head) - 1)] == own)
        return bool(similar(len(own), len(head), both, self.least))

    def matrix(self, sets: list[np.ndarray], meets: np.ndarray) -> np.ndarray:
        """Which of the pairs that meet are near."""
        size = np.array([len(x) for x in sets])
        return meets & similar(size[:, None], size, overlaps(sets), self.least)


def star_links(pairs: DataFrame, bag: DataFrame, kind: Multisets) -> DataFrame:
    """The links among pairs(a, b, n): b is a head of up to n members. Groups are dealt to cells of about STAR members that each get
    the head's bag, and a task compares a cell in one pass, the head first."""
    dealt = pairs.withColumn("salts", F.ceil(F.col("n") / STAR).cast("int")).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    heads = dealt.select("b", "salts", "salt").distinct().withColumn("id", F.col("b"))
    rows = heads.unionByName(dealt.select("b", "salts", "salt", F.col("a").alias("id"))).join(shuffled(bag), "id")
    cells = rows.repartition("b", "salts", "salt").sortWithinPartitions("b", "salts", "salt", F.col("id") != F.col("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, None
        for batch in batches:
            a, b = [], []
            for i, top, bag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if i == top:
                    if top != at:
                        at, head = top, kind.load(bag.as_py())
                    continue
                if kind.near(head, kind.load(bag.as_py())):
                    a.append(i)
                    b.append(top)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return cells.select("id", "b", "bag").mapInArrow(compare, "a long, b long")


def overlaps(sets: list[np.ndarray], run: int = 32) -> np.ndarray:
    """The number of common elements of any two sets. Elements of few sets are counted pair by pair, those of many as columns of a matrix."""
    n = len(sets)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    starts = np.flatnonzero(np.diff(element, prepend=~element[:1]))
    length = np.diff(np.append(starts, len(element)))
    both = np.zeros(n * n, np.float32)
    few = np.repeat((length > 1) & (length <= run), length)
    e, o = element[few], owner[few]
    for lag in range(1, run):
        same = np.flatnonzero(e[lag:] == e[:-lag])
        if not len(same):
            break
        both += np.bincount(o[same] * n + o[same + lag], minlength=n * n)
    both = both.reshape(n, n)
    both += both.T
    many = np.flatnonzero(length > run)
    for at in range(0, len(many), 4_096):
        part = many[at : at + 4_096]
        column = np.repeat(np.arange(len(part)), length[part])
        row = owner[np.repeat(starts[part] - (np.cumsum(length[part]) - length[part]), length[part]) + np.arange(length[part].sum())]
        grid = np.zeros((n, len(part)), np.float32)
        grid[row, column] = 1
        both += grid @ grid.T
    return both


def forest(root: np.ndarray, linked: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """What linked, a matrix of rows, joins of their roots: each root once, with the first root that it reaches."""
    roots, own = np.unique(root, return_inverse=True)
    near = np.zeros((len(roots), len(roots)), bool)
    a, b = np.nonzero(linked)
    near[own[a], own[b]] = near[own[b], own[a]] = True
    top = np.full(len(roots), -1)
    for start in range(len(roots)):
        new = np.array([start]) if top[start] < 0 else ()
        while len(new):
            top[new] = start
            new = np.flatnonzero(near[new].any(axis=0) & (top < 0))
    more = np.flatnonzero(top != np.arange(len(roots)))
    return pa.array(roots[more]), pa.array(roots[top[more]])


def finer(classed: DataFrame, bag: DataFrame, kind: Multisets, work: Work) -> DataFrame:
    """classed(key, id, weight, root) with a column small, where rare tokens take the place of all keys of more than a block of members and more than kind.rest
    outside the largest class, so that a passage that many texts share makes no large group. A member has a row for each rare token, in however many such keys it was.

    No near pair is lost. Of the size of both together, near bags share at least `least`, so the smaller of two lacks at most
    (1 - least) / (1 + least) of its own size, and the larger at most 1 - least. With tokens in one order for all, the rarest first, a bag has no
    more than what the other lacks before the first token that both share. So each bag goes to the keys of its first 1 - least, and is small in
    those that it would reach as the smaller of two: of a near pair, one at least is small in the key of the first common token. Texts of a family that
    is not near have more than that of their own, so what they all share is a key without small members. Such keys, and those of one class, drop out."""
    sizes = classed.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("n"), F.max("m").alias("m"))
    wide = work.store(sizes.where((F.col("n") > BLOCK_ROWS) & (F.col("n") - F.col("m") > kind.rest)).select("key"), "wide")
    found = wide.count()
    if not found:
        return classed.withColumn("small", F.lit(True))
    inside = work.store(join_small(classed, wide, ["key"], "left_semi", found).select("id", "weight", "root").distinct(), "inside")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_slices(b, 1)):
            own = [np.asarray(kind.parts(kind.load(x.as_py())), np.int64).reshape(-1, 2) for x in batch.column(1)]
            n = [len(x) for x in own]
            flat, whole = np.concatenate([np.empty((0, 2), np.int64), *own]), np.array([x[:, 1].sum() for x in own], np.int64)
            columns = [*(np.repeat(batch.column(i).to_numpy(), n) for i in (0, 2, 3)), flat[:, 0], flat[:, 1], np.repeat(whole, n)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["id", "weight", "root", "token", "size", "whole"])

    bagged = inside.join(shuffled(bag), "id").select("id", "bag", F.col("weight").cast("long"), "root")
    tokens = work.store(bagged.mapInArrow(write, "id long, weight long, root long, token long, size long, whole long"), "tokens")
    held = work.store(tokens.groupBy("token").agg(F.count("*").alias("n")), "held")
    ranked = join_small(tokens, held, ["token"], "inner", held.count(), salt=F.pmod(F.xxhash64("id"), F.lit(32)).cast("int"))
    before = F.sum("size").over(Window.partitionBy("id").orderBy("n", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    upto = lambda share: F.col("before") <= share * F.col("whole") + 1e-6
    first = ranked.withColumn("before", before).where(upto(1 - kind.least) & (F.col("n") > 1))
    small = upto((1 - kind.least) / (1 + kind.least)).alias("small")
    rare = work.store(first.select(F.xxhash64("token").alias("key"), "id", "weight", "root", small), "rare")
    meet = work.store(rare.groupBy("key").agg(F.max("small").alias("small"), (F.min("root") < F.max("root")).alias("several")).where("small AND several").select("key"), "meet")
    split = work.store(join_small(rare, meet, ["key"], "left_semi", meet.count()), "finer")
    work.drop(tokens, held, rare, meet)
    return join_small(classed, wide, ["key"], "left_anti", found).withColumn("small", F.lit(True)).unionByName(split)


def rest_links(members: DataFrame, roots: DataFrame, bag: DataFrame, kind: Multisets, work: Work) -> DataFrame:
    """The classes (a, b) that the links among all pairs of members(key, id, weight) join that share a key and differ in their root.

    The members of a key that need not meet each other, those of its largest class or those that are not small, meet blocks of the others
    only, and the others meet block by block."""
    classed = members.join(shuffled(roots), "id", "left").withColumn("root", F.coalesce("root", "id")).select("key", "id", "weight", "root")
    classed = finer(classed, bag, kind, work)
    large = F.when(F.col("small"), 0).otherwise(1)
    by = classed.groupBy("key", "root").agg(F.count("*").alias("m"), F.sum("weight").alias("w"), F.sum(large).alias("lm"), F.sum(large * F.col("weight")).alias("lw"))
    by = by.groupBy("key").agg(F.max(F.struct("m", "w", "root")).alias("x"), *(F.sum(c).alias(c) for c in ("m", "w", "lm", "lw"))).where("x.m < m AND lm < m")
    by = by.withColumn("by_size", F.col("lm") > F.col("x.m"))
    alone, heavy = (F.when(F.col("by_size"), F.col(a)).otherwise(F.col(b)) for a, b in (("lm", "x.m"), ("lw", "x.w")))
    blocks = lambda rows, weight: F.ceil(F.greatest(rows / BLOCK_ROWS, weight * (WIDTH / BLOCK_BYTES))).cast("int")
    split = work.store(by.select("key", F.col("x.root").alias("top"), "by_size", blocks(alone, heavy).alias("kd"), blocks(F.col("m") - alone, F.col("w") - heavy).alias("ko")), "split")
    found = split.count()
    if not found:
        return split.select(F.col("top").alias("a"), F.col("top").alias("b"))
    rows = join_small(classed, split, ["key"], "inner", found).withColumn("first", F.when(F.col("by_size"), ~F.col("small")).otherwise(F.col("root") == F.col("top")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("first"), F.col("kd")).otherwise(F.col("ko"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cell = lambda mixed, lo, hi: F.struct(F.lit(mixed).alias("mixed"), lo.alias("lo"), hi.alias("hi"))
    own = F.col("own")
    firsts = F.transform(upto("ko"), lambda k: cell(True, own, k))
    others = F.concat(F.transform(upto("kd"), lambda k: cell(True, k, own)), F.transform(upto("ko"), lambda k: cell(False, F.least(own, k), F.greatest(own, k))))
    cells = rows.select("key", "id", "root", "first", "own", F.explode(F.when(F.col("first"), firsts).otherwise(others)).alias("c")).select("key", "c.*", "id", "root", "first", "own")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(cell: pa.Table) -> pa.Table:
        mixed, lo, hi = (cell.column(n)[0].as_py() for n in ("mixed", "lo", "hi"))
        ids, root, first, own = (cell.column(n).to_numpy() for n in ("id", "root", "first", "own"))
        sets = [kind.load(x.as_py()) for x in cell.column("bag")]
        meets = (ids[:, None] > ids) & (root[:, None] != root) & ((first[:, None] != first) if mixed else ((own[:, None] != own) | (lo == hi)))
        return pa.table(list(forest(root, kind.matrix(sets, meets))), schema=out)

    return cells.join(shuffled(bag), "id").groupBy("key", "mixed", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame, work: Work) -> DataFrame:
    """(id, root): the smallest id that each linked id reaches, by alternating large and small stars. Links (a, b) are
    stored each round; the rounds end when their number and sum stay the same."""
    links = work.store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            out = work.store(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")), "roots")
            work.drop(links)
            return out
        before = now
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that a join may split the rows of a hot end
        least = work.store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(shuffled(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(shuffled(own), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own.select("a", F.col("m").alias("b")))
        after = work.store(small.distinct(), "links")
        work.drop(links, least)
        links = after


def classes(keys: DataFrame, bags: Callable[[DataFrame], DataFrame], kind: Multisets, work: Work) -> DataFrame:
    """(id, root) of the ids that are near another one. keys(id, key, weight), where weight says how large an id's bag is; bags gives (id, bag)
    of some ids."""
    heads = work.store(keys.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1"), "heads")
    members = work.store(join_small(keys, heads, ["key"], "inner", heads.count()).where("id <> b"), "members")
    pairs = work.store(members.groupBy(F.col("id").alias("a"), "b").agg(F.max("n").alias("n")), "pairs")
    active = work.store(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "active")
    bag = work.store(bags(active), "bags")
    links = work.store(star_links(pairs, bag, kind), "stars")
    roots = components(links, work)
    rest = work.store(rest_links(members.select("key", "id", "weight"), roots, bag, kind, work), "rest")
    if rest.limit(1).count():
        stars = roots.select(F.col("id").alias("a"), F.col("root").alias("b"))
        roots = components(stars.union(rest), work)
    return roots


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, same, content, root, class_id) of each row of docs(doc_id, text): class_id is the smallest doc_id of the class, and root
    a number that is the class's alone where rows repeat a doc_id with other texts."""
    work = Work(docs.sparkSession)
    rows = work.store(contents(docs).withColumn("row", F.monotonically_increasing_id()), "contents")
    # a stored row's number is its own, so the number of its first row is a content's id
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same", "row")).alias("r")
    named = work.store(rows.groupBy("content").agg(first, F.first("weight").alias("weight"), F.first("bands").alias("bands")).select("content", F.col("r.row").alias("id"), "r.doc_id", "r.same", "weight", "bands"), "named")
    bags = lambda active: bags_of(join_small(named, active, ["id"], "left_semi", active.count()), docs)
    roots = classes(named.select("id", "weight", F.explode("bands").alias("key")), bags, Multisets(least), work)
    rooted = named.select("content", "id", "doc_id").join(shuffled(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min("content").alias("c")).withColumn("class_id", F.coalesce("class_id", -1 - F.pmod(F.xxhash64("c"), F.lit(1 << 62)))).drop("c")
    ids = work.store(rooted.select("content", "root").join(shuffled(work.store(smallest, "smallest")), "root"), "ids")
    out = work.store(rows.select("doc_id", "same", "content").join(shuffled(ids), "content"), "classes")
    work.drop(*(t for t, _ in [*work.paths.values()] if t is not out))
    return out


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without near-duplicates: of each class one row with the smallest doc_id stays."""
    work = Work(docs.sparkSession)
    rows = near_duplicates(docs, least).select(row_key().alias("_op6_row"), "doc_id", "same", "root")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")).alias("r"))
    first = work.store(first.select("root", row_key("r.doc_id", "r.same").alias("_op6_kept")), "kept")
    out = work.store(rows.join(shuffled(first), "root").where("_op6_row <> _op6_kept").select("_op6_row").distinct(), "dropped")
    own = {"_op6_row": row_key("doc_id", "_op6_same")}
    keyed = docs.withColumn("_op6_same", F.md5(F.coalesce("text", F.lit("")))).withColumns(own)
    kept = join_small(keyed, out, ["_op6_row"], "left_anti", out.count()).drop("_op6_row", "_op6_same")
    repeats = rows.groupBy("_op6_row").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeats else kept


def op6_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def brute_force(texts: dict[int, str | None], least: float = LEAST) -> dict[int, int]:
    """doc_id to class_id by comparing all with all; for tests."""
    import re
    from collections import Counter

    def bag(t: str) -> Counter:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return Counter(tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))) if w else Counter({("=", t): 1})

    bags, root = {d: bag(t or "") for d, t in texts.items()}, {d: d for d in texts}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = sum((bags[a] & bags[b]).values())
            if both >= least * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}
