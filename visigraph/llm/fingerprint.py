"""Operator 8: document fingerprints by a randomised edit embedding.

A text is cut where its own characters say so (a hash of the last few), so what lies behind an insertion is cut as before. A walk
goes over each chunk: at step j it stands on one character and moves on by a random bit that depends on j and the character only. All
texts share those bits, so walks over chunks a few edits apart meet again soon after each edit, and the characters that
they stand on agree at most steps: edit distance becomes Hamming distance. A fingerprint lists the chunks; each has a mark of
four digits, from the characters before it (0000 for the first), and the characters at sampled steps, hashed to digits 1 to f. The
first chunk has more samples, for short texts.

The likeness of two fingerprints compares chunks of equal marks, the n-th of a mark with the n-th: the share of samples that agree, less
what unrelated texts agree by chance, weighed by the samples of all chunks of both. Each band samples places of the embedded text, the digits there
are its key, and equal keys find candidates; likeness verifies them.

Defined results: a null text is empty, and an empty text has an empty fingerprint; two empty fingerprints are alike (1.0);
equal texts have equal fingerprints; rows that repeat a doc_id are ordered by text; a null doc_id comes last; the next
document of the only one is itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dedup
from .common import Work, join_small, mixed, range_cuts, small_batches, table

#: Characters that decide on a cut, one place in so many is cut, and the bounds of a chunk's characters.
WINDOW = 8
EVERY = 128
SHORTEST, LONGEST = 48, 512
#: Hashed characters of unrelated texts agree so often.
CHANCE = 0.13
SHARD_ROWS = 8_192
SEED = 20_240_101
#: Bands, the places that each of a band's two chunks is sampled at, and the likeness that links.
BANDS = 24
DRAWN = 4
LEAST = 0.8
#: Fingerprints are digits of four bits, which only an entropy coder stores in less than a byte.
CODEC = "zstd"

_random = np.random.default_rng(SEED)
STEPS = 2 * LONGEST + 128
#: By step and symbol: whether the walk moves on, and the digit of a sample. Symbol 0 is the end: no move, digit 0.
MOVES = _random.integers(0, 2, (STEPS, 256)).astype(np.int32)
MOVES[:, 0] = 0
DIGITS = _random.integers(1, 16, (STEPS, 256)).astype(np.uint8)
DIGITS[:, 0] = 0
#: Sampled steps of any chunk, and of a first one.
EVEN = np.arange(3, STEPS, 20)
EARLY = np.union1d(np.arange(0, 48, 2), EVEN)
#: By band and chunk: what is added to chunks' hashes, and by a chunk's samples the places to look at.
DRAWS = _random.integers(1, 1 << 63, 2 * BANDS).astype(np.uint64)


def _places() -> np.ndarray:
    """The first places of a random order that a chunk of so many samples has, so that a sample more or less seldom changes them. The two chunks of a band
    take other places, as they may be the same."""
    out = np.zeros((2 * BANDS, len(EARLY) + 1, DRAWN), np.int64)
    for band in range(BANDS):
        order = _random.permutation(len(EARLY))
        for n in range(1, len(EARLY) + 1):
            held = np.resize(order[order < n], 2 * DRAWN)
            out[2 * band, n], out[2 * band + 1, n] = held[:DRAWN], held[DRAWN:]
    return out


PLACES = _places()
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
#: Marks that are looked at together when many fingerprints are compared.
COLUMNS = 4_096
#: Fingerprints whose bands are made together, and chunks times bands that are looked at together.
BANDED, CELLS = 256, 1 << 20
#: Chunks that walk together.
LOCKSTEP = 8_192
U = np.uint32


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), U)
    return ((points * U(2654435761)) >> U(8)) % U(255) + U(1)


def cuts(own: np.ndarray) -> tuple[list[int], list[int]]:
    """Where the chunks of a text's symbols begin, and their marks."""
    n = len(own)
    if n < 2 * SHORTEST:
        return ([0], [0]) if n else ([], [])
    h = np.zeros(n - WINDOW + 1, U)  # of the WINDOW symbols before place WINDOW and on
    for i in range(WINDOW):
        h = (h ^ own[i : n - WINDOW + 1 + i]) * U(0x9E3779B1)
        h ^= h >> U(15)
    places = np.flatnonzero(h % U(EVERY) == 0)
    at, marks, found = [0], [0], (places + WINDOW).tolist()
    k = bisect_left(found, SHORTEST)
    while True:
        place = min(found[k] if k < len(found) else n, at[-1] + LONGEST)
        if n - place < SHORTEST:  # what is left at the end belongs to the last chunk, unless that grows too long
            if n - at[-1] <= LONGEST:
                return at, marks
            place = n - SHORTEST if place > n - SHORTEST else place
        at.append(place)
        marks.append(1 + int(h[place - WINDOW] // U(EVERY)) % 0xFFFF)
        k = bisect_left(found, place + SHORTEST, k)


def walk(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, firsts: np.ndarray) -> list[bytes]:
    """The samples of chunks, as digits, without those behind the end. flat: the symbols of all texts, with a 0 behind each chunk."""
    order = np.argsort(-lengths, kind="stable")
    at, ends, first = begins[order].astype(np.int32), (begins + lengths)[order], firsts[order]
    out = np.zeros((len(at), len(EARLY)), np.uint8)
    column = {int(j): k for k, j in enumerate(EARLY)}
    even, live = set(EVEN.tolist()), len(at)
    for j in range(STEPS):
        while live and at[live - 1] >= ends[live - 1]:
            live -= 1
        if not live:
            break
        here = flat[at[:live]]
        if j in column:
            digits = DIGITS[j][here]
            out[:live, column[j]] = digits if j in even else np.where(first[:live], digits, 0)
        at[:live] += MOVES[j][here]
    text = HEX[out]
    used = out != 0
    made: list[bytes] = [b""] * len(at)
    for i, k in enumerate(order.tolist()):
        made[k] = text[i, used[i]].tobytes()
    return made


def fingerprints(texts: list[str]) -> list[str]:
    own = [symbols(t) for t in texts]
    found = [cuts(x) for x in own]
    parts, begins, lengths, marks, total = [], [], [], [], 0
    for x, (at, mark) in zip(own, found, strict=True):
        for a, b in zip(at, [*at, len(x)][1:], strict=True):
            parts += [x[a:b].astype(np.uint8), np.zeros(1, np.uint8)]
            begins.append(total)
            lengths.append(b - a)
            total += b - a + 1
        marks += mark
    if not begins:
        return [""] * len(texts)
    flat, begins, lengths, marks = np.concatenate(parts), np.array(begins), np.array(lengths), np.array(marks)
    made = []
    for i in range(0, len(begins), LOCKSTEP):
        made += walk(flat, begins[i : i + LOCKSTEP], lengths[i : i + LOCKSTEP], marks[i : i + LOCKSTEP] == 0)
    chunks = iter(f"{m:04x}{d.decode()}" for m, d in zip(marks.tolist(), made, strict=True))
    return [".".join(next(chunks) for _ in at) for at, _ in found]


def chunks_of(fingerprint: str) -> dict[tuple[str, int], bytes]:
    """The samples of a fingerprint's chunks by mark and by its number among those of the mark."""
    out, seen = {}, Counter()
    for chunk in fingerprint.split(".") if fingerprint else ():
        mark = chunk[:4]
        out[mark, seen[mark]] = chunk[4:].encode()
        seen[mark] += 1
    return out


def likeness(a: str | dict, b: str | dict) -> float:
    """0 to 1, of fingerprints or of their chunks. Samples that a shorter chunk lacks don't agree."""
    x, y = (chunks_of(s) if isinstance(s, str) else s for s in (a, b))
    if not x and not y:
        return 1.0
    total = alike = 0.0
    for mark in x.keys() | y.keys():
        p, q = x.get(mark, b""), y.get(mark, b"")
        n = max(len(p), len(q))
        total += n
        if p == q:
            alike += n
        elif p and q:
            m = min(len(p), len(q))
            share = np.count_nonzero(np.frombuffer(p, np.uint8, m) == np.frombuffer(q, np.uint8, m)) / n
            alike += n * max(0.0, (share - CHANCE) / (1 - CHANCE))
    return alike / total


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_chars, fingerprint)."""
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(fingerprints(texts), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "doc_id long, n_chars long, fingerprint string")


class Prints:
    """How fingerprints are compared, for dedup.classes. They have few parts, so large keys are split for any member of another class."""

    rest = 0

    def __init__(self, least: float = LEAST):
        self.least = least

    @staticmethod
    def load(data: bytes) -> dict:
        return chunks_of(data.decode())

    @staticmethod
    def parts(x: dict) -> list[tuple[int, int]]:
        return [(int(mark, 16) << 32 | n, len(d)) for (mark, n), d in x.items()]

    def near(self, head: dict, own: dict) -> bool:
        return likeness(head, own) >= self.least

    def matrix(self, prints: list[dict], meets: np.ndarray) -> np.ndarray:
        """Which pairs are near. No more samples agree than chunks of equal marks have in common, so most pairs that share a passage only
        are settled by matrix products; likeness decides on the rest."""
        held = Counter(mark for x in prints for mark in x)
        column = {mark: k for k, mark in enumerate(m for m, n in held.items() if n > 1)}
        rows, columns, sizes = (np.array(x, np.int64) for x in ([i for i, x in enumerate(prints) for m in x if m in column], [column[m] for x in prints for m in x if m in column], [len(d) for x in prints for m, d in x.items() if m in column]))
        both = np.zeros(meets.shape, np.float32)
        for low in range(0, len(column), COLUMNS):
            at = (columns >= low) & (columns < low + COLUMNS)
            size = np.zeros((len(prints), min(COLUMNS, len(column) - low)), np.float32)
            size[rows[at], columns[at] - low] = sizes[at]
            both += size @ (size > 0).astype(np.float32).T
        both = np.minimum(both, both.T)
        whole = np.array([sum(map(len, x.values())) for x in prints], np.float32)
        meets = meets & (both >= self.least * (whole[:, None] + whole - both) * (1 - 1e-5))
        out = np.zeros_like(meets)
        for i, j in zip(*np.nonzero(meets), strict=True):
            out[i, j] = self.near(prints[i], prints[j])
        return out


def bands(prints: list[str]) -> np.ndarray:
    """The keys of fingerprints that have chunks, BANDS each. A band samples two chunks, by a hash of mark and number only, and some places in each:
    what is sampled depends on no digit, so the digits there are bits of the embedded text at places that all texts share."""
    chunks = [chunks_of(x) for x in prints]
    sizes = np.array([len(x) for x in chunks])
    begins = np.cumsum(sizes) - sizes
    label = np.array([int(mark, 16) << 32 | n for x in chunks for mark, n in x], np.uint64)
    size = np.array([len(d) for x in chunks for d in x.values()])
    starts = np.cumsum(size) - size
    digits = np.frombuffer(b"".join(d for x in chunks for d in x.values()), np.uint8)
    keys = np.zeros((len(prints), 2 * BANDS), np.uint64)
    step = max(1, CELLS // len(label))
    for low in range(0, 2 * BANDS, step):
        draws = np.arange(low, min(low + step, 2 * BANDS))
        h = mixed(label[:, None] ^ DRAWS[draws])
        least = np.repeat(np.minimum.reduceat(h, begins), sizes, axis=0)
        pick = np.maximum.reduceat(np.where(h == least, np.arange(len(label))[:, None], -1), begins)
        sampled = digits[starts[pick][..., None] + PLACES[draws, size[pick]]].astype(np.uint64)
        # first chunks have no mark of their own, so they give one digit more
        sampled[label[pick] != 0, -1] = 0
        key = label[pick]
        for k in range(DRAWN):
            key = mixed(key * np.uint64(5) + sampled[..., k])
        keys[:, draws] = key
    return (mixed(keys[:, ::2] + np.uint64(3) * keys[:, 1::2] + np.arange(BANDS, dtype=np.uint64)) >> np.uint64(1)).view(np.int64)


def class_ids(rows: DataFrame, least: float, work: Work) -> DataFrame:
    """(fingerprint, class_id, several) of rows(row, doc_id, fingerprint), a stored table whose rows are numbered: documents of fingerprints that
    are linked have the class of the smallest doc_id, and `several` says whether a class has more than one row. Equal fingerprints are compared
    once. What the job stores on its way goes."""
    held = set(work.paths)
    prints = work.store(rows.groupBy("fingerprint").agg(F.min("row").alias("id"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "named", codec=CODEC)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BANDED):
                part = batch.slice(at, BANDED)
                prints = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), BANDS)), pa.array(bands(prints).ravel()), pa.array(np.repeat([len(x) for x in prints], BANDS).astype(np.int32))], names=["id", "key", "weight"])

    keys = work.store(prints.where("fingerprint <> ''").select("id", "fingerprint").mapInArrow(write, "id long, key long, weight int"), "keys", codec=CODEC)
    bag = prints.select("id", F.col("fingerprint").cast("binary").alias("bag"))
    roots = dedup.classes(keys, lambda active: join_small(bag, active, ["id"], "left_semi", active.count()), Prints(least), work)
    rooted = prints.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = work.store(rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), (F.sum("n") > 1).alias("several")), "smallest")
    ids = work.store(rooted.select("fingerprint", "root").join(smallest, "root").select("fingerprint", "class_id", "several"), "ids")
    work.drop(*(t for k, (t, _) in [*work.paths.items()] if k not in held and t is not ids))
    return ids


def with_classes(rows: DataFrame, least: float, work: Work) -> DataFrame:
    """rows, as class_ids takes them, with class_id instead of row. Only rows of classes of several meet the table of classes, by a digest."""
    key = F.md5("fingerprint").alias("_op8_key")
    ids = work.store(class_ids(rows, least, work).where("several").select(key, "class_id", F.lit(True).alias("_op8_several")), "several")
    joined = join_small(rows.withColumn("_op8_key", F.md5("fingerprint")), ids, ["_op8_key"], "left", ids.count(), salt=F.pmod(F.xxhash64("row"), F.lit(32)).cast("int"))
    return joined.withColumn("class_id", F.when(F.col("_op8_several"), F.col("class_id")).otherwise(F.col("doc_id"))).drop("_op8_key", "_op8_several", "row")


def near_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, class_id): documents whose fingerprints are linked, by a likeness of `least` or more, have the class of the smallest
    doc_id. Equal fingerprints are compared once; texts that share no key are not. A class of null doc_ids only is null."""
    work = Work(docs.sparkSession)
    rows = work.store(fingerprint_rows(docs).withColumn("row", F.monotonically_increasing_id()), "prints", codec=CODEC)
    return with_classes(rows, least, work).select("doc_id", "class_id")


def edited(text: str, after: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def neighbours(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """docs(doc_id, text) in shards of falling doc_id; a shard's last row, with `ghost`, repeats the first of the next shard (of
    the first one in the last shard). Cuts and the largest doc_id of each shard are all that the driver learns."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = np.array(range_cuts(rows, "doc_id", -(-rows.count() // shard_rows)), np.int64)
    last = len(cuts)

    def place(ids):  # noqa: ANN001, ANN202
        return last - np.searchsorted(cuts, ids, "right")

    @F.pandas_udf("int")
    def shard(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(place(ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64)).astype(np.int32))

    heads = {r[0]: r[1] for r in rows.where("doc_id IS NOT NULL").groupBy(shard("doc_id").alias("s")).agg(F.max("doc_id")).collect()}
    full = sorted(heads)
    before = {heads[s]: full[i - 1] for i, s in enumerate(full)} if full else {}  # the first shard's head follows the last one

    @F.pandas_udf("int")
    def ghost(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        return ids.map(before).astype("Int32") if len(ids) else pd.Series([], dtype="Int32")

    own = F.struct(shard("doc_id").alias("shard"), F.lit(False).alias("ghost"))
    other = F.struct(ghost("doc_id").alias("shard"), F.lit(True).alias("ghost"))
    dealt = rows.withColumn("_at", F.explode(F.array(own, other))).where("_at.shard IS NOT NULL").select("_at.shard", "_at.ghost", "doc_id", "text")
    return dealt.repartitionById(last + 1, F.col("shard")).sortWithinPartitions("shard", "ghost", F.col("doc_id").desc_nulls_last(), "text"), last + 1


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness to each other and to the next document."""
    small_batches(docs.sparkSession)
    dealt, _ = neighbours(docs)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        kept, first, ended = None, None, False

        def rows(own: list, prints: list) -> pa.RecordBatch:
            """All but the last of own, which are followed by it."""
            changed = [edited(t, own[i + 1][1]) for i, (_, t) in enumerate(own[:-1])]
            other = fingerprints(changed)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([[d for d, _ in own[:-1]], [len(t) for _, t in own[:-1]], [hashlib.sha256(t.encode()).hexdigest() for t in changed], prints[:-1], other, [likeness(a, b) for a, b in zip(prints, other, strict=False)], [likeness(a, b) for a, b in zip(prints, prints[1:], strict=False)]], kind, strict=True)], schema=kind)

        for batch in batches:
            own, ghosts = [], batch.column(1).to_pylist()
            for g, d, t in zip(ghosts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not ended:
                    own.append((d, t))
                ended |= g
            if not own:
                continue
            prints = fingerprints([t for _, t in own])
            if kept:
                own, prints = [kept[0], *own], [kept[1], *prints]
            first = first or (own[0], prints[0])
            yield rows(own, prints)
            kept = (own[-1], prints[-1])
        if kept and not ended:  # no ghost: no doc_id is known, so this shard holds all rows
            yield rows([kept[0], first[0]], [kept[1], first[1]])

    return dealt.mapInArrow(write, OUT)


def linked_next(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """compare_next with the class_id of near_classes; texts are walked over once, and their shuffle is gone before classes are made."""
    work = Work(docs.sparkSession)
    rows = work.store(compare_next(docs).withColumn("row", F.monotonically_increasing_id()), "compared", codec=CODEC)
    return with_classes(rows, least, work)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_next(table(spark, sf_dir, "documents"))
