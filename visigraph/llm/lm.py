"""Operator 10: language-model scoring with a causal self-attention model over subword ids, in numpy.

Documents are dealt to segments by a hash of doc_id and text and sorted there, so scores don't depend on how the table is laid out, up
to rounding. In a segment each distinct word is kept once with its subword ids and a 64-bit hash. From
all training documents Spark gathers word counts (for the base score; words are told apart by that hash), and for each subword
its count and what stands before it. Subwords are clustered into classes by that; the model predicts the class of the next
subword by attention over the subwords before it, and the subword within its class follows from counts after that kind of
subword, so probabilities of all subwords sum to 1.

The model trains on all windows of every training document, by segments in parallel: each segment runs Adam from the common
weights, and Spark averages the weights, summed up in a tree. That is done twice: first briefly, over every WARM-th run of windows, so that the
segments set out from common weights that fit, then over all windows. Scoring runs over windows of 32 inputs that overlap
by half; each scores the 16 tokens that no other does, so every token is scored once with 16 to 31 tokens before it.

Word tokens are lower-case runs without white space; the model reads " " + word, and an end token after the last.

Defined results: null text is empty: one token, the end; a null doc_id counts as empty text for the held-out test; rows that repeat
a doc_id are scored one by one; without training documents counts are 0 and the model is uniform over its classes; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classifier import held_out
from .common import MOST_SHARDS, SPACE_BYTES, Work, small_batches, table, words_of

TOKENIZER = os.environ.get("VISIGRAPH_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Bytes of text that a segment is planned for.
SEGMENT_BYTES = 12 << 20
#: The first round takes one run of windows in so many, the second one all.
WARM = 16
#: Learning rates of the two rounds.
RATES = (0.01, 0.004)
#: Segments whose words, all of them, are as many as those of a part of the word counts.
PART = 4
#: Rows of the tree's nodes.
FAN = 32
#: Subwords of the tokenizer, then the end token; START and BEFORE only occur as inputs.
SUBWORDS = 50_256
END = SUBWORDS
START, BEFORE = SUBWORDS + 1, SUBWORDS + 2
NONE = 0xFFFF
VOCAB = SUBWORDS + 1
NEW, WIDE = 16, 32
DIM, HIDDEN, CLASSES, OWN_ROWS, LEFT = 16, 32, 32, 1_536, 128
#: Windows scored at a time; windows of a run, which lie side by side and share their inputs, and runs of a training step.
BATCH = 128
RUN = 16
RUNS = 16
#: A Python float keeps arrays in single precision.
SCALE = DIM**-0.5
#: Counts within a class that a kind of subword before needs to outweigh those of all kinds.
PRIOR = 200.0

SEGMENTS = "segment int, doc_ids array<long>, held array<boolean>, n_words array<long>, codes binary, hashes binary, counts binary, trained long, pieces binary, piece_counts binary"


# Subwords.


class Subwords:
    """Subword ids of distinct words, many at once: their text is encoded together and cut at the word ends again."""

    def __init__(self, path: str = TOKENIZER):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(VOCAB, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, each behind a space, and how many each has."""
        ids, counts = [np.zeros(0, np.uint16)], []
        for s in range(0, len(words), 4_096):
            part = words[s : s + 4_096]
            got = np.array(self.encoding.encode_ordinary((b" " + b" ".join(part)).decode()), np.uint16)
            ends = np.cumsum([len(w) + 1 for w in part])
            at = np.cumsum(self.length[got])
            cut = np.searchsorted(at, ends)
            if not np.array_equal(at[cut], ends):  # a piece spans two words: take them one by one
                each = [np.array(self.encoding.encode_ordinary(" " + w.decode()), np.uint16) for w in part]
                got, cut = np.concatenate(each), np.cumsum([len(x) for x in each]) - 1
            ids.append(got)
            counts.append(np.diff(cut, prepend=-1))
        return np.concatenate(ids), np.concatenate(counts) if counts else np.zeros(0, np.int64)


def pack(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x), codec="zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def expand(codes: np.ndarray, pieces: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subword ids of words given by code, and how many each has."""
    begins = np.cumsum(counts) - counts
    n = counts[codes]
    at = np.repeat(begins[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return pieces[at], n


def streams(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of documents that lie end to end in ids, each with its end token: (inputs, where each begins, where each target is).

    A document of n tokens has NEW times BEFORE, then START and its first n - 1 tokens, filled up to a multiple of NEW with
    BEFORE. The input at i predicts the token after it, and the stream is one row for each NEW inputs."""
    room = NEW + -(-lengths // NEW) * NEW
    begins = np.cumsum(room) - room
    out = np.full(int(room.sum()), BEFORE, np.int32)
    firsts = np.cumsum(lengths) - lengths
    at = np.repeat(begins + NEW - firsts, lengths) + np.arange(len(ids))  # of the input that predicts each token
    out[begins + NEW] = START
    inner = np.ones(len(ids), bool)
    inner[firsts + lengths - 1] = False  # an end is no input
    out[at[inner] + 1] = ids[inner]
    return out, begins, at


def with_ends(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds the end token to each document."""
    return np.insert(ids.astype(np.int32), np.cumsum(lengths), END), lengths + 1


# Segments.


def segment_row(segment: int, ids: list, held: list, texts: pa.Array, subwords: Subwords) -> dict:
    words, n_words = words_of(texts, SPACE_BYTES)
    n_words, held = np.asarray(n_words, np.int64), np.array(held, bool)
    coded = words.dictionary_encode()
    codes, distinct = np.asarray(coded.indices, np.int32), listed(coded.dictionary)
    if b"\xff" in words.buffers()[2].to_pybytes():
        distinct = [w.replace(b"\xff", b"\0") for w in distinct]
    trained = np.bincount(codes[np.repeat(~held, n_words)], minlength=len(distinct)).astype(np.int32)
    pieces, counts = subwords.encode(distinct)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return {"segment": segment, "doc_ids": ids, "held": held, "n_words": n_words, "codes": pack(codes), "hashes": pack(hashes), "counts": pack(trained), "trained": int(trained.sum()), "pieces": pack(pieces), "piece_counts": pack(counts.astype(np.uint16))}


def listed(words: pa.LargeBinaryArray) -> list[bytes]:
    """The words, which hold no space, as Python objects: all at once, not one by one."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.insert(data, offsets[1:-1] - offsets[0], 0x20).tobytes().split(b" ") if len(words) else []


def tokens_of(r: dict, held: bool | None = False, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and lengths of a segment's documents, of those that train (held: False) or all (None)."""
    codes, n_words, out = unpack(r["codes"], np.int32), np.asarray(r["n_words"], np.int64), np.asarray(r["held"], bool)
    if held is not None:
        codes, n_words = codes[np.repeat(out == held, n_words)], n_words[out == held]
    return documents(codes, n_words, unpack(r["pieces"], np.uint16), unpack(r["piece_counts"], np.uint16).astype(np.int64), most)


def training_stream(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets (NONE where there is none) of all training documents of a segment, in rows of NEW. A window is two
    neighbouring rows of inputs and the targets of the second."""
    inputs, targets = [np.zeros((0, NEW), np.uint16)], [np.zeros((0, NEW), np.uint16)]
    for tokens, lengths in tokens_of(r):
        own, _, at = streams(tokens, lengths)
        wanted = np.full(len(own), NONE, np.uint16)
        wanted[at] = tokens
        inputs.append(own.astype(np.uint16).reshape(-1, NEW))
        targets.append(wanted.reshape(-1, NEW))
    return np.concatenate(inputs), np.concatenate(targets)


def documents(codes: np.ndarray, n_words: np.ndarray, pieces: np.ndarray, counts: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and lengths of documents, some hundred thousand words at a time."""
    ends = np.cumsum(n_words)
    a = 0
    while a < len(n_words):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + most, "right")))
        ids, n = expand(codes[before : ends[b - 1]], pieces, counts)
        lengths = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends[a:b] - before])])
        yield with_ends(ids, lengths)
        a = b


def segments_of(docs: DataFrame, tokenizer: str, segment_bytes: int) -> DataFrame:
    small_batches(docs.sparkSession)
    kind = pa.schema([("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_words", pa.list_(pa.int64())), ("codes", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary()), ("trained", pa.int64()), ("pieces", pa.binary()), ("piece_counts", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, now = Subwords(tokenizer), None
        ids, held, texts = [], [], []

        def row() -> pa.RecordBatch:
            s = segment_row(now, ids, held, pa.concat_arrays(texts), subwords)
            return pa.RecordBatch.from_arrays([pa.array([s[f.name]], f.type) for f in kind], schema=kind)

        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(own, prepend=own[:1] - 1))
            for a, b in zip(cuts, np.append(cuts[1:], len(own)), strict=True):
                if ids and own[a] != now:
                    yield row()
                    ids, held, texts = [], [], []
                now = int(own[a])
                ids += batch.column(1)[a:b].to_pylist()
                held += batch.column(2)[a:b].to_pylist()
                texts.append(batch.column(3)[a:b].cast(pa.large_string()))
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 7, 2).alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    n = -(-(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 1) // segment_bytes)
    own = F.xxhash64("doc_id", "text")
    dealt = rows.withColumn("segment", F.pmod(own, F.lit(n)).cast("int")).withColumn("_own", own)
    dealt = dealt.repartitionById(min(n, MOST_SHARDS), F.pmod("segment", F.lit(min(n, MOST_SHARDS)))).sortWithinPartitions("segment", "doc_id", "_own")
    return dealt.select("segment", "doc_id", "held", "text").mapInArrow(write, SEGMENTS)


# The model.


def abreast(x: np.ndarray, f: np.ufunc, row: np.ndarray) -> None:
    """f(x, row) for each row of x, in place. A row repeated until it is long spares numpy a short loop for each."""
    many = math.gcd(len(x), NEW)
    f(x.reshape(len(x) // many, -1), np.tile(row, many), out=x.reshape(len(x) // many, -1))


class Model:
    """class_of: the class of each subword; log_in: its log probability within the class, by the kind of subword before it; row_of:
    the embedding row of each input."""

    def __init__(self, counts: np.ndarray, left: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.class_of = classes_of(counts, left)
        size = np.bincount(self.class_of, counts + 1.0, CLASSES)
        alone = (counts + 1.0) / size[self.class_of]
        after = np.stack([np.bincount(self.class_of, left[:, k], CLASSES) for k in range(LEFT)], axis=1)
        self.log_in = np.log((left + PRIOR * alone[:, None]) / (after + PRIOR)[self.class_of]).astype(np.float32)
        rank = np.argsort(-counts, kind="stable")
        self.row_of = np.concatenate([OWN_ROWS + self.class_of, [OWN_ROWS + CLASSES, OWN_ROWS + CLASSES + 1]]).astype(np.int32)
        self.row_of[rank[:OWN_ROWS]] = np.arange(OWN_ROWS)
        self.has = np.bincount(self.class_of, minlength=CLASSES) > 0
        normal = lambda *s, by=1.0: rng.normal(0, by, s)
        self.p = {"E": normal(OWN_ROWS + CLASSES + 2, DIM, by=0.3), "Q": normal(DIM, DIM, by=0.25), "K": normal(DIM, DIM, by=0.25), "V": normal(DIM, DIM, by=0.25), "R": np.zeros((NEW, WIDE)), "H": normal(2 * DIM, HIDDEN, by=0.2), "h": np.zeros(HIDDEN), "O": normal(HIDDEN, CLASSES, by=0.1)}
        share = np.log(np.maximum(size, 1e-3) / size.sum())
        self.p["o"] = share - share.mean()
        self.shapes = {k: v.shape for k, v in self.p.items()}
        self.take(np.concatenate([v.ravel() for v in self.p.values()]))
        self.cells = np.arange(self.p["E"].size).reshape(-1, DIM)
        ahead = np.arange(WIDE)[None] > NEW + np.arange(NEW)[:, None]
        self.mask = np.where(ahead, 0, 1).astype(np.float32)

    def take(self, flat: np.ndarray) -> Model:
        """The weights, as views of one array."""
        self.flat, at = flat.astype(np.float32), 0
        for k, shape in self.shapes.items():
            size = int(np.prod(shape))
            self.p[k] = self.flat[at : at + size].reshape(shape)
            at += size
        return self

    def copy(self) -> Model:
        out = Model.__new__(Model)
        out.__dict__ |= self.__dict__ | {"p": {}}
        return out.take(self.flat)

    def score(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural-log probabilities of the tokens of documents that lie end to end."""
        p = self.p
        inputs, begins, at = streams(tokens, lengths)
        rows = self.row_of[inputs]
        queries, direct = p["E"] @ (p["Q"] @ p["K"].T * SCALE), p["E"] @ p["H"][DIM:] + p["h"]
        mixed = p["V"] @ p["H"][:DIM]
        target = np.zeros(len(inputs), np.int32)
        target[at] = self.class_of[tokens]
        out = np.empty(len(inputs), np.float32)
        bias = p["R"]
        last = len(inputs) // NEW
        nought, spots = np.zeros(HIDDEN, np.float32), np.arange(0, BATCH * NEW * CLASSES, CLASSES)
        every, ones = np.ones((WIDE, 1), np.float32), np.ones((CLASSES, 1), np.float32) * self.has[:, None]
        for s in range(1, last, BATCH):
            e = min(last, s + BATCH)
            own = rows[(s - 1) * NEW : e * NEW]
            x = p["E"].take(own, axis=0)
            n = e - s
            seen = np.lib.stride_tricks.as_strided(x, (n, WIDE, DIM), (NEW * x.strides[0], *x.strides))
            a = queries.take(own[NEW:], axis=0).reshape(n, NEW, DIM) @ seen.swapaxes(1, 2)
            a += bias
            np.clip(a, -20, 20, out=a)
            np.exp(a, out=a)
            a *= self.mask
            c = (a @ seen).reshape(n * NEW, DIM)
            c /= a.reshape(n * NEW, WIDE) @ every
            hidden = c @ mixed
            hidden += direct.take(own[NEW:], axis=0)
            abreast(hidden, np.maximum, nought)
            logits = hidden @ p["O"]
            abreast(logits, np.add, p["o"])
            np.clip(logits, -20, 20, out=logits)
            picked = logits.ravel().take(spots[: n * NEW] + target[s * NEW : e * NEW])
            np.exp(logits, out=logits)
            out[s * NEW : e * NEW] = picked - np.log((logits @ ones)[:, 0])
        return out[at] + self.log_in[tokens, kinds_before(tokens, lengths)]

    def loss(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, dict]:
        """Mean loss over the classes of runs of windows, and its gradient. inputs: (runs, windows + 1, NEW), as neighbouring windows
        share a row; targets: (runs, windows, NEW), or NONE. Q with K, and V with the part of H that reads it, are multiplied before
        any token is, so attention meets the embeddings themselves; it is divided by its sum only after that."""
        p = self.p
        runs, n = targets.shape[:2]
        rows = self.row_of.take(inputs.ravel())
        wanted = targets.ravel()
        live = (wanted != NONE).astype(np.float32)
        spot = np.arange(0, len(wanted) * CLASSES, CLASSES) + self.class_of.take(wanted, mode="clip")
        one = np.ones((1, len(wanted)), np.float32)
        upper, lower = p["H"][:DIM], p["H"][DIM:]
        asked, into = p["Q"] @ p["K"].T * SCALE, np.concatenate([p["V"] @ upper, lower])
        x = p["E"].take(rows, axis=0).reshape(runs, n + 1, NEW, DIM)
        z = np.empty((len(wanted), 2 * DIM), x.dtype)  # what attention gives, then the input itself
        c, own = z[:, :DIM], z[:, DIM:]
        own.reshape(runs, n, NEW, DIM)[:] = x[:, 1:]
        seen = np.lib.stride_tricks.as_strided(x, (runs, n, WIDE, DIM), x.strides)
        across = seen.swapaxes(2, 3)
        both = np.empty((runs, n, 2 * NEW, DIM), x.dtype)  # queries, then the gradient of what attention gives
        both[:, :, :NEW] = (own @ asked).reshape(runs, n, NEW, DIM)
        weights = np.empty((runs, n, 2 * NEW, WIDE), x.dtype)  # the gradient of attention, then attention
        a = both[:, :, :NEW] @ across
        a += p["R"]
        np.clip(a, -20, 20, out=a)
        np.exp(a, out=a)
        a *= self.mask
        weights[:, :, NEW:] = a
        over = 1 / (a.reshape(-1, WIDE) @ np.ones((WIDE, 1), np.float32))
        np.multiply((a @ seen).reshape(-1, DIM), over, out=c)
        hidden = z @ into
        abreast(hidden, np.add, p["h"])
        abreast(hidden, np.maximum, np.zeros_like(p["h"]))
        d = hidden @ p["O"]
        abreast(d, np.add, p["o"])
        np.clip(d, -20, 20, out=d)
        np.exp(d, out=d)
        if not self.has.all():
            d *= self.has
        total = max(1.0, float(live.sum()))
        sums = (d @ np.ones((CLASSES, 1), np.float32))[:, 0]
        loss = -float((np.log(d.ravel().take(spot) / sums) * live).sum()) / total
        d *= (live / (total * sums))[:, None]
        d.ravel()[spot] -= live / total
        g = {"O": hidden.T @ d, "o": (one @ d)[0]}
        dh = d @ p["O"].T
        dh *= hidden > 0
        g["h"] = (one @ dh)[0]
        dz = dh @ into.T
        dc = dz[:, :DIM] * over
        both[:, :, NEW:] = dc.reshape(runs, n, NEW, DIM)
        ds = (both[:, :, NEW:] @ across).reshape(-1, WIDE)
        dc *= c
        ds -= dc @ np.ones((DIM, 1), np.float32)
        ds = ds.reshape(runs, n, NEW, WIDE)
        ds *= a
        weights[:, :, :NEW] = ds
        g["R"] = (one[:, : runs * n] @ ds.reshape(runs * n, -1)).reshape(NEW, WIDE)
        dq = (ds @ seen).reshape(-1, DIM)
        part = weights.swapaxes(2, 3) @ both
        dx = np.empty_like(x)  # a row of inputs is in two windows
        dx[:, 0], dx[:, -1] = part[:, 0, :NEW], part[:, -1, NEW:]
        np.add(part[:, 1:, :NEW], part[:, :-1, NEW:], out=dx[:, 1:-1])
        direct = dq @ asked.T
        direct += dz[:, DIM:]
        dx[:, 1:] += direct.reshape(runs, n, NEW, DIM)
        asking, mixing = own.T @ dq * SCALE, z.T @ dh
        g["Q"], g["K"], g["V"] = asking @ p["K"], asking.T @ p["Q"], mixing[:DIM] @ upper.T
        g["H"] = np.concatenate([p["V"].T @ mixing[:DIM], mixing[DIM:]])
        g["E"] = np.bincount(self.cells.take(rows, axis=0).ravel(), dx.ravel(), p["E"].size).reshape(-1, DIM)
        return loss, g

    def fit(self, inputs: np.ndarray, targets: np.ndarray, rate: float, every: int = 1, seed: int = 3) -> tuple[int, float]:
        """One pass of Adam over every so many-th run of the stream: the windows taken, and the loss of the last steps."""
        n = -(-max(0, len(inputs) - 1) // RUN)
        fill = ((0, n * RUN + 1 - len(inputs)), (0, 0)) if n else ((0, 0), (0, 0))
        inputs, targets = np.pad(inputs, fill, constant_values=BEFORE), np.pad(targets, fill, constant_values=NONE)
        rng = np.random.default_rng(seed)
        order = rng.permutation(n)[: -(-n // every)]
        size = int(np.clip(len(order) // 200, 1, RUNS))
        first, second, flat, step = (np.zeros_like(self.flat) for _ in range(4))
        losses, steps = [], -(-len(order) // size)
        for t in range(1, steps + 1):
            at = order[(t - 1) * size : t * size, None] * RUN + np.arange(RUN + 1)
            loss, g = self.loss(inputs[at], targets[at[:, 1:]])
            losses.append(loss)
            np.concatenate([g[k].ravel() for k in self.shapes], out=flat, casting="same_kind")
            first *= 0.9
            first += np.multiply(flat, 0.1, out=step)
            second *= 0.99
            second += np.multiply(np.multiply(flat, flat, out=flat), 0.01, out=flat)
            np.sqrt(np.multiply(second, 1 / (1 - 0.99**t), out=step), out=step)
            step += 1e-7
            np.divide(first, step, out=step)
            step *= rate * (1 - 0.8 * t / steps) / (1 - 0.9**t)
            self.flat -= step
        return len(order) * RUN, float(np.mean(losses[-20:])) if losses else 0.0


def classes_of(counts: np.ndarray, left: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Clusters subwords by what stands before them, more finely where they are frequent (k-means, weighed by count)."""
    if not counts.sum():
        return (np.arange(VOCAB) % CLASSES).astype(np.int32)
    share = np.sqrt((left + left.sum(0) / left.sum()) / (left.sum(1, keepdims=True) + 1)).astype(np.float32)
    common = np.argsort(-counts, kind="stable")
    centres = share[common[:CLASSES]].copy()
    for _ in range(rounds):
        own = (share @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        for c in range(CLASSES):
            if (weight := counts[own == c]).sum():
                centres[c] = np.average(share[own == c], axis=0, weights=weight)
    return own.astype(np.int32)


def kinds_before(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The kind of the subword before each token, from its id; the last kind is the start of a document."""
    kinds = np.roll(tokens, 1).astype(np.int64) * 40_503 // 64 % (LEFT - 1)
    kinds[np.cumsum(lengths) - lengths] = LEFT - 1
    return kinds


def tree_sum(segments: DataFrame, each: Callable[[dict], np.ndarray | None], kind: type, work: Work) -> np.ndarray | None:
    """The sum of each(segment) over all segments, None where there is none. Arrays of one size are summed in a tree of nodes with up to
    FAN arrays, in the order of the segments; only the sum comes to the driver."""
    rows = "node long, data binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                got = each({n: batch.column(n)[i].as_py() for n in batch.schema.names})
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("segment")[i].as_py()], pa.int64()), pa.array([pack(got.astype(kind))], pa.binary())], names=["node", "data"])

    def sum_of(nodes: pa.Table) -> pa.Table:
        total = None
        for i in np.argsort(nodes.column("node").to_numpy()):
            own = unpack(nodes.column("data")[int(i)].as_py(), kind)
            total = own.copy() if total is None else np.add(total, own, out=total)
        return pa.table([pa.array([nodes.column("node")[0].as_py() // FAN], pa.int64()), pa.array([pack(total)], pa.binary())], names=["node", "data"])

    columns = [c for c in ("segment", "held", "n_words", "codes", "pieces", "piece_counts")]
    now = work.store(segments.select(*columns).mapInArrow(first, rows), "sums")
    while True:
        n = now.agg(F.count("*"), F.max("node")).first()
        if n[0] == 0 or n[0] == 1:
            out = now.first()
            work.drop(now)
            return unpack(out["data"], kind).copy() if out else None
        after = work.store(now.groupBy(F.expr(f"node div {FAN}").alias("up")).applyInArrow(lambda t: sum_of(t), rows), "sums")
        work.drop(now)
        now = after


def gather(segments: DataFrame, work: Work) -> tuple[np.ndarray, np.ndarray]:
    """Of each subword in all training documents its count and how often each of LEFT kinds of subword stands before it. The result's
    size is that of the vocabulary."""

    def count(r: dict) -> np.ndarray:
        total = np.zeros(VOCAB * LEFT, np.int64)
        for tokens, lengths in tokens_of(r, most=2_000_000):
            total += np.bincount(tokens.astype(np.int64) * LEFT + kinds_before(tokens, lengths), minlength=VOCAB * LEFT)
        return total

    total = tree_sum(segments, count, np.int64, work)
    left = (np.zeros(VOCAB * LEFT) if total is None else total).reshape(VOCAB, LEFT).astype(np.float64)
    return left.sum(1), left


def train(segments: DataFrame, work: Work, rates: tuple[float, ...] = RATES, warm: int = WARM) -> Model:
    model = Model(*gather(segments, work))
    for i, rate in enumerate(rates):
        sent = segments.sparkSession.sparkContext.broadcast(model)

        def fit(r: dict, i: int = i, rate: float = rate, sent=sent) -> np.ndarray | None:  # noqa: ANN001
            local = sent.value.copy()
            windows, _ = local.fit(*training_stream(r), rate, warm if i == 0 else 1)
            return np.append(local.flat.astype(np.float64) * windows, windows) if windows else None

        total = tree_sum(segments, fit, np.float64, work)
        if total is None:
            break
        model.take(total[:-1] / total[-1])
    return model


# Base counts and the scores.


def word_counts(segments: DataFrame, work: Work) -> tuple[DataFrame, int]:
    """For each segment the counts, over all training documents, of its words, (segment, c) with c packed in the order of their hashes, and
    the number of different words with a count. Segments send their words, each once, as blocks to parts of the range of hashes; a part adds up
    what all segments have, and sends each of them its blocks of totals."""
    parts = -(-segments.count() // PART) or 1
    kind = pa.schema([("segment", pa.int32()), ("part", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, counts = unpack(batch.column(1)[i].as_py(), np.uint64), unpack(batch.column(2)[i].as_py(), np.int32)
                order = np.argsort(hashes)
                hashes, counts = hashes[order], counts[order]
                cuts = np.searchsorted(hashes, np.array([(p << 64) // parts for p in range(parts)], np.uint64)).tolist()
                for part, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(hashes)], strict=True)):
                    if a < b:
                        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((batch.column(0)[i].as_py(), part, pack(hashes[a:b]), pack(counts[a:b])), kind, strict=True)], schema=kind)

    def add(blocks: pa.Table) -> pa.Table:
        hashes, counts = ([unpack(x.as_py(), k) for x in blocks.column(name)] for name, k in (("hashes", np.uint64), ("counts", np.int32)))
        words, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(words)).astype(np.int64)
        cuts = np.cumsum([len(x) for x in hashes])
        c = [pack(total[x]) for x in np.split(at, cuts[:-1])]
        known = np.zeros(len(c), np.int64)
        known[0] = (total > 0).sum()
        return pa.table([blocks.column("segment"), blocks.column("part"), pa.array(c, pa.binary()), pa.array(known)], names=["segment", "part", "c", "known"])

    def join(blocks: pa.Table) -> pa.Table:
        c = [unpack(blocks.column("c")[int(i)].as_py(), np.int64) for i in np.argsort(blocks.column("part").to_numpy())]
        return pa.table([blocks.column("segment")[:1], pa.array([pack(np.concatenate(c))], pa.binary())], names=["segment", "c"])

    blocks = segments.select("segment", "hashes", "counts").mapInArrow(split, "segment int, part int, hashes binary, counts binary")
    totals = work.store(blocks.groupBy("part").applyInArrow(lambda t: add(t), "segment int, part int, c binary, known long"), "totals")
    return work.store(totals.groupBy("segment").applyInArrow(lambda t: join(t), "segment int, c binary"), "counts"), totals.agg(F.sum("known")).first()[0] or 0


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, tokenizer: str = TOKENIZER, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Base and model scores of docs(doc_id, text), both learned from all rows that are not held out."""
    spark = docs.sparkSession
    work = Work(spark)
    segments = work.store(segments_of(docs, tokenizer, segment_bytes), "segments")
    counts, distinct = word_counts(segments, work)
    sums = segments.agg(F.sum(F.size(F.filter("held", lambda h: ~h))), F.sum("trained")).first()
    ends = sums[0] or 0
    everything = ends + (sums[1] or 0)
    distinct += ends > 0
    model = spark.sparkContext.broadcast(train(segments, work))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                n_words, codes = np.array(r["n_words"], np.int64), unpack(r["codes"], np.int32)
                c = np.zeros(len(hashes := unpack(r["hashes"], np.uint64)), np.int64)
                if len(c):
                    c[np.argsort(hashes)] = unpack(r["c"], np.int64)
                logs = np.log10((c + 1) / (everything + (distinct + 1)))
                cuts = np.concatenate([[0], np.cumsum(n_words)])
                summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[cuts])  # noqa: B023, E731
                base = summed(logs[codes]) + np.log10((ends + 1) / (everything + (distinct + 1)))
                scores = []
                for tokens, lengths in tokens_of(r, None, 50_000):
                    got = model.value.score(tokens, lengths).astype(np.float64)
                    scores.append(np.add.reduceat(got, np.cumsum(lengths) - lengths) / np.log(10))
                n = len(n_words)
                known = summed((c > 0)[codes].astype(np.int64)) + (ends > 0)
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(r["held"]), pa.array(n_words + 1), pa.array(known.astype(np.int64)), pa.array(np.full(n, everything, np.int64)), pa.array(base, pa.float64()), pa.array(np.concatenate(scores), pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = segments.select("segment", "doc_ids", "held", "n_words", "codes", "hashes", "pieces", "piece_counts").join(counts, "segment", "left")
    return rows.drop("segment").mapInArrow(score, SCORES)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
