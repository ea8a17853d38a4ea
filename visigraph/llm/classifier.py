"""Operator 4: a quality classifier, a byte-level convolutional network in numpy.

A text's UTF-8 bytes, each an embedded symbol, are covered by chunks of 16 bytes that overlap by half. A symbol is the byte and
whether the four bytes that end there also end 2 to 32 bytes before, as a filter alone can't see that a chunk repeats. Learned
filters score each chunk, the largest score of each filter over the whole text is kept, and a small layer combines those
into one probability. Training sees a bounded sample of labelled rows (TRAIN_ROWS rows of TRAIN_BYTES at most,
chosen by a hash of their doc_id); scoring sees whole texts, long ones piece by piece.

Defined results: null text is empty, and an empty text is one chunk of padding with a score like any other; labels that
are null, or of documents that are not in the table, are ignored, and of labels that repeat a doc_id the smaller holds; without
labelled rows of both kinds every score is the share of label 1 (0.5 without any); rows that repeat stay; an empty
table gives no rows; `score_rows` keeps other columns, and its own replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import small_batches, table, text_bytes

TRAIN_ROWS = 6_000
TRAIN_BYTES = 16_384
HALF = 8
PAD = 512
LAGS = range(2, 33)
DIM = 8
FILTERS = 32
HIDDEN = 16
#: Passes over the sample, more where it is so small that they would be fewer steps than this.
EPOCHS = 5
LEAST_STEPS = 500
THRESHOLD = 0.3
#: Half chunks that are scored at a time.
PIECE = 16_384


def held_out(doc_id: Column, of: int = 5, is_: int = 0) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of)) == is_


def symbols(data: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Bytes, plus 256 where the last four occurred a little before. before: bytes that come first, if these are a later piece."""
    out = data.astype(np.int32)
    whole = data if before is None else np.concatenate([before, data])
    if len(whole) < 6:
        return out
    four = whole[3:].astype(np.uint32)
    for i in range(3):
        four |= whole[i : i - 3].astype(np.uint32) << np.uint32(8 * (i + 1))
    again = np.zeros(len(four), bool)
    for lag in LAGS:
        if lag < len(four):
            again[lag:] |= four[lag:] == four[:-lag]
    out[max(0, len(data) - len(four)) :] += 256 * again[max(0, len(four) - len(data)) :]
    return out


def halves(data: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The symbols of a text as rows of HALF, at least two; a chunk is two neighbouring rows."""
    n = max(2, -(-len(data) // HALF))
    out = np.full(n * HALF, PAD, np.int32)
    out[: len(data)] = symbols(data, before)
    return out.reshape(n, HALF)


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        n = HALF * DIM
        self.p = {
            "E": r.normal(0, 0.5, (PAD + 1, DIM)), "A": r.normal(0, 1 / np.sqrt(2 * n), (n, FILTERS)), "B": r.normal(0, 1 / np.sqrt(2 * n), (n, FILTERS)), "c": np.zeros(FILTERS),
            "H": r.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)), "h": np.zeros(HIDDEN), "o": r.normal(0, 0.1, HIDDEN), "b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.constant: float | None = None

    def pooled(self, rows: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """The largest score of each filter, by text; firsts: where the texts begin in rows."""
        p, x = self.p, self.p["E"][rows].reshape(len(rows), -1)
        chunk = x @ p["A"]
        chunk[:-1] += (x @ p["B"])[1:]
        # the row that begins at a text's last half is no chunk, and ends its range
        bounds = np.column_stack([firsts, np.append(firsts[1:], len(rows)) - 1]).ravel()
        return np.maximum.reduceat(chunk, bounds)[::2] + p["c"]

    def head(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(np.tanh(m) @ self.p["H"] + self.p["h"], 0)
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.p["o"] + self.p["b"], -30, 30)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of texts that lie end to end in data."""
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        out, group, size = np.zeros((len(offsets) - 1, FILTERS), np.float32), [], 0

        def flush() -> None:
            nonlocal group, size
            if group:
                out[[i for i, _ in group]] = self.pooled(np.concatenate([x for _, x in group]), np.cumsum([0, *(len(x) for _, x in group[:-1])]))
            group, size = [], 0

        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            if b - a > PIECE * HALF:
                step = (PIECE - 1) * HALF
                parts = [self.pooled(halves(data[s : min(b, s + PIECE * HALF)], data[max(a, s - 64) : s]), np.zeros(1, np.int64)) for s in range(a, b - HALF, step)]
                out[i] = np.max(np.concatenate(parts), axis=0)
                continue
            group.append((i, halves(data[a:b])))
            size += len(group[-1][1])
            if size >= PIECE:
                flush()
        flush()
        return self.head(out)[1].astype(np.float64)

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 3e-3, seed: int = 7) -> Network:
        """Adam on the log loss; a filter learns from the one chunk that it scored highest in each text."""
        labels = np.asarray(labels, np.float32)
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        rng, p = np.random.default_rng(seed), self.p
        first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        t = 0
        rows = [halves(np.frombuffer(x, np.uint8)) for x in texts]
        epochs = max(epochs, -(-LEAST_STEPS * batch // len(rows)))
        total = epochs * -(-len(rows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for s in range(0, len(rows), batch):
                picked = order[s : s + batch]
                n, y = len(picked), labels[picked]
                best = np.zeros((n, FILTERS), np.float32)
                won = np.zeros((n, FILTERS, 2 * HALF), np.int32)
                for i, k in enumerate(picked):
                    x = p["E"][rows[k]].reshape(len(rows[k]), -1)
                    chunk = (x @ p["A"])[:-1] + (x @ p["B"])[1:]
                    at = chunk.argmax(axis=0)
                    best[i] = chunk[at, np.arange(FILTERS)]
                    won[i] = np.concatenate([rows[k][at], rows[k][at + 1]], axis=1)
                m = best + p["c"]
                squashed = np.tanh(m)
                hidden, prob = self.head(m)
                d = (prob - y).astype(np.float32) / n
                g = {"o": hidden.T @ d, "b": np.array([d.sum()], np.float32)}
                dh = np.outer(d, p["o"]) * (hidden > 0)
                g["H"], g["h"] = squashed.T @ dh, dh.sum(0)
                dm = (dh @ p["H"].T) * (1 - squashed**2)
                g["c"] = dm.sum(0)
                x = p["E"][won].reshape(n, FILTERS, -1)
                dw = np.einsum("nf,nfd->df", dm, x)
                g["A"], g["B"] = dw[: HALF * DIM], dw[HALF * DIM :]
                dx = dm[:, :, None] * np.concatenate([p["A"], p["B"]]).T[None]
                g["E"] = np.zeros_like(p["E"])
                np.add.at(g["E"], won.ravel(), dx.reshape(-1, DIM))
                t += 1
                step = rate * (1 - 0.9 * t / total)
                for k, v in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    p[k] -= (step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Network:
    """A network fitted to docs(doc_id, text) and labels(doc_id, quality), without held-out rows."""
    picked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)  # the bound of the broadcast side
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("_bytes")).where(F.octet_length("_bytes") <= train_bytes)
    # of rows that repeat a doc_id the smallest text, so there are no more than train_rows
    got = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_quality").agg(F.min("_bytes").alias("_bytes")).select("doc_id", "_bytes", "_quality").collect()
    got.sort(key=lambda r: r[0])
    return Network().fit([bytes(r[1]) for r in got], np.array([r[2] for r in got]))


def score_rows(docs: DataFrame, network: Network, name: str = "score") -> DataFrame:
    """docs with a column of that name: the probability that label 1 holds."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(*text_bytes(text)), pa.float64())], names=[*batch.schema.names, name])

    rows = docs.drop(name)
    return rows.mapInArrow(write, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def op4_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_rows(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
