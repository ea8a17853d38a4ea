"""What the training-data operators share: tables, the shared folder, words as Arrow arrays, range shards."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast; beyond it operators shuffle instead.
BROADCAST_ROWS = 100_000
#: Rows of an Arrow batch: long texts must not pile up in a Python worker.
BATCH_ROWS = 1_000
#: And its bytes, for rows that are themselves large.
BATCH_BYTES = 32 << 20
#: Most shards that a table is dealt to by ranges; beyond it shards grow, and the driver's cut points don't.
MOST_SHARDS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and Spark runs in one process (tests), a new temporary one."""
    sc = spark.sparkContext
    if base := sc.getConf().get("spark.checkpoint.dir"):
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(base)
        return base.rstrip("/")
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a path of `scratch`."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Work:
    """Tables that a job writes for itself below the shared folder: they cut lineage, and go once they are spent."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame, name: str, partitions: int | None = None, codec: str = "snappy") -> DataFrame:
        """df, written and read again. Spark drops its shuffle files as soon as it is written."""
        path, cleanup = scratch(self.spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(cleanup, "false")
        self.spark.conf.set(cleanup, "true")
        try:
            (df.select("*") if partitions is None else df.coalesce(partitions)).write.parquet(path, compression=codec)
        finally:
            self.spark.conf.set(cleanup, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)  # holds out, so that no other frame gets its number
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, self.paths.pop(id(t))[1])


def text_slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text, of a row at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    part = (np.cumsum(size) - size) // limit
    cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ascii_lower(c: Column | str) -> Column:
    """A-Z only, as SQL's lower() also folds other letters."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffled(rows: DataFrame) -> DataFrame:
    """A side of a join that Spark never broadcasts: files of some MB may hold a million ids, which take a hundred MB and more of the driver."""
    return rows.hint("merge")


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int, salt: Column | None = None) -> DataFrame:
    """Join with a side of `rows` counted rows: broadcast up to BROADCAST_ROWS, else shuffled, whatever the size of its files lets Spark
    choose; with `salt` (an int column of big, 0 to 31) each key of big is spread over 32 tasks then."""
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    if salt is None:
        return big.join(shuffled(small), on, how)
    spread = small.withColumn("_op_salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return big.withColumn("_op_salt", salt).join(shuffled(spread), [*on, "_op_salt"], how).drop("_op_salt")


# Words of an Arrow string array without a Python loop over texts.

#: Maps a byte to its lower-case form (A-Z only), or to 0 where it separates words.
WORD_BYTES = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0 for b in range(256)], np.uint8)
SPACE_BYTES = np.array([b + 32 if 0x41 <= b <= 0x5A else 0 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256)], np.uint8)
#: NUL is no separator of SPACE_BYTES but stands for one above; it is kept as this byte, which UTF-8 never has.
SPACE_BYTES[0] = 0xFF


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes and the offsets of the texts (n + 1); null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, table: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of all texts in order, and the number of words of each text."""
    data, offsets = text_bytes(texts)
    mapped = table[data]
    keep = mapped != 0
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    start = keep.copy()
    start[1:] &= ~keep[:-1] | first[1:-1]
    at = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(at, offsets))
    before = np.cumsum(keep, dtype=np.int64)
    ends = np.concatenate([before[at] - 1, before[-1:] if len(before) else np.zeros(1, np.int64)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(mapped[keep])])
    return words, counts


def mixed(x: np.ndarray) -> np.ndarray:
    """A good 64-bit mix of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Deterministic range shards.


def range_cuts(df: DataFrame, key: str, shards: int) -> list[int]:
    """At most shards - 1 rising cut points of an integer key. They come from a sample of keys chosen by
    their hash, of about 100 keys a shard, so any run over the same rows gets the same cuts."""
    if shards <= 1:
        return []
    shards = min(shards, MOST_SHARDS)
    total = df.count()
    keep = max(1, total // (100 * shards))
    picked = df.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(keep)) == 0)).select(key).distinct()
    keys = np.sort(np.array([r[0] for r in picked.collect()], np.int64))
    if not len(keys):
        return []
    return sorted({int(keys[len(keys) * i // shards]) for i in range(1, shards)} - {int(keys[0])})
