"""Operator 3: a deterministic sharded WARC writer, and its reader.

Records are dealt by ranges of page_id to shards and sorted there; each shard is written as files of gzip members, one
for each record, that roll at a compressed size. Headers and digests are made anew from the payload. A file is written
under a temporary name and then renamed; the manifest, a table of the files, is committed last, and readers
open only files that it lists. A task that runs again writes the same bytes to the same names.

Of records with equal payloads of REVISIT_FROM bytes or more the one with the largest page_id is the response, and
the others are revisits of it without payload; a revisit keeps the payload's length and digest in its headers.

Defined results: null html is an empty payload; rows that repeat a page_id are records of their own, and those
with the largest page_id of a group are all responses; a null page_id comes first and has a record id without number; a null url
is an empty target; an empty table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, range_cuts, scratch, table

REVISIT_FROM = 1_000
#: Compressed bytes at which a file rolls, so that a shard has several files.
ROLL_BYTES = 4 << 20
#: Payload bytes that a shard is planned for.
SHARD_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, shard int, records long, bytes long, sha1 string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, valid boolean"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def write_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One gzip member. The url is written percent-free in UTF-8; line ends in it would break the header and become spaces."""
    digest = hashlib.sha1(payload).hexdigest()
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(url.splitlines())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def read_members(stream) -> Iterator[bytes]:
    """The records of an archive, one in memory at a time."""
    rest = b""
    while True:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if not rest and not (rest := stream.read(1 << 20)):
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(member.decompress(rest))
            rest = member.unused_data if member.eof else b""
        yield b"".join(parts)


def number(text: str) -> int | None:
    return int(text) if (text := text.removeprefix("<urn:x-page:").removesuffix(">")) else None


def read_record(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    valid = hashlib.sha1(block).hexdigest() == fields["WARC-Block-Digest"].removeprefix("sha1:") and (revisit or len(payload) == length and hashlib.sha1(payload).hexdigest() == digest)
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload, "valid": valid}


def shard_of(key: str, cuts: list[int]) -> Column:
    """The shard of an integer key: the number of cuts at or below it; null is 0."""
    points = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def place(keys):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.searchsorted(points, keys.fillna(np.iinfo(np.int64).min).to_numpy(np.int64), "right").astype(np.int32))

    return place(F.col(key).cast("long"))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the records that only refer to another. pages(page_id, digest, bytes)."""
    long = pages.where(F.col("bytes") >= REVISIT_FROM)
    last = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return long.join(last, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, out: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE) -> DataFrame:
    """Writes pages(page_id, url, html) below `out`, a folder that all executors reach, and returns the committed manifest."""
    from pyarrow import fs

    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    narrow = rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("bytes"))
    # all rows of an id go to one shard, so cuts are needed only as far as ids differ
    shards = max(1, -(-(narrow.agg(F.sum("bytes")).first()[0] or 0) // shard_bytes))
    cuts = range_cuts(rows.select("page_id"), "page_id", int(shards))
    none = F.lit(None)
    both = rows.select("page_id", "digest", none.cast("long").alias("refers_to"), "url", "payload").unionByName(revisits(narrow).select("page_id", "digest", "refers_to", none.cast("string").alias("url"), none.cast("binary").alias("payload")))
    # a revisit's reference comes just before the rows of its page and digest: no join carries the payloads
    dealt = both.withColumn("shard", shard_of("page_id", cuts)).repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", F.col("payload").isNotNull(), "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, base = fs.FileSystem.from_uri(out)
        store.create_dir(base, recursive=True)
        made, now, refers = [], {}, (None, None, None)

        def close() -> None:
            if now:
                now["stream"].close()
                store.move(now["temporary"], f"{base}/{now['file']}")
                made.append({"file": now["file"], "shard": now["shard"], "records": now["records"], "bytes": now["bytes"], "sha1": now["sha1"].hexdigest()})
                now.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                shard, page, digest, refer, url, body = (batch.column(n)[i].as_py() for n in ("shard", "page_id", "digest", "refers_to", "url", "payload"))
                if body is None:
                    refers = (page, digest, refer)
                    continue
                if now and (now["shard"] != shard or now["bytes"] >= roll_bytes):
                    close()
                if not now:
                    file = f"shard-{shard:06d}-{sum(x['shard'] == shard for x in made):05d}.warc.gz"
                    temporary = f"{base}/.{file}.{uuid.uuid4().hex}.tmp"
                    now.update(shard=shard, file=file, temporary=temporary, stream=store.open_output_stream(temporary, compression=None), records=0, bytes=0, sha1=hashlib.sha1())
                member = write_record(page, url, body, refers[2] if refers[:2] == (page, digest) else None, date)
                now["stream"].write(member)
                now["sha1"].update(member)
                now["records"] += 1
                now["bytes"] += len(member)
        close()
        yield pa.RecordBatch.from_pylist(made, pa.schema([("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/manifest")


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """The records of the files that the manifest below `out` lists; each file is read by one task, record by record."""
    from pyarrow import fs

    manifest = spark.read.parquet(f"{out}/manifest").select("shard", "file")
    files = manifest.agg(F.count("*")).first()[0]
    dealt = manifest.repartition(max(1, min(files, BROADCAST_ROWS)), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(out)
        kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("valid", pa.bool_())])
        for batch in batches:
            for file in batch.column(1).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for member in read_members(stream):
                        rows.append(read_record(member))
                        size += len(member)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, kind)

    return dealt.mapInArrow(read, READ)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), out)
    return read_archives(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to, true AS valid
FROM g
"""
