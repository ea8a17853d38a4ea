"""Crawl results that arrive as files, upserted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY = ["project_id", "url"]
#: So many parts of one level are merged into one of the next.
FAN = 16


def last_results(rows: DataFrame) -> DataFrame:
    """The result of each page with the largest seq (null is the least). Applying it to parts and then to their union changes nothing, in any order."""
    rest = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.coalesce(F.col("seq"), F.lit(-1 << 63))).alias("r")).select(*KEY, "r.*").select(rows.columns)


class Pages:
    """The pages below a path, as parts that hold results of some batches each: a batch adds a part of its own rows, and nothing else is written until
    FAN parts of a level are merged. A result is written about once for each level, of which there are as many as the logarithm of the batches to the base
    FAN. Parts may overlap, as the results' seq decides, so a batch or a merge that runs again after a failure, and late or repeated results, do no harm. One writer
    at a time; a merge removes parts that frames of an earlier `read` still need."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def _at(self, *names: str):  # noqa: ANN202
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def parts(self) -> list[tuple[int, int]]:
        """(level, last batch) of the parts that were written to their end."""
        fs, at = self._at()
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        done = [n for n in names if n[0] == "l" and fs.exists(self._at(n, "_SUCCESS")[1])]
        return sorted(tuple(map(int, n[1:].split("-"))) for n in done)

    def _rows(self, parts: list[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.path}/l{level}-{number}" for level, number in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The pages, without seq."""
        return last_results(self._rows(self.parts())).drop("seq")

    def add(self, batch: DataFrame, number: int) -> None:
        last_results(batch.select(self.schema.names)).write.mode("overwrite").parquet(f"{self.path}/l0-{number}")
        level = 0
        while len(full := [p for p in self.parts() if p[0] == level]) >= FAN:
            last_results(self._rows(full)).write.mode("overwrite").parquet(f"{self.path}/l{level + 1}-{full[-1][1]}")
            for own, last in full:
                fs, at = self._at(f"l{own}-{last}")
                fs.delete(at, True)
            level += 1


def stream_upsert_pages(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, files_per_batch: int = 1) -> DataFrame:
    """Takes what is new below source (Parquet with project_id, url, seq and page columns) and returns the pages after it: the result with the largest
    seq replaces all columns of a page, whatever batch it comes in."""
    pages = Pages(spark, target, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(pages.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return pages.read()
