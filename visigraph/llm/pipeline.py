"""From raw documents to a training mix, in stages that each read what the one before has written.

Each stage takes (spark, docs, sf_dir) and works on all its docs; all but the last return the columns of documents, as they were but for what
the stage says. Rows that repeat stay or go together, but for near-duplicates, of which one stays; an empty table gives no rows. Columns
whose names begin with `_op` are the operators' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, decontaminate, dedup, mix, pii
from .common import remove, scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the classifier's threshold; it learns from the labelled ones that are not held out. A null text has
    the score of an empty one; a column `score` of docs stays as it is."""
    network = classifier.train(docs, table(spark, sf_dir, "labels"))
    return classifier.score_rows(docs, network, "_op4_score").where(F.col("_op4_score") >= classifier.THRESHOLD).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of the smallest doc_id; null texts are empty, and one empty text stays."""
    return dedup.keep_one(docs).select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; a null text has none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it become labels; n_chars follows. A null text stays null, with null for n_chars; columns
    `base` and `spans` of docs stay as they are."""
    own = {c: f"_op7_own_{c}" for c in ("base", "spans") if c in docs.columns}
    clean = pii.sanitise(pii.find(docs.withColumnsRenamed(own))).drop("base", "spans").withColumnsRenamed({b: a for a, b in own.items()})
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, with what the mix decided; a document that it takes no times has none."""
    return mix.emit(mix.mix(docs))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("pii", sanitise),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(out := scratch(spark, f"stage-{name}"))
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs
