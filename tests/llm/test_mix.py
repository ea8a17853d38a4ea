import pytest
from pyspark.sql import functions as F

from visigraph.llm import mix

from .edge import documents, nothing


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Excess shared again and again until no source is above its cap."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda x: (x is None, x or "")))}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = {s: w[s] for s in sizes if s not in capped}
        share = (total - sum(capped.values())) / sum(rest.values()) if rest else 0
        over = [s for s in rest if share * w[s] > cap * sizes[s]]
        if not over:
            return {s: capped.get(s, share * w[s]) for s in sizes}
        capped |= {s: cap * sizes[s] for s in over}


def test_edge_rows_as_sql(spark, same_as_sql):
    same_as_sql(mix.op1_mix, mix.SQL, documents=documents(spark))


def test_empty_table(spark):
    assert mix.mix(nothing(spark)).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 100, "c": 100}, {"a": 10}, {"a": 1, "b": 1, "c": 1, "d": 1000, None: 5}, {"x": 0, "y": 7}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r[0]: r[2] for r in mix.targets(rows).collect()}
    assert got == pytest.approx(fill(sizes))


def test_copies_follow_rate_and_reruns_agree(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("source"))
    one, two = mix.mix(docs), mix.mix(docs.repartition(7))
    assert one.select("doc_id", "copies").exceptAll(two.select("doc_id", "copies")).count() == 0
    for r in one.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("copies").alias("m")).collect():
        assert r.t == pytest.approx(r.g, rel=0.03) and r.m <= 3
    assert mix.emit(one).count() == one.agg(F.sum("copies")).first()[0]
