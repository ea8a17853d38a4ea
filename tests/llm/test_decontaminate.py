import random
import time
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visigraph.llm import decontaminate as d
from visigraph.llm.common import Work

from .edge import STORY, documents, nothing

ITEMS = [(1, STORY), (2, "one"), (3, None), (4, "..."), (5, "runs away INTO the"), (10, STORY + " and more words here"), (1, "lazy dog and"), (None, "quick brown fox"), (7, "a b a b a b a b a b a b")]


def benchmark(spark):
    return spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, doc_id string")


def test_edge_rows_as_sql(spark, same_as_sql):
    items = benchmark(spark).where("item_id IS NOT NULL")
    same_as_sql(d.op5_decontaminate, d.SQL, documents=documents(spark, [(20, "x a b a b a b a b a b a b a b y"), (21, STORY * 50)], repeat=False), benchmark=items)


def test_brute_force_and_small_segments_and_blocks(spark):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "d", "é"]
    texts = {i: " ".join(r.choices(words, k=r.randint(0, 120))) for i in range(150)}
    items = {i: " ".join(r.choices(words, k=r.choice([1, 3, 8, 10, 11]))) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = d.brute_force(texts, items)
    for size, block in ((1_000_000, 8 << 20), (300, 200)):
        queries = list(d.blocks(bench, block))
        index = d.build_index(docs, Work(spark), size)
        reports = [d.search(index, q) for q in queries]
        got = (reports[0] if len(reports) == 1 else d.merged(reduce(DataFrame.unionByName, reports))).withColumn("sha", F.sha2(F.array_join("items", ","), 256)).collect()
        assert {x.doc_id: (x.n_words, x.n_hit, len(x["items"]), x.sha, x.n_hit > 0) for x in got} == want
        assert len(queries) == 1 if block > 1_000 else len(queries) > 1
        assert all(sum(s.end - s.start for s in x.spans) == x.n_hit for x in got)
    got = {x.doc_id: (x.n_words, x.n_hit, len(x["items"])) for x in d.decontaminate(docs, bench, block_bytes=300).collect()}
    assert got == {i: w[:3] for i, w in want.items()}


def test_proximity_allows_words_between(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "red x green y blue"), (3, "red x x x x green blue"), (4, "blue green red")], "doc_id long, text string")
    [query] = d.blocks(spark.createDataFrame([(9, "red green blue")], "item_id long, text string"))
    index = d.build_index(docs, Work(spark))
    found = lambda slack: {r.doc_id for r in d.search(index, query, slack).where("n_hit > 0").collect()}
    assert found(0) == {1} and found(2) == {1, 2} and found(4) == {1, 2, 3, 4}


def test_repeated_null_and_empty(spark):
    got = d.decontaminate(documents(spark), benchmark(spark)).collect()
    assert len(got) == 16 and sum(r.doc_id == 5 and r.n_hit > 0 for r in got) == 2
    assert any(r.doc_id is None and "null" in r["items"] for r in got)
    assert d.decontaminate(nothing(spark), benchmark(spark)).count() == 0
    assert d.decontaminate(documents(spark), benchmark(spark).limit(0)).where("n_hit > 0").count() == 0
    left = d.drop_contaminated(documents(spark), benchmark(spark))
    assert left.columns == documents(spark).columns
    assert {r.doc_id for r in left.collect()} == {1, 2, 3, 4, 9, 11, 12, 13, None}


def test_repeated_words_take_no_longer():
    """An item and a document of one word over and over: one distinct window, so as many candidates as places, not their square."""
    text = " ".join(["x"] * 20_000)
    windows = d.Windows([("a", text), ("b", text), ("c", "x x y")])
    assert len(windows.rows) == 2
    row = d.segment("s", [1], pa.array([text], pa.large_string()))
    began = time.perf_counter()
    (got,) = d.match({**row, "terms": row["terms"].cast(pa.binary())}, windows)
    assert (got["n_words"], got["n_hit"], got["items"]) == (20_000, 20_000, ["a", "b"]) and time.perf_counter() - began < 10


def test_runs_of_candidates_give_the_same(monkeypatch):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choices("abc", k=rng.randrange(60))) for i in range(60)}
    items = {f"i{j}": " ".join(rng.choices("abc", k=rng.choice([0, 1, 3, 9, 10, 14, 30]))) for j in range(40)}
    windows = d.Windows(list(items.items()))
    row = d.segment("s", list(texts), pa.array(list(texts.values()), pa.large_string()))
    want = {k: v[:3] for k, v in d.brute_force(texts, items).items()}
    for run in (d.CANDIDATES, 7):
        monkeypatch.setattr(d.find, "__defaults__", (run,))
        got = d.match({**row, "terms": row["terms"].cast(pa.binary())}, windows)
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"])) for r in got} == want
