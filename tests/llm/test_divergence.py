import duckdb
import pytest

from visigraph.llm import divergence

from . import edge

DOCS = [
    ("the cat sat", "en", "a"), ("The cat ran", "en", "a"), ("a cat the THE end", "en", "b"), ("the dog", "en", "b"), ("", "en", "c"), (None, "en", None), ("Ünï ünï straße", "de", "a"),
    ("Ünï x", "de", "b"), ("ünÏ ünï 12 x_y", "de", "b"), ("ünï", "de", ""), ("un deux", "fr", "a"), ("deux", "fr", "b"), ("the cat", None, None), ("the", "", "z"), ("the the", "", "q"), ("nur einmal", "xx", "q"), *[("dog cat bird " * (i % 4) + "mouse", "en", f"s{i % 5}") for i in range(12)],
]


def tables(spark, kind):
    if kind == "edge":
        return edge.documents(spark)
    if kind == "empty":
        return edge.nothing(spark)
    return spark.createDataFrame([(i, t, lang, source, 1, "x") for i, (t, lang, source) in enumerate(DOCS)], "doc_id long, text string, lang string, source string, g long, term string")


@pytest.mark.parametrize(("kind", "bits"), [("small", 64), ("small", 2), ("edge", 64), ("edge", 6), ("empty", 64)])
def test_equals_sql(spark, tmp_path, kind, bits):
    """Also where a digest has so few bits that most terms share theirs."""
    docs = tables(spark, kind)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(divergence.SQL)
    names = [d[0] for d in cursor.description]
    want = sorted(map(tuple, cursor.fetchall()))
    got = sorted(tuple(r) for r in divergence.divergence(docs, bits).select(names).collect())
    assert got == want
    if kind == "empty":
        assert got == []
    if kind == "small":
        assert {r[names.index("part")] for r in got} == {"pair", "term"}
        assert any(r[names.index("lang")] == "xx" or r[names.index("value")] == 0 for r in got)


def test_large_groups_are_cut(spark):
    """Corrections in runs of few pairs add up to the same."""
    docs = tables(spark, "small")
    want = sorted(map(tuple, divergence.divergence(docs).collect()))
    assert sorted(map(tuple, divergence.divergence(docs, run=3).collect())) == want


def test_many_sources_and_ties(spark, same_as_sql):
    docs = spark.createDataFrame([(i, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(i % 7, 400, 1 + i % 3)), "en", f"s{i % 30}") for i in range(90)], "doc_id long, text string, lang string, source string")
    same_as_sql(divergence.op11_divergence, divergence.SQL, documents=docs)
