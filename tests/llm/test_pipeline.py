import corpus_pipeline
from visigraph.llm import decontaminate, dedup

from .edge import STORY, documents, nothing


def test_stages_take_effect_in_turn(spark, tmp_path):
    good = [(i, f"This is a calm text, number {i}. It was written in town on a day that nobody knew of, and it ended well for {i} of them.", "en", f"s{i % 3}") for i in range(120)]
    bad = [(1_000 + i, "BUY!! NOW!! CHEAP!! " * 20 + f"x{i}", "en", "s0") for i in range(60)]
    other = [(2_000, good[7][1] + " End", "en", "s1"), (2_001, f"He said: {STORY}. Then he went home to write more of it.", "en", "s2"), (2_002, "Please write to john.doe@mail.example about all of this, he said, and she did so at once.", "en", "s1")]
    docs = spark.createDataFrame([(i, t, g, s, len(t)) for i, t, g, s in good + bad + other], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(1_000 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, STORY)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, now = {}, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = {r.doc_id: r.text for r in now.collect()}
        if name != "mix":
            assert now.columns == docs.columns
        if name == "near_duplicates":
            kept = dedup.brute_force({r.doc_id: r.text for r in before.collect()})
            assert set(seen[name]) == set(kept.values())
        if name == "decontaminate":
            hit = decontaminate.brute_force({r.doc_id: r.text for r in before.collect()}, {1: STORY})
            assert set(seen[name]) == {d for d, x in hit.items() if not x[4]}
    assert set(range(120)) <= set(seen["quality"]) and not any(i in seen["quality"] for i in range(1_000, 1_060))
    assert 2_001 not in seen["decontaminate"] and "[EMAIL]" in seen["pii"][2_002] and "@" not in seen["pii"][2_002]
    assert set(seen["mix"]) <= set(seen["pii"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_empty_table(spark, tmp_path):
    docs = nothing(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_nulls_repeats_and_clashing_columns(spark, tmp_path):
    docs = documents(spark)
    spark.createDataFrame([(4, 1, 0), (5, 1, 0), (9, 1, 0), (12, 0, 0), (13, 0, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, STORY), (2, None), (None, ""), (1, STORY)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = sorted(map(str, docs.collect()))
    seen = {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES}
    got = {name: out.collect() for name, out in seen.items()}
    for name in ("quality", "near_duplicates", "decontaminate", "pii"):
        assert seen[name].columns == docs.columns
    for name in ("quality", "near_duplicates", "decontaminate"):
        assert set(map(str, got[name])) <= set(rows)
    ids = lambda name: sorted((r.doc_id is None, r.doc_id or 0) for r in got[name])
    assert not {r.doc_id for r in got["near_duplicates"]} & {6, 7, 13} and ids("near_duplicates").count((False, 5)) == 1
    assert not {r.doc_id for r in got["decontaminate"]} & {5, 6, 7} and {1, 2, 3, 4, 9, 10, 11, 12, 13} <= {r.doc_id for r in got["decontaminate"]}
    assert len(got["pii"]) == len(rows) and {(r.base, r.spans, r.score) for r in got["pii"]} == {("b", "x", 0.1)}
    clean = {r.doc_id: r for r in got["pii"]}
    assert clean[9].text.count("[") == 4 and clean[1].text is None and clean[9].n_chars == len(clean[9].text)
