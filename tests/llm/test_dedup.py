import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from visigraph.llm import dedup
from visigraph.llm.common import join_small

from .edge import documents, nothing


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.random()}"
    return out


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3_000)]
    texts = {}
    for g in range(25):
        base = r.choices(vocabulary, k=r.choice([3, 8, 60, 300]))
        for _ in range(r.choice([1, 2, 6])):
            texts[len(texts) * 3 + 1] = " ".join(edited(r, base, r.choice([0, 0, 1, 2, 5]))) + r.choice(["", ".", "!"])
    chain = r.choices(vocabulary, k=200)
    for _ in range(8):  # each is near the one before, the ends are not
        chain = edited(r, chain, 3)
        texts[len(texts) * 3 + 1] = " ".join(chain)
    texts |= {900: None, 901: "", 902: " ", 903: "?!", 904: "?!", 905: "er " * 500, 906: "er " * 520, 907: "er " * 300, 908: "One", 909: "one."}
    return texts


def test_classes_as_by_comparing_all(spark):
    for seed in (1,):
        texts = corpus(seed)
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
        got = {r.doc_id: r.class_id for r in dedup.near_duplicates(docs).collect()}
        assert got == dedup.brute_force(texts)


def test_one_of_a_group_of_thousands_stays(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(2_000)}" for _ in range(150)]
    rows = [(i, " ".join(edited(r, base, 1))) for i in range(1_500)] + [(5_000 + i, " ".join(base)) for i in range(500)]
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_links_within_a_family_that_is_not_near(spark):
    """A thousand texts share a passage and are at 0.778 to each other; a hundred pairs of them are at 0.824."""
    passage = [f"p{i}" for i in range(404)]
    own = {i: [f"o{i}x{k}" for k in range(57)] for i in range(1_000)}
    for i in range(0, 200, 2):
        own[i + 1][:13] = own[i][:13]
    names = {}
    shingles = np.zeros((1_000, 60_000), np.float32)
    texts = {i: " ".join(passage + w) for i, w in own.items()}
    for i, t in texts.items():
        w = t.split()
        for k in range(len(w) - 4):
            shingles[i, names.setdefault(tuple(w[k : k + 5]), len(names))] += 1
    both = shingles @ shingles.T
    near = both >= 0.8 * (2 * 457 - both)
    want = {i: int(np.flatnonzero(near[i])[0]) for i in texts}
    assert sorted(want.values()) == sorted([*range(0, 200, 2)] * 2 + [*range(200, 1_000)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in dedup.near_duplicates(docs).collect()} == want


def test_a_family_makes_no_large_key(spark, monkeypatch):
    """Of 1,500 texts that are at 0.789 to each other, only near pairs meet in a key of rare tokens, and texts of other sizes find each other."""
    passage = [f"p{i}" for i in range(101)]
    own = {i: [f"o{i}x{k}" for k in range(13)] for i in range(1_500)}
    for i in range(0, 60, 2):
        own[i + 1][:7] = own[i][:7]
    for i in range(60, 100, 2):
        own[i + 1] = own[i] + [f"more{i}x{k}" for k in range(20)]
    texts = {i: " ".join(passage + w) for i, w in own.items()}
    seen, plain = [], dedup.finer
    monkeypatch.setattr(dedup, "finer", lambda *a: seen.extend((a[0], plain(*a))) or seen[-1])
    keep = dedup.Work.drop
    monkeypatch.setattr(dedup.Work, "drop", lambda self, *tables: None)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in dedup.near_duplicates(docs).collect()}
    monkeypatch.setattr(dedup.Work, "drop", keep)
    before, after = (x.groupBy("key").count().agg({"count": "max"}).first()[0] for x in seen)
    assert before > 1_000 and after <= dedup.BLOCK_ROWS
    bags = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = {i: i - 1 if i % 2 and i < 100 and near(bags[i], bags[i - 1]) else i for i in texts}
    assert got == want and 20 < sum(i != c for i, c in want.items())
    assert not near(bags[200], bags[201])


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 12, 300), r.integers(0, 12, 300)
    b[:200] = a[:200]
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    agree = []
    for trial in range(12):
        names = dedup.mixed(np.arange(300, dtype=np.uint64) + np.uint64(1 + 1_000 * trial))
        text = np.concatenate([np.zeros((a > 0).sum(), np.int64), np.ones((b > 0).sum(), np.int64)])
        s = dedup.signatures(text, np.concatenate([names[a > 0], names[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 256)
        agree.append((s[0] == s[1]).mean())
    assert np.mean(agree) == pytest.approx(truth, abs=0.02)


def test_shingles_do_not_depend_on_the_batch():
    texts = ["a b c d e f a b c d e", "x", "", None, "a b c d e f a b c d e"]
    text, shingle, count, n, content = dedup.shingles(pa.array(texts))
    alone = dedup.shingles(pa.array(texts[:1]))
    assert sorted(zip(shingle[text == 0], count[text == 0])) == sorted(zip(shingle[text == 4], count[text == 4])) == sorted(zip(alone[1], alone[2]))
    assert list(n) == [11, 1, 0, 0, 11] and (content[0] == content[4]).all() and count[text == 0].max() == 2


def test_edge_rows(spark):
    docs = documents(spark)
    got = {(r.doc_id, r.class_id) for r in dedup.near_duplicates(docs).collect()}
    assert {(5, 5), (6, 5), (7, 5), (None, 5), (12, 12), (13, 12)} <= got
    assert {c for d, c in got if d in (1, 2)} == {1} and (3, 3) in got
    assert len({c for d, c in got if d is None}) == 2
    kept = dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for _, c in got if c >= 0}) and ids.count(5) == 1
    assert dedup.keep_one(nothing(spark)).count() == 0


def test_rows_that_repeat_an_id_with_other_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n"), (None, "z z"), (None, "z z")]
    kept = dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", "a b c d e f g"), ("1", "h i j k l m n"), ("None", "z z")]


def test_components_of_a_long_path(spark):
    from visigraph.llm.common import Work

    links = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.id: r.root for r in dedup.components(links, Work(spark)).collect()}
    assert {got.get(i, i) for i in range(13)} == {0} and got[101] == 100
    assert dedup.components(links.limit(0), Work(spark)).count() == 0


@pytest.fixture
def plans(monkeypatch):
    """The plans of all joins, where each counted table is held to have more than 100,000 rows."""
    joins, plain = [], DataFrame.join

    def join(self, other, *how):
        joins.append(plain(self, other, *how))
        return joins[-1]

    monkeypatch.setattr(DataFrame, "join", join)
    monkeypatch.setattr(dedup, "join_small", lambda big, small, on, how, rows, **more: join_small(big, small, on, how, rows + 100_001, **more))
    return lambda: [x._jdf.queryExecution().optimizedPlan().toString() for x in joins]


def test_many_ids_are_never_broadcast(spark, plans):
    """They are shuffled, and no other join is left to Spark's own limit."""
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.class_id for r in dedup.near_duplicates(docs).collect()} == dedup.brute_force(texts)
    assert len(plans()) > 10 and all("strategy=merge" in x and "strategy=broadcast" not in x for x in plans())


def test_many_rows_that_go_are_never_broadcast(spark, plans, monkeypatch):
    rows = [(i, "one two three four five six", i // 5) for i in range(10)]
    classes = spark.createDataFrame(rows, "doc_id long, text string, root long").selectExpr("doc_id", "md5(text) AS same", "root")
    monkeypatch.setattr(dedup, "near_duplicates", lambda docs, least: classes)
    kept = dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, other long"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 5]
    assert len(plans()) == 2 and all("strategy=merge" in x and "strategy=broadcast" not in x for x in plans())


def test_bags_give_the_overlap_of_multisets():
    r = random.Random(5)
    texts = [" ".join(r.choices("abcde", k=r.randrange(5, 90))) for _ in range(40)] + ["x y z", "a " * 300]
    text, shingle, count, _, _ = dedup.shingles(pa.array(texts))
    sets = [dedup.elements(b) for b in dedup.bags(text, shingle, count, len(texts))]
    words = [t.split() for t in texts]
    plain = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in words]
    want = np.array([[sum((a & b).values()) for b in plain] for a in plain])
    for run in (3, 32):
        got = dedup.overlaps(sets, run)
        assert all(got[i, j] == want[i, j] for i in range(len(texts)) for j in range(len(texts)) if i != j)
    assert [len(s) for s in sets] == list(np.diag(want)) and all((np.diff(s) > 0).all() for s in sets)
