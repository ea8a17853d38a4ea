import numpy as np
import pytest
from pyspark.sql import functions as F

from visigraph.llm import classifier as c

from .edge import LONG, documents, nothing


def toy(n=240):
    good = [f"The {w} went to town. It was {w}." for w in (f"man{i}" for i in range(n // 2))]
    bad = [f"BUY!! NOW!! x{i} !!" if i % 2 else f"spam{i} " * 12 for i in range(n // 2)]
    return good + bad, [1] * len(good) + [0] * len(bad)


def test_long_texts_in_pieces_score_as_whole(monkeypatch):
    net = c.Network().fit([t.encode() for t in toy()[0]], np.array(toy()[1]))
    data = np.frombuffer((LONG[:5_000] + "!!!").encode(), np.uint8)
    whole = net.score(data, np.array([0, len(data)]))
    both = net.score(np.concatenate([data, data[:50]]), np.array([0, len(data), len(data), len(data) + 50]))
    assert both[0] == pytest.approx(whole[0], abs=1e-6) and 0 <= both[1] <= 1
    monkeypatch.setattr(c, "PIECE", 40)
    assert net.score(data, np.array([0, len(data)]))[0] == pytest.approx(whole[0], abs=1e-5)


def test_symbols_mark_repeats():
    assert (c.symbols(np.frombuffer(b"abcdefgh", np.uint8)) < 256).all()
    marked = c.symbols(np.frombuffer(b"word word word", np.uint8)) >= 256
    assert not marked[:8].any() and marked[8:].all()


def test_learns_and_is_the_same_again(spark):
    texts, labels = toy(600)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, x, 0) for i, x in enumerate(labels)] + [(9_999, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    net = c.train(docs, marks)
    rows = c.score_rows(docs, net).withColumn("h", c.held_out(F.col("doc_id"))).where("h").collect()
    right = [(r.score >= 0.5) == bool(labels[r.doc_id]) for r in rows]
    assert len(rows) > 60 and np.mean(right) > 0.95
    again = {r.doc_id: r.score for r in c.score_rows(docs.repartition(3), c.train(docs.repartition(5), marks)).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-4) for r in rows)


def test_edge_rows(spark):
    docs = documents(spark)
    marks = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    got = c.score_rows(docs, c.train(docs, marks.limit(0)))
    assert sorted(got.columns) == sorted(docs.columns) and got.count() == docs.count()
    assert {r.score for r in got.collect()} == {0.5}
    net = c.Network().fit([b"a", b"b"], np.array([0, 1]))
    assert all(0 <= r.score <= 1 for r in c.score_rows(docs, net).collect())
    assert c.score_rows(nothing(spark), net).count() == 0


def plain(net, data):
    """The score of a text, one chunk, filter and byte at a time."""
    marked = [b + 256 * any(i - lag >= 3 and data[i - 3 : i + 1] == data[i - lag - 3 : i - lag + 1] for lag in c.LAGS) if i >= 3 else b for i, b in enumerate(data)]
    size = max(2, -(-len(data) // c.HALF)) * c.HALF
    marked += [c.PAD] * (size - len(data))
    filters = np.concatenate([net.p["A"], net.p["B"]]).astype(np.float64)
    best = np.full(c.FILTERS, -np.inf)
    for at in range(0, size - c.HALF, c.HALF):
        x = [v for s in marked[at : at + 2 * c.HALF] for v in net.p["E"][s].astype(np.float64)]
        for f in range(c.FILTERS):
            best[f] = max(best[f], sum(a * b for a, b in zip(x, filters[:, f])))
    hidden = [max(0.0, sum(np.tanh(best + net.p["c"]) * net.p["H"][:, k]) + net.p["h"][k]) for k in range(c.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(h * o for h, o in zip(hidden, net.p["o"])) + net.p["b"][0])))


def test_scores_by_brute_force(monkeypatch):
    texts, labels = toy(80)
    net = c.Network().fit([t.encode() for t in texts], np.array(labels))
    monkeypatch.setattr(c, "PIECE", 60)
    some = [b"", b"a", b"12345678", texts[3].encode(), texts[50].encode() * 3, "ünï ".encode() * 40, LONG[:900].encode()]
    got = net.score(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
    assert got == pytest.approx([plain(net, list(x)) for x in some], abs=1e-4)
