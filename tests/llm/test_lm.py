import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from visigraph.llm import lm

from .edge import documents, nothing


def small_model(seed=0):
    r = np.random.default_rng(seed)
    left = np.zeros((lm.VOCAB, lm.LEFT))
    left[:300] = r.integers(0, 50, (300, lm.LEFT))
    return lm.Model(left.sum(1), left)


def test_probabilities_sum_to_one():
    model = small_model()
    for start in ([], [5, 9, 200]):
        tokens = np.array([t for x in range(lm.VOCAB) for t in [*start, x]], np.int32)
        lengths = np.full(lm.VOCAB, len(start) + 1)
        assert np.exp(model.score(tokens, lengths)[len(start) :: len(start) + 1].astype(np.float64)).sum() == pytest.approx(1, abs=1e-3)


def test_no_token_sees_what_comes_after_and_windows_agree():
    model = small_model(1)
    r = np.random.default_rng(4)
    a = r.integers(0, 300, 75).astype(np.int32)
    b = np.concatenate([a[:40], r.integers(0, 300, 35)]).astype(np.int32)
    x, y = model.score(a, np.array([75])), model.score(b, np.array([75]))
    assert np.allclose(x[:40], y[:40], atol=1e-5) and not np.allclose(x[41:], y[41:])
    many = model.score(np.concatenate([a, b[:3], a]), np.array([75, 3, 75]))
    assert np.allclose(many[:75], x, atol=1e-5) and np.allclose(many[78:], x, atol=1e-5)


def stream(tokens, lengths):
    inputs, _, at = lm.streams(tokens, lengths)
    targets = np.full(len(inputs), lm.NONE)
    targets[at] = tokens
    return inputs.reshape(-1, lm.NEW), targets.reshape(-1, lm.NEW)


def test_attention_one_token_at_a_time():
    """The class scores of a text, by a plain loop over its tokens and those before each."""
    model = small_model(6)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    p["R"] = np.random.default_rng(1).normal(0, 1, p["R"].shape)
    model.p["R"][:] = p["R"]
    tokens = np.random.default_rng(2).integers(0, 300, 70).astype(np.int32)
    inputs = [lm.START, *map(int, tokens[:-1])]
    got, kinds = model.score(tokens, np.array([70])), lm.kinds_before(tokens, np.array([70]))
    for i, token in enumerate(tokens):
        first = i // lm.NEW * lm.NEW - lm.NEW  # of the window; what is before the text is BEFORE
        seen = [inputs[j] if j >= 0 else lm.BEFORE for j in range(first, i + 1)]
        x = p["E"][model.row_of[seen]]
        weight = np.exp([x[-1] @ p["Q"] * lm.SCALE @ (p["K"].T @ y) + p["R"][i % lm.NEW, j] for j, y in enumerate(x)])
        context = (weight[:, None] * (x @ p["V"])).sum(0) / weight.sum()
        logits = np.maximum(np.concatenate([context, x[-1]]) @ p["H"] + p["h"], 0) @ p["O"] + p["o"]
        share = np.exp(logits) * model.has
        assert got[i] == pytest.approx(np.log(share[model.class_of[token]] / share.sum()) + model.log_in[token, kinds[i]], abs=1e-3)


def test_loss_is_that_of_scoring():
    model = small_model(2)
    tokens, lengths = np.arange(40, dtype=np.int32), np.array([40])
    inputs, targets = stream(tokens, lengths)
    within = model.log_in[tokens, lm.kinds_before(tokens, lengths)]
    assert model.loss(inputs[None], targets[None, 1:])[0] == pytest.approx(-(model.score(tokens, lengths) - within).mean(), abs=1e-4)


def test_gradients():
    model = small_model(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    r = np.random.default_rng(5)
    inputs = r.integers(0, 300, (2, 4, lm.NEW))
    targets = np.where(r.random((2, 3, lm.NEW)) < 0.2, lm.NONE, r.integers(0, 300, (2, 3, lm.NEW)))
    _, g = model.loss(inputs, targets)
    for k in model.p:
        flat = model.p[k].reshape(-1)
        i = int(np.abs(g[k].reshape(-1)).argmax())
        kept, step = flat[i], 1e-4
        flat[i] = kept + step
        up = model.loss(inputs, targets)[0]
        flat[i] = kept - step
        down = model.loss(inputs, targets)[0]
        flat[i] = kept
        assert (up - down) / (2 * step) == pytest.approx(g[k].reshape(-1)[i], rel=2e-3, abs=1e-6), k


def test_training_lowers_the_loss():
    model = small_model(4)
    tokens = np.tile(np.arange(7, dtype=np.int32), 800)
    inputs, targets = stream(tokens, np.array([len(tokens)]))
    before = model.loss(inputs[None], targets[None, 1:])[0]
    for _ in range(6):
        windows, _ = model.fit(inputs, targets, 0.01)
    assert windows >= len(inputs) - 1 and model.loss(inputs[None], targets[None, 1:])[0] < 0.3 * before


def test_subwords_of_words_taken_together():
    s = lm.Subwords()
    words = ["the", "ünïcödé", "don't", "x" * 300, " odd", "a.b,c", "12", "😀", "ß!", " nb"]
    ids, counts = s.encode([w.encode() for w in words])
    cuts = np.cumsum(counts)
    for w, a, b in zip(words, cuts - counts, cuts, strict=True):
        assert list(ids[a:b]) == s.encoding.encode_ordinary(" " + w)


def test_every_token_of_every_training_document_trains():
    texts = ["", "one", "a few words only", *(f"{i} the same words again and again " * (1 + i % 9) for i in range(40))]
    held = [i % 5 == 4 for i in range(len(texts))]
    subwords = lm.Subwords()
    row = lm.segment_row(0, list(range(len(texts))), held, pa.array(texts, pa.large_string()), subwords)
    inputs, targets = lm.training_stream(row)
    want = Counter(int(x) for t, h in zip(texts, held, strict=True) if not h for w in t.split() for x in subwords.encode([w.encode()])[0])
    want[lm.END] = held.count(False)
    assert Counter(targets[targets != lm.NONE].tolist()) == want and (targets[0] == lm.NONE).all()
    assert (inputs == lm.START).sum() == held.count(False)
    model, seen = small_model(7), Counter()
    plain = model.loss
    model.loss = lambda i, t: (seen.update(t[t != lm.NONE].tolist()), plain(i, t))[1]
    model.fit(inputs, targets, 0.01)
    assert seen == want


def test_scores_do_not_depend_on_the_layout(spark):
    docs = documents(spark, [(100 + i, f"word{i % 5} Word{i % 3} the {i} " * (1 + i % 4)) for i in range(80)], repeat=False)
    one = {r.doc_id: r.score for r in lm.score_documents(docs.coalesce(1), segment_bytes=2_000).collect()}
    many = {r.doc_id: r.score for r in lm.score_documents(docs.repartition(8), segment_bytes=2_000).collect()}
    assert one.keys() == many.keys() and all(one[i] == pytest.approx(many[i], rel=1e-5) for i in one)


def base(texts):
    """Counts and base scores in plain Python."""
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    held = {i: crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in [*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for i, t in texts.items():
        own = [*words(t), None]
        out[i] = (held[i], len(own), sum(counts[w] > 0 for w in own), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own))
    return out


@pytest.mark.parametrize("segment_bytes", [12 << 20, 2_000])
def test_base_columns_by_brute_force(spark, segment_bytes):
    docs = documents(spark, [(100 + i, f"word{i % 5} Word{i % 3} the {i}") for i in range(60)], repeat=False)
    got = lm.score_documents(docs.repartition(3), segment_bytes=segment_bytes).collect()
    want = base({r.doc_id: r.text for r in docs.collect()})
    assert len(got) == len(want)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9) and r.score < 0


def test_word_counts_go_in_blocks(spark, monkeypatch):
    """No table has a row for a word: segments send a block to each part of the hashes and get one from it."""
    docs = spark.createDataFrame([(100 + i, f"word{i % 5} Word{i % 3} only{i} more{i} other{i} the \x00nul {i}") for i in range(30)], "doc_id long, text string")
    stored, plain = {}, lm.Work.store

    def store(work, df, name, *more):
        out = plain(work, df, name, *more)
        stored[name] = out.count()
        return out

    monkeypatch.setattr(lm.Work, "store", store)
    got = lm.score_documents(docs, segment_bytes=100).collect()
    segments = stored["segments"]
    assert segments > 2 * lm.PART and stored["counts"] <= segments and stored["totals"] <= segments * -(-segments // lm.PART) < 80  # words
    want = base({r.doc_id: r.text for r in docs.collect()})
    assert len(got) == len(want) and all((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4] and r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9) for r in got)


def test_edge_rows(spark):
    assert lm.score_documents(documents(spark)).count() == 16
    assert lm.score_documents(nothing(spark)).count() == 0
    only_held = documents(spark).where(lm.held_out(F.col("doc_id"), 7, 2))
    rows = lm.score_documents(only_held).collect()
    assert rows and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)
