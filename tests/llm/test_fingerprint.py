import hashlib
import random

import numpy as np

import pytest

from visigraph.llm import dedup
from visigraph.llm import fingerprint as f

from .edge import LONG, STORY, documents, nothing


def plain(text):
    """The fingerprint of a text, one character at a time."""
    own = [int(x) for x in f.symbols(text)]
    at, marks = f.cuts(f.symbols(text))
    out = []
    for a, b, mark in zip(at, [*at, len(own)][1:], marks):
        place, digits = a, ""
        for j in range(f.STEPS):
            if place == b:
                break
            if j in f.EVEN or mark == 0 and j in f.EARLY:
                digits += f"{int(f.DIGITS[j][own[place]]):x}"
            place += int(f.MOVES[j][own[place]])
        out.append(f"{mark:04x}{digits}")
    return ".".join(out)


def test_walk_as_one_character_at_a_time():
    texts = ["", "a", STORY, STORY * 7, "😀é" * 900, LONG[:3_000], "a" * 5_000]
    assert f.fingerprints(texts) == [plain(t) for t in texts]


def prose(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randrange(2, 9))) for _ in range(900)]
    return " ".join(r.choices(words, k=n))[:n]


def test_chunks_are_bounded_and_realign():
    for text in (prose(1, 9_000), "a" * 9_000, "ab" * 4_000, LONG):
        at, marks = f.cuts(f.symbols(text))
        sizes = [b - a for a, b in zip(at, [*at, len(text)][1:])]
        assert max(sizes) <= f.LONGEST and min(sizes) >= f.SHORTEST and marks[0] == 0 and 0 not in marks[1:]
    text = prose(2, 9_000)
    before, after = ({len(t) - x for x in f.cuts(f.symbols(t))[0]} for t in (text, "something new here " + text))
    assert len(before & after) >= len(before) - 2


def test_likeness():
    a, b, c, d = f.fingerprints([LONG[:6_000], LONG[:3_000] + "x" + LONG[3_000:6_000], "zq" * 3_000, STORY])
    assert f.likeness(a, a) == 1.0 and f.likeness("", "") == 1.0 and f.likeness("", a) == 0.0
    assert f.likeness(a, b) > 0.9 and f.likeness(a, c) < 0.1 and f.likeness(a, d) < 0.2 and 0 <= f.likeness(b, d) <= 1


@pytest.mark.parametrize("inserted", [1, 4, 16, 64])
@pytest.mark.parametrize("place", [0, 3_000])
def test_likeness_after_an_insertion(inserted, place):
    new = prose(99, 200)[:inserted]
    texts = [prose(s, 6_000) for s in range(20)]
    near = [f.likeness(*f.fingerprints([t, t[:place] + new + t[place:]])) for t in texts]
    far = [f.likeness(*f.fingerprints([texts[i], texts[i - 1]])) for i in range(20)]
    assert min(near) >= (0.8 if inserted <= 16 else 0.7) and np.mean(near) >= 0.85 and max(far) < 0.1


def test_classes_after_edits(spark):
    """Each text has a copy with a heading, one with words replaced, and one that is half of another text."""
    rows = []
    for s in range(60):
        t = prose(s, 4_000)
        cut = 1_000 + 13 * s
        rows += [(10 * s, t), (10 * s + 1, f"Heading {s}. " + t), (10 * s + 2, t[:cut] + " other words " + t[cut + 20 :]), (10 * s + 3, t[:2_000] + prose(1_000 + s, 2_000))]
    got = {r.doc_id: r.class_id for r in f.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = sum(got[10 * s + k] == 10 * s for s in range(60) for k in (1, 2))
    assert linked >= 0.98 * 120 and all(got[10 * s + 3] == 10 * s + 3 for s in range(60))


@pytest.mark.parametrize("shard_rows", [8_192, 4])
def test_contract_by_brute_force(spark, monkeypatch, shard_rows):
    docs = documents(spark, [(100 + i, STORY[i:] * (i % 4)) for i in range(30)], repeat=False)
    monkeypatch.setattr(f, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(f.neighbours, "__defaults__", (shard_rows,))
    got = {r.doc_id: r for r in f.compare_next(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    prints = dict(zip(order, f.fingerprints([texts[i] for i in order]), strict=True))
    assert len(got) == len(order)
    for i, nxt in zip(order, order[1:] + order[:1], strict=True):
        t = texts[i]
        k = len(t) // 3
        changed = t[: len(t) - k] + texts[nxt][:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(changed.encode()).hexdigest(), prints[i])
        assert r.edited_fingerprint == f.fingerprints([changed])[0]
        assert r.near_edited == f.likeness(prints[i], r.edited_fingerprint) and r.near_next == f.likeness(prints[i], prints[nxt])


def test_repeated_null_and_single_rows(spark):
    assert f.compare_next(documents(spark)).count() == 16
    assert f.compare_next(nothing(spark)).count() == 0
    one = spark.createDataFrame([(None, "abcdef")], "doc_id long, text string")
    assert f.compare_next(one).first().near_next == 1.0
    assert f.compare_next(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).first().near_next == 1.0
    assert f.compare_next(one.union(one).union(one)).count() == 3


def test_classes_of_edge_rows(spark):
    rows = [(1, STORY * 5), (2, STORY * 5 + " end"), (3, LONG[:700]), (4, ""), (5, STORY * 5), (6, None), (None, STORY * 5), (5, STORY * 5)]
    got = sorted(((r.doc_id or 0), r.class_id) for r in f.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), 0.7).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 1), (5, 1), (6, 4)]
    assert f.near_classes(nothing(spark)).count() == 0


def test_query_has_the_classes(spark):
    """class_id of the query's rows is that of near_classes, for copies, edits, nulls, repeated rows and texts that stand alone."""
    docs = documents(spark, [(100 + i, prose(i // 3, 3_000) + " the end" * (i % 3)) for i in range(30)])
    got = sorted((str(r.doc_id), str(r.class_id), r.fingerprint) for r in f.linked_next(docs).collect())
    alone = sorted((str(r.doc_id), str(r.class_id)) for r in f.near_classes(docs).collect())
    assert [x[:2] for x in got] == alone and len(got) == docs.count()
    classes = dict(x[:2] for x in got)
    assert all(classes[str(100 + i)] == str(100 + i - i % 3) for i in range(30)) and classes["10"] == "10"
    assert f.linked_next(nothing(spark)).count() == 0


def test_all_pairs_as_one_by_one():
    """The bound before likeness loses no pair: copies, edits, cut texts, shared passages, empty and short ones."""
    texts = [*(prose(s, 2_500) for s in range(6)), *(prose(s, 2_500)[40 * k : 2_500 - 90 * k] for s in range(3) for k in (1, 2, 3)), *(prose(s, 1_500) + prose(90, 1_000) for s in range(6)), "", "a", "ab", STORY, STORY + "!"]
    prints = [f.chunks_of(x) for x in f.fingerprints(texts)]
    meets = np.triu(np.ones((len(texts), len(texts)), bool), 1)
    for least in (0.3, 0.6, 0.8, 1.0):
        want = np.array([[i < j and f.likeness(x, y) >= least for j, y in enumerate(prints)] for i, x in enumerate(prints)])
        assert (f.Prints(least).matrix(prints, meets) == want).all()


def test_a_passage_that_many_share_loses_no_link(spark, monkeypatch):
    """Keys above a block are split by rare chunks: the classes are those of comparing all pairs, and no key stays above a block for the passage alone."""
    passage = prose(99, 1_200)
    texts = {i: prose(i // 2, 1_500) + passage + (" and more" if i % 2 else "") for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 6)
    seen = []
    finer = dedup.finer

    def watched(classed, *rest):  # noqa: ANN001, ANN002, ANN202
        out = finer(classed, *rest)
        seen.append([max(r["count"] for r in x.groupBy("key").count().collect()) for x in (classed, out)])
        return out

    monkeypatch.setattr(dedup, "finer", watched)
    got = {r.doc_id: r.class_id for r in f.near_classes(docs).collect()}
    prints = dict(zip(texts, map(f.chunks_of, f.fingerprints([*texts.values()])), strict=True))
    root = {i: min(j for j in texts if j == i or f.likeness(prints[i], prints[j]) >= f.LEAST) for i in texts}
    assert got == root == {i: i - i % 2 for i in texts}
    assert seen and seen[0][0] > 6 and seen[0][1] < seen[0][0] / 2


@pytest.mark.parametrize("n", [1_000, 6_000])
@pytest.mark.parametrize("share", [0.005, 0.01])
def test_bands_find_texts_with_spread_edits(n, share):
    r, met = random.Random(n), 0
    for seed in range(100):
        text = list(prose(seed, n))
        other = text.copy()
        for i in r.sample(range(n), round(n * share)):
            other[i] = r.choice("abcdefgh")
        a, b = f.bands(f.fingerprints(["".join(text), "".join(other)])).tolist()
        met += bool(set(a) & set(b))
    assert met >= 95


def test_bands_sample_places_not_digits(monkeypatch):
    """A fingerprint's keys don't depend on what it is in a batch with, nor on how many bands are made at a time; digits at places not sampled don't matter."""
    prints = [*f.fingerprints([STORY, LONG, "a", "ab" * 40, prose(5, 9_000), STORY])]
    together = f.bands(prints)
    assert together.shape == (6, f.BANDS) and (together[0] == together[5]).all() and (together >= 0).all()
    assert all((f.bands([x])[0] == own).all() for x, own in zip(prints, together))
    monkeypatch.setattr(f, "CELLS", 100)
    assert (f.bands(prints) == together).all()
    # in one chunk of 40 samples each band sees 8: about a fifth of the bands changes with one digit
    chunk = "0000" + "5" * 40
    kept = [(f.bands([chunk])[0] == f.bands([chunk[: 4 + k] + "6" + chunk[5 + k :]])[0]).sum() for k in range(40)]
    assert sum(kept) == 40 * f.BANDS - 8 * f.BANDS
