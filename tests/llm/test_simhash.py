import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from visigraph.llm import simhash
from visigraph.llm.common import Work

from . import edge


def test_hash_is_xxh64():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5_000))
    begin = np.array([rng.randrange(4_800) for _ in range(2_000)])
    stop = np.array([min(5_000, b + rng.randrange(150)) for b in begin])
    got = simhash.xxh64(np.frombuffer(data, np.uint8), begin, stop)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(begin, stop, strict=True)]


def test_fingerprints_follow_the_definition():
    rng = random.Random(2)
    texts = [None, "", " \t", "One", "a B", "A B c d", "Ünï cödé ß 😀 𝄞 \x00 x", "\x00", "the the the the", " ".join(f"w{rng.randrange(50)}" for _ in range(2_000)), edge.LONG, *(" ".join(rng.choices("abcde", k=rng.randrange(12))) for _ in range(50))]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [simhash.plain_fingerprint(t) for t in texts]


def by_rows(spark, prints, bucket):
    rows = spark.createDataFrame([(d, simhash.signed(p)) for d, p in prints], "doc_id long, fp long")
    stored = Work(spark).store(rows, "given")
    return sorted((str(r.doc_id), r.fp, r.component_id) for r in simhash.components(stored, bucket=bucket).collect())


def wanted(prints):
    return sorted((str(d), simhash.signed(p), c) for (d, p), c in zip(prints, simhash.brute_force(prints), strict=True))


def family(rng, n):
    """Fingerprints in chains and dense clouds about a few centres, and far ones; many share whole segments, and some are equal."""
    centres = [rng.getrandbits(64) for _ in range(4)] + [0]
    out = [rng.getrandbits(64) for _ in range(n // 10)]
    while len(out) < n:
        base = rng.choice(centres + out[-20:])
        for _ in range(rng.choice([0, 1, 2, 3, 3, 4, 4, 5])):
            base ^= 1 << rng.choice([rng.randrange(64), rng.randrange(8), 32 + rng.randrange(12)])
        out.append(base)
    return out


@pytest.mark.parametrize("bucket", [3])
def test_components_equal_comparing_all(spark, bucket):
    rng = random.Random(bucket)
    prints = [(rng.choice([i, i, i, None, 7]), p) for i, p in enumerate(family(rng, 500))]
    assert by_rows(spark, prints, bucket) == wanted(prints)


def test_every_place_of_three_bits_is_found(spark):
    """Pairs that differ in exactly three or four bits, spread over the segments in all ways, with and without full keys."""
    rng, prints = random.Random(5), []
    for k in range(120):
        a = rng.getrandbits(64)
        n = 3 if k % 2 else 4
        low = rng.randrange(n + 1)
        flips = rng.sample(range(32), low) + rng.sample(range(32, 64), n - low)
        prints += [(10 * k, a), (10 * k + 1, a ^ sum(1 << b for b in flips))]
    for bucket in (256, 0):
        got = by_rows(spark, prints, bucket)
        assert got == wanted(prints)
        assert all((c == int(d) // 10 * 10) == (int(d) % 10 == 0 or int(d) // 10 % 2 == 1) for d, _, c in got)


def test_texts(spark, tmp_path):
    docs = edge.documents(spark, more=[(20 + i, f"{edge.STORY} {'and more ' * (i % 3)}") for i in range(6)])
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, simhash.plain_fingerprint(r.text)) for r in docs.collect()]
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.op12_simhash(spark, str(tmp_path)).collect())
    assert got == sorted((str(d), f"{p:016x}", c) for (d, p), c in zip(rows, simhash.brute_force(rows), strict=True))
    assert simhash.near_duplicates(edge.nothing(spark)).collect() == []
