import random
import re

import numpy as np
import pytest
import xxhash

from parchment.llm import simhash as sh
from parchment.llm.components import components

from .conftest import make


def plain_hash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    bits = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(axis=1)
        if (new == label).all():
            return dict(zip(ids, label.tolist()))
        label = new


def test_fingerprint_is_xxhash_of_spark(spark):
    assert spark.sql("select xxhash64('a b c d') h").first().h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_documents_against_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 40)) for _ in range(120)] for _ in range(12)]
    rows = []
    for i in range(240):
        words = list(base[i % 12])
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            words[rng.randrange(120)] = "x" + str(rng.random())
        rows.append((1000 - i, " ".join(words), "en", "s"))
    want_fp = {i: plain_hash(t) for i, t, *_ in rows}
    want = plain_components(list(want_fp), list(want_fp.values()))
    for most in (1024, 3):  # 3: nearly all cells are crowded
        got = sh.near_duplicates(make(spark, rows), most).collect()
        assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in want_fp.items()}
        assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("most", [1024, 2])
def test_every_pair_within_radius_meets(spark, most):
    rng = random.Random(8)
    fps = []
    for _ in range(40):
        f = rng.getrandbits(64)
        g = f
        for b in rng.sample(range(64), 4):
            g ^= 1 << b
        far = f
        for b in rng.sample(range(64), 5):
            far ^= 1 << b
        fps += [f, g, far]
    want = plain_components(list(range(len(fps))), fps)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    roots = {r.node: r.root for r in components(sh.links(spark.createDataFrame(signed, "fp long").distinct(), most)).collect()}
    label = [roots.get(f, f) for (f,) in signed]
    for i in range(len(fps)):
        for j in range(i):
            assert (label[i] == label[j]) == (want[i] == want[j])


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (502, 500), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500, 502: 500}


def test_odd_cases(spark, odd, odd_rows, empty):
    got = sh.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert by[2].fingerprint == by[3].fingerprint == "0" * 16 and by[3].component_id == 1
    assert by[9].component_id == 5
    assert all(r.component_id == 6 or r.component_id == 8 or r.component_id == 7 or r.doc_id is not None or r.fingerprint == "0" * 16 for r in got)
    assert sh.near_duplicates(empty).collect() == []
    kept = sh.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {r.component_id for r in got}
    assert sh.deduplicated(empty).count() == 0
