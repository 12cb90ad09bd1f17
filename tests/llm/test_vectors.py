"""Hard negatives and whitening against plain versions of them."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.llm import hard_negatives, whitening
from parchment.llm.hard_negatives import window

SCHEMA = "vec_id long, embedding array<float>, label int, x string, slot string, n string, score string, rank string, block string"


def make(spark, rows):
    return spark.createDataFrame([(i, v, c, *["-"] * 6) for i, v, c in rows], SCHEMA)


def vectors(n=230, d=6, seed=1):
    rng = np.random.default_rng(seed)
    out = [(i, [float(c) for c in rng.normal(size=d) + 0.4], int(rng.integers(0, 3))) for i in range(n)]
    same = out[3][1]
    out += [(1000 + i, same, i % 3) for i in range(90)]  # a third of all rows agree
    return out


ODD = [(None, [1.0] * 6, 1), (7000, None, 1), (7001, [1.0, None], 1), (7002, [float("nan")] * 6, 1), (7003, [float("inf")] * 6, 2), (7004, [1.0] * 6, None)]


def plain_mining(rows):
    once = {(i, tuple(v), c) for i, v, c in rows if i is not None and v is not None and c is not None and all(e is not None and math.isfinite(e) for e in v)}
    turned = [(i, [math.floor(256 * float(np.float32(e))) for e in v], (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in once]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    found = []
    for i, x, c in turned:
        if i % 50:
            continue
        scored = sorted(((-dot(x, y), j, e == c) for j, y, e in turned if j != i))
        for p, j, _ in [s for s in scored if s[2]][:5]:
            fits = [(s, k) for s, k, alike in scored if not alike and 50 * -p <= 100 * -s <= 95 * -p][:3]
            found += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(fits, 1)]
    return sorted(found)


@pytest.mark.parametrize("block", [hard_negatives.ANCHOR_BYTES, 3 * 8 * 6])
def test_hard_negatives_against_all_pairs(spark, block):
    rows = vectors() + ODD + vectors()[:4] + [(8000, [0.5, 0.25], 1), (8050, [], 2), (8100, [0.1] * 6, 0), (8050, [0.3] * 6, 2)]
    df = make(spark, rows)
    got = hard_negatives.mine(hard_negatives.prepared(df), F.col("vec_id") % 50 == 0, anchor_bytes=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_mining(rows) != []


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(make(spark, [])).count() == 0
    assert hard_negatives.hard_negatives(make(spark, ODD)).count() == 0
    assert hard_negatives.hard_negatives(make(spark, [(50, [1.0], 1), (100, [1.0], 2)])).count() == 0


def test_products_beyond_float64():
    a, b = np.array([[2**40 + 1, 3]]), np.array([[2**40 - 1, 5], [1, 1]])
    assert hard_negatives.products(a, b).tolist() == [[(2**40 + 1) * (2**40 - 1) + 15, 2**40 + 4]]
    assert hard_negatives.products(a[:, 1:], b[:, 1:]).dtype == np.float64


def test_huge_entries(spark):
    rows = [(50, [3e30, 1.0], 1), (51, [3e30, 2.0], 1), (52, [2.1e30, 2.0], 2), (53, [1e13, 1.0], 2)]
    got = hard_negatives.hard_negatives(make(spark, rows)).collect()
    assert got == [] and window(101) == (51, 95) and window(-10) == (-5, -10)


def test_whitening_against_numpy(spark):
    rows = vectors() + ODD[1:5] + [(2000, vectors()[5][1], 0)]
    got = whitening.whitened(make(spark, rows)).toPandas()
    x = np.array([[math.floor(64 * float(np.float32(e))) + 10**6 for e in v] for _, v, _ in vectors()] + [[math.floor(64 * float(np.float32(e))) + 10**6 for e in vectors()[5][1]]], float)
    n = len(x)
    y = x - x.mean(0)
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == n * 6 and set(got.n) == {n} and got.identity_error.max() < 1e-9
    want = y @ v / np.sqrt(e)
    by = got.sort_values(["vec_id", "component"]).whitened.to_numpy().reshape(n, 6)
    ids = [i for i, _, _ in vectors()] + [2000]
    want = want[np.argsort(ids, kind="stable")]
    sign = np.sign((want * by).sum(0))
    assert np.allclose(want * sign, by, atol=1e-8)
    assert np.allclose(got.explained.to_numpy().reshape(n, 6), e / e.sum(), rtol=1e-9)
    exact = sorted(int(d) for d in ((n * x - x.sum(0)).astype(object) ** 2).sum(1))
    assert sorted(got[got.component == 1].deviation.tolist()) == exact


def test_whitening_of_flat_short_and_missing_vectors(spark):
    assert whitening.whitened(make(spark, [])).count() == 0
    assert whitening.whitened(make(spark, [(1, [1.0, 2.0], 1)])).count() == 0
    assert whitening.whitened(make(spark, [(i, [1.0, 2.0], 1) for i in range(9)])).count() == 0
    assert whitening.whitened(make(spark, [(1, [], 1), (2, [], 1)])).count() == 0
    got = whitening.whitened(make(spark, [(None, [1.0, 5.0], 1), (2, [3.0], None), (3, [0.5, 5.0], 2), (4, [1.5, 5.0], 2)])).collect()
    assert len(got) == 8 and {r.component for r in got} == {1, 2} and None in {r.vec_id for r in got}
    flat = whitening.whitened(make(spark, [(i, [float(i % 5), 3.0, float(i % 5)], 1) for i in range(40)])).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12  # two equal dimensions and a constant one


@pytest.mark.parametrize("spread", [[1e9, 3e8, 5, 4.5, 3], [1e7, 8, 8, 2, 2], [1, 1, 1, 1, 1]])
def test_covariance_and_eigenpairs_of_graded_data(spread):
    rng = np.random.default_rng(4)
    d, n = 5, 700
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    x = np.floor(rng.normal(size=(n, d)) * spread @ q.T).astype(np.int64) + 10**6
    total = [int(s) for s in x.sum(0)]
    mean = tuple(np.array(c) for c in zip(*(whitening.as_dd(s, n) for s in total)))
    hi, lo = whitening.centred(x, mean)
    zero = (np.zeros((d, d)), np.zeros((d, d)))
    halves = whitening.dd_add(whitening.outer(hi[:300], lo[:300], zero), whitening.outer(hi[300:], lo[300:], zero))
    u = x.astype(object) * n - np.array(total, object)
    exact = u.T @ u
    most = max(abs(int(c)) for c in exact.ravel())
    for i in range(d):
        for j in range(d):
            off = Fraction(float(halves[0][i, j])) + Fraction(float(halves[1][i, j])) - Fraction(int(exact[i, j]), n * n)
            assert abs(off) * n * n < most * 1e-21
    e, v = whitening.eigen(halves)
    w = (hi @ v + lo @ v) / np.sqrt(e / n)
    assert np.abs(w.T @ w / n - np.eye(d)).max() < 1e-5
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-14 and (np.diff(e) <= 0).all()


def test_deviations_of_any_size():
    x = np.array([[10**6, 3], [10**6 + 5, 4]])
    assert whitening.deviations(x, 2, [2 * 10**6 + 5, 7]) == [26, 26]
    big = np.array([[2**40, 0], [0, 2**40]])
    assert whitening.deviations(big, 2, [2**40, 2**40]) == [None, None]
    assert whitening.deviations(big, 1, [2**40 - 2**30, 2**40]) == [None, None]
    assert whitening.deviations(np.array([[2**31, 0]]), 2, [2**32 - 3, 0]) == [9]
