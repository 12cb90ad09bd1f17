import random

import numpy as np
from pyspark.sql import functions as F

from parchment.llm import language, quality
from parchment.llm.common import crc_fold

from .conftest import make


def corpus(n=1500):
    rng = random.Random(12)
    words = {"en": "the of and to in that is was for it with as his on be at by".split(), "fr": "le la les des une est que dans pour pas sur au par plus avec".split()}
    rows, labels = [], []
    for i in range(n):
        lang = ("en", "fr")[i % 2]
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(20, 60)))
        bad = rng.random() < 0.3
        if bad:
            text = " | ".join(text.upper().split()) + "!!!"
        rows.append((i, text, lang, "s"))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_quality_on_the_held_out_fold(spark, odd, odd_rows, empty):
    rows, labels = corpus()
    truth = dict(labels)
    table = spark.createDataFrame([*labels, (None, 1), (99_999, None)], "doc_id long, quality int")
    got = quality.quality_scores(make(spark, rows), table).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and 200 < len(held) < 400
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    again = quality.quality_scores(make(spark, rows), table).collect()
    assert {r.doc_id: r.score for r in got} == {r.doc_id: r.score for r in again}
    odd_scores = quality.quality_scores(odd, table).collect()
    assert len(odd_scores) == len(odd_rows) and all(r.score is not None for r in odd_scores)
    assert quality.quality_scores(empty, table).count() == 0
    assert {r.score for r in quality.quality_scores(odd, table.limit(0)).collect()} == {0.5}
    assert quality.accepted(odd, table).columns == odd.columns


def test_held_out_labels_are_never_learned(spark):
    rows, labels = corpus(400)
    docs = make(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    turned = table.withColumn("quality", F.when(crc_fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, t) for t in (table, turned))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.steps[1], b.steps[1])


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=30).round(1), rng.integers(0, 2, 30).astype(float)
    knots, values = quality.isotonic(x, y)
    assert (np.diff(values) >= -1e-12).all() and (np.diff(knots) >= 0).all()
    order = np.argsort(x, kind="stable")
    z = y[order]
    want = [max(min(z[a : b + 1].mean() for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]  # max-min formula
    assert np.allclose(sorted(set(np.round(want, 9))), sorted(set(np.round(values, 9))))


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    n = quality.N_STATISTICS
    model = quality.Model(mean=np.zeros(n), scale=np.ones(n), frequency=rng.normal(size=(n, 4096)) / np.sqrt(n), phase=rng.uniform(0, 2 * np.pi, 4096))
    x = rng.normal(size=(12, n))
    gram = model.lift(x) @ model.lift(x).T * quality.FEATURES / 4096
    exact = np.exp(-((x[:, None] - x[None, :]) ** 2).sum(-1) / (2 * n))
    assert np.abs(gram - exact).max() < 0.1


def test_language_on_the_held_out_fold(spark, odd, odd_rows, empty):
    rows, _ = corpus(800)
    truth = {i: lang for i, _, lang, _ in rows}
    got = language.languages(make(spark, rows), steps=60).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    by = language.languages(odd, steps=5).collect()
    assert len(by) == len(odd_rows)
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 11) or (r.doc_id is None and r.score == 0)) for r in by)
    assert language.languages(empty).count() == 0


def test_gradients_of_the_network():
    rng = np.random.default_rng(5)
    layer = language.Direction(rng, 3)
    layer.e, layer.u = layer.e.astype(np.float64), layer.u.astype(np.float64)
    x = rng.integers(1, 256, (6, 4)).astype(np.uint8)
    goal = rng.normal(size=(6, 3, 4)).astype(np.float32)
    loss = lambda: float((layer.run(x).astype(np.float64) * goal).sum())
    _, kept = layer.run(x, True)
    d_e, d_u = layer.back(x, kept, goal)
    for param, grad, cells in ((layer.u, d_u, [(0, 0), (4, 1), (8, 2)]), (layer.e, d_e, [(r, int(x[2, 1])) for r in (0, 4, 8)])):
        for c in cells:
            old = param[c]
            param[c] = old + 1e-2
            up = loss()
            param[c] = old - 1e-2
            down = loss()
            param[c] = old
            assert abs((up - down) / 2e-2 - grad[c]) < 2e-2 * max(1, abs(grad[c]))


def test_windows_label_every_byte():
    network = language.Network(["a", "b"])
    texts = [b"x" * 5, b"abc" * 200, b""]
    whole = network.documents(texts)
    alone = np.concatenate([network.documents([t]) for t in texts])
    assert np.allclose(whole, alone, atol=1e-5) and np.allclose(whole[:2].sum(axis=1), 1)
