import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parchment.llm import mixing

from .conftest import make


def plain_targets(sizes, weights=(3, 1, 2), ratio=1.5, cap=2.0):
    """Share by weight, stop at the caps, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {s: 0.0 for s in names}, set(names), ratio * sum(sizes.values())
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        share = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_targets_and_whole_quotas(spark):
    docs = make(spark, [(i, "w " * (i % 40 + 1), "en", f"s{i % 7 if i % 3 else 0}") for i in range(300)])
    got = rows_of(mixing.mix_by_document(docs, block_words=8, shard_blocks=32))
    sizes = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = rows_of(mixing.mix_by_document(docs.orderBy(F.desc("doc_id")), block_words=8, shard_blocks=32))
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in again}


def test_draws_are_disjoint_and_shards_even(spark):
    docs = make(spark, [(i, "w " * 50, "en", f"s{i % 3}") for i in range(120)])
    draws, _, _ = mixing.mix(docs, block_words=10, shard_blocks=50)
    rows = rows_of(draws)
    assert len({(r["row"], r["block"], r["pass"]) for r in rows}) == len(rows)
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r["slot"])
    assert len(shards) == 32 and max(map(len, shards.values())) - min(map(len, shards.values())) <= 6  # halves of halves
    assert all(sorted(s) == list(range(1, len(s) + 1)) for s in shards.values())


def test_tree_keeps_quotas_and_follows_the_law(spark):
    start = spark.sql("select array(400L, 0L, 100L, 3L) as quotas")
    leaves = mixing.split_tree(start, 3).collect()
    assert [sum(x) for x in zip(*[r.quotas for r in leaves])] == [400, 0, 100, 3]
    assert all(sum(r.quotas) in (62, 63) for r in leaves)
    firsts = [mixing.split_tree(start, 1, seed).orderBy("node").first().quotas[2] for seed in range(40)]
    mean = sum(firsts) / len(firsts)
    assert abs(mean - 50 * 252 / 251.5) < 4 and len(set(firsts)) > 5  # sd of one draw is about 4.5


def test_odd_cases(spark, odd, odd_rows, empty):
    got = rows_of(mixing.mix_by_document(odd))
    assert len(got) == len(odd_rows)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert rows_of(mixing.mix_by_document(empty)) == []
    kept = mixing.mixed_documents(odd)
    assert kept.columns == [*(c for c in odd.columns if c != "taken"), "taken"] and mixing.mixed_documents(empty).count() == 0
    total = sum(r["taken"] for r in got)
    assert kept.agg(F.sum("taken")).first()[0] == total


def test_order_of_rows_does_not_matter(spark):
    rng = random.Random(12)
    rows = [(1, " ".join(["w"] * rng.randint(400, 3000)) + f" {i}", "en", "a") for i in range(8)]  # one doc_id
    rows += [(i, " ".join(["w"] * rng.randint(1, 900)), "en", rng.choice("abc")) for i in range(2, 60)]
    result = lambda r, parts: sorted(map(tuple, mixing.mix_by_document(make(spark, r).repartition(parts)).collect()), key=repr)
    want = result(rows, 1)
    assert result(rows[::-1], 1) == want and result(rng.sample(rows, len(rows)), 3) == want


def test_sums_before(spark):
    rng = random.Random(4)
    rows = [(k, at, rng.randint(0, 9), rng.randint(0, 9)) for k in (0, 1) for at in rng.sample(range(500), 200)]
    got = mixing.sums_before(spark.createDataFrame(rows, "k int, at long, a long, b long"), "k", "at", {"a": "a0", "b": "b0"}, 16).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.a0, r.b0) == tuple(sum(x[c] for x in rows if x[0] == r.k and x[1] < r["at"]) for c in (2, 3))
