"""Language-model scores against plain versions of their parts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from parchment.llm import attention
from parchment.llm.attention import LEFT, STRIDE

from .conftest import make

SMALL = {"sample": 300, "steps": 60}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = {"en": "the of and to in that is was for it with as his on be at by".split(), "fr": "le la les des une est que dans pour pas sur au par plus avec".split()}
    rows = [(1000 + i, " ".join(rng.choice(words[("en", "fr")[i % 2]]) for _ in range(rng.randint(5, 60))), "x", "s") for i in range(600)]
    return rows + [(2700, "Only HERE, " + "ñ" * 200 + " la", "x", "s"), (20, "the of   x", "x", "s")]


def plain_base(rows):
    """n_tokens, n_known, N and base score of each row, by the contract's own words."""
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = [[*(t or "").encode().translate(lower).split(), None] for _, t, *_ in rows]
    c = Counter()
    for (i, *_), words in zip(rows, tokens):
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            c.update(words)
    n, v = sum(c.values()), len(c)
    return [(len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for w in tokens]


@pytest.mark.parametrize("hot", [3, 200_000])
def test_base_against_plain_counts(spark, odd_rows, corpus, hot):
    rows = corpus + odd_rows
    got = attention.scores(make(spark, rows), hot=hot, **SMALL).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = sorted(((i, *p) for (i, *_), p in zip(rows, plain_base(rows))), key=key)
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(want, found):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-7 * max(1, abs(a[4]))
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    texts = {i: {t or "" for j, t, *_ in rows if j == i} for i, *_ in rows if i is not None}
    by = {}
    for r in got:
        if r.doc_id is not None and len(texts[r.doc_id]) == 1:
            by.setdefault(next(iter(texts[r.doc_id])), set()).add(round(r.score, 3))
    assert all(len(v) == 1 for v in by.values())  # equal texts, equal scores


def test_held_out_texts_score_better_than_by_counts(spark, corpus):
    got = [r for r in attention.scores(make(spark, corpus), **SMALL).collect() if r.held_out]
    assert len(got) > 30 and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_held_out_texts_are_never_learned(spark, corpus):
    changed = [(i, t if zlib.crc32(str(i).encode()) % 10 else "zzz " * 9, *r) for i, t, *r in corpus]
    a, b = ({r.doc_id: (r.train_tokens, r.score) for r in attention.scores(make(spark, rows), **SMALL).collect()} for rows in (corpus, changed))
    same = [i for i, *_ in corpus if zlib.crc32(str(i).encode()) % 10]
    assert all(a[i] == b[i] for i in same)


def test_nothing_to_learn_from(spark, empty):
    assert attention.scores(empty, **SMALL).count() == 0
    got = attention.scores(make(spark, [(None, "a b", "x", "s"), (None, None, None, None)]), **SMALL).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


@pytest.fixture(scope="module")
def model(spark, corpus):
    docs = make(spark, corpus)
    counts = attention.word_counts(attention.learned(docs))
    return attention.fit(docs, counts, attention.learned(docs).count(), sample=300, steps=20)[0]


def test_probabilities_sum_to_one(model):
    """Over all ids and the end, after any text: classes sum to one, and so do the shares of each class."""
    c = model.classes
    texts = [[], [b"the"], [b"le", b"la", b"unseen"]]
    flat, _, n, _ = model.tokens(texts)
    x, y, weight, per = model.windows(flat, n)
    for j in range(STRIDE):
        total = sum(np.exp(model.network.losses(x, np.full_like(y, k)))[:, j] for k in range(c.n))
        assert np.allclose(total, 1, atol=1e-4)
    every = np.arange(len(c.of))
    opening = every[c.opens]
    assert np.allclose(np.bincount(c.of[opening], np.exp(c.share[opening]), minlength=c.n)[np.unique(c.of[opening])], 1)
    inner = every[~c.opens]
    for before in (model.subwords.encode([b"the"])[0][0], model.subwords.encode([b"qqqq"])[0][-1]):
        pairs = np.stack([np.full(len(inner), before), inner], axis=1).ravel()
        shares = c.shares(pairs, np.full(len(inner), 2))[1::2]
        assert np.allclose(np.bincount(c.of[inner], np.exp(shares), minlength=c.n)[np.unique(c.of[inner])], 1)
    assert not set(c.of[opening]) & set(c.of[inner])


def test_windows_score_each_token_once(model):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, len(model.classes.of), 3 * STRIDE + 5)
    lengths = np.array([0, 5, len(ids) - 5])
    x, y, weight, per = model.windows(ids, lengths)
    assert weight.sum() == len(ids) + 3 and list(per) == [1, 1, -(-(len(ids) - 4) // STRIDE)]
    kinds, end = model.classes.kind[ids[5:]], model.classes.end_kind
    before = np.concatenate([np.full(LEFT + 1, end), kinds])
    own = x[2:]
    for w in range(len(own)):  # query j of window w stands for token w * STRIDE + j, and its last key is the token before
        for j in range(STRIDE):
            i = w * STRIDE + j
            if i <= len(kinds):
                assert (own[w, : LEFT + j + 1] == before[max(0, i - j) : i + LEFT + 1]).all()
    logs = model.network.losses(x, y)
    later = x.copy()
    later[:, LEFT + 7 :] = 0  # what lies ahead changes nothing
    assert np.allclose(model.network.losses(later, y)[:, :7], logs[:, :7], atol=1e-5)
    assert np.allclose(model.network.losses(x, y, True), logs, atol=1e-4)


def test_gradients_of_the_network():
    rng = np.random.default_rng(5)
    net = attention.Network(rng.normal(size=(9, 7)))
    for name in ("q", "k", "v", "u", "far", "t"):
        setattr(net, name, rng.normal(size=getattr(net, name).shape) * 0.5)
    net.bias = lambda: np.where((g := np.arange(STRIDE)[:, None] + LEFT - np.arange(LEFT + STRIDE)) >= 0, net.far[np.maximum(g, 0)], -1e4)
    x, y = rng.integers(0, 9, (3, LEFT + STRIDE)), rng.integers(0, 7, (3, STRIDE))
    weight = rng.random((3, STRIDE)) < 0.8
    loss = lambda: -(net.losses(x, y) * weight).sum() / weight.sum()
    for p, g in zip(net.parameters(), net.gradients(x, y, weight)):
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 12)]:
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_subwords_of_odd_words():
    own = attention.Subwords.load()
    words = [b"the", " ".encode(), "a b".encode(), b"x", b"'s", "é".encode(), b"don't", b"\x1c", b"a" * 3000]
    ids, lengths = own.encode(words)
    alone = [own.encode([w]) for w in words]
    assert ids.tolist() == [i for a, _ in alone for i in a.tolist()] and lengths.tolist() == [int(n.sum()) for _, n in alone]
    assert own.encode([])[0].tolist() == []
    assert attention.short(b"abc") == b"abc" and len(attention.short(b"a" * 65)) == 65


def test_every_part_of_a_text_is_learned_from(spark):
    """Words change places at the start, in the middle or at the end of a long text, which changes no count of words: each change is learned."""
    i = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10)
    out = next(i for i in range(100, 200) if not zlib.crc32(str(i).encode()) % 10)
    words = [f"{a} {b}" for a, b in zip("the of and to in that is was".split() * 100, "for it with as his on be at by".split() * 100)]

    def score(at):
        own = list(words)
        if at is not None:
            own[at : at + 60] = sorted(own[at : at + 60])
        return {r.doc_id: r.score for r in attention.scores(make(spark, [(i, " ".join(own), "x", "s"), (out, " ".join(words[:50]), "x", "s")])).collect()}[out]

    base = score(None)
    assert all(score(at) != base for at in (0, len(words) // 2, len(words) - 60))


def test_neighbours_are_counted_over_all_texts(spark, corpus):
    """Against a plain count of pairs of kinds in all training texts."""
    docs = make(spark, corpus)
    counts = attention.word_counts(attention.learned(docs))
    coder = attention.prepared(docs, counts, 0, attention.TOKENIZER, 5)[0]
    shipped = spark.sparkContext.broadcast(coder)
    kind, kinds = attention.ranked(attention.subword_counts(counts, spark.sparkContext.broadcast(coder.subwords)))[1:]
    near, after = attention.neighbours(attention.coded(docs, shipped).where("round is not null"), shipped, kind, kinds)
    want_near, want_after = np.zeros_like(near), np.zeros_like(after)
    for j, t, *_ in corpus:
        if zlib.crc32(str(j).encode()) % 10:
            k = kind[ids := coder.subwords.encode(attention.words_of(t))[0]].tolist()
            for a in range(len(k)):
                for b in range(max(0, a - attention.NEAR), min(len(k), a + attention.NEAR + 1)):
                    if a != b and k[b] < attention.OWN:
                        want_near[k[a], k[b]] += 1
            to = [kinds + 1 if c == kinds - 1 and coder.subwords.opens[w] else c for c, w in zip(k, ids)]
            for a, b in zip([kinds, *k], [*to, kinds]):
                want_after[a, b] += 1
    assert (near == want_near).all() and (after == want_after).all()


@pytest.mark.parametrize("kinds", [20, 300])
def test_neighbours_against_a_plain_count(spark, corpus, kinds):
    """What stands near what, ends of texts left out, whatever the kinds: the ends' own kind may be one of the first."""
    docs = make(spark, corpus[:40] + corpus[-2:] + [(1, "", "x", "s"), (2, "the", "x", "s")])
    coder = attention.Coder(attention.Subwords.load(), [(b"the", 5), (b"la", 3)])
    shipped = spark.sparkContext.broadcast(coder)
    table = attention.coded(docs, shipped).cache()
    kind = np.arange(len(coder.subwords.opens)) * 7919 % kinds
    near, after = attention.neighbours(table, shipped, kind, kinds)
    want, follows = np.zeros((kinds, attention.OWN), int), np.zeros(kinds + 1, int)
    for r in table.collect():
        k = [int(kind[i]) for i in np.frombuffer(r.ids, coder.type)]
        for i, a in enumerate(k):
            for c in k[max(0, i - attention.NEAR) : i] + k[i + 1 : i + 1 + attention.NEAR]:
                if c < attention.OWN:
                    want[a, c] += 1
        follows += np.bincount([kinds, *k], minlength=kinds + 1)
    assert (near[:, : min(kinds, attention.OWN)] == want[:, : min(kinds, attention.OWN)]).all() and (after.sum(axis=1) == follows).all()
    if kinds < attention.OWN:
        assert not near[:, kinds:].any()
