import hashlib
import random

import numpy as np
import pytest

from parchment.llm import substring_dedup as sd
from parchment.llm.fm_index import FMIndex

from .conftest import make


def plain(rows, threshold):
    """(doc_id, n_words, n_removed, sha) of every row, from sets of windows."""
    rank = lambda i: (1 << 70) if i is None else i
    least = {}
    words = [(i, sd.words_of(t)) for i, t, *_ in rows]
    for i, w in words:
        for p in range(len(w) - threshold + 1):
            key = tuple(w[p : p + threshold])
            least[key] = min(least.get(key, 1 << 80), rank(i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - threshold + 1):
            if least[tuple(w[p : p + threshold])] < rank(i):
                gone[p : p + threshold] = [True] * threshold
        left = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("most, shard_words", [(2000, 300_000), (2, 300), (0, 100), (2000, 500)])
def test_against_brute_force(spark, most, shard_words):
    rng = random.Random(13)
    passages = [[rng.choice("abcde") for _ in range(rng.randint(20, 200))] for _ in range(6)]
    rows = []
    for i in range(70):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "z"
            w += p + [str(rng.random())] * rng.randint(0, 3)
        rows.append((rng.randint(0, 40), " ".join(w), "en", "s"))
    assert got(sd.remove_repeats(make(spark, rows), most=most, shard_words=shard_words)) == plain(rows, 50)


@pytest.mark.parametrize("most", [2000, 0])
def test_passage_twice_in_the_first_document_that_has_its_segment(spark, most):
    x, y, u, v, m = (" ".join(f"{k}{i}" for i in range(60)) for k in "xyuvm")
    p = " ".join(f"p{i}" for i in range(80))
    rows = [(1, f"{x} {p} {y}", "en", "s"), (2, f"{u} {p} {v} {m} {u} {p} {v}", "en", "s"), (3, f"{u} {p} {v}", "en", "s")]
    rows += [(5, f"{x} {m}", "en", "s"), (5, f"{y} {v} {m} {v}", "en", "s")]  # two rows of one document
    got_rows = got(sd.remove_repeats(make(spark, rows), most=most))
    assert got_rows == plain(rows, 50) and [r[2] for r in got_rows if r[0] == 2] == [160]


def test_odd_cases(spark, odd, odd_rows, empty):
    assert got(sd.remove_repeats(odd)) == plain(odd_rows, 50)
    assert sd.remove_repeats(empty).collect() == []
    assert "kept" not in sd.remove_repeats(odd, with_text=False).columns


def test_index_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 40, rng.integers(1, 12))
        symbols = rng.integers(0, 3, lengths.sum())
        docs = rng.integers(0, 6, len(lengths))
        threshold = int(rng.integers(2, 9))
        index = FMIndex(symbols, lengths, docs, 3, threshold)
        parts = np.split(symbols, np.cumsum(lengths)[:-1])
        least = {}
        for d, p in zip(docs, parts):
            for k in range(len(p) - threshold + 1):
                key = tuple(p[k : k + threshold])
                least[key] = min(least.get(key, 99), d)
        asked = [rng.integers(0, 3, n) for n in rng.integers(1, 40, 5)] + parts
        owners = np.concatenate([rng.integers(0, 7, 5), docs])
        text, place = index.stream(np.concatenate(asked), np.array([len(a) for a in asked]), owners)
        want = {(i, k) for i, (a, d) in enumerate(zip(asked, owners)) for k in range(len(a) - threshold + 1) if least.get(tuple(a[k : k + threshold]), 99) < d}
        assert {*zip(text.tolist(), place.tolist())} == want
