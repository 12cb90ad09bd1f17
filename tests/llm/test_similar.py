import random
import re

import numpy as np

from parchment.llm import similar as sm

from .conftest import make


def plain_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def plain_groups(rows, similarity=0.8):
    """doc_id -> least doc_id that links of the similarity reach, by all pairs."""
    sets = {i: plain_set(t) for i, t, *_ in rows}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            x, y = sets[a], sets[b]
            if a < b and group[a] != group[b] and (x == y or len(x & y) >= similarity * len(x | y)):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    return group


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = "x" + str(rng.random())
    return words


def test_groups_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):  # four edits of 300 words leave 0.88 at least, sixty leave less than 0.6
        base = [rng.choice("abcdefgh") + str(rng.randint(0, 500)) for _ in range(300)]
        for n in (0, 0, 1, 2, 4, 60, 60):
            rows.append((len(rows), " ".join(edited(rng, base, n)), "en", "s"))
    chain = [f"c{i}" for i in range(400)]  # each is like the next, the first not like the last
    rows += [(len(rows) + k, " ".join(chain[20 * k : 20 * k + 300]), "en", "s") for k in range(6)]
    rows += [(len(rows), "Two  WORDS", "en", "s"), (len(rows) + 1, "two words", "en", "s"), (len(rows) + 2, "", "en", "s"), (len(rows) + 3, None, "en", "s")]
    rng.shuffle(rows)
    want = plain_groups(rows)
    for most in (sm.CELL_MOST, 2):  # 2: nearly no cell is held
        found, g = sm.groups(make(spark, rows), cell_most=most)
        got = {r.doc_id: r.g_id for r in found.join(g, found.node == g.g_node).collect()}
        assert got == want
    kept = sm.deduplicated(make(spark, rows))
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == make(spark, rows).columns


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    rows = [(i, " ".join(edited(rng, base, 2)), "en", "s") for i in range(300)] + [(300 + i, " ".join(edited(rng, base, 60)), "en", "s") for i in range(20)]
    want = plain_groups(rows)
    for most in (sm.CELL_MOST, 50):
        found, g = sm.groups(make(spark, rows).repartition(7), cell_most=most)
        assert {r.doc_id: r.g_id for r in found.join(g, found.node == g.g_node).collect()} == want


def test_stars_connect_what_pairs_connect():
    rng = np.random.default_rng(1)
    for n in (2, 5, 40):
        for _ in range(30):
            centres = rng.integers(0, 1 << 63, (3, sm.WORDS), dtype=np.uint64)
            fps = centres[rng.integers(0, 3, n)] ^ (np.uint64(1) << rng.integers(0, 64, (n, sm.WORDS), dtype=np.uint64)) * (rng.random((n, sm.WORDS)) < 0.5)
            only = rng.random(n) < 0.5
            for mask in (None, only):
                linked = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= 9
                if mask is not None:
                    linked &= mask[:, None] | mask[None, :]
                parts = []
                for edges in (list(zip(*np.nonzero(linked))), [e[1:] for e in sm.stars(np.arange(n), fps, 9, 9, mask) if e[0] == 0]):
                    label = list(range(n))
                    for u, v in edges:
                        old, new = max(label[u], label[v]), min(label[u], label[v])
                        label = [new if x == old else x for x in label]
                    parts.append(label)
                assert parts[0] == parts[1]


def test_pairs_about_the_threshold(spark):
    """Similarities of 0.75 to 0.85: none below 0.8 is linked, and of those above nearly all are."""
    rng = random.Random(5)
    rows = []
    for _ in range(150):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
        rows += [(len(rows), " ".join(base), "en", "s"), (len(rows) + 1, " ".join(base[: rng.randint(300, 340)]), "en", "s")]
    want = plain_groups(rows)
    found, g = sm.groups(make(spark, rows))
    got = {r.doc_id: r.g_id for r in found.join(g, found.node == g.g_node).collect()}
    assert not [i for i in got if got[i] != i and want[i] == i]
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 50 and sum(got[i] == want[i] for i in linked) >= 0.95 * len(linked)


def parts(n, edges):
    label = list(range(n))
    for u, v in edges:
        old, new = max(label[u], label[v]), min(label[u], label[v])
        label = [new if x == old else x for x in label]
    return label


def family(rng, members, hashes=200):
    """Sets that share most of what they hold, with similarities about 0.8."""
    common = rng.integers(0, 1 << 63, int(hashes * rng.uniform(0.84, 0.92)), dtype=np.uint64)
    return [np.unique(np.r_[common, rng.integers(0, 1 << 63, hashes - len(common), dtype=np.uint64)]) for _ in range(members)]


def plain_links(sets, similarity=0.8):
    return [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= similarity * len(np.union1d(sets[i], sets[j]))]


def mutated(rng, members, hashes=200):
    """Each set keeps a random 0.85 to 0.95 of one base, so pairs scatter to both sides of 0.8."""
    base = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)
    out = []
    for _ in range(members):
        own = base.copy()
        at = rng.choice(hashes, int(hashes * rng.uniform(0.05, 0.15)), replace=False)
        own[at] = rng.integers(0, 1 << 63, len(at), dtype=np.uint64)
        out.append(np.unique(own))
    return out


def test_groups_about_the_threshold_lose_no_link():
    """What a cell says (links, and members to be compared), then the comparison: equal to all pairs, for every group."""
    rng = np.random.default_rng(11)
    sure, most = sm.zone(0.8)
    lost = links = 0
    for members in [3] * 300 + [6] * 150 + [25] * 10:
        sets = mutated(rng, members) if members % 2 else family(rng, members)
        fps = sm.unpacked([sm.signature(h)[1] for h in sets])
        told = sm.stars(np.arange(members), fps, sure, most)
        label = parts(members, [e[1:] for e in told if e[0] == 0])
        open_ = np.array(sorted({u for kind, u, _ in told if kind == 2}), int)
        more = sm.connected(open_, [sets[i] for i in open_], np.array(label)[open_], 0.8) if len(open_) > 1 else []
        want = plain_links(sets)
        links += len(want)
        lost += parts(members, [e[1:] for e in told if e[0] == 0] + more) != parts(members, want)
    assert links > 900 and lost == 0


def test_triples_about_the_threshold(spark):
    """The whole search on texts, where a link holds a triple together that the nearest pair doesn't."""
    rng = random.Random(8)
    rows = []
    for _ in range(120):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
        for _ in range(3):
            rows.append((len(rows), " ".join(edited(rng, base, rng.randint(3, 12))), "en", "s"))
    sets = {i: plain_set(t) for i, t, *_ in rows}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = {}
    for k in range(0, len(rows), 3):
        label = parts(3, [(i, j) for i in range(3) for j in range(i) if near(k + i, k + j)])
        want |= {k + i: k + label[i] for i in range(3)}
    assert 20 < sum(want[i] != i for i in want) < 220
    for bytes_ in (sm.BLOCK_BYTES, 4000):  # 4000: a cell's sets don't fit a block
        before, sm.BLOCK_BYTES = sm.BLOCK_BYTES, bytes_
        try:
            found, g = sm.groups(make(spark, rows))
            assert {r.doc_id: r.g_id for r in found.join(g, found.node == g.g_node).collect()} == want
        finally:
            sm.BLOCK_BYTES = before


def test_a_full_cell_of_doubtful_members():
    """8192 fingerprints 150 bits apart: memory grows with members, not with pairs."""
    import tracemalloc

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, sm.WORDS, dtype=np.uint64)
    bits = np.zeros((sm.CELL_MOST, 1024), np.uint8)
    np.put_along_axis(bits, rng.random((sm.CELL_MOST, 1024)).argpartition(75, axis=1)[:, :75], 1, axis=1)  # pairs differ in about 139 bits
    fps = base ^ np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    tracemalloc.start()
    told = sm.stars(np.arange(len(fps)), fps, *sm.zone(0.8))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {kind for kind, *_ in told} == {2} and len(told) == len(fps) and most < 50e6


def test_odd_rows(spark, odd, odd_rows, empty):
    assert sm.deduplicated(empty).count() == 0
    kept = sm.deduplicated(odd).collect()
    assert sorted(r.doc_id for r in kept) == [1, 4, 5, 6, 11]  # 6: the passage and its two neighbours; 5: the long text
    assert {r.doc_id for r in sm.deduplicated(odd.where("doc_id is null")).collect()} == {None}


def test_radius_is_that_of_the_similarity():
    rng = random.Random(6)
    for target in (0.7, 0.8, 0.9):
        far = []
        for _ in range(60):
            common = int(2000 * target)
            a = np.array([rng.getrandbits(64) for _ in range(2000)], np.uint64)
            rest = (2000 - common) // 2
            x, y = np.unique(a[: common + rest]), np.unique(np.r_[a[:common], a[common + rest :]])
            far.append(np.bitwise_count(sm.unpacked([sm.signature(x)[1]]) ^ sm.unpacked([sm.signature(y)[1]])).sum())
        assert abs(np.mean(far) - sm.radius(target)) < 6
