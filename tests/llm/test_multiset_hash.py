import hashlib
import random

from pyspark.sql import functions as F

from parchment.llm import multiset_hash as mh

from .conftest import make


def test_edited_texts_and_likeness(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    rows = [(3 * i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 12))) + "." for _ in range(rng.randint(12, 30))), "en", "s") for i in range(60)]
    rows[7] = (21, rows[6][1], "en", "s")
    got = {r.doc_id: r for r in mh.fingerprints_with_edits(make(spark, rows)).collect()}
    for (i, t, *_), (_, nxt, *_) in zip(rows, rows[1:] + rows[:1]):
        q = len(t) // 4
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
        assert 0.4 < got[i].near_edited < 1 and (got[i].near_next < 0.45 or i == 18)
    assert got[18].fingerprint == got[21].fingerprint and got[18].near_next == 1.0
    assert len({r.fingerprint for r in got.values()}) == 59


def test_order_doesnt_matter_and_bags_add_up(spark):
    df = spark.createDataFrame([(1, "a b\nc d\ne f"), (2, "e f\na b\nc d"), (3, "a b"), (4, "c d\ne f")], "id long, t string")
    v = {r.id: r for r in mh.bag_hashes(df, ["id"], "t").collect()}
    assert v[1].exact == v[2].exact and v[1].sketch == v[2].sketch
    h = mh.bag_hashes(df, ["id"], "t")
    a, b = h.where("id = 3").select(F.col("exact").alias("e1"), F.col("sketch").alias("s1")), h.where("id = 4").select(F.col("exact").alias("e2"), F.col("sketch").alias("s2"))
    both = a.join(b).select(mh.combine(F.col("e1"), F.col("e2"), 32).alias("e"), mh.combine(F.col("s1"), F.col("s2"), 16).alias("s")).first()
    assert both.e == v[1].exact and both.s == v[1].sketch
    less = h.where("id = 1").join(a).select(mh.combine(F.col("exact"), F.col("e1"), 32, -1).alias("e"), mh.combine(F.col("sketch"), F.col("s1"), 16, -1).alias("s")).first()
    assert less.e == v[4].exact and less.s == v[4].sketch


def test_a_line_repeated_thousands_of_times(spark):
    line = "a line of eight words that comes again and again.\n"
    wide = "x" * 70 + ".\n"
    rows = [(i, f"{wide * n}{line * 3}", "en", "s") for i, n in enumerate((4200, 5000, 10000, 40000))]
    got = {r.doc_id: r for r in mh.fingerprints_with_edits(make(spark, rows)).collect()}
    assert all(r.near_edited > 0.99 and r.near_next > 0.99 for r in got.values())
    df = spark.createDataFrame([(1, wide * 5000 + line), (2, wide * 5000), (3, line)], "id long, t string")
    h = mh.bag_hashes(df, ["id"], "t")
    whole, a, b = (h.where(f"id = {i}").select(F.col("sketch").alias(f"s{i}")) for i in (1, 2, 3))
    r = whole.join(a).join(b).select("s1", "s2", "s3", mh.combine(F.col("s2"), F.col("s3"), 32, 1, True).alias("sum"), mh.combine(F.col("s1"), F.col("s3"), 32, -1, True).alias("less")).first()
    assert r["sum"] == r.s1 and r.less == r.s2 and max(map(abs, r.s2)) == 40_000


def test_odd_cases(spark, odd, odd_rows, empty):
    got = mh.fingerprints_with_edits(odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    blank = {r.fingerprint for r in got if r.n_chars == 0}
    assert blank == {"0" * 544}
    assert len({r.fingerprint for r in got if r.doc_id in (5, 9)}) == 1
    assert mh.fingerprints_with_edits(empty).collect() == []
    alone = mh.fingerprints_with_edits(make(spark, [(1, "abcdefgh", "en", "s")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and alone.near_next == 1.0
