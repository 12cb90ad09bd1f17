import random

from pyspark.sql import functions as F

from parchment.operators import casting, layout, review, sequence
from parchment.streaming import jobs


def plain_range(sizes, gap=2):
    """Longest run of dense pages, numbered from 1."""
    need = max(60, 0.35 * sorted(sizes)[len(sizes) // 2])
    dense = [i for i, s in enumerate(sizes) if s >= need]
    if not dense:
        return 1, len(sizes)
    runs, start = [], dense[0]
    for a, b in zip(dense, [*dense[1:], None]):
        if b is None or b - a > gap + 1:
            runs.append((start, a))
            start = b
    best = max(runs, key=lambda r: (r[1] - r[0], -r[0]))
    return best[0] + 1, best[1] + 1


def test_dense_range_against_a_plain_loop(spark):
    rng = random.Random(3)
    groups = {g: [rng.choice((0, 10, 80, 300, 900)) for _ in range(rng.randint(1, 30))] for g in range(80)}
    df = spark.createDataFrame([(g, i + 1, float(s)) for g, ss in groups.items() for i, s in enumerate(ss)], "g int, pos long, size double")
    for r in sequence.dense_range(df, ["g"], "pos", "size").collect():
        assert (r["first"], r["last"]) == plain_range(groups[r.g])


def test_even_spread(spark):
    df = spark.createDataFrame([(n, i) for n in range(1, 25) for i in range(n)], "g int, i int")
    for k in (1, 3, 7):
        got = {}
        for r in sequence.even_spread(df, ["g"], ["i"], k).collect():
            got.setdefault(r.g, []).append(r.i)
        assert {g: sorted(v) for g, v in got.items()} == {n: (list(range(n)) if n <= k else [int(i * n / k) for i in range(k)]) for n in range(1, 25)}


def test_nearest_rank(spark):
    rng = random.Random(5)
    values = {g: [rng.randint(0, 9) for _ in range(rng.randint(1, 30))] for g in range(30)}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g int, v int")
    for r in layout.nearest_rank(df, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.99}).collect():
        s = sorted(values[r.g])
        assert (r.a, r.m, r.z) == tuple(s[min(len(s) - 1, int(len(s) * f))] for f in (0.1, 0.5, 0.99))


def test_alignment_and_guards(spark):
    pairs = spark.createDataFrame([(1, "le chat noir trouVait un arbre", "le chien noir trouvait un bel arbre mort"), (2, None, "x")], "id long, raw string, clean string")
    assert {(r.offset, r.word, r.expected) for r in review.alignment_truth(pairs).collect()} == {(3, "chat", "chien"), (13, "trouVait", "trouvait")}
    cases = [("Mason", "Maison", True, "Maison", ""), ("Mason", "maison", True, "", "capital lost"), ("mot", None, True, "", ""), ("mot", "mots!", True, "", "punctuation brought in"),
             ("mot", "a b c", True, "", "3 words"), ("mot", "tout", True, "", "2 > 1"), ("mot", "mat", False, "", "not in the lexicon"), ("l’ane", "l'âne", True, "l’âne", "")]
    df = spark.createDataFrame(cases, "w string, p string, k boolean, want string, cause string")
    for r in df.withColumn("g", review.guard(F.col("w"), F.col("p"), F.col("k"))).collect():
        assert (r.g.replacement, r.g.cause) == (r.want, r.cause)


def test_envelope(spark):
    rows = [("a", i, t) for i, t in enumerate(["notice", "START", "x", "y", "END", "licence"])] + [("b", i, t) for i, t in enumerate(["x", "END", "z"])] + [("c", 0, "x")]
    kept = sequence.envelope_trim(spark.createDataFrame(rows, "k string, pos int, t string"), ["k"], "pos", F.col("t") == "START", F.col("t") == "END")
    assert sorted((r.k, r.t) for r in kept.collect()) == [("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")]


def test_signature_round_trip(spark):
    df = spark.createDataFrame([("xtts", "Ann", {"Zoe": "z", "bob": "b"}, 0.8)], "b string, v string, r map<string,string>, s double")
    said = df.select(casting.signature(F.col("b"), F.col("v"), F.col("r"), F.col("s")).alias("x"))
    assert said.first().x == "xtts/Ann+bob=b+Zoe=z@0.80"
    back = said.select(casting.parse_signature(F.col("x")).alias("p")).first().p
    assert (back.backend, back.voice, back.roles, back.speed) == ("xtts", "Ann", {"bob": "b", "Zoe": "z"}, 0.8)
    old = spark.range(1).select(casting.parse_signature(F.lit("xtts/Ann+Max@1.00")).alias("p")).first().p
    assert old.roles == {"dialogue": "Max"}


def test_job_queue(spark, tmp_path):
    q = jobs.JobQueue(spark, str(tmp_path / "jobs"))
    assert q.enqueue(1, "book", 1.0) and not q.enqueue(2, "book", 2.0) and q.enqueue(3, "other", 3.0)
    assert q.claim(4.0) == 1 and q.claim(5.0) == 3 and q.claim(6.0) is None
    q.finish(1, "book", 7.0)
    assert q.enqueue(4, "book", 8.0)
    assert {r.job: r.state for r in q.jobs().collect()} == {1: "done", 3: "running", 4: "pending"}


def test_streams_say_what_batches_say(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    jobs.run_to_table(jobs.windowed(stream, "ts", "1 day", None, ["event_type"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.event_type): r.n for r in jobs.windowed(events, "ts", "1 day", None, ["event_type"]).collect()}
    assert got and all(want[k] == n for k, n in got.items())  # windows that the watermark hasn't closed are still to come
    assert jobs.once(events.union(events), "event_id", "ts").count() == events.count()


def test_glyph_votes(spark):
    words = spark.createDataFrame([("c?t",), ("b?t",), ("c?t",), ("??t",), ("?t",)], "word string")
    lexicon = spark.createDataFrame([("cat",), ("bat",), ("cut",), ("at",)], "form string")
    assert {r.letter: r.votes for r in layout.glyph_votes(words, lexicon).collect()} == {"a": 2, "u": 1}
