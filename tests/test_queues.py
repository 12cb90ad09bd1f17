"""Idle timers and claims: streams against tables, restarts, batches that run twice."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parchment.streaming import claims, idle

START = datetime(2024, 1, 1)
EVENTS = "k long, ts timestamp"


def at(minutes, micros=0):
    return START + timedelta(minutes=minutes, microseconds=micros)


def test_releases_of_a_table(spark):
    rows = [(1, at(0)), (1, at(10)), (1, at(40)), (2, at(5)), (3, at(35)), (3, at(45, 1)), (None, at(1)), (4, None), (5, at(41)), (5, at(41))]
    got = sorted((r.k, r.last, r.released) for r in idle.idle_releases(spark.createDataFrame(rows, EVENTS), "k", "ts", 10).collect())
    assert got == [(1, at(10), at(20)), (2, at(5), at(15)), (3, at(35), at(45))]
    assert idle.idle_releases(spark.createDataFrame([], EVENTS), "k", "ts", 10).count() == 0


def test_stream_and_table_agree_after_a_restart(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    batches = [[(1, at(0)), (1, at(8)), (2, at(3))], [(1, at(30)), (3, at(29))], [(2, at(31)), (3, at(36)), (1, at(50))], [(9, at(100))]]
    for b in batches:  # each call takes the stream up where the last has left it
        spark.createDataFrame(b, EVENTS).coalesce(1).write.mode("append").parquet(source)
        idle.releases_to_table(spark.readStream.schema(EVENTS).parquet(source), out, cp, "k", "ts", 10, "60 seconds")
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("k", "last", "released").collect())
    want = sorted(tuple(r) for r in idle.idle_releases(spark.read.schema(EVENTS).parquet(source), "k", "ts", 10, "60 seconds").collect())
    assert got == want and (1, at(50), at(60)) in got and 9 not in {r[0] for r in got}


def test_stream_over_events(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts")
    for k in range(3):
        part = events.where((F.col("ts") >= F.lit(at(k * 14400))) & ((F.col("ts") < F.lit(at((k + 1) * 14400))) | F.lit(k == 2)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        idle.releases_to_table(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), "user_id", "ts", 360, "60 seconds")
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("user_id", "last", "released").collect())
    assert got == sorted(tuple(r) for r in idle.idle_releases(events, "user_id", "ts", 360, "60 seconds").collect()) and len(got) > 100


def told(spark, path):
    return sorted((r.batch, r.kind, r.job, r.worker) for r in spark.read.parquet(path).collect())


def request(spark, *rows):
    return spark.createDataFrame(rows, claims.REQUESTS)


def test_many_claims_in_a_batch(spark, tmp_path):
    write, path = claims.answer_batch(str(tmp_path / "q")), str(tmp_path / "q")
    write(request(spark, *[(i, "enqueue", "q", f"p{i}", i, None) for i in range(1, 31)], *[(100 + i, "claim", "q", None, None, f"w{i}") for i in range(20)], (130, "claim", "q", None, None, "w3"), (131, "claim", "other", None, None, "x")), 0)
    assert [(job, w) for _, kind, job, w in told(spark, path) if kind == "running"] == [(i + 1, f"w{i}") for i in range(20)]


def test_one_active_job_a_project(spark, tmp_path):
    write, path = claims.answer_batch(str(tmp_path / "q")), str(tmp_path / "q")
    write(request(spark, (1, "enqueue", "q", "a", 1, None), (2, "enqueue", "q", "a", 2, None), (3, "enqueue", "q", "b", 1, None)), 0)
    write(request(spark, (4, "enqueue", "q", "a", 3, None), (5, "claim", "q", None, None, "w")), 1)
    write(request(spark, (6, "finish", None, None, 1, "w"), (7, "enqueue", "q", "a", 4, None), (8, "finish", None, None, 9, "w")), 2)
    write(request(spark, (9, "claim", "q", None, None, "w"), (10, "claim", "q", None, None, "v")), 3)
    assert told(spark, path) == [(0, "pending", 1, None), (1, "running", 1, "w"), (2, "over", 1, "w"), (2, "pending", 4, None), (3, "running", 4, "w")]


def test_a_batch_run_twice(spark, tmp_path):
    write, path = claims.answer_batch(str(tmp_path / "q")), str(tmp_path / "q")
    first = request(spark, (1, "enqueue", "q", "a", 1, None), (2, "enqueue", "q", "b", 2, None), (3, "claim", "q", None, None, "w"))
    second = request(spark, (4, "claim", "q", None, None, "v"), (5, "finish", None, None, 1, "w"))
    write(first, 0)
    write(second, 1)
    before = told(spark, path)
    write(second, 1)
    write(first, 0)
    assert told(spark, path) == before == [(0, "pending", 1, None), (0, "pending", 2, None), (0, "running", 1, "w"), (1, "over", 1, "w"), (1, "running", 2, "v")]


def test_a_stream_of_requests(spark, tmp_path):
    source, path, cp = (str(tmp_path / n) for n in ("in", "q", "cp"))
    for rows in ([(1, "enqueue", "q", "a", 1, None), (2, "claim", "q", None, None, "w")], [(3, "enqueue", "q", "a", 2, None), (4, "claim", "q", None, None, "v")]):
        request(spark, *rows).coalesce(1).write.mode("append").parquet(source)
        claims.serve(spark.readStream.schema(claims.REQUESTS).parquet(source), path, cp)
    assert [r[1:] for r in told(spark, path)] == [("pending", 1, None), ("running", 1, "w")]
