from pyspark.sql import functions as F

from parchment.streaming import state

EVENTS = "job long, kind string, ts double, seq long"


def test_moves():
    start = (None, 0, None, None, False)
    run = lambda *kinds: _fold(start, kinds)
    assert run("pending", "running", "done")[0] == "done" and run("pending", "cancel", "running")[0] == "cancelled"
    assert run("pending", "running", "cancel")[0] == "running" and run("pending", "running", "cancel", "failed")[0] == "cancelled"
    assert run("done")[0] is None and run("pending", "running", "done", "failed")[0] == "done"


def _fold(kept, kinds):
    for i, k in enumerate(kinds):
        kept = state.advance(kept, k, float(i))
    return kept


def test_state_is_kept_between_runs(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    stream = lambda: spark.readStream.schema(EVENTS).parquet(source)
    spark.createDataFrame([(1, "pending", 1.0, 0), (1, "running", 2.0, 1), (2, "pending", 1.5, 0)], EVENTS).write.parquet(source)
    state.follow_to_table(stream(), out, cp)
    spark.createDataFrame([(1, "done", 9.0, 2), (3, "pending", 8.0, 0)], EVENTS).write.mode("append").parquet(source)
    state.follow_to_table(stream(), out, cp)
    rows = spark.read.parquet(out).groupBy("job").agg(F.max_by(F.struct("state", "n_events", "started", "finished"), "batch").alias("s")).collect()
    assert {r.job: tuple(r.s) for r in rows} == {1: ("done", 3, 2.0, 9.0), 2: ("pending", 1, None, None), 3: ("pending", 1, None, None)}


def test_two_workers_claim_different_jobs(spark, tmp_path):
    from parchment.streaming.jobs import JobQueue

    one, two = JobQueue(spark, f"file://{tmp_path}/jobs"), JobQueue(spark, f"file://{tmp_path}/jobs")
    for job, project in ((1, "a"), (2, "b"), (3, "c")):
        assert one.enqueue(job, project, float(job))
    assert not one.enqueue(4, "a", 4.0)
    stale = two.jobs().cache()  # what a slow worker has read before the other claims
    stale.count()
    assert one.claim(5.0) == 1
    two.jobs = lambda: stale
    assert two.claim(5.0) == 2 and one.claim(6.0) == 3 and one.claim(7.0) is None
    one.finish(1, "a", 8.0)
    assert one.enqueue(4, "a", 9.0) and one.claim(9.0) == 4
