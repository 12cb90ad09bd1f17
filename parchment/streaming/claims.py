"""A queue of jobs that many workers ask at once: batches of requests are set against the table of what happened before.

Requests are rows: a job that is put in for a project, a worker that asks for work, a job that is over. A batch is answered
by one job of joins and windows: a project gets a job only while it has none, and the pending jobs of a queue go to its
workers by rank, first in, first out, so no job has two workers and no worker two jobs. Answers of a batch are a folder
of its own that carries the batch's number, and are made from the folders before it: a batch that is run twice, after a
worker or the driver was lost, writes the same answers over itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REQUESTS = "seq long, kind string, queue string, project string, job long, worker string"
EVENTS = "seq long, kind string, queue string, project string, job long, worker string"


def active(events: DataFrame) -> DataFrame:
    """queue, project, job, seq, state of jobs that aren't over: pending, or running once claimed."""
    jobs = events.groupBy("job").agg(
        F.max_by("queue", F.when(F.col("kind") == "pending", F.col("seq"))).alias("queue"),
        F.max_by("project", F.when(F.col("kind") == "pending", F.col("seq"))).alias("project"),
        F.min(F.when(F.col("kind") == "pending", F.col("seq"))).alias("seq"),
        F.bool_or(F.col("kind") == "running").alias("running"),
        F.bool_or(F.col("kind") == "over").alias("over"),
    )
    return jobs.where("not over").select("queue", "project", "job", "seq", F.when(F.col("running"), "running").otherwise("pending").alias("state"))


def accepted(busy: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (seq, queue, project, job) that become pending: the first of each project that has no job in busy, jobs once."""
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    once = asked.withColumn("n", first("job")).where("n = 1")
    return once.join(busy.select("project").distinct(), "project", "left_anti").withColumn("n", first("project")).where("n = 1").drop("n")


def matched(pending: DataFrame, asking: DataFrame) -> DataFrame:
    """seq, queue, project, job, worker: the pending jobs of each queue, oldest first, for its workers by the order in which they asked; a worker gets one."""
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("queue").orderBy("seq")))
    once = asking.groupBy("queue", "worker").agg(F.min("seq").alias("seq"))
    jobs = ranked(pending.select("queue", "project", "job", "seq")).drop("seq")
    return ranked(once).join(jobs, ["queue", "rank"]).select("seq", "queue", "project", "job", "worker")


def answered(events: DataFrame, requests: DataFrame) -> DataFrame:
    """The events that a batch of requests adds to those before it: jobs over first, then new jobs, then claims."""
    over = requests.where("kind = 'finish'").join(active(events).where("state = 'running'").select("job", F.col("queue").alias("q"), F.col("project").alias("p")), "job")
    done = over.groupBy("job", "q", "p").agg(F.min("seq").alias("seq"), F.min_by("worker", "seq").alias("worker"))
    done = done.select("seq", F.lit("over").alias("kind"), F.col("q").alias("queue"), F.col("p").alias("project"), "job", "worker")
    known = events.select("job").distinct()
    busy = active(events.unionByName(done))
    new = accepted(busy, requests.where("kind = 'enqueue'").select("seq", "queue", "project", "job").join(known, "job", "left_anti"))
    new = new.select("seq", F.lit("pending").alias("kind"), "queue", "project", "job", F.lit(None).cast("string").alias("worker"))
    waiting = busy.where("state = 'pending'").select("queue", "project", "job", "seq").unionByName(new.select("queue", "project", "job", "seq"))
    claims = matched(waiting, requests.where("kind = 'claim'").select("seq", "queue", "worker")).withColumn("kind", F.lit("running"))
    return done.unionByName(new).unionByName(claims.select(*done.columns))


def answer_batch(path: str):
    """foreachBatch function: answers of batch n go to path/batch=n, from the batches before it."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        empty = spark.createDataFrame([], EVENTS + ", batch long")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        before = spark.read.schema(EVENTS + ", batch long").parquet(path).where(F.col("batch") < number) if there else empty
        answered(before.drop("batch"), batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def serve(requests: DataFrame, path: str, checkpoint: str) -> None:
    """Answer the requests that a stream has, then stop; the checkpoint makes the next call go on from here."""
    requests.writeStream.foreachBatch(answer_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
