"""Jobs from an append-only log of events: state, log, stale sweep, heartbeats; in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("done", "failed", "cancelled")
LOG_CHARS = 20_000


def fold(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, state, n_events, started, finished: what a job's events come to. events has kind and ts."""
    last = F.max_by("kind", F.struct(*order))
    return events.groupBy(key).agg(
        last.alias("state"), F.count("*").alias("n_events"),
        F.min(F.when(F.col("kind") == "running", F.col("ts"))).alias("started"),
        F.max(F.when(F.col("kind").isin(*TERMINAL), F.col("ts"))).alias("finished"),
    )


def stale_sweep(jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Running jobs that started by the cutoff become cancelled, if that was asked for, else failed."""
    stale = (F.col("state") == "running") & (F.col("started") <= cutoff)
    return jobs.withColumn("state", F.when(stale & F.col("cancel"), "cancelled").when(stale, "failed").otherwise(F.col("state")))


def oldest_pending(jobs: DataFrame, *keys: str) -> DataFrame:
    """keys, job: what is claimed next, first in, first out. jobs has job and state."""
    return jobs.where("state = 'pending'").groupBy(*keys).agg(F.min("job").alias("job"))


def log_tail(parts: Column) -> Column:
    """The last LOG_CHARS characters of a job's log."""
    return F.right(F.array_join(parts, ""), F.lit(LOG_CHARS))


def heartbeat_sessions(beats: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """key, start, end, beats: times in which no two beats are further apart than `gap`. Works on streams with a watermark."""
    return beats.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("beats")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def windowed(events: DataFrame, ts: str, size: str, slide: str | None, keys: list[str], late: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling or sliding windows; late rows count up to `late` behind the newest."""
    w = F.window(ts, size, slide or size).alias("w")
    source = events.withWatermark(ts, late) if events.isStreaming else events
    return source.groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def once(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Events without repeats of a key."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def latest(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: progress, or the newest heartbeat."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there to Parquet and stop; the checkpoint makes the next call go on from here."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


class JobQueue:
    """First in, first out over an append-only table of events. Nothing is updated: a claim is an event behind a lock.

    A lock is a file that only one worker can create (the file system's create without overwriting), so two workers that
    see the same pending job don't both get it; the other goes on to the next.
    """

    SCHEMA = "job long, project string, kind string, ts double, seq long"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _events(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def _append(self, *rows: tuple) -> None:
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def jobs(self) -> DataFrame:
        e = self._events()
        return fold(e, "job", ["ts", "seq"]).join(e.groupBy("job").agg(F.first("project").alias("project")), "job")

    def enqueue(self, job: int, project: str, ts: float) -> bool:
        """False if the project has a job that isn't over."""
        try:
            busy = not self.jobs().where((F.col("project") == project) & ~F.col("state").isin(*TERMINAL)).isEmpty()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            busy = False
        if not busy:
            self._append((job, project, "pending", ts, 0))
        return not busy

    def _lock(self, job: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}-claims/{job}")
        try:
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False).close()
        except Exception as e:
            if "already exists" not in str(e).lower():
                raise
            return False
        return True

    def claim(self, ts: float) -> int | None:
        """The oldest pending job that no other worker has claimed, now running; None if there is none."""
        for row in self.jobs().where("state = 'pending'").orderBy("job").select("job", "project").toLocalIterator():
            if self._lock(row.job):
                self._append((row.job, row.project, "running", ts, 1))
                return row.job
        return None

    def finish(self, job: int, project: str, ts: float, state: str = "done") -> None:
        self._append((job, project, state, ts, 2))
