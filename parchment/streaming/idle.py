"""Release after a time without activity: by windows over a table, or by timers over a stream. Both give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

#: State that expires and timers ask for this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def idle_releases(events: DataFrame, key: str, ts: str, minutes: float, late: str = "0 seconds") -> DataFrame:
    """key, last, released: each time that a key was without activity for `minutes`.

    The last activity of a key is followed by a release once the newest of all events, less `late`, is as far. Rows without key
    or time are no activity; a release at just the time of the next activity doesn't happen.
    """
    gap = round(minutes * 60e6)
    known = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    # milliseconds, as timers have them
    newest = known.agg(F.floor(F.max("t") / 1000).alias("newest")).withColumn("newest", F.col("newest") - F.lit(pd.Timedelta(late).value // 1_000_000))
    follows = F.lead("t").over(Window.partitionBy("key").orderBy("t"))
    rows = known.withColumn("next", follows).where(F.col("next").isNull() | (F.col("next") - F.col("t") > gap)).crossJoin(F.broadcast(newest))  # newest is one row
    over = rows.where(F.col("next").isNotNull() | (F.floor((F.col("t") + gap) / 1000) <= F.col("newest")))
    return over.select(F.col("key").alias(key), F.timestamp_micros("t").alias("last"), F.timestamp_micros(F.col("t") + gap).alias("released"))


class IdleTimer(StatefulProcessor):
    """A key's last activity, and a timer that is set anew by each. When it goes off, the key is released and its state is gone."""

    def __init__(self, minutes: float):
        self.gap = round(minutes * 60e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("t", LongType())]))

    def _released(self, key, times: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(times), "t": times}, columns=["key", "t"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        before, out = last, []
        for t in sorted(t for b in rows for t in b["t"].tolist()):
            if last is not None and t - last > self.gap:
                out.append(last)
            last = t if last is None else max(last, t)
        if last != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.gap) // 1000)
            self.last.update((last,))
        yield self._released(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [self.last.get()[0]] if self.last.exists() else []
        self.last.clear()
        yield self._released(key, out)

    def close(self) -> None:
        pass


def stream_releases(events: DataFrame, key: str, ts: str, minutes: float, late: str = "0 seconds") -> DataFrame:
    """idle_releases() of a stream: a row as soon as the watermark says that nothing more can come. State is a row for each key that is in use."""
    kind = events.schema[key].dataType.simpleString()
    known = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    known = known.withWatermark("ts", late).withColumn("t", F.unix_micros("ts"))
    told = known.groupBy("key").transformWithStateInPandas(IdleTimer(minutes), outputStructType=f"key {kind}, t long", outputMode="Append", timeMode="EventTime")
    return told.select(F.col("key").alias(key), F.timestamp_micros("t").alias("last"), F.timestamp_micros(F.col("t") + round(minutes * 60e6)).alias("released"))


def releases_to_table(events: DataFrame, path: str, checkpoint: str, key: str, ts: str, minutes: float, late: str = "0 seconds") -> None:
    """Append what a stream releases as Parquet, a folder for each batch; the checkpoint makes the next call go on from here."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch writes over itself

    stream_releases(events, key, ts, minutes, late).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
