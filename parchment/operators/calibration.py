"""Rates of voices with a store of what was measured before, and takes that fall back to their sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import even_spread

# A sample of a voice, what it takes to tell a rate, the shortest text that counts, the silence between sentences.
SAMPLE, LEAST_TAKES, LEAST_CHARS, SENTENCE_PAUSE = 12, 8, 12, 0.25
ATTEMPTS = 5  # of a text, before its sentences are tried
STORE = "key string, rate double"


def voice_key(engine: Column, voice: Column, speed: Column) -> Column:
    """A rate holds for an engine, a voice and a speed."""
    return F.concat(engine, F.lit("/"), F.coalesce(voice, F.lit("default")), F.lit("@"), F.format_string("%.2f", speed))


def to_measure(segments: DataFrame, known: DataFrame, order: list[str], sample: int = SAMPLE) -> DataFrame:
    """segments (key, text) of keys that the store hasn't: `sample` of each at most, spread evenly over its texts that are long enough."""
    new = segments.join(known.select("key"), "key", "left_anti").where(F.length("text") >= LEAST_CHARS)
    return even_spread(new, ["key"], order, sample)


def rates(takes: DataFrame, least: int = LEAST_TAKES) -> DataFrame:
    """key, rate: median of characters a second over clean takes (key, text, duration, clean), to a tenth; keys of fewer takes have none."""
    usable = takes.where("clean and duration > 0 and length(text) > 0").select("key", (F.length("text") / F.col("duration")).alias("r"))
    return usable.groupBy("key").agg(F.count("*").alias("n"), F.bround(F.median("r"), 1).alias("rate")).where(F.col("n") >= least).select("key", "rate")


def calibrated(segments: DataFrame, store: str, measure: Callable[[DataFrame], DataFrame], order: list[str]) -> DataFrame:
    """key, rate of the voices of segments; `measure` gives a sample's duration and clean. What is new is appended to the store in one job.

    A key that the store has is not measured again, one whose takes were too few is tried again next time. A store that isn't there is empty.
    """
    spark = segments.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    known = spark.read.schema(STORE).parquet(store) if there else spark.createDataFrame([], STORE)
    wanted = to_measure(segments, known, order)
    if not wanted.isEmpty():
        rates(measure(wanted)).coalesce(1).write.mode("append").parquet(store)  # one file: it is there whole or not at all
        known = spark.read.schema(STORE).parquet(store)
    return known.join(segments.select("key").distinct(), "key", "left_semi")


def tried(attempts: DataFrame, keys: list[str], most: int = ATTEMPTS) -> DataFrame:
    """keys, clean, duration, attempts of texts that were tried (attempt from 1, clean, off, duration): the first clean take, else the one least off.

    Only `most` tries are made, and none after a clean one; so attempts is the clean one's number, else how many were made.
    """
    made = attempts.where(F.col("attempt") <= most)
    rank = F.struct((~F.col("clean")).cast("int").alias("bad"), F.when(F.col("clean"), 0.0).otherwise(F.col("off")).alias("off"), F.col("attempt").alias("attempt"), F.col("duration").alias("duration"))
    best = made.groupBy(*keys).agg(F.min(rank).alias("b"), F.count("*").alias("n"))
    return best.select(*keys, (F.col("b.bad") == 0).alias("clean"), F.col("b.duration").alias("duration"), F.when(F.col("b.bad") == 0, F.col("b.attempt")).otherwise(F.col("n")).cast("long").alias("attempts"))


def with_fallback(segments: DataFrame, sentences: DataFrame, keys: list[str]) -> DataFrame:
    """keys, clean, duration, attempts, split: takes of segments, or all of their sentences' where that helps.

    segments: as tried() says, and hard_max; sentences: as tried() says, of the sentences of each segment. A segment whose take isn't
    clean is told by sentences if it has two at least, all of them are clean, and their sum with silences keeps within hard_max.
    """
    whole = sentences.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and("clean").alias("all_clean"), F.sum("duration").alias("sum"), F.sum("attempts").alias("more"))
    met = segments.join(whole, keys, "left").withColumn("length", F.col("sum") + (F.col("n") - 1) * SENTENCE_PAUSE)
    split = F.coalesce(~F.col("clean") & (F.col("n") >= 2) & F.col("all_clean") & (F.col("length") <= F.col("hard_max")), F.lit(False))
    return met.select(
        *keys, (F.col("clean") | split).alias("clean"), F.when(split, F.col("length")).otherwise(F.col("duration")).alias("duration"),
        (F.col("attempts") + F.when(split, F.col("more")).otherwise(0)).cast("long").alias("attempts"), split.alias("split"),
    )
