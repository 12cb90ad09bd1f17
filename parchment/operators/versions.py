"""Chapters as versions: rename, delete, merge; what a change makes stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renumbered(chapters: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return chapters.withColumn("chapter", F.row_number().over(Window.partitionBy(*(keys or ["book_id"])).orderBy("chapter")))


def rename(chapters: DataFrame, number: int, title: str) -> DataFrame:
    return chapters.withColumn("title", F.when(F.col("chapter") == number, F.lit(title)).otherwise(F.col("title")))


def delete(chapters: DataFrame, number: int) -> DataFrame:
    """Without a chapter; later ones move up by one."""
    return chapters.where(F.col("chapter") != number).withColumn("chapter", F.col("chapter") - (F.col("chapter") > number).cast("int"))


def merge_into_previous(chapters: DataFrame, number: int) -> DataFrame:
    """Paragraphs of a chapter go to the end of the one before; pages run from its first to the other's last."""
    target = F.when(F.col("chapter") >= number, F.col("chapter") - 1).otherwise(F.col("chapter"))
    rest = [c for c in chapters.columns if c not in ("chapter", "paragraphs", "pages", "book_id")]
    rows = chapters.withColumn("__at", F.col("chapter")).withColumn("chapter", target)
    return rows.groupBy("book_id", "chapter").agg(
        *[F.min_by(c, "__at").alias(c) for c in rest],
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__at", "paragraphs"))), lambda x: x["paragraphs"])).alias("paragraphs"),
        F.struct(F.min_by("pages.first", "__at").alias("first"), F.max_by("pages.last", "__at").alias("last")).alias("pages"),
    )


def stale_after(tracks: DataFrame, number: int) -> DataFrame:
    """Tracks that a change of a chapter's number makes stale: its own and all later ones."""
    return tracks.where(F.col("chapter") >= number)


def approved(timing: DataFrame, chapter: int, idx: int, value: bool) -> DataFrame:
    here = (F.col("chapter") == chapter) & (F.col("idx") == idx)
    return timing.withColumn("approved", F.when(here, F.lit(value)).otherwise(F.col("approved")))


def authoritative(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """book_id, chapter, body, reviewed: the reviewed body where there is one."""
    c = clean.select("book_id", "chapter", F.col("body").alias("__c"))
    return raw.join(c, ["book_id", "chapter"], "left").select("book_id", "chapter", F.coalesce("__c", "body").alias("body"), F.col("__c").isNotNull().alias("reviewed"))


def stale_by_time(text_time: Column, made_time: Column) -> Column:
    return F.coalesce(text_time > made_time, made_time.isNull())
