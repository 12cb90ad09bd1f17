"""Chapters to spoken segments: announcement, readers, normalised text, silences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions import text as T
from ..functions.misc import scaled_pause
from .library import chapter_announcement


def normalised(c: Column) -> Column:
    """Text as it is spoken: signs unified, numbers in words, runs of capitals lowered, punctuation put right."""
    return T.tidy(T.capitalise_acronyms(numbers.spelled_numbers(T.unify(c))))


def spoken_segments(chapters: DataFrame, key: str = "book", announce: bool = True, scale: float = 1.0) -> DataFrame:
    """key, chapter, title, idx, role, text, pause_after_ms of chapters (key, chapter, title, paragraphs).

    A marker hands what follows to its reader; else the opening of the raw paragraph says who reads. A paragraph's last
    segment is followed by the paragraph's silence, a sentence's by the sentence's, others by the segment's; a run of dots
    at the end adds its own. With announce, a chapter's announcement comes first, in a book of one chapter its title alone.
    `scale` stretches all silences, each rounded for itself. Segments without text are left out, and idx counts from 0.
    """
    run = Window.partitionBy(key, "chapter").orderBy("para").rowsBetween(Window.unboundedPreceding, 0)
    marker = T.persona_of(F.col("p"))
    lines = T.exploded(chapters.select(key, "chapter", "title", "paragraphs"), "paragraphs", "para", "p").withColumn("marker", marker)
    read = lines.withColumn("reader", F.last("marker", True).over(run)).where("marker is null")
    role = F.coalesce(F.nullif("reader", F.lit("")), T.role_of(F.col("p")))
    said = read.withColumn("role", role).withColumn("p", T.unify(F.col("p"))).withColumn("p", numbers.spelled_numbers(F.col("p")))  # a column that several steps ask is worked out once
    cut = said.select(key, "chapter", "title", "para", "role", T.segments(T.tidy(T.capitalise_acronyms(F.col("p")))).alias("s"))
    each = T.exploded(cut.withColumn("n", F.size("s")), "s", "k", "one")
    text, extra = T.defuse_ellipsis(F.col("one.text"))
    base = F.when(F.col("k") == F.col("n") - 1, T.PAUSE_PARAGRAPH).when(F.col("one.ends"), T.PAUSE_SENTENCE).otherwise(T.PAUSE_SEGMENT)
    pause = lambda ms: scaled_pause(ms, F.lit(scale))
    out = each.select(key, "chapter", "title", "para", "k", "role", text.alias("text"), (pause(base) + pause(extra)).alias("pause_after_ms"))
    if announce:
        size = chapters.groupBy(F.col(key).alias("__b")).agg(F.count("*").alias("__n"))
        number = F.col("chapter")
        said = normalised(chapter_announcement(number, numbers.spelled_numbers(number.cast("string")), F.coalesce("title", F.lit("")), F.col("__n") == 1))
        heads = chapters.join(size, F.col(key) == F.col("__b")).select(
            key, "chapter", "title", F.lit(-1).alias("para"), F.lit(0).alias("k"), F.lit("narrateur").alias("role"), said.alias("text"), pause(F.lit(T.PAUSE_TITLE)).alias("pause_after_ms")
        )
        out = heads.unionByName(out)
    order = Window.partitionBy(key, "chapter").orderBy("para", "k")
    return out.where("text <> ''").withColumn("idx", F.row_number().over(order) - 1).select(key, "chapter", "title", "idx", "role", "text", "pause_after_ms")
