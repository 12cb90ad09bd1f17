"""Plain text and Markdown chapters as tables, and back to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Suffixes and markers of the kinds of files.
PLAIN = ("txt", "md", "markdown", "text")


def kind_of(path: Column, chars_per_page: Column, ocr_marked: Column) -> Column:
    """Kind of a file by suffix; of a PDF by how much text its pages hold and whether a recogniser made it."""
    suffix = F.lower(F.element_at(F.split(path, r"\."), -1))
    pdf = F.when(ocr_marked, "ocr").when(chars_per_page < 40, "image").otherwise("text")
    return F.when(suffix == "epub", "epub").when(suffix.isin(*PLAIN), "plain").when(suffix == "pdf", pdf)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def chapters(texts: DataFrame, key: str = "path") -> DataFrame:
    """key, chapter, title, paragraphs of plain texts.

    Headings are Markdown's if the text has any, else lines that look like
    headings once something stands before them; page numbers and footers glued
    to a sentence are left out.
    """
    lines = (
        texts.select(key, F.posexplode(F.split(F.regexp_replace("text", T.GLUED_FOOTER, ""), "\r?\n")).alias("pos", "line"))
        .withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").rlike(T.PAGE_NUMBER))
        .withColumn("mark", F.col("line").rlike(r"^#{1,3}\s+.+"))
    )
    whole = Window.partitionBy(key)
    run = whole.orderBy("pos")
    before = F.coalesce(F.lag((~T.heading_like(F.col("line"))).cast("int")).over(run) == 1, F.lit(False))
    heading = F.when(F.max("mark").over(whole), F.col("mark")).otherwise(T.heading_like(F.col("line")) & before)
    numbered = lines.withColumn("h", heading).withColumn("chapter", F.sum(F.col("h").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    title = T.clean_title(F.regexp_replace("line", r"^#{1,3}\s+|\s*#*$", ""))
    return numbered.groupBy(key, "chapter").agg(
        F.max(F.when(F.col("h"), title)).alias("title"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("pos", "line")))), lambda x: x["line"]).alias("paragraphs"),
    )


def to_markdown(number: Column, title: Column, paragraphs: Column) -> Column:
    head = F.format_string('---\nchapter: %d\ntitle: "%s"\n---\n\n', number.cast("long"), title)
    return F.concat(head, F.array_join(paragraphs, "\n\n"), F.lit("\n"))


def from_markdown(c: Column) -> Column:
    """struct<chapter, title, pages, paragraphs> of a chapter file with a head between lines of ---."""
    parts = F.split(c, r"(?m)^---\s*$", 3)
    field = lambda name: F.trim(F.regexp_replace(F.regexp_extract(F.get(parts, F.lit(1)), rf"(?m)^{name}:[ \t]*(.*)$", 1), '^"|"$', ""))
    pages = F.split(field("pages"), "-")
    return F.struct(
        field("chapter").try_cast("int").alias("chapter"), field("title").alias("title"),
        F.when(F.size(pages) == 2, F.struct(F.get(pages, F.lit(0)).try_cast("int").alias("first"), F.get(pages, F.lit(1)).try_cast("int").alias("last"))).alias("pages"),
        T.paragraphs_of(F.get(parts, F.lit(2))).alias("paragraphs"),
    )


def write_markdown(chapters: DataFrame, path: str, book: str | None = None) -> None:
    """One folder for each chapter number with its Markdown text; with `book`, a column, below one for each book."""
    out = chapters.select(*([book] if book else []), "chapter", to_markdown(F.col("chapter"), F.coalesce("title", F.lit("")), F.col("paragraphs")).alias("value"))
    out.write.mode("overwrite").partitionBy(*([book] if book else []), "chapter").option("lineSep", "\n\f").text(path)


SEGMENTS = "idx int, text string, pause_after_ms int, role string, chapter int, title string"
TIMING = "chapter int, idx int, start double, end double, attempts int, clean boolean, cause string, split boolean, text string, reused boolean, role string, voice string, approved boolean"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a missing role is the narrator's."""
    return spark.read.schema(SEGMENTS).json(path).withColumn("role", F.coalesce("role", F.lit("narrateur")))


def read_timing(spark: SparkSession, path: str) -> DataFrame:
    """Manifests, an array in each file; what can't be read is left out, what is missing takes its default."""
    raw = spark.read.schema(TIMING).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return raw.fillna({"clean": True, "attempts": 1, "reused": False, "split": False, "approved": False, "role": "narrateur", "cause": ""})


def write_if_changed(df: DataFrame, path: str, keys: list[str]) -> bool:
    """Write JSON only if rows differ from those there; True if written. Rows are compared by count and hash."""
    sign = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64(*[F.col(c).cast("string") for c in sorted(d.columns)]))).first()
    try:
        same = sign(df.sparkSession.read.schema(df.schema).json(path)) == sign(df)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        same = False
    if not same:
        df.orderBy(*keys).write.mode("overwrite").json(path)
    return not same
