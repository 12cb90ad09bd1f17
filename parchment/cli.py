"""Command line over the operators: python -m parchment.cli COMMAND ...

Chapters are folders of Markdown files as `ingest` writes them, segments and manifests JSON lines, sound Parquet. Models are
named as module:factory; without a name the deterministic stand-ins of sources.services take their place.
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import audio as A
from .operators import proofreading, review, segmentation, versions
from .session import session
from .sources import epub, plain, services


def _made(name: str | None, default):
    """The factory that a name module:factory stands for."""
    if not name:
        return default
    module, factory = name.split(":")
    return getattr(importlib.import_module(module), factory)


def _chapters(spark, path: str) -> DataFrame:
    """chapter, title, paragraphs of a folder of chapter files."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    one = files.select(F.explode(F.split("value", "\n\f")).alias("text")).where(F.trim("text") != "").select(plain.from_markdown(F.col("text")).alias("m"))
    return one.select("m.chapter", "m.title", "m.paragraphs")


def _bodies(spark, path: str) -> DataFrame:
    """doc_id (the chapter's number), text: chapters as offsets count in them."""
    return _chapters(spark, path).select(F.col("chapter").cast("long").alias("doc_id"), F.array_join("paragraphs", "\n\n").alias("text"))


def _lexicon(spark, args, bodies: DataFrame) -> DataFrame:
    """form: the words of a file, one a line; without one, words that stand in three chapters."""
    if args.lexicon:
        return spark.read.text(args.lexicon).select(F.lower(F.trim("value")).alias("form")).where("form <> ''").distinct()
    return review.document_frequency(bodies).where("d >= 3").select("form")


def ingest(args, spark) -> None:
    """Texts or e-books to chapter files."""
    if args.source.endswith(".epub") or args.kind == "epub":
        found = epub.chapters(epub.read_archives(spark, args.source)).select("path", F.col("pos").alias("chapter"), "title", "paragraphs")
    else:
        found = plain.chapters(plain.read_texts(spark, args.source))
    plain.write_markdown(versions.renumbered(found, ["path"]), args.target)


def review_(args, spark) -> None:
    """Suspicious words of chapters, as JSON lines."""
    bodies = _bodies(spark, args.source)
    frequency = review.word_frequency(review.words(bodies))
    judged = review.judged_words(frequency, _lexicon(spark, args, bodies), review.proper_nouns(frequency))
    found = review.suspects(review.tokens(bodies), judged).withColumnRenamed("doc_id", "chapter")
    found.orderBy("chapter", "offset").write.mode("overwrite").json(args.target)


def drop_chapter(args, spark) -> None:
    """Chapters without one; later ones move up."""
    plain.write_markdown(versions.delete(_chapters(spark, args.source), args.number), args.target)


def merge_chapter(args, spark) -> None:
    """Chapters with one appended to the one before."""
    own = _chapters(spark, args.source).withColumn("book_id", F.lit(0)).withColumn("pages", F.struct(F.lit(0).alias("first"), F.lit(0).alias("last")))
    plain.write_markdown(versions.merge_into_previous(own, args.number), args.target)


def llm_check(args, spark) -> None:
    """One question to the model, and whether it answers with JSON."""
    reply = _made(args.model, services.Echo)().ask(json.dumps([{"id": 0, "word": "word", "context": "a word"}]))
    print(json.dumps(json.loads(reply)))


def proofread(args, spark) -> None:
    """A report for each chapter that has suspicious words, as JSON lines; with --apply, corrected chapters as well."""
    bodies = _bodies(spark, args.source)
    proofs = proofreading.proofread(bodies, _lexicon(spark, args, bodies), _made(args.model, services.Echo))
    proofreading.reports(proofs).select(F.col("doc_id").alias("chapter"), "report").orderBy("chapter").write.mode("overwrite").json(args.target)
    if args.apply:
        fixed = proofreading.applied(bodies, proofs).join(_chapters(spark, args.source), F.col("doc_id") == F.col("chapter"))
        plain.write_markdown(fixed.select("chapter", "title", F.split("text", "\n\n").alias("paragraphs")), args.apply)


def bench_proofread(args, spark) -> None:
    """What proofreading makes of raw chapters, against reviewed ones: precision, recall and what was missed."""
    raw = _bodies(spark, args.source)
    clean = _bodies(spark, args.clean).select(F.col("doc_id").alias("c"), F.col("text").alias("clean"))
    truth = review.alignment_truth(raw.join(clean, F.col("doc_id") == F.col("c")).select(F.col("doc_id").alias("id"), F.col("text").alias("raw"), "clean"))
    proofs = proofreading.proofread(raw, _lexicon(spark, args, raw), _made(args.model, services.Echo))
    at = lambda df, *more: df.select(F.col("doc_id").alias("chapter"), "offset", *more)
    result = review.outcome(at(proofs.where("replacement <> ''"), "replacement"), truth.select(F.col("id").alias("chapter"), "offset", "expected"), at(proofs))
    result.write.mode("overwrite").json(args.target)


def normalize(args, spark) -> None:
    """Chapter texts to spoken segments, as JSON lines."""
    book = _chapters(spark, args.source).withColumn("book", F.lit(0))
    segments = segmentation.spoken_segments(book, announce=not args.no_announce, scale=args.pauses).drop("book")
    plain.write_if_changed(segments, args.target, ["chapter", "idx"])


def synth(args, spark) -> None:
    """Segments to sound and a manifest of where each begins and ends, in seconds of its chapter."""
    segments = spark.read.schema("chapter int, idx int, role string, text string, pause_after_ms long, title string").json(args.source)
    sound = services.synthesised(segments, _made(args.engine, services.Tone))
    sound.write.mode("overwrite").parquet(f"{args.target}/sound")
    made = spark.read.parquet(f"{args.target}/sound")
    run = Window.partitionBy("chapter").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    seconds = F.size("audio") / A.SAMPLE_RATE
    start = 0.6 + F.coalesce(F.sum(seconds + F.col("pause_after_ms") / 1000).over(run), F.lit(0.0))
    made.select("chapter", "idx", "role", "text", start.alias("start"), (start + seconds).alias("end")).write.mode("overwrite").json(f"{args.target}/manifest")


def assemble(args, spark) -> None:
    """Sound of segments to a WAV file's bytes for each chapter. A chapter is one row; books aren't gathered."""
    parts = spark.read.parquet(f"{args.source}/sound").groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("idx", "audio", F.col("pause_after_ms").alias("pause_ms")))).alias("parts"))
    parts.select("chapter", A.encode_wav(A.quantised(A.joined(F.col("parts")))).alias("wav")).write.mode("overwrite").parquet(args.target)


def voices(args, spark) -> None:
    """Names of an engine's voices."""
    print(json.dumps(list(getattr(_made(args.engine, services.Tone)(), "voices", lambda: ["tone"])())))


def status(args, spark) -> None:
    """Chapters, paragraphs and words of a folder of chapters."""
    c = _chapters(spark, args.source)
    words = F.size(F.filter(F.split(F.array_join("paragraphs", " "), r"\s+"), lambda w: w != ""))
    print(json.dumps(c.agg(F.count("*").alias("chapters"), F.coalesce(F.sum(F.size("paragraphs")), F.lit(0)).alias("paragraphs"), F.coalesce(F.sum(words), F.lit(0)).alias("words")).first().asDict()))


def run(args, spark) -> None:
    """ingest, normalize, synth and assemble, one after the other, below one folder."""
    for step, source, target in ((ingest, args.source, "chapters"), (normalize, "chapters", "segments"), (synth, "segments", "sound"), (assemble, "sound", "tracks")):
        own = argparse.Namespace(**vars(args) | {"source": source if step is ingest else f"{args.target}/{source}", "target": f"{args.target}/{target}"})
        step(own, spark)


def query(args, spark) -> None:
    """A registered query over a folder of tables, to Parquet."""
    from . import plans

    plans.QUERIES[args.name](spark, args.tables).write.mode("overwrite").parquet(args.target)


COMMANDS = (
    (ingest, "source target"), (review_, "source target"), (drop_chapter, "source target number"), (merge_chapter, "source target number"), (llm_check, ""), (proofread, "source target"),
    (bench_proofread, "source clean target"), (normalize, "source target"), (synth, "source target"), (assemble, "source target"), (voices, ""), (status, "source"), (run, "source target"), (query, "name tables target"),
)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(required=True)
    for f, places in COMMANDS:
        p = commands.add_parser(f.__name__.strip("_").replace("_", "-"), help=f.__doc__, aliases=["segment"] if f is normalize else [])
        for o in places.split():
            p.add_argument(o, type=int if o == "number" else str)
        p.add_argument("--kind", choices=("epub", "plain"))
        p.add_argument("--lexicon", help="file of known words")
        p.add_argument("--model", help="module:factory of a language model")
        p.add_argument("--engine", help="module:factory of a speech engine")
        p.add_argument("--apply", help="folder for corrected chapters")
        p.add_argument("--no-announce", action="store_true")
        p.add_argument("--pauses", type=float, default=1.0)
        p.add_argument("--master")
        p.set_defaults(run=f)
    args = parser.parse_args(argv)
    args.run(args, session(args.master))


if __name__ == "__main__":
    main()
