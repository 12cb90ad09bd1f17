"""From raw documents to a training mix: a chain of five operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All stages but the last
return the columns of documents; the last adds `taken`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import decontamination, mixing, quality, secrets, similar
from parchment.llm.common import materialize, sweep, table, text_batches, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are judged like any other; repeated rows go or stay together; without labels of both kinds all
    rows have one score; an empty table stays empty; other columns pass through.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 (five-word shingles) connect, the least doc_id stays.

    Null, empty and blank texts are one group; rows of one doc_id and text become one; an empty table stays empty; other
    columns pass through.
    """
    return similar.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go.

    Null and empty texts hold none and stay, null and empty items hit nothing; repeated rows go or stay together; an empty
    table on either side changes nothing; other columns pass through.
    """
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; values of secrets are replaced in its text, and n_chars follows.

    A null text stays null, an empty one empty; repeated rows change alike; other columns pass through.
    """
    text_batches(spark)
    columns = {"text": secrets.redacted("text")}
    out = docs.withColumns(columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix draws from, with the words it takes of each.

    Texts without words are never drawn and go; a null source is one of its own; rows of one doc_id and text become one and
    take what they took together; an empty table stays empty; other columns pass through, but a `taken` gives way.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]

#: The first stage learns a classifier, which SQL can't express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix. Once a stage is written, what it wrote on its way and its input are deleted; the last stage's tables stay until sweep()."""
    docs = table(spark, sf_dir, "documents")
    before = written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        sweep(spark, before, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
