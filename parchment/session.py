"""Session defaults for work on a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.config(map=DEFAULTS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


#: What one Arrow batch, which is what a Python worker holds at once, takes at most; the same bounds as of the operators for corpora.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 50_000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes: ten thousand long texts or archives would be gigabytes in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the folder that driver and executors share (spark.checkpoint.dir); a local master may have one of its own."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not path:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="parchment-")
        context.setCheckpointDir(path)
    return df.checkpoint()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder's path in the folder that driver and executors share; without that setting a local master has one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not path and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{path.rstrip('/') if path else tempfile.mkdtemp(prefix='parchment-')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, computed once and read back from a table in the folder that driver and executors share; later steps read the columns they need."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
