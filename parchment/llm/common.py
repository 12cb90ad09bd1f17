"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the setting is missing on a local master, as in tests, a folder of
    our own is made and set. A cluster without the setting is an error: its
    executors share no folder with the driver.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="parchment-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_written: list[str] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._parchment_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Delete the table behind a materialized DataFrame that nothing reads any more."""
    path = getattr(df, "_parchment_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written.remove(path)


def written() -> int:
    """How many tables this process has materialized and not deleted: a mark for sweep()."""
    return len(_written)


def sweep(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete the tables that this process has materialized after a mark, once their results are written elsewhere. How many went.

    The table behind `keep` stays.
    """
    kept = getattr(keep, "_parchment_path", None)
    gone = [p for p in _written[since:] if p != kept]
    for path in gone:
        _delete(spark, path)
        _written.remove(path)
    return len(gone)


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id written as text, modulo 5: fold 0 is held out."""
    return F.crc32(doc_id.cast("string")) % 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What one Arrow batch, which is what a Python worker holds at once, takes at most.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 50_000


def text_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes, so long texts make small ones. The bounds are the same for every operator: which was built last doesn't matter."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
