import os

import pytest
from pyspark.sql import functions as F

from parchment.llm import common


def test_tables_are_written_shared_and_swept(spark):
    before = common.sweep(spark)
    assert before >= 0
    df = common.materialize(spark.range(5).withColumn("t", F.lit(None).cast("string")), "t")
    path = df._parchment_path.removeprefix("file://")
    assert path.startswith(common.shared_dir(spark).removeprefix("file://")) and os.path.isdir(path)
    assert df.count() == 5 and df.dtypes == [("id", "bigint"), ("t", "string")]
    other = common.materialize(spark.range(1).toDF("x"), "t")
    common.release(other)
    assert common.sweep(spark) == 1 and not os.path.isdir(path)


@pytest.mark.parametrize("i, fold", [(1, 0x83DCEFB7 % 5), (None, None)])
def test_folds(spark, i, fold):
    assert spark.range(1).select(common.crc_fold(F.lit(i).cast("long")).alias("f")).first().f == fold
