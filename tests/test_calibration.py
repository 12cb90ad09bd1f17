from pyspark.sql import functions as F

from parchment.operators import calibration as C


def segments(spark, *voices):
    rows = [(v, i, "x" * (20 + i)) for v in voices for i in range(30)]
    df = spark.createDataFrame(rows, "voice string, seq int, text string")
    return df.select(C.voice_key(F.lit("e"), F.col("voice"), F.lit(1.0)).alias("key"), "seq", "text")


def test_a_second_run_measures_new_voices_only(spark, tmp_path):
    asked = []

    def measure(sample):
        asked.append(sorted({r.key for r in sample.collect()}))
        assert sample.count() == 12 * len(asked[-1])
        return sample.withColumn("duration", F.length("text") / F.lit(16.0)).withColumn("clean", F.col("seq") < F.when(F.col("key") == "e/c@1.00", 5).otherwise(99))

    store = str(tmp_path / "store")
    run = lambda *v: {r.key: r.rate for r in C.calibrated(segments(spark, *v), store, measure, ["seq"]).collect()}
    assert run("a", "b") == {"e/a@1.00": 16.0, "e/b@1.00": 16.0}
    assert run("a") == {"e/a@1.00": 16.0} and len(asked) == 1  # nothing new: nothing is measured or written
    assert run("a", "c", None) == {"e/a@1.00": 16.0, "e/default@1.00": 16.0}  # too few clean takes of c: no rate
    assert run("c") == {} and asked == [["e/a@1.00", "e/b@1.00"], ["e/c@1.00", "e/default@1.00"], ["e/c@1.00"]]
    assert spark.read.parquet(store).count() == 3


def test_fallback_by_sentence(spark):
    whole = [(1, False, 9.0, 5, 20.0), (2, False, 9.0, 5, 20.0), (3, True, 5.0, 2, 20.0), (4, False, 9.0, 5, 5.0), (5, False, 9.0, 5, 20.0), (6, False, 9.0, 5, 20.0)]
    parts = [(1, 0, True, 3.0, 1), (1, 1, True, 4.0, 2), (2, 0, True, 3.0, 1), (2, 1, False, 4.0, 5), (3, 0, True, 1.0, 1), (3, 1, True, 1.0, 1), (4, 0, True, 3.0, 1), (4, 1, True, 3.0, 1), (5, 0, True, 3.0, 1)]
    s = spark.createDataFrame(whole, "seg int, clean boolean, duration double, attempts int, hard_max double")
    p = spark.createDataFrame(parts, "seg int, sentence int, clean boolean, duration double, attempts int")
    got = {r.seg: (r.clean, r.duration, r.attempts, r.split) for r in C.with_fallback(s, p, ["seg"]).collect()}
    assert got == {1: (True, 7.25, 8, True), 2: (False, 9.0, 5, False), 3: (True, 5.0, 2, False), 4: (False, 9.0, 5, False), 5: (False, 9.0, 5, False), 6: (False, 9.0, 5, False)}


def test_tries_end_with_the_first_clean_one(spark):
    rows = [(1, 1, False, 0.5, 1.0), (1, 2, True, 0.9, 2.0), (1, 3, True, 0.0, 3.0), (2, 1, False, 0.5, 1.0), (2, 2, False, 0.4, 2.0), (2, 6, True, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "seg int, attempt int, clean boolean, off double, duration double")
    assert {r.seg: tuple(r)[1:] for r in C.tried(df, ["seg"]).collect()} == {1: (True, 2.0, 2), 2: (False, 2.0, 2)}
