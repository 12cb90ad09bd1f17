import json

import pytest
from pyspark.sql import functions as F

from parchment.operators import tables as B
from parchment.operators.sequence import budget_slices
from parchment.plans.table_queries import lines_with_progress


def test_packing_in_sql(spark):
    B.register(spark)
    rows = [(k, i, (i * 7 + k) % 40 if (i + k) % 9 else None) for k in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "key int, place int, size int").repartition(7)
    got = {(r.key, r.place): r.slice for r in spark.sql("SELECT * FROM packed(TABLE({df}), 100)", df=df).collect()}
    folded = df.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("size", F.lit(0)).alias("size")))).alias("t")).select("key", budget_slices(F.transform("t", lambda x: x["size"]), 100).alias("s"))
    assert got == {(r.key, i): s for r in folded.collect() for i, s in enumerate(r.s)} and len(got) == 300
    assert spark.sql("SELECT * FROM packed(TABLE({df}), 100)", df=df.limit(0)).count() == 0
    with pytest.raises(Exception, match="key, place and size"):
        spark.sql("SELECT * FROM packed(TABLE({df}), 100)", df=df.drop("size"))


def test_contents_of_any_depth(spark):
    B.register(spark)
    deep = {"title": "x"}
    for i in range(300):
        deep = {"title": str(i), "children": [deep, 5, {"title": None, "href": "h"}]}
    df = spark.createDataFrame([(1, json.dumps([deep])), (2, None), (3, "{broken"), (4, "[]"), (5, '[{"title":"a","children":"no"}]')], "id int, toc string")
    rows = spark.sql("SELECT id, place, depth, title, href FROM {df} d, LATERAL contents(d.toc)", df=df).collect()
    first = [r for r in rows if r.id == 1]
    assert len(first) == 601 and max(r.depth for r in first) == 300 and [r.place for r in sorted(first, key=lambda r: r.place)] == list(range(601))
    assert [tuple(r) for r in rows if r.id != 1] == [(5, 0, 0, "a", "")]


def test_reports_that_grow_or_are_cut_off(spark):
    lines = ['{"a":1,"b":"x"}', '{"a":2,"c":{"d":[1]},"e":null}', '{"a":"no number"}', '{"a":3', None, "[1]"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, l string").select("i", B.told_reports(F.col("l"), "a int, b string").alias("r"))
    got = {r.i: (r.r.report.a, r.r.report.b, r.r.more, r.r.broken) for r in df.collect() if r.r is not None}
    assert got[0] == (1, "x", {}, None) and got[1] == (2, None, {"c": '{"d":[1]}', "e": None}, None)
    assert got[2][0] is None and got[2][3] == lines[2] and got[3][3] == lines[3] and got[4][:2] == (None, None)


def test_progress_is_read_from_the_listener(spark):
    said = []
    progress = B.Progress(then=lambda stage, m: said.append(stage))
    docs = spark.createDataFrame([(1, "a\n\nbcd"), (2, " \t\n"), (3, "xy")], "doc_id int, text string")
    rows = {r.doc_id: (r.lines, r.chars) for r in lines_with_progress(docs, progress).collect()}
    assert rows == {1: (2, 4), 3: (1, 2)}
    assert progress.report() == {"documents": {"n": 3, "chars": 11}, "lines": {"n": 3, "longest": 3}} and said == ["documents", "lines"]
