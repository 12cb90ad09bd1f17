"""Queries of rates, takes by sentence, states of projects and their newest jobs, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import misc as M
from ..operators import calibration as C
from ..operators import library as L
from ..operators import orderings as O
from ..operators import versions as V
from ..session import scratch_dir
from ..sources.changed import write_changed
from .registry import query, table


@query("""
WITH s AS (SELECT l_returnflag || '/v' || (l_suppkey % 9) || '@' || printf('%.2f', 1 + l_linenumber % 2 * 0.25) AS key, l_orderkey, l_linenumber, l_partkey, l_quantity, repeat('x', CAST(l_quantity AS INT)) AS text, l_tax <= 0.07 AS clean, l_quantity / (11 + l_suppkey % 9) + l_discount AS duration FROM lineitem),
known AS (SELECT DISTINCT key, 12.5::DOUBLE AS rate FROM s WHERE key LIKE 'A/%@1.00'),
l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, duration) - 1 AS r, count(*) OVER (PARTITION BY key) AS n FROM s WHERE length(text) >= 12 AND key NOT IN (SELECT key FROM known)),
picked AS (SELECT * FROM l WHERE n <= 12 OR r IN (SELECT CAST(floor(i * n / 12.0) AS BIGINT) FROM range(12) t(i))),
m AS (SELECT key, round_even(median(length(text) / duration), 1) AS rate FROM picked WHERE clean AND duration > 0 GROUP BY key HAVING count(*) >= 8)
SELECT key, rate FROM known UNION ALL SELECT key, rate FROM m""")
def calibrated_voices(spark, sf):
    """Lines of orders stand for segments; of some voices a rate is known, of the others a spread sample is measured."""
    li = table(spark, sf, "lineitem")
    key = C.voice_key(F.col("l_returnflag"), F.concat(F.lit("v"), (F.col("l_suppkey") % 9).cast("string")), 1 + F.col("l_linenumber") % 2 * 0.25)
    s = li.select(
        key.alias("key"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"), (F.col("l_tax") <= 0.07).alias("clean"),
        (F.col("l_quantity") / (11 + F.col("l_suppkey") % 9) + F.col("l_discount")).alias("duration"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
    )
    known = s.where("key like 'A/%@1.00'").select("key").distinct().withColumn("rate", F.lit(12.5))
    sample = C.to_measure(s, known, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "duration"])
    return known.unionByName(C.rates(sample))


@query("""
WITH a AS (SELECT l_orderkey AS seg, CASE WHEN l_linenumber > 3 THEN l_linenumber % 3 END AS sentence, l_linenumber AS attempt, l_tax <= 0.03 AS clean, l_discount AS off, l_quantity / 4 AS duration,
  row_number() OVER (PARTITION BY l_orderkey, CASE WHEN l_linenumber > 3 THEN l_linenumber % 3 END ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax, l_discount) AS try FROM lineitem),
b AS (SELECT seg, sentence, bool_or(clean) AS clean, min(try) FILTER (clean) AS first, count(*) AS n, arg_min(duration, try) FILTER (clean) AS good, arg_min(duration, (off, try)) AS near FROM a WHERE try <= 5 GROUP BY ALL),
t AS (SELECT seg, sentence, clean, CASE WHEN clean THEN good ELSE near END AS duration, CASE WHEN clean THEN first ELSE n END AS attempts FROM b),
w AS (SELECT seg, count(*) AS n, bool_and(clean) AS ok, sum(duration) AS s, sum(attempts) AS more FROM t WHERE sentence IS NOT NULL GROUP BY seg),
j AS (SELECT t.*, n, s + (n - 1) * 0.25 AS len, more, coalesce(NOT clean AND n >= 2 AND ok AND s + (n - 1) * 0.25 <= 20, false) AS split FROM t LEFT JOIN w USING (seg) WHERE sentence IS NULL)
SELECT seg, clean OR split AS clean, CASE WHEN split THEN len ELSE duration END AS duration, CAST(attempts + CASE WHEN split THEN more ELSE 0 END AS BIGINT) AS attempts, split FROM j""")
def takes_by_sentence(spark, sf):
    """Lines of an order are tries of a segment, up to the third, then of its sentences."""
    from pyspark.sql import Window

    sentence = F.when(F.col("l_linenumber") > 3, F.col("l_linenumber") % 3)
    w = Window.partitionBy("seg", "sentence").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount")
    li = table(spark, sf, "lineitem").withColumn("seg", F.col("l_orderkey")).withColumn("sentence", sentence)
    a = li.select("seg", "sentence", F.row_number().over(w).alias("attempt"), (F.col("l_tax") <= 0.03).alias("clean"), F.col("l_discount").alias("off"), (F.col("l_quantity") / 4).alias("duration"))
    segments = C.tried(a.where("sentence is null").drop("sentence"), ["seg"]).withColumn("hard_max", F.lit(20.0))
    return C.with_fallback(segments, C.tried(a.where("sentence is not null"), ["seg", "sentence"]), ["seg"])


@query("""
WITH g AS (SELECT o_custkey AS project, bool_or(o_orderstatus = 'P') AS active, bool_or(o_totalprice > 480000) AS bound, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) LIKE '1%' AS last_failed,
  count(*) FILTER (o_orderstatus = 'F') AS tracks, bool_or(o_orderkey % 9 = 0) AS needs_review, count(*) AS segments FROM orders GROUP BY o_custkey)
SELECT project, CASE WHEN active THEN 'at work' WHEN bound THEN 'bound' WHEN last_failed THEN 'failed' WHEN tracks > 0 THEN 'recorded' WHEN needs_review THEN 'to review' WHEN segments > 0 THEN 'segmented' ELSE 'new' END AS status FROM g""")
def project_states(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("project")).agg(
        F.bool_or(F.col("o_orderstatus") == "P").alias("active"), F.bool_or(F.col("o_totalprice") > 480000).alias("bound"),
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).startswith("1").alias("last_failed"), F.count_if(F.col("o_orderstatus") == "F").alias("tracks"),
        F.bool_or(F.col("o_orderkey") % 9 == 0).alias("needs_review"), F.count("*").alias("segments"),
    )
    return g.select("project", L.project_status().alias("status"))


@query("SELECT o_custkey AS project, o_orderkey AS job, o_orderdate AS created, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS place FROM orders QUALIFY place <= 6")
def newest_of_projects(spark, sf):
    """The six newest jobs of each project."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("created"))
    return O.newest(o, ["project"], "job", 6).withColumn("place", F.col("place").cast("long"))


@query("SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN contains(text, '@') THEN 'address' END, CASE WHEN n_chars > 3000 THEN 'length' END, CASE WHEN lang = 'de' THEN 'german' END], lambda x: x IS NOT NULL)), ',') AS flags FROM documents")
def broken_categories(spark, sf):
    flags = F.create_map(F.lit("length"), F.col("n_chars") > 3000, F.lit("address"), F.contains("text", F.lit("@")), F.lit("german"), F.col("lang") == "de")
    return table(spark, sf, "documents").select("doc_id", F.array_join(M.true_keys(flags), ",").alias("flags"))


@query("SELECT user_id AS book_id, event_id AS old, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS chapter FROM events WHERE event_type <> 'error'")
def renumbered_chapters(spark, sf):
    e = table(spark, sf, "events").where("event_type <> 'error'").select(F.col("user_id").alias("book_id"), F.col("event_id").alias("old"), F.col("event_id").alias("chapter"))
    return V.renumbered(e).withColumn("chapter", F.col("chapter").cast("long"))


@query("SELECT vec_id, round((embedding[1]::DOUBLE + embedding[7]::DOUBLE) / 2, 6) AS x, round((embedding[2]::DOUBLE + embedding[8]::DOUBLE) / 2, 6) AS y FROM embeddings")
def quad_left_middles(spark, sf):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    box = F.array(*[F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")) for i in range(4)])
    left = table(spark, sf, "embeddings").select("vec_id", M.quad_left(box).alias("l"))
    return left.select("vec_id", F.round("l.x", 6).alias("x"), F.round("l.y", 6).alias("y"))


@query("""
WITH l AS (SELECT p_brand || '/' || (p_size % 5) || '.txt' AS name, p_partkey, p_partkey || ' ' || p_name AS line FROM part)
SELECT name, sha256(string_agg(line, chr(10) ORDER BY p_partkey)) AS sha, count(*) AS lines FROM l GROUP BY name""")
def written_files(spark, sf):
    """Parts as a file for each brand and size, written, written again with half of the files changed and back, and read as a folder."""
    p = table(spark, sf, "part").select(F.concat("p_brand", F.lit("/"), (F.col("p_size") % 5).cast("string"), F.lit(".txt")).alias("name"), "p_partkey", F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name").alias("line"))
    files = p.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "\n").alias("content"))
    path = scratch_dir(spark, "files")
    for content in (F.col("content"), F.when(F.crc32("name") % 2 == 0, "changed").otherwise(F.col("content")), F.col("content")):
        write_changed(files.withColumn("content", content), path)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return read.select(F.regexp_replace(name, "%23", "#").alias("name"), F.sha2("content", 256).alias("sha"), F.size(F.split(F.decode("content", "UTF-8"), "\n")).cast("long").alias("lines"))
