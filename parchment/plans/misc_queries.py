"""Queries of small functions, page lines and versions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import misc as M
from ..operators import pages as P
from ..operators import versions as V
from .registry import query, table


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE least(greatest(l_quantity / 30.0, 0.7), 1.3) END AS speed, CAST(round_even(250 * least(greatest(l_quantity / 10.0, 0.25), 4.0), 0) AS BIGINT) AS pause FROM lineitem")
def clamped_settings(spark, sf):
    q = F.col("l_quantity").cast("double")
    typed = F.when(F.col("l_linenumber") == 3, "").otherwise(F.replace((q / 30).cast("string"), F.lit("."), F.lit(",")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", M.bounded_number(typed, 0.7, 1.3).alias("speed"), M.scaled_pause(F.lit(250.0), q / 10).alias("pause"))


@query("""
WITH q AS (SELECT vec_id, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS y0, embedding[3]::DOUBLE AS x1, embedding[4]::DOUBLE AS y1, embedding[5]::DOUBLE AS x2, embedding[6]::DOUBLE AS y2, embedding[7]::DOUBLE AS x3, embedding[8]::DOUBLE AS y3 FROM embeddings),
a AS (SELECT *, (atan2(y1 - y0, x1 - x0) + atan2(y2 - y3, x2 - x3)) / 2 AS a FROM q)
SELECT vec_id, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) AS width, round(sqrt((x3 - x0) ** 2 + (y3 - y0) ** 2), 6) AS height, round(a, 6) AS angle,
  round(((x0 - 1) * cos(a) + (y0 - 1) * sin(a) + 1) * 0.24, 6) AS px, round(((y0 - 1) * cos(a) - (x0 - 1) * sin(a) + 1) * 0.24, 6) AS py FROM a""")
def quad_geometry(spark, sf):
    e = F.transform("embedding", lambda v: v.cast("double"))
    box = F.array(*[F.struct(F.get("e", F.lit(2 * i)).alias("x"), F.get("e", F.lit(2 * i + 1)).alias("y")) for i in range(4)])
    q = table(spark, sf, "embeddings").select("vec_id", e.alias("e")).select("vec_id", box.alias("b")).withColumn("a", M.quad_angle(F.col("b")))
    p = M.deskewed(F.col("b")[0]["x"], F.col("b")[0]["y"], F.col("a"), F.lit(2.0), F.lit(2.0), 300.0)
    r = lambda c: F.round(c, 6)
    return q.select("vec_id", r(M.quad_width(F.col("b"))).alias("width"), r(M.quad_height(F.col("b"))).alias("height"), r("a").alias("angle"), r(p["x"]).alias("px"), r(p["y"]).alias("py"))


@query("SELECT doc_id, 'voice_' || left(sha1(source), 16) AS id, CASE WHEN regexp_matches(lower(left(lang, 2)), '^[a-z]{2}$') THEN lower(left(lang, 2)) END AS code FROM documents")
def hash_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.hash_id(F.col("source")).alias("id"), M.language_code(F.col("lang")).alias("code"))


@query("""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS para, unnest(x) AS t FROM d), l2 AS (SELECT *, para % 30 AS s FROM l),
w AS (SELECT *, list_filter(string_split_regex(trim(t), '\\s+'), lambda x: x <> '') AS tok FROM l2),
x AS (SELECT *, len(list_filter(tok, lambda v: regexp_full_match(v, '[\\p{L}''’-]+') AND regexp_matches(v, '(?i)[aeiouyàâäéèêëîïôöùûüœæ]') AND (length(v) >= 2 OR lower(v) IN ('a', 'à', 'y')))) AS good FROM w)
SELECT doc_id, CAST(para AS INT) AS para, CASE WHEN s NOT BETWEEN 5 AND 24 THEN true WHEN regexp_matches(t, '(?i)^\\s*(chapitre|chapter|cap[ií]tulo|kapitel)\\b') THEN true WHEN length(trim(t)) >= 20 THEN false
  WHEN length(regexp_replace(t, '[^\\p{L}]', '', 'g')) < 3 THEN true WHEN upper(t) = t AND length(trim(t)) < 8 THEN true ELSE good < 0.6 * len(tok) END AS garbage FROM x""".replace("\\\\", "\\"))
def garbage_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("para", "t")).withColumn("s", F.col("para") % 30)
    return d.select("doc_id", "para", M.garbage(F.col("t"), F.col("s"), F.lit(5), F.lit(24)).alias("garbage"))


#: First lines of documents stand for lines of a source's pages.
SQL_PAGE = "l AS (SELECT source, doc_id, string_split(text, chr(10))[1] AS text, CAST(doc_id * 37 % 100 AS DOUBLE) AS y, 8 + doc_id % 9 AS h FROM documents)"


@query(f"""
WITH {SQL_PAGE}, m AS (SELECT *, (y > 0.86::DOUBLE * 100 OR y < 0.14::DOUBLE * 100) AS e, trim(regexp_replace(upper(text), '[^A-ZÀ-Ý]+', ' ', 'g')) AS n FROM l),
c AS (SELECT source, n, count(*) AS times FROM m WHERE e AND n <> '' GROUP BY source, n),
s AS (SELECT m.*, coalesce(times, 0) AS times, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS tok FROM m LEFT JOIN c ON c.source = m.source AND c.n = m.n),
r AS (SELECT source, doc_id, text, h, regexp_full_match(text, '\\s*\\d{{1,4}}\\s*') OR (length(trim(text)) <= 2 AND h < 18) OR NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]')
  OR (len(tok) >= 3 AND len(list_filter(tok, lambda x: length(x) = 1)) >= 0.75 * len(tok)) OR (e AND times >= 3) OR (doc_id % 50 = 0 AND length(text) <= 60 AND h < 12.5)
  OR (e AND (h < 8.5 OR (upper(text) = text AND lower(text) <> text))) AS running FROM s)
SELECT source, doc_id, running, NOT running AND h >= 12.5 AND NOT (h >= 18 AND regexp_full_match(trim(text), '\\p{{L}}[''’]?')) AS heading FROM r""".replace("\\\\", "\\"))
def running_lines(spark, sf):
    first = F.split("text", "\n")[0]
    lines = table(spark, sf, "documents").select("source", "doc_id", first.alias("text"), (F.col("doc_id") * 37 % 100).cast("double").alias("y"), (8 + F.col("doc_id") % 9).cast("double").alias("h"))
    return P.classify(lines, ["source"], F.lit(10.0), F.lit(100.0), F.col("doc_id") % 50 == 0).select("source", "doc_id", "running", "heading")


@query("""
WITH p AS (SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS chapter, doc_id, n_chars FROM documents),
m AS (SELECT book_id, CASE WHEN chapter >= 4 THEN chapter - 1 ELSE chapter END AS chapter, chapter AS was, doc_id, n_chars FROM p)
SELECT book_id, CAST(chapter AS BIGINT) AS chapter, arg_min(doc_id, was) AS doc_id, count(*) AS n_paragraphs, arg_min(n_chars, was) AS "first", arg_max(n_chars, was) AS "last" FROM m GROUP BY book_id, chapter""")
def merged_chapters(spark, sf):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    c = table(spark, sf, "documents").select(F.col("source").alias("book_id"), rank.alias("chapter"), "doc_id", F.array("text").alias("paragraphs"), F.struct(F.col("n_chars").alias("first"), F.col("n_chars").alias("last")).alias("pages"))
    m = V.merge_into_previous(c, 4)
    return m.select("book_id", F.col("chapter").cast("long").alias("chapter"), "doc_id", F.size("paragraphs").cast("long").alias("n_paragraphs"), "pages.first", "pages.last")


@query("""SELECT event_id, array_to_string(list_sort(list_filter([CASE WHEN value > 50 THEN 'hate' END, CASE WHEN user_id % 3 = 0 THEN 'spam' END], lambda x: x IS NOT NULL)), ',') AS found FROM events""")
def nested_violations(spark, sf):
    j = F.format_string('{"a": {"hate": {"violated": %s, "score": 1}}, "spam": {"violated": %s}, "n": 3}', F.col("value") > 50, F.col("user_id") % 3 == 0)
    return table(spark, sf, "events").select("event_id", F.array_join(M.violations(j), ",").alias("found"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'P' THEN o_orderkey END AS c, o_orderpriority LIKE '5%' AS wanting FROM orders)
SELECT o_orderkey, CASE WHEN wanting THEN coalesce(lag(c) OVER w, lead(c) OVER w) ELSE c END AS c FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def borrowed_titles(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey")).alias("c"), F.col("o_orderpriority").startswith("5").alias("wanting"))
    return P.borrowed_from_neighbours(o, ["o_custkey"], "o_orderkey", "c", F.col("wanting")).select("o_orderkey", "c")
