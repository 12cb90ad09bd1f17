"""Queries of page spans, casts and words on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..functions import text as T
from ..operators import library as L
from ..operators import review
from . import number_sql as N
from .registry import query, table, texts
from .text_queries import SQL_TOKENS

#: Lines of an order stand for spans of a page.
SQL_SPANS = "s AS (SELECT l_orderkey AS page, l_linenumber AS line, CAST(l_partkey % 40 AS DOUBLE) AS x, CAST(l_suppkey % 100 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS size, l_returnflag || l_linestatus AS text FROM lineitem)"


def _spans(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 40).cast("double").alias("x"), (F.col("l_suppkey") % 100).cast("double").alias("y"),
        F.col("l_quantity").cast("double").alias("size"), F.concat("l_returnflag", "l_linestatus").alias("text"),
    )


@query(f"WITH {SQL_SPANS} SELECT page, CAST(sum(CASE WHEN y >= 10 AND y < 90 AND size BETWEEN 5 AND 40 THEN length(trim(text)) ELSE 0 END) AS BIGINT) AS chars FROM s GROUP BY page")
def page_chars(spark, sf):
    return L.page_chars(_spans(spark, sf), F.lit(5), F.lit(40), F.lit(10), F.lit(90))


@query(f"WITH {SQL_SPANS}, r AS (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY size) - 1 AS r, count(*) OVER (PARTITION BY page, line) AS n FROM s) SELECT page, line, min(y) AS y, min(x) AS x, max(size) FILTER (r = n // 2) AS size, max(size) AS top_size, string_agg(text, '' ORDER BY x, text) AS text FROM r GROUP BY page, line")
def page_lines(spark, sf):
    return L.page_lines(_spans(spark, sf))


@query(f"WITH {SQL_SPANS}, f AS (SELECT page, arg_min(text, (line, size, text)) AS t, arg_min(size, (line, size, text)) AS z FROM s GROUP BY page) SELECT page, t AS title FROM f WHERE z >= 1.25 * 24")
def heading_starts(spark, sf):
    s = _spans(spark, sf).select("page", F.struct("line", "size", "text").alias("line"), "size", "text")
    return L.heading_starts(s, F.lit(24.0))


@query(f"""
WITH {SQL_SPANS}, g AS (SELECT DISTINCT ON (page, line) page, line, x, text FROM s ORDER BY page, line, size, x, text),
p AS (SELECT *, sum(CASE WHEN x > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line) AS n FROM g)
SELECT page, CAST(n AS BIGINT) AS paragraph, string_agg(text, ' ' ORDER BY line) AS text FROM p GROUP BY page, n""")
def native_paragraphs(spark, sf):
    one = _spans(spark, sf).groupBy("page", "line").agg(F.min(F.struct("size", "x", "text")).alias("m")).select("page", "line", "m.x", "m.text")
    return L.native_paragraphs(one, F.lit(16.0))


@query(f"""
WITH {SQL_SPANS}, g AS (SELECT page, line, min(x) AS x, max(size) AS width, min(text) || CASE WHEN max(size) < 12 THEN '.' ELSE '' END AS text FROM s GROUP BY page, line),
m AS (SELECT page, min(x) AS m, median(width) AS w FROM g GROUP BY page),
o AS (SELECT g.*, CASE WHEN x > m + 4 OR coalesce(lag(width < 0.8 * w AND ends_with(text, '.')) OVER (PARTITION BY g.page ORDER BY line), false) THEN 1 ELSE 0 END AS o FROM g JOIN m USING (page)),
p AS (SELECT *, sum(o) OVER (PARTITION BY page ORDER BY line) AS n FROM o)
SELECT page, CAST(n AS BIGINT) AS paragraph, string_agg(text, ' ' ORDER BY line) AS text FROM p GROUP BY page, n""")
def scan_paragraphs(spark, sf):
    s = _spans(spark, sf).groupBy("page", "line").agg(F.min("x").alias("x"), F.max("size").alias("width"), F.min("text").alias("t"))
    return L.scan_paragraphs(s.select("page", "line", "x", "width", F.concat("t", F.when(F.col("width") < 12, ".").otherwise("")).alias("text")))


@query("SELECT c_custkey, c_mktsegment AS role, coalesce(v, 'narrator') AS voice FROM customer LEFT JOIN (SELECT lower(c_mktsegment) AS r, max(c_name) AS v FROM customer WHERE c_nationkey = 3 GROUP BY 1) ON r = lower(c_mktsegment)")
def voiced_segments(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("role"), F.col("c_name").alias("voice"))
    return L.voiced(c.select("c_custkey", "role"), c.where("c_nationkey = 3"), F.lit("narrator"))


@query("SELECT n_name AS service, coalesce(state, 'absent') AS state FROM nation LEFT JOIN (SELECT s_nationkey, max(CASE WHEN s_acctbal > 8500 THEN 'running' ELSE 'exited' END) AS state FROM supplier WHERE s_acctbal > 7000 GROUP BY 1) ON s_nationkey = n_nationkey")
def service_inventory(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("service"))
    s = table(spark, sf, "supplier").where("s_acctbal > 7000").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("service", F.when(F.col("s_acctbal") > 8500, "running").otherwise("exited").alias("state"))
    return L.inventory(n.select("service"), s)


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')")
def card_search(spark, sf):
    return L.search(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"], "Brand#1").select("p_partkey")


@query("SELECT l_orderkey, count(*) AS n, array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') AS causes FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def flagged_causes(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_returnflag") != "R").alias("clean"), F.col("l_linestatus").alias("cause"))
    return L.flagged_causes(t, ["l_orderkey"]).select("l_orderkey", "n", F.array_join("causes", ",").alias("causes"))


@query("SELECT DISTINCT w AS form FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM documents UNION ALL SELECT lower(p_type) FROM part) WHERE w NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) FROM documents WHERE lang = 'en')")
def allowed_words(spark, sf):
    d = table(spark, sf, "documents")
    forms = lambda df: df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("form"))
    return L.allowed_words(table(spark, sf, "part").select(F.lower("p_type").alias("form")), forms(d), forms(d.where("lang = 'en'")))


@query(
    rf"""
WITH {SQL_TOKENS}, last AS (SELECT doc_id, arg_max(word, "offset") AS word, max("offset") - 60 AS asked FROM toks GROUP BY doc_id),
pieces AS (SELECT doc_id, string_split(regexp_replace(text, '([\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS l FROM documents),
each AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS piece FROM pieces),
placed AS (SELECT doc_id, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM each),
near AS (SELECT last.doc_id, arg_min(spot, (abs(spot - asked), spot)) AS best FROM last JOIN placed ON placed.doc_id = last.doc_id AND piece = word GROUP BY last.doc_id)
SELECT d.doc_id, word, CAST(CASE WHEN asked >= 0 AND substring(text, asked + 1, length(word)) = word THEN asked ELSE coalesce(best, nullif(instr(text, word) - 1, -1)) END AS INT) AS place
FROM documents d JOIN last USING (doc_id) LEFT JOIN near USING (doc_id)
"""
)
def relocated_words(spark, sf):
    """Where the last word of each text stands, asked for 60 characters before its place."""
    toks = review.tokens(texts(spark, sf)).groupBy("doc_id").agg(F.max_by("word", "offset").alias("word"), F.max("offset").cast("int").alias("offset"))
    d = toks.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", "word", L.relocated(F.col("text"), F.col("word"), F.col("offset") - 60).alias("place"))


@query("SELECT conv_id, array_to_string(l[1:2] || ['@Ann'] || l[3:4] || ['@'] || l[5:], '|') AS text FROM (SELECT conv_id, list(replace(text, '@', '#') ORDER BY turn) AS l FROM conversations GROUP BY conv_id) WHERE len(l) >= 4")
def assigned_paragraphs(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.replace("text", F.lit("@"), F.lit("#")).alias("t")))), lambda x: x["t"]).alias("l")).where(F.size("l") >= 4)
    return c.select("conv_id", F.array_join(L.assigned(F.col("l"), F.lit(2), F.lit(3), F.lit("Ann")), "|").alias("text"))


@query(
    rf"""
WITH {N.WORDS}, d AS (SELECT doc_id, doc_id % 120 AS n, regexp_replace(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g'), '^[ .:\-—–_*#]+|[ .:\-—–_*#]+$', '', 'g') AS bare FROM documents),
t AS (SELECT doc_id, n, regexp_replace(trim(bare), '^\d+\s*[.:)\-–—]\s+(\S)', '\1') AS t FROM d),
c AS (SELECT doc_id, n, regexp_replace(trim(CASE WHEN t <> '' AND upper(t) = t THEN upper(t[1]) || lower(t[2:]) ELSE t END), '[.\s]+$', '') AS t FROM t),
k AS (SELECT doc_id, n, CASE WHEN regexp_full_match(lower(t), '(chapitres?\s*\d+)?') THEN '' ELSE t END AS t, 'Chapitre ' || {N.NUMBER.format("CAST(n AS VARCHAR)")} || '.' AS s FROM c, spoken)
SELECT doc_id, CASE WHEN n = 0 THEN '' WHEN n = 7 THEN CASE WHEN t <> '' THEN t || '.' ELSE '' END WHEN t <> '' THEN s || ' ' || t || '.' ELSE s END AS said FROM k
"""
)
def announcements(spark, sf):
    """What is said before the chapters of a source; numbers are put in words."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 120).alias("n"), T.clean_title(F.substring_index("text", "\n", 1)).alias("title"))
    words = numbers.spelled_numbers(F.col("n").cast("string"))
    return d.withColumn("words", words).select("doc_id", L.chapter_announcement(F.col("n"), F.col("words"), F.col("title"), F.col("n") == 7).alias("said"))
