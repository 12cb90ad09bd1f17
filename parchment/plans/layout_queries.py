"""Queries of layout statistics, casts, reuse and lookups on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import casting as C
from ..operators import layout as L
from .registry import query, table


@query("SELECT l_returnflag, quantile_disc(l_quantity, 0.5)::DOUBLE AS dominant FROM lineitem GROUP BY 1")
def weighted_median_size(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("q"))
    return L.dominant(li, ["l_returnflag"], "q")


@query("""
WITH r AS (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(v) FILTER (r = least(n - 1, floor(n * 0.1))) AS p10, max(v) FILTER (r = least(n - 1, floor(n * 0.5))) AS p50, max(v) FILTER (r = least(n - 1, floor(n * 0.9))) AS p90 FROM r GROUP BY 1""")
def nearest_rank_percentiles(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    return L.nearest_rank(li, ["l_returnflag"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


#: Lines of an order stand for lines of a page: quantity for the size, a hash of keys for y on a page of 100.
SQL_LINES = "l AS (SELECT l_suppkey AS page, CAST((l_orderkey * 7 + l_linenumber * 13) % 100 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS size FROM lineitem)"


@query(f"""
WITH {SQL_LINES}, b AS (SELECT page, quantile_disc(size, 0.5) AS d FROM l GROUP BY page),
z AS (SELECT page, y, d, CASE WHEN y < 0.14::DOUBLE * 100 THEN 'top' WHEN y > 0.86::DOUBLE * 100 THEN 'bottom' END || CASE WHEN size < 0.85::DOUBLE * d THEN '_run' ELSE '_body' END AS zone FROM l JOIN b USING (page)),
m AS (SELECT page, zone, y FROM (SELECT *, row_number() OVER (PARTITION BY page, zone ORDER BY y) - 1 AS r, count(*) OVER (PARTITION BY page, zone) AS n FROM z WHERE zone IS NOT NULL) WHERE r = n // 2),
w AS (SELECT page, max(y) FILTER (zone = 'top_run') AS tr, max(y) FILTER (zone = 'top_body') AS tb, max(y) FILTER (zone = 'bottom_run') AS br, max(y) FILTER (zone = 'bottom_body') AS bb FROM m GROUP BY page)
SELECT page, 0.78 * d AS body_min, 1.32 * d AS body_max, coalesce(CASE WHEN tr < tb THEN (tr + tb) / 2 END, 0) AS header_y, coalesce(CASE WHEN bb < br THEN (bb + br) / 2 END, 100) AS footer_y
FROM b LEFT JOIN w USING (page)""")
def layout_bands(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 100).cast("double").alias("y"), F.col("l_quantity").cast("double").alias("size"))
    return L.layout_bands(li, ["page"], "y", "size", F.lit(100.0))


@query("SELECT source, lang, CAST(w AS BIGINT) AS w FROM (SELECT source, lang, sum(n_chars) AS w, sum(sum(n_chars)) OVER (PARTITION BY source) AS t FROM documents GROUP BY source, lang) WHERE w < 0.1 * t")
def rare_groups(spark, sf):
    return L.rare(table(spark, sf, "documents"), ["source"], "lang", F.col("n_chars"), 0.1)


@query(r"""
WITH h AS (SELECT source, trim(regexp_replace(upper(string_split(text, chr(10))[1]), '[^A-ZÀ-Ý]+', ' ', 'g')) AS head FROM documents)
SELECT source, head, count(*) AS n FROM h GROUP BY ALL HAVING count(*) >= 2""")
def repeated_heads(spark, sf):
    head = T.head_letters(F.substring_index("text", "\n", 1))
    return table(spark, sf, "documents").groupBy("source", head.alias("head")).agg(F.count("*").alias("n")).where("n >= 2")


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY source, lang) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, f) = 1")
def mode_first_seen(spark, sf):
    return L.mode_first_seen(table(spark, sf, "documents"), ["source"], "lang", "doc_id")


@query("SELECT l_suppkey, mode FROM (SELECT l_suppkey, CAST(l_linenumber AS BIGINT) AS mode, sum(l_quantity) AS w, min(l_orderkey) AS f FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, f) = 1")
def weighted_mode(spark, sf):
    return L.weighted_mode(table(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_linenumber").cast("long"), F.col("l_quantity"), "l_orderkey")


@query("""
WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
p AS (SELECT vec_id, i // 2 AS k, max(v) FILTER (i % 2 = 1) AS x, max(v) FILTER (i % 2 = 0) AS y FROM (SELECT vec_id, i - 1 AS i, v FROM e) GROUP BY ALL),
s AS (SELECT a.vec_id, (b.x - a.x) / (b.y - a.y) AS s FROM p a JOIN p b ON a.vec_id = b.vec_id AND (b.y, b.x) > (a.y, a.x) WHERE abs(b.y - a.y) >= 0.1)
SELECT e.vec_id, round(CASE WHEN count(s) >= 3 THEN -atan(median(s)) ELSE 0 END, 6) AS angle FROM (SELECT DISTINCT vec_id FROM e) e LEFT JOIN s USING (vec_id) GROUP BY e.vec_id""")
def theil_sen_skew(spark, sf):
    """Vectors as pages of 32 points."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    p = e.groupBy("vec_id", F.floor(F.col("i") / 2).alias("k")).agg(F.max(F.when(F.col("i") % 2 == 1, F.col("v"))).cast("double").alias("x"), F.max(F.when(F.col("i") % 2 == 0, F.col("v"))).cast("double").alias("y"))
    return L.skew(p, "vec_id", "x", "y", F.lit(0.1)).withColumn("angle", F.round("angle", 6))


@query(f"""
WITH {SQL_LINES.replace("size FROM", "size, l_orderkey, l_linenumber FROM")}, g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y, l_orderkey, l_linenumber) > 1 THEN 1 ELSE 0 END AS n FROM l)
SELECT page, line, count(*) AS spans, min(y) AS y_min, max(y) AS y_max FROM (SELECT page, y, CAST(sum(n) OVER (PARTITION BY page ORDER BY y, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM g) GROUP BY page, line""")
def line_groups(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 100).cast("double").alias("y"), "l_orderkey", "l_linenumber")
    g = L.line_groups(li, ["page"], "y", ["l_orderkey", "l_linenumber"], 1.0)
    return g.groupBy("page", "line").agg(F.count("*").alias("spans"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS f FROM documents),
m AS (SELECT DISTINCT f[1] || '?' || f[3:] AS word FROM w), c AS (SELECT word, chr(CAST(97 + k AS INT)) AS letter FROM m, range(26) t(k))
SELECT letter, count(*) AS votes FROM c WHERE replace(word, '?', letter) IN (SELECT f FROM w) GROUP BY letter""")
def glyph_votes(spark, sf):
    """All words with their second letter masked."""
    d = table(spark, sf, "documents")
    w = d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("form")).distinct()
    return L.glyph_votes(w.select(F.concat(F.substring("form", 1, 1), F.lit("?"), F.substring("form", 3, 1 << 30)).alias("word")), w)


#: Orders stand for segments, their lines for takes of customers' texts.
@query("""
WITH s AS (SELECT o_orderkey, o_custkey AS text, o_orderstatus AS voice FROM orders),
t AS (SELECT DISTINCT o_custkey AS text, o_orderstatus AS voice FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' AND l_quantity > 40)
SELECT o_orderkey, s.text, s.voice, CASE WHEN t.text IS NULL THEN 'render' ELSE 'reuse' END AS action FROM s LEFT JOIN t ON s.text = t.text AND s.voice = t.voice""")
def reuse_plan(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("text"), F.col("o_orderstatus").alias("voice"))
    takes = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("text", "voice", "l_linenumber", (F.col("l_returnflag") != "R").alias("clean"), F.lit(40.0).alias("start"), F.col("l_quantity").cast("double").alias("end"))
    return C.reuse_plan(o, takes, ["text", "voice"], "l_linenumber")


@query("""
WITH s AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i, l_returnflag AS x, l_shipdate, l_quantity FROM lineitem),
m AS (SELECT k, i, CASE WHEN l_quantity > 48 THEN 'X' ELSE x END AS x FROM s WHERE l_quantity < 50)
SELECT k, count(s.x) AS n_segments, count(m.x) AS n_manifest, bool_and(s.x IS NOT NULL AND m.x IS NOT NULL AND s.x = m.x) AS current FROM s FULL JOIN m USING (k, i) GROUP BY k""")
def track_currency(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.row_number().over(w).alias("i"), F.col("l_returnflag").alias("x"), "l_quantity")
    m = s.where("l_quantity < 50").withColumn("x", F.when(F.col("l_quantity") > 48, "X").otherwise(F.col("x")))
    return C.track_currency(s, m, "k", "i", "x")


@query("SELECT c_mktsegment AS role, c_name AS voice FROM customer WHERE c_name <> '' AND lower(c_mktsegment) IN (SELECT lower(c_mktsegment) FROM customer WHERE c_nationkey = 3)")
def effective_voices(spark, sf):
    c = table(spark, sf, "customer")
    cast = c.select(F.col("c_mktsegment").alias("role"), F.col("c_name").alias("voice"))
    return C.effective_voices(cast, c.where("c_nationkey = 3").select(F.col("c_mktsegment").alias("role")))


@query("""
WITH a AS (SELECT DISTINCT 'r' || (s_suppkey % 40 + 5) AS k FROM supplier), b AS (SELECT DISTINCT 'r' || c_custkey % 38 AS k FROM customer)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'voice without segments' ELSE 'role without voice' END AS issue FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def cast_diagnostics(spark, sf):
    """Suppliers stand for voices of a role, customers for segments of one; roles are written in either case."""
    cast = table(spark, sf, "supplier").select(F.concat(F.lit("r"), (F.col("s_suppkey") % 40 + 5).cast("string")).alias("role"))
    return C.cast_diagnostics(cast, table(spark, sf, "customer").select(F.concat(F.lit("R"), (F.col("c_custkey") % 38).cast("string")).alias("role")))


@query("""
WITH w AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE p_name[2:] END AS w FROM part), n AS (SELECT DISTINCT p_name AS name FROM part),
e AS (SELECT w, name FROM w JOIN n ON w = name), o AS (SELECT w FROM w WHERE w NOT IN (SELECT w FROM e)),
i AS (SELECT w, min(name) AS name FROM o JOIN n ON lower(w) = lower(name) GROUP BY w HAVING count(*) = 1),
s AS (SELECT w, min(name) AS name FROM o JOIN n ON contains(lower(name), lower(w)) WHERE w NOT IN (SELECT w FROM i) GROUP BY w HAVING count(*) = 1)
SELECT w.w, f.name AS found FROM w LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM i UNION ALL SELECT * FROM s) f ON w.w = f.w""")
def resolve_voice(spark, sf):
    p = table(spark, sf, "part")
    form = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.substring("p_name", 2, 1 << 30))
    return C.resolve(p.select(form.alias("w")).distinct(), p.select(F.col("p_name").alias("name")))


@query("""SELECT p_partkey, p_type || '/' || p_brand || '+dialogue=' || p_name || '+letter=x@' || printf('%.2f', p_size / 4.0) AS sig, p_type AS backend, p_brand AS voice, p_name AS dialogue, p_size / 4.0 AS speed FROM part""")
def signature_build_parse(spark, sf):
    p = table(spark, sf, "part")
    sig = C.signature(F.col("p_type"), F.col("p_brand"), F.create_map(F.lit("letter"), F.lit("x"), F.lit("dialogue"), F.col("p_name")), F.col("p_size") / 4.0)
    parsed = p.select("p_partkey", sig.alias("sig")).withColumn("s", C.parse_signature(F.col("sig")))
    return parsed.select("p_partkey", "sig", "s.backend", "s.voice", F.col("s.roles")["dialogue"].alias("dialogue"), "s.speed")


@query("SELECT key, c_mktsegment FROM (SELECT lower(c_mktsegment) AS key, c_mktsegment, row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY c_custkey) AS r FROM customer) WHERE r = 1")
def persona_names(spark, sf):
    return C.keep_first(table(spark, sf, "customer"), "c_mktsegment", "c_custkey")


@query(r"""
WITH n AS (SELECT page_id, regexp_replace(regexp_replace(url, '^\w+://', ''), '[?#].*$', '') AS name FROM pages),
h AS (SELECT DISTINCT ON (href) href, pos, title FROM (SELECT regexp_replace(regexp_replace(url, '^\w+://[^/]+/', ''), '[?#].*$', '') AS href, page_id AS pos, 't' || page_id AS title FROM pages) ORDER BY href, pos)
SELECT n.page_id, (SELECT min_by(title, pos) FROM h WHERE ends_with(n.name, href) AND href <> '') AS title FROM n""")
def toc_suffix_join(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", r"^\w+://", ""), r"[?#].*$", "").alias("name"))
    toc = table(spark, sf, "pages").select(F.regexp_replace(F.regexp_replace("url", r"^\w+://[^/]+/", ""), r"[?#].*$", "").alias("href"), F.col("page_id").alias("pos"))
    first = toc.where("href <> ''").groupBy("href").agg(F.min("pos").alias("pos")).withColumn("title", F.concat(F.lit("t"), F.col("pos").cast("string")))
    titles = C.suffix_join(p.select("name").distinct(), first)
    return p.join(titles, "name").select("page_id", "title")
