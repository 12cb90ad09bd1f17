"""Queries of pages and their lines: orders, base lines, chapters, paragraphs; archives and paged services."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import orderings as O
from ..operators import pages as P
from ..operators import shelf as S
from ..sources import epub
from ..sources.epub import packed
from ..sources.paged import paged_source
from ..sources.pages import named
from .registry import query, table
from .source_queries import SQL_BLOCKS


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 5 DESC, l_partkey % 7, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS place FROM lineitem")
def reading_order(spark, sf):
    li = table(spark, sf, "lineitem").select("*", (F.col("l_suppkey") % 5).alias("y"), (F.col("l_partkey") % 7).alias("x"))
    o = O.reading_order(li, ["l_orderkey"], "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return o.select("l_orderkey", "l_linenumber", "l_partkey", F.col("place").cast("long").alias("place"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 5, l_partkey % 7, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS place FROM lineitem")
def span_order(spark, sf):
    li = table(spark, sf, "lineitem").select("*", (F.col("l_suppkey") % 5).alias("y"), (F.col("l_partkey") % 7).alias("x"))
    o = O.span_order(li, ["l_orderkey"], "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return o.select("l_orderkey", "l_linenumber", "l_partkey", F.col("place").cast("long").alias("place"))


@query("""
WITH f AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'notes' || chr(CAST(97 + o_orderkey % 26 AS INT)) || '.md' ELSE 'ch' || o_orderkey || '.md' END AS name FROM orders)
SELECT o_custkey, name, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey END NULLS LAST, name, o_orderkey) - 1 AS place FROM f""")
def natural_order(spark, sf):
    plain = F.concat(F.lit("notes"), F.char(97 + F.col("o_orderkey") % 26), F.lit(".md"))
    name = F.when(F.col("o_orderkey") % 9 == 0, plain).otherwise(F.concat(F.lit("ch"), F.col("o_orderkey").cast("string"), F.lit(".md")))
    return O.natural_order(table(spark, sf, "orders").select("o_custkey", name.alias("name")), ["o_custkey"]).withColumn("place", F.col("place").cast("long"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 8")
def previews(spark, sf):
    return O.preview(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey").drop("place")


@query("""
WITH v AS (SELECT DISTINCT p_brand, p_name || CASE p_partkey % 3 WHEN 0 THEN ' - Neutral' WHEN 1 THEN ' - Sad' ELSE '' END AS name FROM part)
SELECT p_brand, name, row_number() OVER (PARTITION BY p_brand ORDER BY NOT contains(lower(name), 'neutral'), name) - 1 AS place FROM v""")
def neutral_voices(spark, sf):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " - Neutral").when(F.col("p_partkey") % 3 == 1, " - Sad").otherwise(""))
    return O.neutral_first(table(spark, sf, "part").select("p_brand", name.alias("name")).distinct(), ["p_brand"]).withColumn("place", F.col("place").cast("long"))


@query("SELECT n_regionkey, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name IN ('NATION_0', 'NATION_1', 'NATION_12'), lower(n_name), n_name) - 1 AS place FROM nation")
def shipped_voices(spark, sf):
    n = table(spark, sf, "nation").select("n_regionkey", F.col("n_name").alias("name"))
    return O.shipped_last(n, ["n_regionkey"], ["NATION_0", "NATION_1", "NATION_12"]).withColumn("place", F.col("place").cast("long"))


#: Lines of orders stand for fragments of a page; heights and base lines are whole numbers, so that both sides compare alike.
SQL_FRAGMENTS = "f AS (SELECT DISTINCT l_orderkey AS page, CAST(l_partkey % 50 AS DOUBLE) AS x, CAST(l_suppkey % 4 AS DOUBLE) * 10 + l_linenumber % 2 AS y, CAST(8 + l_quantity % 7 AS DOUBLE) AS h, 'w' || l_partkey AS text, l_returnflag = 'R' AS rare FROM lineitem)"


def _fragments(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 50).cast("double").alias("x"), ((F.col("l_suppkey") % 4).cast("double") * 10 + F.col("l_linenumber") % 2).alias("y"),
        (8 + F.col("l_quantity") % 7).cast("double").alias("h"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), (F.col("l_returnflag") == "R").alias("rare"),
    ).distinct()


@query(f"""
WITH {SQL_FRAGMENTS}, l AS (SELECT page, list({{'t': text, 'y': y, 'h': h, 'r': rare}} ORDER BY -y, x, text, y, h, rare) AS l FROM f GROUP BY page),
m AS (SELECT page, list_reduce(l, lambda a, x: CASE WHEN len(a) > 0 AND a[-1].r = x.r AND abs(a[-1].y - x.y) <= 0.15::DOUBLE * greatest(a[-1].h, x.h) AND least(a[-1].h, x.h) > 0.6::DOUBLE * greatest(a[-1].h, x.h)
  THEN a[:-2] || [{{'t': trim(a[-1].t || ' ' || x.t), 'y': a[-1].y, 'h': greatest(a[-1].h, x.h), 'r': x.r}}] ELSE a || [x] END, CAST([] AS STRUCT(t VARCHAR, y DOUBLE, h DOUBLE, r BOOLEAN)[])) AS m FROM l)
SELECT page, CAST(unnest(range(len(m))) AS INT) AS pos, unnest(list_transform(m, lambda x: x.t)) AS text, unnest(list_transform(m, lambda x: x.y)) AS y, unnest(list_transform(m, lambda x: x.h)) AS h, unnest(list_transform(m, lambda x: x.r)) AS rare FROM m""")
def merged_baselines(spark, sf):
    return P.merged_baselines(_fragments(spark, sf))


@query("""
WITH g AS (SELECT o_custkey AS book, o_orderkey AS page, CASE WHEN o_orderstatus = 'P' THEN o_orderkey END AS a, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'One' ELSE 'Two' END AS header FROM orders),
f AS (SELECT *, last_value(a IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS l, first_value(a IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM g WINDOW w AS (PARTITION BY book ORDER BY page)),
c AS (SELECT book, l, header, count(*) AS n, min(page) AS f FROM f WHERE a IS NULL AND header <> '' AND l IS NOT NULL GROUP BY book, l, header),
t AS (SELECT book, l, arg_max(header, (n, -f, header)) AS title FROM c GROUP BY book, l),
k AS (SELECT f.*, title, max(CASE WHEN f.header = title OR a IS NOT NULL THEN page END) OVER (PARTITION BY f.book, f.l) AS s FROM f LEFT JOIN t ON t.book = f.book AND t.l = f.l)
SELECT book, page, CASE WHEN l IS NULL THEN n WHEN page > s AND n IS NOT NULL THEN n ELSE l END AS chapter FROM k""")
def chapters_of_pages(spark, sf):
    header = F.when(F.col("o_orderkey") % 4 == 0, "").when(F.col("o_orderkey") % 4 == 1, "One").otherwise("Two")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("page"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey")).alias("number"), header.alias("header"))
    return P.chapter_of_pages(o, ["book"], "page", F.col("number")).select("book", "page", "chapter")


#: Three lines of each fifth of an order stand for a page; x, y and h follow from their numbers.
SQL_BODY = """
b AS (SELECT l_orderkey AS chapter, l_linenumber AS page, CAST(90 - 12 * r - CASE WHEN l_partkey % 5 = 0 AND r > 1 THEN 12 ELSE 0 END AS DOUBLE) AS y, CASE WHEN l_suppkey % 3 = 0 AND r = 1 THEN 16.0 ELSE 10.0 END AS x,
  CASE WHEN l_partkey % 4 = 0 AND r = 0 THEN 22.0 ELSE 10.0 END AS h, CASE WHEN l_partkey % 4 = 0 AND r = 0 THEN 'L''' ELSE ['word', 'Lower', 'end-'][CAST((l_partkey + r) % 3 AS INT) + 1] || r END AS text, r
  FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey), (SELECT unnest(range(4)) AS r))"""


@query(f"""
WITH {SQL_BODY}, g AS (SELECT *, lag(y) OVER w AS above, lag(h >= 18) OVER w AS cap, min(x) OVER (PARTITION BY chapter, page) AS margin FROM b WINDOW w AS (PARTITION BY chapter, page ORDER BY y DESC, x)),
gaps AS (SELECT chapter, page, list_sort(list(above - y))[len(list(above - y)) // 2 + 1] AS pitch FROM g WHERE above > y GROUP BY chapter, page),
kept AS (SELECT g.*, pitch, CASE WHEN cap THEN NULL ELSE above END AS above2 FROM g LEFT JOIN gaps ON gaps.chapter = g.chapter AND gaps.page = g.page WHERE h < 18),
o AS (SELECT *, CASE WHEN coalesce(cap, false) OR (above2 IS NOT NULL AND above2 - y > 1.6::DOUBLE * pitch) OR (x - margin > 3 AND NOT regexp_matches(text, '^[a-z]')) OR row_number() OVER (PARTITION BY chapter ORDER BY page, y DESC, x) = 1 THEN 1 ELSE 0 END AS o FROM kept),
n AS (SELECT *, sum(o) OVER (PARTITION BY chapter ORDER BY page, y DESC, x) - 1 AS pos, CASE WHEN cap THEN 'L''' ELSE '' END || text AS t FROM o)
SELECT chapter, CAST(pos AS BIGINT) AS pos, string_agg(t, ' ' ORDER BY page, y DESC, x) AS text FROM n GROUP BY chapter, pos""")
def fixed_paragraphs(spark, sf):
    """Pages of four lines: a first line may be a drop cap, a second one indented, a wide gap may follow it."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("m")).select("l_orderkey", "l_linenumber", "m.*")
    b = li.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("r"))
    cap = (F.col("l_partkey") % 4 == 0) & (F.col("r") == 0)
    word = F.concat(F.element_at(F.array(F.lit("word"), F.lit("Lower"), F.lit("end-")), ((F.col("l_partkey") + F.col("r")) % 3 + 1).cast("int")), F.col("r").cast("string"))
    line = F.struct(
        F.col("l_linenumber").alias("page"), F.when(cap, "L'").otherwise(word).alias("text"), F.when((F.col("l_suppkey") % 3 == 0) & (F.col("r") == 1), 16.0).otherwise(10.0).alias("x"),
        (90 - 12 * F.col("r") - F.when((F.col("l_partkey") % 5 == 0) & (F.col("r") > 1), 12).otherwise(0)).cast("double").alias("y"), F.when(cap, 22.0).otherwise(10.0).alias("h"),
    )
    packed = b.groupBy(F.col("l_orderkey").alias("chapter")).agg(F.collect_list(line).alias("lines"))
    return packed.mapInPandas(P.fixed_paragraphs(10.0), "chapter long, pos long, text string")


@query("""
WITH l AS (SELECT doc_id // 4 AS book, doc_id % 4 AS page, unnest(range(len(x))) AS pos, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
s AS (SELECT *, (pos + page) % 5 = 0 AS running, length(text) % 3 <> 0 AS heading FROM l), v AS (SELECT * FROM s WHERE NOT running),
f AS (SELECT book, page, arg_min(text, pos) AS title, arg_min(heading, pos) AS heading, sum(length(text)) AS n FROM v GROUP BY book, page)
SELECT book, page, title FROM f WHERE heading AND n >= 40""")
def opening_headings(spark, sf):
    d = table(spark, sf, "documents").select(F.expr("doc_id div 4").alias("book"), (F.col("doc_id") % 4).alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    marked = d.withColumn("running", (F.col("pos") + F.col("page")) % 5 == 0).withColumn("heading", F.length("text") % 3 != 0)
    return S.opening_headings(marked, ["book"])


@query("""
WITH g AS (SELECT l_orderkey AS book, l_suppkey % 3 AS font, l_partkey % 20 AS code, min(l_linenumber * 1000 + l_partkey % 1000) AS at_ FROM lineitem GROUP BY 1, 2, 3)
SELECT book, font, code, row_number() OVER (PARTITION BY book ORDER BY at_, font, code) - 1 AS id FROM g""")
def glyph_placeholders(spark, sf):
    g = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book"), (F.col("l_suppkey") % 3).alias("font"), (F.col("l_partkey") % 20).alias("code"), (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000).alias("at"))
    return S.placeholders(g, ["book"], "at").withColumn("id", F.col("id").cast("long"))


def _archives(spark, sf):
    """An e-book for each page: a cover, the page, listed or not, and a short page that the contents don't list."""

    def pack(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                paths, books = [], []
                for i, html in zip(part.column("page_id").to_pylist(), part.column("html").to_pylist()):
                    title = f"Page & {i}" if i % 3 else None
                    documents = [("cover.xhtml", None, "<p>cover</p>"), (f"c{i}.xhtml", title, html or ""), ("tail.xhtml", None, "<p>short</p>")]
                    paths.append(str(i))
                    books.append(packed(f"Book {i}", "Doe, Ann" if i % 2 else "Ann Doe", "fr-FR", f"{1900 + i % 100}-01-02", documents))
                broken = at + 64 >= b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(paths + ["broken"] * broken, pa.string()), pa.array(books + [b"no archive"] * broken, pa.binary())], names=["path", "content"])

    return table(spark, sf, "pages").select("page_id", "html").mapInArrow(pack, "path string, content binary")


@query("""
SELECT page_id AS book, unnest(['cover.xhtml', 'c' || page_id || '.xhtml', 'tail.xhtml']) AS name, unnest([0, 1, 2]) AS pos, unnest([NULL, CASE WHEN page_id % 3 <> 0 THEN 'Page & ' || page_id END, NULL]) AS title, unnest([12, length(html), 12]) AS chars FROM pages""")
def epub_spines(spark, sf):
    return epub.spine(_archives(spark, sf)).select(F.col("path").cast("long").alias("book"), "name", "pos", "title", F.length("html").cast("long").alias("chars"))


@query("SELECT page_id AS book, 'Book ' || page_id AS title, 'Ann Doe' AS creator, 'fr' AS language, CAST(1900 + page_id % 100 AS VARCHAR) AS year FROM pages")
def epub_metadata(spark, sf):
    return epub.metadata(_archives(spark, sf)).select(F.col("path").cast("long").alias("book"), "title", "creator", "language", "year")


@query(rf"""
WITH l AS (SELECT page_id, list_filter(list_transform(string_split({SQL_BLOCKS}, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM pages)
SELECT page_id AS book, CASE WHEN page_id % 3 <> 0 THEN 'Page & ' || page_id END AS title, len(l) AS n_paragraphs FROM l WHERE list_sum(list_transform(l, lambda x: length(x))) >= 200""")
def epub_chapters(spark, sf):
    c = epub.chapters(_archives(spark, sf), named)
    return c.select(F.col("path").cast("long").alias("book"), "title", F.size("paragraphs").cast("long").alias("n_paragraphs"))


@query("SELECT range AS id, 'voice ' || range AS name FROM range(95)")
def paged_voices(spark, sf):
    """A service that gives ten of its 95 voices at a time."""

    def fetch(offset: int, limit: int) -> list[tuple[int, str]]:
        return [(i, f"voice {i}") for i in range(offset, min(95, offset + limit))]

    spark.dataSource.register(paged_source("voices_by_ten", "id long, name string", fetch, lambda: 95, 10))
    return spark.read.format("voices_by_ten").load()
