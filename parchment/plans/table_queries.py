"""Queries of table functions, of reports that don't parse, and of observed plans, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as B
from .registry import query, table, texts


@query("""
WITH RECURSIVE c AS (SELECT conv_id AS key, turn AS place, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
f AS (SELECT key, place, r, n AS size, 0 AS slice FROM c WHERE r = 1
  UNION ALL SELECT c.key, c.place, c.r, CASE WHEN f.size > 0 AND f.size + c.n > 900 THEN c.n ELSE f.size + c.n END, f.slice + CASE WHEN f.size > 0 AND f.size + c.n > 900 THEN 1 ELSE 0 END FROM f JOIN c ON c.key = f.key AND c.r = f.r + 1)
SELECT key, place, CAST(slice AS BIGINT) AS slice FROM f""")
def packed_turns(spark, sf):
    B.register(spark)
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("place"), F.length("text").alias("size"))
    return spark.sql("SELECT key, place, slice FROM packed(TABLE({c}), 900)", c=c)


@query("""
WITH n AS (SELECT p_partkey, p_name, p_brand, p_size % 4 AS d FROM part WHERE p_size % 6 <> 0)
SELECT p_partkey, CAST(i AS INTEGER) AS place, CAST(i AS INTEGER) AS depth, p_name || i AS title, 'c' || i AS href FROM n, range(4) t(i) WHERE i <= d
UNION ALL SELECT p_partkey, CAST(d + 1 AS INTEGER), 0, p_brand, '' FROM n""")
def nested_contents(spark, sf):
    """A chain of chapters below each other, then a last one; every sixth part's contents are cut off."""
    B.register(spark)

    def entry(i, below):
        head = F.concat(F.lit('{"title":"'), F.col("p_name"), F.lit(f'{i}","href":"c{i}"'))
        return F.concat(head, F.when(F.col("p_size") % 4 > i, F.concat(F.lit(',"children":['), below, F.lit("]}"))).otherwise("}"))

    chain = entry(0, entry(1, entry(2, entry(3, F.lit("")))))
    whole = F.concat(F.lit("["), chain, F.lit(',{"title":"'), F.col("p_brand"), F.lit('"}]'))
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 6 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole).alias("toc"))
    return spark.sql("SELECT p_partkey, place, depth, title, href FROM {p} p, LATERAL contents(p.toc)", p=p)


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey END AS job, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 4 <> 0 THEN o_orderstatus END AS state,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 THEN o_orderpriority END AS note, o_orderkey % 7 = 0 AS broken FROM orders""")
def read_reports(spark, sf):
    """Orders as lines of JSON: some are cut off, some lack a field, some have one that the schema doesn't know."""
    known = F.to_json(F.struct(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("state"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).alias("note")))
    line = F.when(F.col("o_orderkey") % 7 == 0, F.substring(known, F.lit(1), F.length(known) - 1)).otherwise(known)
    r = table(spark, sf, "orders").select("o_orderkey", B.told_reports(line, "job long, state string").alias("r"))
    return r.select("o_orderkey", "r.report.job", "r.report.state", F.try_element_at("r.more", F.lit("note")).alias("note"), F.col("r.broken").isNotNull().alias("broken"))


@query(r"""SELECT doc_id, count(*) AS lines, CAST(sum(length(l)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l, ' ' || chr(9)) <> '' GROUP BY doc_id""")
def observed_lines(spark, sf):
    """Lines of texts, with what passes each stage observed."""
    return lines_with_progress(texts(spark, sf), B.Progress())


def lines_with_progress(docs, progress: B.Progress):
    docs = progress.watch(docs, "documents", n=F.count("*"), chars=F.sum(F.length("text")))
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where(F.regexp_replace("l", "^[ \t]+|[ \t]+$", "") != "")
    lines = progress.watch(lines, "lines", n=F.count("*"), longest=F.max(F.length("l")))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("l")).cast("long").alias("chars"))
