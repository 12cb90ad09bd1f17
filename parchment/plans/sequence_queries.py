"""Queries over ordered rows. Orders and their lines stand for manifests, users' events for pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequence as S
from .registry import query, table


def _events(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts", F.row_number().over(w).alias("pos"))


SQL_EVENTS = "e AS (SELECT user_id, event_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"


@query(
    f"""
WITH {SQL_EVENTS}, s AS (SELECT user_id, min(pos) FILTER (event_type = 'signup') AS s FROM e GROUP BY user_id),
m AS (SELECT e.* FROM e JOIN s USING (user_id) WHERE s IS NULL OR pos > s),
x AS (SELECT user_id, min(pos) FILTER (event_type = 'error') AS x FROM m GROUP BY user_id)
SELECT m.user_id, m.event_id, CAST(pos AS BIGINT) AS pos FROM m JOIN x USING (user_id) WHERE x IS NULL OR pos < x
"""
)
def envelope_trim(spark, sf):
    kept = S.envelope_trim(_events(spark, sf), ["user_id"], "pos", F.col("event_type") == "signup", F.col("event_type") == "error")
    return kept.select("user_id", "event_id", F.col("pos").cast("long").alias("pos"))


@query(
    """
WITH l AS (SELECT source, doc_id AS page, n_chars AS n FROM documents),
m AS (SELECT source, n AS m FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n) - 1 AS r, count(*) OVER (PARTITION BY source) AS c FROM l) WHERE r = c // 2),
p AS (SELECT source, page, n, row_number() OVER (PARTITION BY source ORDER BY page) AS pos FROM l),
d AS (SELECT p.* FROM p JOIN m USING (source) WHERE n >= greatest(60, 0.35 * m)),
r AS (SELECT *, sum(CASE WHEN g > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY pos) AS run FROM (SELECT *, pos - lag(pos) OVER (PARTITION BY source ORDER BY pos) AS g FROM d)),
s AS (SELECT source, run, min(pos) AS a, max(pos) AS b FROM r GROUP BY source, run)
SELECT source, CAST(a AS BIGINT) AS "first", CAST(b AS BIGINT) AS "last" FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY b - a DESC, a) = 1
"""
)
def dense_range(spark, sf):
    """Longest run of documents of a source without a short one between."""
    d = table(spark, sf, "documents").select("source", F.col("n_chars").cast("double").alias("n"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("pos"))
    return S.dense_range(d, ["source"], "pos", "n", gap=0)


@query(f"""WITH {SQL_EVENTS}, n AS (SELECT user_id, max(pos) + 1 AS stop_all FROM e GROUP BY user_id)
SELECT user_id, CAST(pos AS BIGINT) AS start, CAST(coalesce(lead(pos) OVER (PARTITION BY user_id ORDER BY pos), stop_all) AS BIGINT) AS stop FROM e JOIN n USING (user_id) WHERE event_type = 'signup'""")
def chapter_bounds(spark, sf):
    e = _events(spark, sf)
    ends = e.groupBy("user_id").agg((F.max("pos") + 1).alias("__end"))
    starts = e.where("event_type = 'signup'").join(ends, "user_id").select("user_id", F.col("pos").cast("long").alias("start"), F.col("__end").cast("long").alias("__end"))
    return S.bounds(starts, ["user_id"], "start", "__end").drop("__end")


@query(f"""WITH {SQL_EVENTS}, a AS (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS anchor FROM e)
SELECT user_id, event_id, coalesce(last_value(anchor IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING),
  first_value(anchor IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM a""")
def anchor_fill(spark, sf):
    e = _events(spark, sf).withColumn("anchor", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return S.anchor_fill(e, ["user_id"], "pos", "anchor").select("user_id", "event_id", "filled")


@query(f"""WITH {SQL_EVENTS}, l AS (SELECT user_id, max(pos) AS l FROM e WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, event_id FROM e JOIN l USING (user_id) WHERE pos <= l""")
def trailing_trim(spark, sf):
    return S.trailing_trim(_events(spark, sf), ["user_id"], "pos", F.col("event_type") == "purchase").select("user_id", "event_id")


@query(f"WITH {SQL_EVENTS} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS number FROM e WHERE event_type <> 'error'")
def renumber(spark, sf):
    left = _events(spark, sf).where("event_type <> 'error'")
    return left.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("pos")).cast("long").alias("number"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) + 0.25 AS len FROM lineitem),
t AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.6 AS b FROM l)
SELECT l_orderkey, l_linenumber, round(b, 2) AS start, round(b + len, 2) AS "end" FROM t""")
def timeline_prefix_sum(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") + 0.25).alias("len"))
    return S.timeline(li, ["l_orderkey"], ["l_linenumber", "len"], F.col("len"), 0.6).drop("len")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) + 0.25 AS len FROM lineitem),
t AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.6 AS b FROM l),
u AS (SELECT l_orderkey, l_linenumber, round(b, 2) AS s, round(b + len, 2) AS x FROM t)
SELECT l_orderkey, l_linenumber, round(s + CASE WHEN l_linenumber > 2 THEN 1.5 ELSE 0 END, 2) AS start, round(x + CASE WHEN l_linenumber >= 2 THEN 1.5 ELSE 0 END, 2) AS "end" FROM u""")
def splice_shift(spark, sf):
    """The second line of every order grows by 1.5."""
    return S.splice_shift(timeline_prefix_sum(spark, sf), F.lit(2), F.col("l_linenumber"), F.lit(1.5))


@query("""
WITH c AS (SELECT conv_id, turn, role, text AS t FROM conversations),
n AS (SELECT *, array_to_string(list(t) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ' ') AS b,
  array_to_string(list(t) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ' ') AS a FROM c)
SELECT conv_id, turn, coalesce(b, '') AS before, coalesce(a, '') AS after FROM n WHERE role = 'assistant'""")
def flagged_context(spark, sf):
    """What stands around an assistant's turn; neighbours are taken before rows are dropped."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("t"))
    return S.neighbours(c, ["conv_id"], ["turn"], "t").where("role = 'assistant'").select("conv_id", "turn", "before", "after")


@query("SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER w AS previous, lead(l_linenumber) OVER w AS next FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def neighbour_nav(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lag("l_linenumber").over(w).alias("previous"), F.lead("l_linenumber").over(w).alias("next"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
i AS (SELECT DISTINCT o_custkey, CAST(floor(k * n / 4) AS BIGINT) AS r FROM r, range(4) t(k) WHERE n > 4)
SELECT r.o_custkey, r.o_orderkey FROM r JOIN i USING (o_custkey, r) UNION ALL SELECT o_custkey, o_orderkey FROM r WHERE n <= 4""")
def even_spread_sample(spark, sf):
    return S.even_spread(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4)


@query("SELECT o_orderstatus, batch, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT *, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 12 AS batch FROM orders) GROUP BY ALL")
def fixed_batches(spark, sf):
    b = S.fixed_batches(table(spark, sf, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], ["o_orderkey"], 12)
    return b.groupBy("o_orderstatus", "batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("""
WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
f AS (SELECT conv_id, turn, r, n AS size, 0 AS slice FROM c WHERE r = 1
  UNION ALL SELECT c.conv_id, c.turn, c.r, CASE WHEN f.size > 0 AND f.size + c.n > 1500 THEN c.n ELSE f.size + c.n END, f.slice + CASE WHEN f.size > 0 AND f.size + c.n > 1500 THEN 1 ELSE 0 END
  FROM f JOIN c ON c.conv_id = f.conv_id AND c.r = f.r + 1)
SELECT conv_id, turn, slice FROM f""")
def budget_slices(spark, sf):
    """Turns of a conversation in slices of 1500 characters; a conversation is one row."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    cut = c.withColumn("s", S.budget_slices(F.transform("t", lambda x: x["n"]), 1500))
    return cut.select("conv_id", F.explode(F.arrays_zip(F.col("t.turn").alias("turn"), F.col("s").alias("slice"))).alias("z")).select("conv_id", "z.turn", "z.slice")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'A', CASE WHEN l_returnflag = 'A' THEN 0 ELSE abs(l_quantity - 20) END, l_linenumber, l_quantity) = 1""")
def best_take(spark, sf):
    """Lines of an order as attempts, those returned with A clean, 20 the expected length."""
    attempt = F.col("l_linenumber") * 1000 + F.col("l_quantity").cast("double")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", attempt.alias("attempt"))
    return S.best_take(li, ["l_orderkey"], "attempt", F.col("l_returnflag") == "A", F.abs(F.col("l_quantity").cast("double") - 20)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""
WITH s AS (SELECT s_nationkey, s_suppkey, CAST(abs(s_acctbal) AS DOUBLE) AS v FROM supplier),
g AS (SELECT *, sum(v) OVER (PARTITION BY s_nationkey) AS used, coalesce(sum(v) OVER (PARTITION BY s_nationkey ORDER BY v DESC, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM s)
SELECT s_nationkey, s_suppkey, used - gone + 3000 + 1.5 > 12000 AS evict FROM g""")
def greedy_eviction(spark, sf):
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.abs(F.col("s_acctbal").cast("double")).alias("v"))
    return S.greedy_eviction(s, ["s_nationkey"], "v", "s_suppkey", F.lit(3000.0), 1.5, F.lit(12000.0)).select("s_nationkey", "s_suppkey", "evict")


@query("""
WITH RECURSIVE b AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey % 97 AS BIGINT) AS f, CAST(o_orderkey % 97 + o_orderkey % 7 AS BIGINT) AS l, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
g AS (SELECT o_custkey, r, [{'f': f, 'l': l}] AS a FROM b WHERE r = 1
  UNION ALL SELECT b.o_custkey, b.r, CASE WHEN len(list_filter(g.a, lambda y: y.f <= b.l AND b.f <= y.l)) > 0 THEN g.a ELSE g.a || [{'f': b.f, 'l': b.l}] END FROM g JOIN b ON b.o_custkey = g.o_custkey AND b.r = g.r + 1),
z AS (SELECT o_custkey, a FROM g QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY r DESC) = 1)
SELECT o_custkey, u.f AS "first", u.l AS "last" FROM (SELECT o_custkey, unnest(a) AS u FROM z)""")
def persona_blocks_greedy(spark, sf):
    """Blocks in the order of answers; one that overlaps an accepted block is refused."""
    b = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 97).alias("f"), (F.col("o_orderkey") % 97 + F.col("o_orderkey") % 7).alias("l"))
    packed = b.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "f", "l"))), lambda x: F.struct(x["f"].alias("first"), x["l"].alias("last"))).alias("b"))
    return packed.select("o_custkey", F.explode(S.greedy_intervals(F.col("b"))).alias("u")).select("o_custkey", "u.first", "u.last")


@query(f"""
WITH {SQL_EVENTS}, w AS (SELECT user_id, event_type AS text, CAST(pos * 2 AS BIGINT) AS at FROM e)
SELECT w.user_id, w.text, w.at, CAST(e.pos AS BIGINT) AS found FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.text
QUALIFY row_number() OVER (PARTITION BY w.user_id, w.text, w.at ORDER BY abs(e.pos - w.at), e.pos) = 1""")
def nearest_occurrence(spark, sf):
    e = _events(spark, sf).select("user_id", F.col("event_type").alias("text"), F.col("pos").cast("long").alias("pos"))
    wanted = e.select("user_id", "text", (F.col("pos") * 2).alias("at"))
    return S.nearest_occurrence(wanted, e, ["user_id"])


@query("SELECT event_type, user_id, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 4")
def top_per_group(spark, sf):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf, "events").withColumn("r", F.row_number().over(w)).where("r <= 4").select("event_type", "user_id", "value", "event_id")
