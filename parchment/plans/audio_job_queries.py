"""Queries over sample arrays, job events, costs, labels, metadata and pages."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import audio as A
from ..functions import text as T
from ..streaming import jobs as J
from .registry import query, table

#: Vectors stand for takes of 8 frames of 8 samples at 800 samples a second, with a threshold they straddle.
W, DB, RATE = 8, -18.5, 800.0
SQL_LOUD = """
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings),
f AS (SELECT vec_id, a, list_filter(range(8), lambda i: 20 * log10(sqrt(list_sum(list_transform(a[i * 8 + 1 : i * 8 + 8], lambda x: x * x)) / 8) + 1e-12) > -18.5) AS loud FROM e)
"""


def _takes(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    return e.withColumn("loud", A.loud_frames(F.col("a"), W, DB))


@query(f"WITH {SQL_LOUD} SELECT vec_id, array_to_string(loud, ',') AS loud FROM f")
def frame_envelope(spark, sf):
    return _takes(spark, sf).select("vec_id", F.array_join(F.col("loud").cast("array<string>"), ",").alias("loud"))


@query(f"""WITH {SQL_LOUD}, t AS (SELECT vec_id, CASE WHEN len(loud) = 0 THEN a ELSE a[greatest(0, loud[1] - 1) * 8 + 1 : least(8, loud[-1] + 2) * 8] END AS b FROM f)
SELECT vec_id, len(b) AS n, round(coalesce(list_sum(b), 0), 6) AS total FROM t""")
def trim_edges(spark, sf):
    t = _takes(spark, sf).select("vec_id", A.trim_edges(F.col("a"), F.col("loud"), W, 1).alias("b"))
    return t.select("vec_id", F.size("b").cast("long").alias("n"), F.round(F.aggregate("b", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"""WITH {SQL_LOUD}, g AS (SELECT vec_id, loud, list_filter(range(1, len(loud)), lambda i: loud[i + 1] - loud[i] >= 2) AS big FROM f)
SELECT vec_id, round(CASE WHEN len(loud) < 2 OR len(big) = 0 THEN 64 / 800 ELSE (loud[-1] - loud[big[-1] + 1] + 1) * 8 / 800 END, 6) AS seconds,
  CASE WHEN len(loud) < 2 OR len(big) = 0 THEN false ELSE (loud[-1] - loud[big[-1] + 1] + 1) * 10 <= 20 END AS artifact FROM g""")
def last_speech_run(spark, sf):
    return _takes(spark, sf).select("vec_id", F.round(A.last_run(F.col("a"), F.col("loud"), W, RATE, 2), 6).alias("seconds"), A.trailing_artifact(F.col("loud"), 10.0, 2, 20.0).alias("artifact"))


@query(r"""
WITH d AS (SELECT doc_id, text AS t, length(text) / 18.0 * (doc_id % 40) / 20.0 AS duration, doc_id % 7 = 0 AS artifact, (doc_id % 11) / 2.0 AS run FROM documents),
x AS (SELECT *, length(t) / 18.0 + 0.15 AS ex, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS p FROM d)
SELECT doc_id, CASE WHEN duration > length(t) / 10.0 + 0.8 THEN 'absurd length' WHEN length(t) >= 12 AND NOT duration BETWEEN ex * 0.75 AND ex * 1.45 THEN 'length'
  WHEN artifact THEN 'trailing sound' WHEN len(p) >= 2 AND run > (length(p[-1]) / 18.0 + 0.15) * 1.6 THEN 'long last sentence' ELSE '' END AS cause FROM x""")
def qc_verdict(spark, sf):
    t = F.col("text")
    cause = A.verdict(F.length(t) / 18.0 * (F.col("doc_id") % 40) / 20.0, t, F.col("doc_id") % 7 == 0, (F.col("doc_id") % 11) / 2.0)
    return table(spark, sf, "documents").select("doc_id", cause.alias("cause"))


@query("SELECT source, CASE WHEN count(*) >= 8 THEN round_even(median(n_chars / (n_chars / 17.0 + doc_id % 5 + 0.5)), 1) END AS rate FROM documents GROUP BY source")
def calibrated_rate(spark, sf):
    """Median characters a second of a source; null under eight samples."""
    rate = F.col("n_chars") / (F.col("n_chars") / 17.0 + F.col("doc_id") % 5 + 0.5)
    return table(spark, sf, "documents").groupBy("source").agg(F.when(F.count("*") >= 8, F.bround(F.median(rate), 1)).alias("rate"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings),
k AS (SELECT vec_id, a, unnest(range(48)) AS k FROM e), x AS (SELECT *, k * 63 / 47.0 AS x FROM k),
v AS (SELECT vec_id, k, a[CAST(floor(x) AS INT) + 1] + (a[least(CAST(floor(x) AS INT) + 2, 64)] - a[CAST(floor(x) AS INT) + 1]) * (x - floor(x)) AS v FROM x)
SELECT vec_id, count(*) AS n, round(sum(v), 5) AS total, round(sum(v * k), 4) AS moment FROM v GROUP BY vec_id""")
def resample_linear(spark, sf):
    r = table(spark, sf, "embeddings").select("vec_id", A.resample(F.col("embedding"), 800, 600).alias("b"))
    total = F.aggregate("b", F.lit(0.0), lambda s, x: s + x)
    moment = F.aggregate(F.transform("b", lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return r.select("vec_id", F.size("b").cast("long").alias("n"), F.round(total, 5).alias("total"), F.round(moment, 4).alias("moment"))


#: Users' events stand for jobs: each event type is a state.
SQL_KIND = "k AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS kind FROM events)"


def _jobs(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("running")
    return table(spark, sf, "events").select("user_id", "event_id", "ts", kind.alias("kind"))


SQL_FOLD = f"WITH {SQL_KIND}, j AS (SELECT user_id, arg_max(kind, (ts, event_id)) AS state, count(*) AS n_events, min(ts) FILTER (kind = 'running') AS started, max(ts) FILTER (kind IN ('done', 'failed')) AS finished FROM k GROUP BY user_id)"


@query(SQL_FOLD + " SELECT user_id, state, n_events, epoch(started)::BIGINT AS started, epoch(finished)::BIGINT AS finished FROM j")
def job_fold(spark, sf):
    folded = J.fold(_jobs(spark, sf), "user_id", ["ts", "event_id"])
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return folded.select("user_id", "state", "n_events", F.round(seconds("started")).cast("long").alias("started"), F.round(seconds("finished")).cast("long").alias("finished"))


@query(SQL_FOLD + """ SELECT user_id, CASE WHEN state = 'running' AND started <= (SELECT min(ts) FROM events) + INTERVAL 1 DAY THEN CASE WHEN user_id % 2 = 0 THEN 'cancelled' ELSE 'failed' END ELSE state END AS state FROM j""")
def job_stale_sweep(spark, sf):
    first = table(spark, sf, "events").agg((F.min("ts") + F.expr("interval 1 day")).alias("cutoff"))
    jobs = J.fold(_jobs(spark, sf), "user_id", ["ts", "event_id"]).withColumn("cancel", F.col("user_id") % 2 == 0).crossJoin(F.broadcast(first))  # one row
    return J.stale_sweep(jobs, F.col("cutoff")).select("user_id", "state")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS beats FROM s GROUP BY user_id, s""")
def heartbeat_sessions(spark, sf):
    s = J.heartbeat_sessions(table(spark, sf, "events"), "user_id", "ts", "6 hours")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return s.select("user_id", us("start").alias("start_us"), us("end").alias("end_us"), "beats")


@query("SELECT epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf):
    w = J.windowed(table(spark, sf, "events"), "ts", "1 day", None, ["event_type"])
    return w.select(F.unix_millis(F.col("start").cast("timestamp")).alias("start_ms"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH s AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start, event_type, value FROM events, range(4) t(k))
SELECT epoch_ms(start) AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL""")
def events_sliding(spark, sf):
    w = J.windowed(table(spark, sf, "events"), "ts", "1 day", "6 hours", ["event_type"])
    return w.select(F.unix_millis(F.col("start").cast("timestamp")).alias("start_ms"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("o"))
    return J.latest(e, ["user_id"], "o").select("user_id", "event_id", "event_type")


@query("SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(length(text)) / 1000.0 * 0.016, 6) AS cost FROM documents GROUP BY source")
def cost_estimate(spark, sf):
    chars = F.sum(F.length("text"))
    return table(spark, sf, "documents").groupBy("source").agg(chars.alias("chars"), F.round(chars / 1000.0 * 0.016, 6).alias("cost"))


@query("SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN contains(text, '@') THEN 'address' END, CASE WHEN regexp_matches(text, '[A-Z]{6,}') THEN 'shouting' END, CASE WHEN length(text) > 5000 THEN 'length' END], lambda x: x IS NOT NULL)), ',') AS flags FROM documents")
def moderation_flags(spark, sf):
    """Categories that hold, from a map of them."""
    t = F.col("text")
    m = F.create_map(F.lit("address"), F.contains(t, F.lit("@")), F.lit("shouting"), t.rlike("[A-Z]{6,}"), F.lit("length"), F.length(t) > 5000)
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(F.map_keys(F.map_filter(m, lambda k, v: v))), ",").alias("flags"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'working' WHEN o_totalprice > 400000 THEN 'finished' WHEN o_orderpriority LIKE '1%' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'recorded' ELSE 'to do' END AS label FROM orders")
def status_label(spark, sf):
    label = F.when(F.col("o_orderstatus") == "P", "working").when(F.col("o_totalprice") > 400000, "finished").when(F.col("o_orderpriority").startswith("1"), "failed").when(F.col("o_orderstatus") == "F", "recorded").otherwise("to do")
    return table(spark, sf, "orders").select("o_orderkey", label.alias("label"))


@query(r"SELECT doc_id, trim(regexp_replace(strip_accents(text), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s-]', '', 'g')) AS slug FROM documents")
def slugify(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("""SELECT doc_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS clock FROM (SELECT doc_id, CAST(n_chars AS BIGINT) AS s FROM documents)""")
def duration_format(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clock(F.col("n_chars")).alias("clock"))


@query("""
WITH j AS (SELECT o_orderkey, l_linenumber, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey, count(*) AS n_segments, count(*) FILTER (l_returnflag = 'R') AS flagged, bool_or(l_returnflag = 'A') AS any_clean FROM j GROUP BY o_orderkey""")
def track_rollup(spark, sf):
    j = table(spark, sf, "orders").select("o_orderkey").join(table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderkey").agg(F.count("*").alias("n_segments"), F.count_if(F.col("l_returnflag") == "R").alias("flagged"), F.bool_or(F.col("l_returnflag") == "A").alias("any_clean"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract(html, '<h1>([^<]*)', 1) AS h1, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang,
  coalesce(nullif(regexp_extract(html, '<h1>([^<]*)', 1), ''), nullif(regexp_extract(html, '<title>([^<]*)', 1), '')) AS best FROM pages""")
def html_title(spark, sf):
    """First heading, else title; the priority of covers works alike: coalesce over ranked candidates."""
    h = F.col("html")
    title, h1 = F.regexp_extract(h, "<title>([^<]*)", 1), F.regexp_extract(h, "<h1>([^<]*)", 1)
    best = F.coalesce(F.nullif(h1, F.lit("")), F.nullif(title, F.lit("")))
    return table(spark, sf, "pages").select("page_id", title.alias("title"), h1.alias("h1"), F.regexp_extract(h, '<html lang="([a-z]*)"', 1).alias("lang"), best.alias("best"))


@query("""
SELECT page_id, coalesce(nullif(regexp_extract(html, '<meta name="cover" content="([^"]*)"', 1), ''), nullif(regexp_extract(html, '<a href="([^"]*)"', 1), ''), nullif(regexp_extract(html, '<img src="([^"]*)"', 1), '')) AS cover FROM pages""")
def cover_priority(spark, sf):
    h = F.col("html")
    ranked = ['<meta name="cover" content="([^"]*)"', '<a href="([^"]*)"', '<img src="([^"]*)"']
    return table(spark, sf, "pages").select("page_id", F.coalesce(*[F.nullif(F.regexp_extract(h, p, 1), F.lit("")) for p in ranked]).alias("cover"))


@query("""
WITH l AS (SELECT doc_id, list_slice(string_split(text, chr(10)), 1, 60) AS l FROM documents),
h AS (SELECT doc_id, list_filter(l, lambda x: regexp_matches(x, '^[A-Za-z]+\\s*[:=]\\s*.+'))[1] AS f, list_filter(l, lambda x: trim(x) <> '')[1] AS t FROM l)
SELECT doc_id, coalesce(f, '') AS field, coalesce(t, '') AS title FROM h""".replace("\\\\", "\\"))
def metadata_peek(spark, sf):
    """First field line of a text's head, and its first line; only the head's lines are looked at."""
    head = F.slice(F.split("text", "\n"), 1, 60)
    field = F.filter(head, lambda x: x.rlike(r"^[A-Za-z]+\s*[:=]\s*.+"))
    first = F.filter(head, lambda x: F.trim(x) != "")
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.try_element_at(field, F.lit(1)), F.lit("")).alias("field"), F.coalesce(F.try_element_at(first, F.lit(1)), F.lit("")).alias("title"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, min(turn) AS first_turn, arg_min(text, turn) AS opening FROM conversations GROUP BY conv_id")
def chapter_titles(spark, sf):
    """The first row's text stands for each group."""
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.min_by("text", "turn").alias("opening"))


@query("SELECT o_orderpriority AS k, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1 ORDER BY n DESC, k LIMIT 6")
def newest_jobs(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))
    return o.orderBy(F.desc("n"), "k").limit(6)
