"""Queries of single functions: names, dates, titles, settings, samples, replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import audio as A
from ..functions import misc as M
from ..functions import text as T
from ..operators import library as L
from ..operators import review
from ..operators import versions as V
from ..sources import plain, services
from ..streaming import jobs as J
from .registry import query, table, texts
from .text_queries import SQL_LINES, SQL_PARAGRAPHS, SQL_TOKENS, lines


@query("""
WITH f AS (SELECT doc_id, ['.epub', '.txt', '.MD', '.pdf', '.PDF', '.doc'][doc_id % 6 + 1] AS s, n_chars % 100 AS c, doc_id % 4 = 0 AS o FROM documents)
SELECT doc_id, CASE WHEN s = '.epub' THEN 'epub' WHEN s IN ('.txt', '.MD') THEN 'plain' WHEN lower(s) = '.pdf' THEN CASE WHEN o THEN 'ocr' WHEN c < 40 THEN 'image' ELSE 'text' END END AS kind FROM f""")
def file_kinds(spark, sf):
    suffix = F.element_at(F.array(*map(F.lit, (".epub", ".txt", ".MD", ".pdf", ".PDF", ".doc"))), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat(F.lit("/shelf/a.b/book"), F.col("doc_id").cast("string"), suffix)
    return table(spark, sf, "documents").select("doc_id", plain.kind_of(path, F.col("n_chars") % 100, F.col("doc_id") % 4 == 0).alias("kind"))


@query(r"""SELECT doc_id, regexp_replace(replace(text, chr(10), ' 4bPage 12' || chr(10)), '([.!?])\s*\d[0-9A-Za-z]{0,10}Page\s*\d{1,4}\b', '\1', 'g') AS text FROM documents""")
def glued_footers(spark, sf):
    return texts(spark, sf).select("doc_id", F.regexp_replace(F.replace("text", F.lit("\n"), F.lit(" 4bPage 12\n")), T.GLUED_FOOTER, "").alias("text"))


LOW = "abcdefghijklmnopqrstuvwxyz"
_FILES = ("cover", "Title_Page", "nav", "toc", "index", "chapter", "acknowledgements", "navigation")


@query(f"""
WITH f AS (SELECT page_id, {list(_FILES)}[page_id % 8 + 1] || '.xhtml' AS name, page_id % 3 = 0 AS listed, length(html) % 400 AS chars FROM pages)
SELECT page_id, (regexp_matches(name, '(?i)cover|title[-_]?page|copyright|colophon|nav\\b|toc\\b|contents|index|acknowledg') AND NOT listed) OR chars < 200 AS service FROM f""")
def service_files(spark, sf):
    name = F.concat(F.element_at(F.array(*map(F.lit, _FILES)), (F.col("page_id") % 8 + 1).cast("int")), F.lit(".xhtml"))
    return table(spark, sf, "pages").select("page_id", L.service_file(name, F.col("page_id") % 3 == 0, F.length("html") % 400).alias("service"))


@query(f"""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Chapitre ' || doc_id WHEN 1 THEN source END AS toc, {SQL_LINES} AS l, lang FROM documents),
g AS (SELECT *, coalesce(regexp_matches(toc, '(?i)^\\s*chapitres?\\s*\\d+\\s*$'), true) AS g, coalesce(length(l[1]) <= 60 AND right(l[1], 1) NOT IN ('.', '!', '?', ';', ':', ','), false) AS f FROM d)
SELECT doc_id, CASE WHEN NOT g THEN toc WHEN f THEN l[1] ELSE coalesce(toc, lang) END AS title, CAST(len(l) - CASE WHEN g AND f THEN 1 ELSE 0 END AS INT) AS n FROM g""")
def picked_titles(spark, sf):
    toc = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Chapitre "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, F.col("source"))
    t = texts(spark, sf, "source", "lang").select("doc_id", L.picked_title(toc, T.lines_of(F.col("text")), F.col("lang")).alias("t"))
    return t.select("doc_id", "t.title", F.size("t.paragraphs").alias("n"))


@query("""SELECT vec_id, vec_id % 5 <> 0 AND abs(embedding[9])::DOUBLE * 3 >= 0.3::DOUBLE AND sqrt((embedding[7]::DOUBLE - embedding[1]::DOUBLE) ** 2 + (embedding[8]::DOUBLE - embedding[2]::DOUBLE) ** 2) > 0 AS usable FROM embeddings""")
def usable_quads(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    box = F.array(*[F.struct(F.get("e", F.lit(2 * i)).alias("x"), F.get("e", F.lit(2 * i + 1)).alias("y")) for i in range(4)])
    said = F.when(F.col("vec_id") % 5 == 0, "  ").otherwise("x")
    return e.select("vec_id", M.usable_quad(said, F.abs(F.get("e", F.lit(8))) * 3, box).alias("usable"))


@query(f"""WITH {SQL_TOKENS}, w AS (SELECT DISTINCT word FROM toks), e AS (SELECT word, CASE WHEN length(word) % 3 = 0 THEN reverse(word) ELSE replace(word, '''', '’') END AS expected FROM w)
SELECT word, expected, replace(word, '''', '’') = expected AS typographic FROM e""")
def typographic_corrections(spark, sf):
    w = review.words(texts(spark, sf)).select("word").distinct()
    e = w.withColumn("expected", F.when(F.length("word") % 3 == 0, F.reverse("word")).otherwise(F.replace("word", F.lit("'"), F.lit("’"))))
    return e.select("word", "expected", T.typographic_only(F.col("word"), F.col("expected")).alias("typographic"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN starts_with(lang, 'fr') OR source LIKE 'fr%' ELSE starts_with(lang, 'de') END AS speaks FROM documents WHERE lang IS NOT NULL""")
def speaking_voices(spark, sf):
    """Voices without languages, and books without one, fit all."""
    m = F.col("doc_id") % 4
    languages = F.when(m == 1, F.array().cast("array<string>")).when(m == 2, F.array("lang", "source")).otherwise(F.array("lang"))
    wanted = F.when(m == 2, "fr").when(m == 3, "de").when(m == 1, "en")
    return table(spark, sf, "documents").where("lang is not null").select("doc_id", L.speaks(languages, wanted).alias("speaks"))


@query("SELECT n_name AS key FROM nation WHERE n_regionkey <> 2 AND n_name IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_7', 'NATION_12', 'NATION_20')")
def available_engines(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("key"), (F.col("n_regionkey") != 2).alias("available"))
    return L.available(n, M.chosen(F.lit("NATION_1, NATION_2  NATION_3,NATION_7\nNATION_12,NATION_20, NATION_2"))).select("key")


@query("""
WITH s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_name END AS i, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_mktsegment END AS e FROM customer)
SELECT c_custkey, coalesce(nullif(i, ''), nullif(e, ''), 'plain') AS value, CASE WHEN nullif(i, '') IS NOT NULL THEN 'interface' WHEN nullif(e, '') IS NOT NULL THEN 'environment' ELSE '-' END AS origin,
  '****' || CASE WHEN length(coalesce(nullif(i, ''), nullif(e, ''), 'tiny')) > 4 THEN right(coalesce(nullif(i, ''), nullif(e, ''), 'tiny'), 4) ELSE '' END AS masked FROM s""")
def setting_layers(spark, sf):
    i = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.col("c_name"))
    e = F.when(F.col("c_custkey") % 5 == 0, "").when(F.col("c_custkey") % 5 != 1, F.col("c_mktsegment"))
    s = table(spark, sf, "customer").select("c_custkey", M.setting(i, e, F.lit("plain")).alias("s"), M.setting(i, e, F.lit("tiny"))["value"].alias("m"))
    return s.select("c_custkey", "s.value", "s.origin", M.masked(F.col("m")).alias("masked"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS INT) AS n FROM documents")
def word_counts(spark, sf):
    return texts(spark, sf).select("doc_id", T.word_count(F.col("text")).alias("n"))


@query(r"""
WITH p AS (SELECT doc_id, para, CASE para % 3 WHEN 0 THEN '.. ' WHEN 1 THEN '' ELSE '...' END || replace(p, ',', ' ...') || CASE para % 2 WHEN 0 THEN ' ..' ELSE '' END AS p FROM (""" + SQL_PARAGRAPHS + r""")),
h AS (SELECT doc_id, para, regexp_replace(p, '^\s*\.{2,}\s*', '') AS h FROM p)
SELECT doc_id, para, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '\s*\.{2,}\s*$', ''), '\s*\.{2,}\s*', ', ', 'g'), '([,;:])(?:\s*[,;:])+', '\1', 'g'), '^[ ,;:]+', ''), '\s+$', '') AS text,
  CASE WHEN regexp_matches(h, '\.{2,}\s*$') THEN 450 ELSE 0 END AS extra FROM h""")
def defused_ellipses(spark, sf):
    front = F.when(F.col("para") % 3 == 0, ".. ").when(F.col("para") % 3 == 1, "").otherwise("...")
    back = F.when(F.col("para") % 2 == 0, " ..").otherwise("")
    text, extra = T.defuse_ellipsis(F.concat(front, F.replace("p", F.lit(","), F.lit(" ...")), back))
    return lines(spark, sf).select("doc_id", "para", text.alias("text"), extra.alias("extra"))


@query("""
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN CASE WHEN lower(trim(role)) = 'narrateur' THEN '' ELSE trim(role) END WHEN 1 THEN '' WHEN 2 THEN '' END AS persona FROM conversations""")
def persona_markers(spark, sf):
    """Markers name a reader, or give back to the narrator; other lines aren't markers."""
    m = F.col("turn") % 4
    line = F.when(m == 0, F.concat(F.lit(" @ "), F.col("role"), F.lit("  "))).when(m == 1, "@Narrateur").when(m == 2, "@").otherwise(F.concat(F.lit("a "), F.col("role"), F.lit(" @")))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.persona_of(line).alias("persona"))


@query(r"""
SELECT doc_id, para, array_to_string(list_filter(string_split_regex(regexp_replace(translate(p, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ' 12 ' || p, '[^\p{L}\p{N}\s]', '', 'g'), '\s+'), lambda w: regexp_full_match(w, '\d+') OR regexp_full_match(w, '[A-ZÀ-ÝŒ]{2,}')), ' ') AS header
FROM (""" + SQL_PARAGRAPHS + ")")
def header_words(spark, sf):
    return lines(spark, sf).select("doc_id", "para", M.header_words(F.concat(F.translate("p", LOW, LOW.upper()), F.lit(" 12 "), F.col("p"))).alias("header"))


@query("SELECT o_orderkey, CAST(o_orderkey % 3999 + 1 AS INT) AS value FROM orders")
def roman_numerals(spark, sf):
    """Numerals written by place and read back."""
    n = F.col("o_orderkey") % 3999 + 1
    places = [("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")]
    for a, b, c in (("X", "L", "C"), ("C", "D", "M"), ("M", "?", "?")):
        places.append(tuple(x.translate(str.maketrans("IVX", a + b + c)) for x in places[0]))
    written = F.concat(*[F.element_at(F.array(*map(F.lit, places[k])), (F.floor(n / 10**k) % 10 + 1).cast("int")) for k in (3, 2, 1, 0)])
    return table(spark, sf, "orders").select("o_orderkey", T.roman(written).alias("value"))


@query(r"""SELECT p_partkey, CASE WHEN right(a, 1) = ' ' OR regexp_matches(b, '^[-,.;:!?»)]') OR (NOT (p_size % 2 = 0) AND p_size % 3 = 0) THEN '' ELSE ' ' END AS between
FROM (SELECT p_partkey, p_size, p_name || CASE p_partkey % 5 WHEN 0 THEN ' ' ELSE '' END AS a, CASE p_partkey % 7 WHEN 0 THEN ',' WHEN 1 THEN '»' ELSE '' END || p_type AS b FROM part)""")
def joined_fragments(spark, sf):
    a = F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(""))
    b = F.concat(F.when(F.col("p_partkey") % 7 == 0, ",").when(F.col("p_partkey") % 7 == 1, "»").otherwise(""), "p_type")
    return table(spark, sf, "part").select("p_partkey", L.joiner(a, b, F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0).alias("between"))


@query("SELECT doc_id, replace(replace(text, 'q', 'kw'), 'x', '7') AS text FROM documents")
def decoded_glyphs(spark, sf):
    glyphs = F.create_map(F.lit("q"), F.lit("kw"), F.lit("x"), F.lit("7"))
    return texts(spark, sf).select("doc_id", M.decoded(F.col("text"), glyphs).alias("text"))


@query("SELECT p_partkey, array_to_string(list_filter([lower(p_type), p_name.string_split(' ')[1], p_name.string_split(' ')[2]], lambda t: t IN ('economy', 'promo', 'cold', 'red', 'widget', 'gear')), ', ') AS said FROM part")
def designed_voices(spark, sf):
    words = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", L.designed(F.array(F.lower("p_type"), F.get(words, F.lit(0)), F.get(words, F.lit(1))), ["economy", "promo", "cold", "red", "widget", "gear"]).alias("said"))


@query(r"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' ' || c_name WHEN 1 THEN c_name ELSE c_name || ', a, ' || c_mktsegment END AS author FROM customer""")
def inverted_authors(spark, sf):
    m = F.col("c_custkey") % 3
    given = F.when(m == 0, F.concat("c_name", F.lit(",  "), "c_mktsegment")).when(m == 1, F.col("c_name")).otherwise(F.concat("c_name", F.lit(", a, "), "c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", M.inverted_author(given).alias("author"))


@query("SELECT p_partkey, p_name AS short FROM part")
def short_titles(spark, sf):
    m = F.col("p_partkey") % 5
    tail = F.when(m == 0, F.concat(F.lit(" - "), "p_brand")).when(m == 1, F.concat(F.lit(" ("), "p_brand", F.lit(")"))).when(m == 2, F.concat(F.lit(" : "), "p_type", F.lit(" — x"))).when(m == 3, "(1)").otherwise("")
    return table(spark, sf, "part").select("p_partkey", M.short_title(F.concat("p_name", tail)).alias("short"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace('“' || text || '”… œuvre – Œ ‘a’', '’', ''''), '‘', ''''), '“', '\"'), '”', '\"'), '…', '...'), '—', '-'), '–', '-'), 'œ', 'oe'), 'Œ', 'OE') AS text FROM documents".replace('\\"', '"'))
def typewritten(spark, sf):
    return texts(spark, sf).select("doc_id", T.typewriter(F.concat(F.lit("“"), "text", F.lit("”… œuvre – Œ ‘a’"))).alias("text"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year FROM orders")
def years_of_dates(spark, sf):
    m, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    said = F.when(m == 0, F.concat(F.lit("D:"), F.date_format(d, "yyyyMMdd"))).when(m == 1, F.date_format(d, "yyyy-MM-dd")).when(m == 2, F.date_format(d, "yyyy")).otherwise(F.concat(F.lit("c. "), F.date_format(d, "yyyy")))
    return table(spark, sf, "orders").select("o_orderkey", M.year_of(said).alias("year"))


@query("""
WITH t AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) / 1000000.0::DOUBLE END AS started, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) / 1000000.0::DOUBLE + value END AS finished, 1735689600.0::DOUBLE AS now FROM events)
SELECT event_id, round(CASE WHEN started IS NULL THEN 0 ELSE coalesce(finished, now) - started END, 3) AS seconds, coalesce(started + 31000000 > now - 20, false) AS online FROM t""")
def running_jobs(spark, sf):
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, ts).alias("started"), F.when(F.col("event_id") % 3 == 0, ts + F.col("value")).alias("finished"))
    now = F.lit(1735689600.0)
    return e.select("event_id", F.round(M.running_for(F.col("started"), F.col("finished"), now), 3).alias("seconds"), M.online(F.col("started") + 31_000_000, now).alias("online"))


@query("SELECT o_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 2 THEN true ELSE o_orderdate > l_shipdate - INTERVAL 30 DAY END AS stale FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def stale_tracks(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    made = F.when(F.col("l_linenumber") != 2, F.col("l_shipdate") - F.expr("interval 30 days"))
    return li.select("o_orderkey", "l_linenumber", "l_partkey", V.stale_by_time(F.col("o_orderdate"), made).alias("stale"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
j AS (SELECT vec_id, list_transform(range(3), lambda i: 0.0::DOUBLE) || e[1:5] || list_transform(range(2), lambda i: 0.0::DOUBLE) || e[6:9] AS j FROM e)
SELECT vec_id, list_transform(j, lambda x: round(x, 6)) AS joined, list_transform(j[1:4] || [9.0::DOUBLE, 8.0::DOUBLE] || j[8:], lambda x: round(x, 6)) AS spliced, list_transform(j, lambda x: CAST(trunc(least(1, greatest(-1, x * 9)) * 32767) AS INT)) AS quantised FROM j""")
def joined_takes(spark, sf):
    """Takes end to end with silences, a splice, and 16-bit samples, at a hundred samples a second."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    part = lambda a, n, ms: F.struct(F.slice("e", a, n).alias("audio"), F.lit(ms).alias("pause_ms"))
    j = e.withColumn("j", F.transform(A.joined(F.array(part(1, 5, 25), part(6, 4, 0)), 100, 30), lambda x: x.cast("double")))
    rounded = lambda c: F.transform(c, lambda x: A.rounded(x, 6))
    new = F.array(F.lit(9.0), F.lit(8.0))
    return j.select(
        "vec_id", rounded("j").alias("joined"), rounded(A.spliced(F.col("j"), F.lit(4), F.lit(7), new)).alias("spliced"), A.quantised(F.transform("j", lambda x: x * 9)).alias("quantised")
    )


@query("""SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE list_transform(embedding[1:6], lambda x: round((CAST(trunc(CAST(x AS DOUBLE) * 9000) AS INT) + vec_id % 2) / 32768.0::DOUBLE, 6)) END AS samples FROM embeddings""")
def decoded_takes(spark, sf):
    """Two-channel recordings packed by hand, one channel a step above the other on odd takes; broken files decode to null."""
    value = F.transform(F.slice("embedding", 1, 6), lambda x: (x.cast("double") * 9000).cast("int"))
    two = lambda x: F.hex(F.concat(*[F.reverse(F.unhex(F.substring(F.lpad(F.hex(x + k), 16, "0"), -4, 4))) for k in (0, 1)]))
    le = lambda n, size: F.lit(int(n).to_bytes(size, "little").hex())
    data = F.transform("v", lambda x: F.transform(F.array(x.cast("long"), x.cast("long") + 2 * (F.col("vec_id") % 2)), lambda y: F.substring(F.hex(F.pmod(y, F.lit(65536)) + 65536), -4, 4)))
    swapped = F.array_join(F.transform(F.flatten(data), lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))), "")
    head = F.concat(F.lit(b"RIFF".hex()), le(36 + 24, 4), F.lit(b"WAVEfmt ".hex()), le(16, 4), le(1, 2), le(2, 2), le(24000, 4), le(96000, 4), le(4, 2), le(16, 2), F.lit(b"data".hex()), le(24, 4))
    e = table(spark, sf, "embeddings").select("vec_id", value.alias("v"))
    raw = e.select("vec_id", F.when(F.col("vec_id") % 9 == 0, F.lit(b"no wave")).otherwise(F.unhex(F.concat(head, swapped))).alias("raw"))
    return raw.select("vec_id", F.transform(A.decode_wav(F.col("raw")), lambda x: F.round(x.cast("double"), 6)).alias("samples"))


@query("SELECT p_partkey, p_name AS word, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_name END AS proposal FROM part")
def model_corrections(spark, sf):
    """Words through the stand-in model; words that it can't say come back without a proposal."""
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_name")).alias("word"), F.col("p_type").alias("context"), F.col("p_name").alias("name"))
    return services.asked(p, services.Echo, 7).select("p_partkey", F.col("name").alias("word"), "proposal")


@query("""
WITH m AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' ELSE c_mktsegment END AS a FROM customer)
SELECT c_custkey, array_to_string(CASE WHEN a <> '' THEN ['engine=' || a] ELSE [] END || ['old=kept', 'speed=1.5'], ',') AS merged FROM m""")
def merged_settings(spark, sf):
    """New values of the allowed keys go over old ones; an empty value takes a key away; other keys don't come in."""
    old = F.create_map(*map(F.lit, ("old", "kept", "speed", "1.0", "engine", "none")))
    new = F.create_map(F.lit("speed"), F.lit("1.5"), F.lit("engine"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")), F.lit("secret"), F.lit("x"))
    both = F.array_sort(F.map_entries(M.merged_settings(old, new, ["speed", "engine"])))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(F.transform(both, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("merged"))


@query("SELECT conv_id, right(repeat(string_agg(text, '' ORDER BY turn), 40), 20000) AS log FROM conversations GROUP BY conv_id")
def log_tails(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("l"))
    return c.select("conv_id", J.log_tail(F.flatten(F.array_repeat("l", 40))).alias("log"))


@query("SELECT o_custkey AS project, min(o_orderkey) AS job FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def oldest_pending(spark, sf):
    state = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return J.oldest_pending(table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("project"), state.alias("state")), "project")


@query("SELECT l_orderkey AS chapter, l_linenumber AS idx, l_partkey, CASE WHEN l_orderkey = 3 AND l_linenumber = 2 THEN true ELSE l_returnflag = 'A' END AS approved, l_linestatus AS cause FROM lineitem")
def approved_segments(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("idx"), "l_partkey", (F.col("l_returnflag") == "A").alias("approved"), F.col("l_linestatus").alias("cause"))
    return V.approved(t, 3, 2, True)


@query("""
SELECT r.doc_id AS book_id, coalesce(c.text, r.text) = r.text AS raw, c.text IS NOT NULL AS reviewed, CAST(length(coalesce(c.text, r.text)) AS BIGINT) AS chars FROM documents r LEFT JOIN (SELECT doc_id, text || '!' AS text FROM documents WHERE doc_id % 3 = 0) c USING (doc_id)""")
def authoritative_bodies(spark, sf):
    raw = texts(spark, sf).select(F.col("doc_id").alias("book_id"), F.lit(1).alias("chapter"), F.col("text").alias("body"))
    clean = raw.where("book_id % 3 = 0").withColumn("body", F.concat("body", F.lit("!")))
    both = V.authoritative(raw, clean).join(raw.select("book_id", F.col("body").alias("raw")), "book_id")
    return both.select("book_id", (F.col("body") == F.col("raw")).alias("raw"), "reviewed", F.length("body").cast("long").alias("chars"))


@query("SELECT DISTINCT CAST(p_size - 1 AS INT) AS page, trim(p_name) AS title FROM part WHERE p_partkey % 3 = 1 AND p_size > 0")
def bookmark_starts(spark, sf):
    p = table(spark, sf, "part").select((F.col("p_partkey") % 3).alias("level"), F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("title"), F.col("p_size").alias("page"))
    return L.bookmark_starts(p)


@query(f"""
WITH {SQL_TOKENS}, h AS (SELECT doc_id, "offset" FROM toks WHERE word = 'the')
SELECT doc_id, "offset", '…' || replace(substring(text, greatest(0, "offset" - 90) + 1, "offset" - greatest(0, "offset" - 90)), chr(10), ' ') || '⟦the⟧' || replace(substring(text, "offset" + 4, 90), chr(10), ' ') || '…' AS marked
FROM h JOIN documents USING (doc_id)""")
def marked_context(spark, sf):
    """Every "the" in a frame, with what stands around it."""
    hits = review.tokens(texts(spark, sf)).where("word = 'the'")
    both = hits.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return both.select("doc_id", "offset", L.marked(F.col("text"), F.col("offset"), F.lit("the")).alias("marked"))
