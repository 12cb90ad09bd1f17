"""Queries around the books: segments as spoken, proofreading, casts, proposals, catalogues, samples, guards of paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import proofreading, review
from ..operators import segmentation as G
from ..operators import shelf as S
from ..sources import services
from . import number_sql as N
from .registry import query, table, texts
from .text_queries import SQL_CAPITALS, SQL_LINES, SQL_PARAGRAPHS, SQL_SEGMENTS, SQL_SUSPECTS, SQL_TIDY, SQL_TOKENS, SQL_UNIFY, T

SQL_NORMAL = f"""WITH {N.WORDS}, raw AS ({SQL_PARAGRAPHS}), said AS (SELECT doc_id, para, {N.ALL.format(SQL_UNIFY.format('p'))} AS t FROM raw, spoken),
para AS (SELECT doc_id, para, {SQL_TIDY.format(SQL_CAPITALS.format('t'))} AS p FROM said)"""
SQL_BOOKS = "books AS (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN -doc_id ELSE doc_id // 4 END AS book, doc_id % 4 AS chapter, source AS title FROM documents)"
SQL_DEFUSED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '\s*\.{2,}\s*$', ''), '\s*\.{2,}\s*', ', ', 'g'), '([,;:])(?:\s*[,;:])+', '\1', 'g'), '^[ ,;:]+', ''), '\s+$', '')"


@query(
    SQL_SEGMENTS.replace(f"WITH para AS ({SQL_PARAGRAPHS})", SQL_NORMAL)
    + rf""", {SQL_BOOKS}, size AS (SELECT book, count(*) AS n FROM books GROUP BY book),
flat AS (SELECT doc_id, para, len(s) AS n, unnest(range(len(s))) AS k, unnest(list_transform(s, lambda x: regexp_replace(x.t, '^\s*\.{{2,}}\s*', ''))) AS h, unnest(list_transform(s, lambda x: x.e)) AS e FROM seg),
body AS (SELECT doc_id, para, k, {SQL_DEFUSED} AS text, CAST(round_even(CASE WHEN k = n - 1 THEN 800 WHEN e THEN 380 ELSE 250 END * 1.5, 0) AS BIGINT) + CASE WHEN regexp_matches(h, '\.{{2,}}\s*$') THEN 675 ELSE 0 END AS pause FROM flat),
heads AS (SELECT doc_id, -1 AS para, 0 AS k, CASE WHEN chapter = 0 THEN '' WHEN n = 1 THEN upper(title[1]) || title[2:] || '.' ELSE 'Chapitre ' || lw[chapter + 1] || '. ' || upper(title[1]) || title[2:] || '.' END AS text, CAST(3000 AS BIGINT) AS pause FROM books JOIN size USING (book), spoken),
every AS (SELECT doc_id, para, k, regexp_replace(text, 'src(\d)', 'src\1') AS text, pause FROM body UNION ALL SELECT doc_id, para, k, text, pause FROM heads)
SELECT book, chapter, row_number() OVER (PARTITION BY every.doc_id ORDER BY para, k) - 1 AS idx, text, pause AS pause_after_ms FROM every JOIN books USING (doc_id) WHERE text <> ''""".replace("upper(title[1]) || title[2:]", N.ALL.format("title"))
)
def spoken_segments(spark, sf):
    """Documents as chapters of books, with announcements and silences half as long again; every fourth document is a book of its own."""
    d = texts(spark, sf, "source")
    book = F.when(F.col("doc_id") % 4 == 3, -F.col("doc_id")).otherwise(F.expr("doc_id div 4"))
    chapters = d.select(book.alias("book"), (F.col("doc_id") % 4).alias("chapter"), F.col("source").alias("title"), T.lines_of(F.col("text")).alias("paragraphs"))
    return G.spoken_segments(chapters, scale=1.5).select("book", "chapter", F.col("idx").cast("long").alias("idx"), "text", "pause_after_ms")


SQL_PROOFS = (
    SQL_SUSPECTS
    + """, times AS (SELECT word, count(*) AS n FROM found GROUP BY word),
cutoff AS (SELECT word, n, left(word, length(word) - 1) AS proposal FROM times),
own AS (SELECT DISTINCT lower(word) AS form FROM toks WHERE lower(word) NOT IN (SELECT lower(word) FROM times)),
pcore AS (SELECT proposal, replace(replace(replace(lower(regexp_replace(proposal, '^[''’-]+|[''’-]+$', '', 'g')), '’', ''''), 'œ', 'oe'), 'æ', 'ae') AS c FROM (SELECT DISTINCT proposal FROM cutoff WHERE n < 4)),
pforms AS (SELECT proposal, c, list_filter(string_split(replace(c, '-', ''''), ''''), lambda x: x <> '' AND x NOT IN ('l','d','j','n','m','t','s','c','qu','jusqu','lorsqu','puisqu','quelqu')) AS f FROM pcore),
peach AS (SELECT proposal, unnest(CASE WHEN len(f) > 0 THEN f ELSE [c] END) AS form FROM pforms),
punknown AS (SELECT DISTINCT proposal FROM peach WHERE length(form) >= 2 AND form NOT IN (SELECT form FROM own)),
asked AS (SELECT word, n, proposal, CASE WHEN contains(word, '’') THEN replace(proposal, '''', '’') ELSE proposal END AS a, proposal IN (SELECT proposal FROM punknown) AS u FROM cutoff),
verdict AS (SELECT word, n, proposal, CASE WHEN n >= 4 THEN NULL WHEN a = word OR a = '' THEN '' WHEN u THEN 'not in the lexicon' ELSE '' END AS cause, CASE WHEN n < 4 THEN CASE WHEN a <> word AND a <> '' AND NOT u THEN a ELSE '' END END AS replacement FROM asked)
"""
)


def _proofs(spark, sf):
    d = texts(spark, sf)
    lexicon = review.document_frequency(d).where("d >= 3").select("form")
    return proofreading.proofread(d, lexicon, services.Cutter)


@query(SQL_PROOFS + """SELECT doc_id, "offset", f.word, f.reason, n AS recurrence, CASE WHEN n < 4 THEN proposal END AS proposal, replacement, cause FROM found f JOIN verdict v ON f.word = v.word""")
def proofread_words(spark, sf):
    """Every suspect with what the stand-in proposes (the word without its last letter) and what the guards say."""
    return _proofs(spark, sf).drop("context")


@query(
    SQL_PROOFS
    + """SELECT doc_id, count(*) AS suspects, count(cause) AS asked, count(*) FILTER (replacement <> '') AS suggestions, count(*) FILTER (cause <> '') AS rejected, count(DISTINCT f.word) FILTER (cause IS NULL) AS skipped,
  max(CASE WHEN replacement <> '' THEN "offset" END) AS last FROM found f JOIN verdict v ON f.word = v.word GROUP BY doc_id"""
)
def proofread_reports(spark, sf):
    """Reports written as JSON and read back."""
    r = proofreading.reports(_proofs(spark, sf)).withColumn("r", S.report_of(F.col("report")))
    size = lambda c: F.size(f"r.{c}").cast("long").alias(c)
    return r.select("doc_id", "r.suspects", "r.asked", size("suggestions"), size("rejected"), size("skipped"), F.array_max(F.transform("r.suggestions", lambda x: x["offset"])).alias("last"))


@query(SQL_PROOFS + """, e AS (SELECT doc_id, count(*) AS n, sum(length(f.word) - length(replacement)) AS less FROM found f JOIN verdict v ON f.word = v.word WHERE replacement <> '' GROUP BY doc_id)
SELECT doc_id, CAST(length(text) - coalesce(less, 0) AS BIGINT) AS chars, coalesce(n, 0) AS n_edits FROM documents LEFT JOIN e USING (doc_id)""")
def proofread_texts(spark, sf):
    return proofreading.applied(texts(spark, sf), _proofs(spark, sf)).select("doc_id", F.length("text").cast("long").alias("chars"), "n_edits")


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(text, 'the') THEN 'article' END, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN contains(text, '!') THEN 'shout' END], lambda x: x IS NOT NULL), ',') AS flags FROM documents")
def moderated_texts(spark, sf):
    """Texts in batches through a service that fails every other time."""
    words = {"shout": "!", "article": "the", "mail": "@"}
    return services.moderated(texts(spark, sf), lambda: services.WordList(words), wait=0.0).select("doc_id", F.array_join("flags", ",").alias("flags"))


@query(f"""
WITH p AS (SELECT doc_id // 3 AS book, replace(text, 'ü', '�') AS t FROM documents)
SELECT book, CAST(sum(length(t) - length(replace(t, '�', ''))) AS BIGINT) AS unread, sum(length(t) - length(replace(t, '�', ''))) >= 5 AS needs_review FROM p GROUP BY book""")
def unread_signs(spark, sf):
    p = texts(spark, sf).select(F.expr("doc_id div 3").alias("book"), F.replace("text", F.lit("ü"), F.lit("�")).alias("text"))
    return S.unread(p, ["book"])


@query(f"SELECT doc_id, para, p, row_number() OVER (PARTITION BY doc_id, p ORDER BY para) - 1 AS rank FROM ({SQL_PARAGRAPHS})")
def occurrence_ranks(spark, sf):
    p = texts(spark, sf).select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("para", "p"))
    return S.occurrence_rank(p, ["doc_id"], "para", "p").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT o_custkey AS book, count(*) FILTER (o_custkey % 3 <> 0 AND o_orderstatus <> 'F') AS pending FROM orders GROUP BY o_custkey")
def pending_reviews(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("book"), (F.col("o_orderstatus") == "F").alias("reviewed"), (F.col("o_custkey") % 3 != 0).alias("needs_review"))
    return S.pending_review(o, "book")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_brand ELSE p_name || '|' || p_brand END AS names FROM part")
def discovered_names(spark, sf):
    m = F.col("p_partkey") % 4
    both = F.array(F.struct(F.col("p_name").alias("name"), F.lit("x").alias("who")), F.struct(F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("who")))
    one = F.array(F.struct(F.lit("").alias("name"), F.lit("x").alias("who")), F.struct(F.col("p_brand").alias("name"), F.lit("y").alias("who")))
    said = F.when(m == 0, "{broken").when(m == 1, F.to_json(F.struct(one.alias("personas")))).otherwise(F.to_json(F.struct(both.alias("personas"), F.lit(1).alias("more"))))
    return table(spark, sf, "part").select("p_partkey", F.array_join(S.discovered_names(said), "|").alias("names"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'dialogue=' || c_name WHEN 1 THEN 'Ann=a' WHEN 2 THEN 'Ann=a,dialogue=' || c_name ELSE 'dialogue=kept' END AS voices FROM customer""")
def migrated_casts(spark, sf):
    m = F.col("c_custkey") % 4
    ann, kept = F.create_map(F.lit("Ann"), F.lit("a")), F.create_map(F.lit("dialogue"), F.lit("kept"))
    had = F.when(m.isin(1, 2), ann).when(m == 3, kept)
    new = S.migrated_voices(had, F.when(m == 1, "").otherwise(F.col("c_name")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(new)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(spark, sf, "customer").select("c_custkey", shown.alias("voices"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Ann=' || c_name || ',Bob=' ELSE 'Ann=' || c_mktsegment || ',Bob=' END AS cast_ FROM customer")
def cast_forms(spark, sf):
    """Two lists of a form; every other form names one reader twice. The narrator, empty names and voices without a name go."""
    even = F.col("c_custkey") % 2 == 0
    names = F.array(F.lit(" @Ann "), F.lit("Narrateur"), F.lit(" "), F.lit("Bob"), F.when(even, "@Ann").otherwise("@"))
    voices = F.array(F.col("c_mktsegment"), F.lit("x"), F.lit("y"), F.lit("  "), F.concat(F.lit(" "), "c_name"), F.lit("extra"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(S.cast_form(names, voices))), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(spark, sf, "customer").select("c_custkey", shown.alias("cast_"))


@query("SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'Known: Ann, Bob.' || chr(10) || chr(10) ELSE '' END || string_agg('[' || (r + 4) || '] ' || text, chr(10) ORDER BY r) AS prompt FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY conv_id")
def numbered_prompts(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("l"))
    known = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("Ann"), F.lit("Bob"))).otherwise(F.array().cast("array<string>"))
    return c.select("conv_id", S.numbered(F.col("l"), known, 5).alias("prompt"))


#: Conversations stand for chapters, turns for paragraphs; a proposal for every turn, of two texts that come up again.
SQL_TURNS = "p AS (SELECT conv_id AS chapter, turn AS i, role AS reader, 't' || length(text) % 3 AS t FROM conversations)"


@query(f"""
WITH {SQL_TURNS}, b AS (SELECT chapter, i AS id, CASE WHEN i % 2 = 0 THEN ' USER' ELSE 'assistant' END AS persona, i + 1 AS f, t AS opening, 't' || i % 3 AS closing FROM p),
o AS (SELECT b.chapter, id, persona, closing, arg_min(p.i, (abs(p.i - f), p.i)) AS found, arg_min(p.t, (abs(p.i - f), p.i)) AS t FROM b JOIN p ON b.chapter = p.chapter AND p.t = opening GROUP BY b.chapter, id, persona, closing, f),
c AS (SELECT o.chapter, id, persona, found, o.t, min(p.i) AS last FROM o JOIN p ON p.chapter = o.chapter AND p.t = closing AND p.i >= found GROUP BY o.chapter, id, persona, found, o.t)
SELECT c.chapter, id, found, last, (SELECT count(*) FROM p WHERE p.chapter = c.chapter AND p.t = c.t AND p.i < found) AS rank, (SELECT bool_and(lower(trim(reader)) = lower(trim(persona))) FROM p WHERE p.chapter = c.chapter AND p.i BETWEEN found AND last) AS done FROM c""")
def open_proposals(spark, sf):
    p = table(spark, sf, "conversations").select(F.col("conv_id").alias("chapter"), F.col("turn").alias("i"), F.col("role").alias("reader"), F.concat(F.lit("t"), (F.length("text") % 3).cast("string")).alias("text"))
    b = p.select(
        F.col("i").alias("id"), "chapter", F.when(F.col("i") % 2 == 0, " USER").otherwise("assistant").alias("persona"), (F.col("i") + 1).alias("first"), F.col("text").alias("opening"),
        F.concat(F.lit("t"), (F.col("i") % 3).cast("string")).alias("closing"),
    )
    return S.open_proposals(b, p).select("chapter", "id", "found", "last", F.col("rank").cast("long").alias("rank"), "done")


@query("""
WITH s AS (SELECT p_partkey, lower(p_type) AS e, replace(p_name, ' ', '_') AS v, p_partkey % 3 AS m FROM part)
SELECT p_partkey, CASE m WHEN 2 THEN 'plain' ELSE e END AS backend, CASE m WHEN 2 THEN '' ELSE replace(v, '_', ' ') END AS voice, m = 1 AND e = 'economy' AS chosen FROM s""")
def voice_samples(spark, sf):
    m, v = F.col("p_partkey") % 3, F.replace("p_name", F.lit(" "), F.lit("_"))
    path = F.when(m == 2, "/a/samples/plain.wav").otherwise(F.concat(F.lit("/a.b/samples/"), F.lower("p_type"), F.lit("--"), v, F.lit(".wav")))
    return table(spark, sf, "part").select("p_partkey", S.sample(path, F.lit("economy"), F.when(m == 1, F.col("p_name")).otherwise("another")).alias("s")).select("p_partkey", "s.*")


@query("SELECT '/x/my-' || replace(p_name, ' ', '_') || '.v' || p_partkey || '.' || ['wav', 'MP3', 'txt'][p_partkey % 3 + 1] AS path, 'my ' || p_name || '.v' || p_partkey AS label FROM part WHERE p_partkey % 3 <> 2")
def sound_files(spark, sf):
    suffix = F.element_at(F.array(F.lit("wav"), F.lit("MP3"), F.lit("txt")), (F.col("p_partkey") % 3 + 1).cast("int"))
    path = F.concat(F.lit("/x/my-"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".v"), F.col("p_partkey").cast("string"), F.lit("."), suffix)
    return S.sound_files(table(spark, sf, "part").select(path.alias("path")))


@query("""SELECT s_nationkey AS engine, s_name AS name FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 50 = 1) UNION ALL SELECT c_nationkey, c_name FROM customer WHERE c_custkey % 50 = 1""")
def voice_catalogue(spark, sf):
    """Suppliers stand for the static lists, every fiftieth customer for what services list themselves."""
    remote = table(spark, sf, "customer").where("c_custkey % 50 = 1").select(F.col("c_nationkey").alias("engine"), F.col("c_name").alias("name"))
    return S.catalogue(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("engine"), F.col("s_name").alias("name")), remote)


@query("""SELECT n_name AS engine, n_regionkey IN (1, 3) OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AS available FROM nation""")
def engine_availability(spark, sf):
    n = table(spark, sf, "nation")
    rich = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("engine"), F.when(F.col("s_acctbal") > 9000, F.col("s_name")).otherwise("").alias("address"))
    packages = table(spark, sf, "region").where("r_regionkey in (1, 3)").select(F.col("r_regionkey").alias("package"))
    return S.availability(n.select(F.col("n_name").alias("engine"), F.col("n_regionkey").alias("package")), packages, rich).select("engine", "available")


_PATHS = ("a/b.png", "../x.css", "a/../b.css", "a/../../b.js", "/etc/x.svg", "a/./b.JPG", "C:/x.png", "a//b.woff", "a/b.exe", "..")


@query(f"""SELECT event_id, {[True, False, True, False, False, True, False, True, True, False]}[event_id % 10 + 1] AS inside, {['image/png', None, 'text/css', None, None, 'image/jpeg', None, 'font/woff', None, None]}[event_id % 10 + 1] AS kind FROM events""".replace("None", "NULL"))
def guarded_paths(spark, sf):
    name = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", S.inside(name).alias("inside"), S.asset_type(name).alias("kind"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN CASE WHEN o_orderstatus = 'F' THEN 'epub' END END AS pages, CASE o_orderkey % 3 WHEN 0 THEN 'http://set' WHEN 1 THEN CASE WHEN o_orderstatus <> 'O' THEN 'http://own' END END AS url,
  o_orderkey % 60 < 30 AND o_orderkey % 5 <> 4 AS valid FROM orders""")
def shown_books(spark, sf):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    source = F.element_at(F.array(*map(F.lit, ("/a/b.PDF", "/a/b.epub", "/a/b.txt", "/a/pdf"))), (k % 4 + 1).cast("int"))
    state = F.when(k % 3 == 2, F.lit(None).cast("string")).when(s == "O", "absent").otherwise("running")
    seen = F.when(k % 5 != 0, k)
    return table(spark, sf, "orders").select(
        "o_orderkey", S.page_source(source, F.when(s == "F", "fixed")).alias("pages"), S.served_url(F.when(k % 3 == 0, "http://set").otherwise(""), state, F.lit("http://own")).alias("url"),
        S.still_valid(k % 60, seen, F.when(k % 5 == 4, k + 1).when(k % 5 != 0, k)).alias("valid"),
    )


@query(f"SELECT doc_id, list_filter({SQL_LINES}, lambda x: true)[1] AS a, lower(trim(lang)) = 'de' AS same FROM documents WHERE len({SQL_LINES}) > 0")
def same_readers(spark, sf):
    d = texts(spark, sf, "lang").select("doc_id", F.get(T.lines_of(F.col("text")), F.lit(0)).alias("a"), S.same_name(F.concat(F.lit(" "), F.upper("lang")), F.lit("De ")).alias("same"))
    return d.where("a is not null")


@query("""
WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'Narrateur' WHEN turn % 7 = 0 THEN upper(role) ELSE role END AS who, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
g AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, who ORDER BY i) AS g FROM t),
b AS (SELECT conv_id, who, min(i) AS f, max(i) AS l FROM g WHERE who <> 'Narrateur' GROUP BY conv_id, who, g),
n AS (SELECT conv_id, lower(who) AS k, arg_min(who, f) AS persona FROM b GROUP BY conv_id, lower(who))
SELECT b.conv_id AS book, n.persona, f AS first, l AS last FROM b JOIN n ON n.conv_id = b.conv_id AND n.k = lower(b.who)""")
def discovered_readers(spark, sf):
    """Conversations stand for chapters whose paragraphs say who reads; a name keeps the spelling it had first."""
    who = F.when(F.col("role") == "system", "Narrateur").when(F.col("turn") % 7 == 0, F.upper("role")).otherwise(F.col("role"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(who, F.lit(": "), F.regexp_replace("text", r"[\[\]\n]", " ")).alias("p"))
    chapters = c.groupBy(F.col("conv_id").alias("book")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "p"))), lambda x: x["p"]).alias("paragraphs")).withColumn("chapter", F.lit(1).cast("long"))
    return services.discovered(chapters, services.Roles).select("book", "persona", "first", "last")


@query("""
WITH o AS (SELECT o_custkey AS name, max(o_orderkey) AS v FROM orders GROUP BY o_custkey)
SELECT name, 't' || v AS title, CASE WHEN v % 3 = 0 THEN 1.0 ELSE v % 10 / 10.0::DOUBLE END AS speed, CASE v % 3 WHEN 1 THEN 'dialogue=d' || v ELSE '' END AS voices FROM o WHERE v % 5 <> 0""")
def project_listing(spark, sf):
    """Orders stand for saves of a customer's project; the last one counts, and a fifth of them can't be read."""
    k = F.col("o_orderkey")
    made = F.to_json(F.struct(F.concat(F.lit("t"), k.cast("string")).alias("title"), F.when(k % 3 != 0, k % 10 / 10.0).alias("speed"), F.when(k % 3 == 1, F.concat(F.lit("d"), k.cast("string"))).alias("dialogue_voice")))
    saves = table(spark, sf, "orders").select(F.col("o_custkey").alias("name"), k.alias("version"), F.when(k % 5 == 0, "{broken").otherwise(made).alias("config"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("voices")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return S.projects(saves).select("name", "title", "speed", shown.alias("voices"))


@query("""
WITH s AS (SELECT o_custkey AS name, max(o_orderkey) AS v, CAST(arg_max(o_orderstatus, o_orderkey) AS VARCHAR) AS c FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey)
SELECT c_custkey AS name, coalesce(v, 0) + 1 AS version, 'F' AS config FROM customer LEFT JOIN s ON name = c_custkey WHERE c IS DISTINCT FROM 'F'""")
def project_saves(spark, sf):
    saves = table(spark, sf, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("config"))
    return S.saved(saves, table(spark, sf, "customer").select(F.col("c_custkey").alias("name"), F.lit("F").alias("config")))


@query(f"""
WITH {SQL_TOKENS}, w AS (SELECT DISTINCT lang, lower(word) AS form FROM toks JOIN documents USING (doc_id) WHERE lang IS NOT NULL),
l AS (SELECT lang, lower(word) AS form FROM toks JOIN documents USING (doc_id) GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2)
SELECT lang, form FROM w WHERE (lang, form) NOT IN (SELECT lang, form FROM l WHERE lang IS NOT NULL)""")
def unknown_by_language(spark, sf):
    """Words that stand in one text only of their language; the lexicon of a language has those of two."""
    d = texts(spark, sf, "lang").where("lang is not null")
    forms = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0)), lambda w: F.lower(w)))
    each = d.select("lang", F.explode(forms).alias("form")).groupBy("lang", "form").agg(F.count("*").alias("n"))
    return S.unknown_by_language(each.select("lang", "form"), each.where("n >= 2"))


@query("SELECT p_partkey, ['copy', 'first page', 'archive', NULL][p_partkey % 4 + 1] AS cover, array_to_string(list_sort(list_distinct([lower(p_name), lower(p_brand)])), '|') AS names FROM part")
def book_covers(spark, sf):
    path = F.element_at(F.array(*map(F.lit, ("/a/b.JPG", "/a.b/c.pdf", "x.epub", "/a.pdf/c"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    listed = F.array(F.concat(F.lit(" "), F.lower("p_name")), F.lit("  "), F.lower("p_brand"), F.lower("p_name"), F.lit(None).cast("string"))
    return table(spark, sf, "part").select("p_partkey", S.cover_source(path).alias("cover"), F.array_join(S.speakers(listed), "|").alias("names"))
