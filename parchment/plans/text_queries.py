"""Queries over texts: sentences, segments, normalisation, roles, headings, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions import text as T
from ..operators import review
from . import number_sql as N
from .registry import query, table, texts

#: Sentences by a mark put where Java looks behind and ahead.
SQL_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace({0}, '([.!?…])\s+([«"A-ZÀ-ÝŒ—])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '')"""
SQL_LINES = r"""list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"""
SQL_PARAGRAPHS = f"SELECT doc_id, unnest(range(len(l))) AS para, unnest(l) AS p FROM (SELECT doc_id, {SQL_LINES} AS l FROM documents)"


def lines(spark, sf: str) -> DataFrame:
    return T.exploded(texts(spark, sf).select("doc_id", T.lines_of(F.col("text")).alias("l")), "l", "para", "p")


@query(
    f"""
WITH para AS ({SQL_PARAGRAPHS}),
pieces AS (SELECT doc_id, para, {SQL_SENTENCES.format("p")} AS ss, p FROM para),
short AS (SELECT doc_id, len(ss) AS n_sentences, length(p) AS n FROM pieces)
SELECT doc_id, count(*) AS n_paragraphs, CAST(sum(n_sentences) AS BIGINT) AS n_sentences, CAST(sum(n) AS BIGINT) AS n_chars FROM short GROUP BY doc_id
"""
)
def doc_sentences_summary(spark, sf):
    p = lines(spark, sf).select("doc_id", F.size(T.sentences(F.col("p"))).alias("s"), F.length("p").alias("n"))
    return p.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.sum("s").alias("n_sentences"), F.sum("n").alias("n_chars"))


#: Levels of cutting as nested list functions, then the fold over pieces.
SQL_CUT = r"list_transform(string_split(regexp_replace(x, '({0})\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y))"
SQL_PACK = """list_reduce(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> ''), lambda a, w: {'out': CASE WHEN a.cur <> '' AND length(a.cur) + 1 + length(w) > 250 THEN a.out || [a.cur] ELSE a.out END,
  'cur': CASE WHEN a.cur = '' OR length(a.cur) + 1 + length(w) > 250 THEN w ELSE a.cur || ' ' || w END}, {'out': CAST([] AS VARCHAR[]), 'cur': ''})"""
SQL_SEGMENTS = """
WITH para AS ({paragraphs}), s AS (SELECT doc_id, para, unnest(range(len(ss))) AS i, unnest(ss) AS x FROM (SELECT doc_id, para, {sentences} AS ss FROM para)),
one AS (SELECT doc_id, para, i, unnest(CASE WHEN length(x) <= 250 THEN [x] ELSE {stops} END) AS x, unnest(range(CASE WHEN length(x) <= 250 THEN 1 ELSE len({stops}) END)) AS j FROM s),
two AS (SELECT doc_id, para, i, j, unnest(CASE WHEN length(x) <= 250 THEN [x] ELSE {commas} END) AS x, unnest(range(CASE WHEN length(x) <= 250 THEN 1 ELSE len({commas}) END)) AS k FROM one),
long AS (SELECT doc_id, para, i, j, k, {pack} AS r FROM two WHERE length(x) > 250),
three AS (SELECT doc_id, para, i, j, k, 0 AS m, x FROM two WHERE length(x) <= 250
  UNION ALL SELECT doc_id, para, i, j, k, unnest(range(len(l))) AS m, unnest(l) AS x FROM (SELECT doc_id, para, i, j, k, CASE WHEN r.cur = '' THEN r.out ELSE r.out || [r.cur] END AS l FROM long)),
pieces AS (SELECT doc_id, para, list({{'t': x, 'last': last}} ORDER BY i, j, k, m) AS p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, para, i ORDER BY j DESC, k DESC, m DESC) = 1 AS last FROM three) GROUP BY doc_id, para),
folded AS (SELECT doc_id, para, list_reduce(p, lambda a, x: {{
    'out': (CASE WHEN a.cur <> '' AND length(a.cur) + 1 + length(x.t) > 250 THEN a.out || [{{'t': a.cur, 'e': false}}] ELSE a.out END)
      || CASE WHEN x.last AND length(CASE WHEN a.cur = '' OR length(a.cur) + 1 + length(x.t) > 250 THEN x.t ELSE a.cur || ' ' || x.t END) >= 30
        THEN [{{'t': CASE WHEN a.cur = '' OR length(a.cur) + 1 + length(x.t) > 250 THEN x.t ELSE a.cur || ' ' || x.t END, 'e': true}}] ELSE [] END,
    'cur': CASE WHEN x.last AND length(CASE WHEN a.cur = '' OR length(a.cur) + 1 + length(x.t) > 250 THEN x.t ELSE a.cur || ' ' || x.t END) >= 30 THEN ''
      ELSE CASE WHEN a.cur = '' OR length(a.cur) + 1 + length(x.t) > 250 THEN x.t ELSE a.cur || ' ' || x.t END END
  }}, {{'out': CAST([] AS STRUCT(t VARCHAR, e BOOLEAN)[]), 'cur': ''}}) AS r FROM pieces),
seg AS (SELECT doc_id, para, CASE WHEN r.cur = '' THEN r.out ELSE r.out || [{{'t': r.cur, 'e': true}}] END AS s FROM folded)
""".format(paragraphs=SQL_PARAGRAPHS, sentences=SQL_SENTENCES.format("p"), stops=SQL_CUT.format("[;:]"), commas=SQL_CUT.format(","), pack=SQL_PACK)


@query(
    SQL_SEGMENTS
    + """SELECT doc_id, count(*) AS n_paragraphs, CAST(sum(len(s)) AS BIGINT) AS n_segments, CAST(max(list_max(list_transform(s, lambda x: length(x.t)))) AS INT) AS longest,
  CAST(sum(len(list_filter(s, lambda x: x.e))) AS BIGINT) AS n_ends FROM seg GROUP BY doc_id"""
)
def doc_segments_summary(spark, sf):
    """Segments of all paragraphs, long sentences cut."""
    seg = lines(spark, sf).select("doc_id", "para", T.segments(F.col("p")).alias("s"))
    return seg.groupBy("doc_id").agg(
        F.count("*").alias("n_paragraphs"), F.sum(F.size("s")).alias("n_segments"), F.max(F.array_max(F.transform("s", lambda x: F.length(x["text"])))).alias("longest"), F.sum(F.size(F.filter("s", lambda x: x["ends"]))).alias("n_ends")
    )


@query(SQL_SEGMENTS + "SELECT doc_id, para, unnest(range(len(s))) AS idx, unnest(list_transform(s, lambda x: x.t)) AS text, unnest(list_transform(s, lambda x: x.e)) AS ends FROM seg")
def doc_segments(spark, sf):
    return T.exploded(lines(spark, sf).select("doc_id", "para", T.segments(F.col("p")).alias("s")), "s", "idx", "one").select("doc_id", "para", "idx", "one.text", "one.ends")


@query(f"WITH para AS ({SQL_PARAGRAPHS}), s AS (SELECT doc_id, para, {SQL_SENTENCES.format('p')} AS ss FROM para) SELECT doc_id, para, unnest(range(len(ss))) AS idx, unnest(ss) AS sentence FROM s")
def sentence_split(spark, sf):
    return T.exploded(lines(spark, sf).select("doc_id", "para", T.sentences(F.col("p")).alias("s")), "s", "idx", "sentence")


SQL_UNIFY = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({0}, '\p{{Zs}}', ' ', 'g'), '’', ''''), '[«»“”]', '', 'g'), '[()]', ', ', 'g'), '^[—–-]\s*', ''), '[—–]', ',', 'g')"""
SQL_TIDY = r"""rtrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\s+([,;:!?…])', '\1', 'g'), '([,;:])(?:\s*[,;:])+', '\1', 'g'), '[,;:]+\s*([.!?…])', '\1', 'g'), '([.!?…])\s*[,;:]+', '\1', 'g'), '\s+', ' ', 'g'), '^[ ,;:]+', ''))"""


@query(f"WITH para AS ({SQL_PARAGRAPHS}) SELECT doc_id, para, {SQL_TIDY.format(SQL_UNIFY.format('p'))} AS text FROM para")
def normalize_text(spark, sf):
    return lines(spark, sf).select("doc_id", "para", T.tidy(T.unify(F.col("p"))).alias("text"))


SQL_CAPITALS = r"""array_to_string(list_transform(string_split(regexp_replace({0}, '([^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)),
  lambda w: CASE WHEN regexp_full_match(w, '[A-ZÀ-ÝŒ]{{2,}}') THEN w[1] || lower(w[2:]) ELSE w END), '')"""


@query(
    f"""WITH para AS ({SQL_PARAGRAPHS}), {N.WORDS}, said AS (SELECT doc_id, para, {N.ALL.format(SQL_UNIFY.format('p'))} AS t FROM para, spoken)
SELECT doc_id, para, {SQL_TIDY.format(SQL_CAPITALS.format('t'))} AS text FROM said"""
)
def normalize_text_full(spark, sf):
    """With numbers in words and runs of capitals lowered."""
    spelled = lines(spark, sf).withColumn("t", numbers.spelled_numbers(T.unify(F.col("p"))))
    return spelled.select("doc_id", "para", T.tidy(T.capitalise_acronyms(F.col("t"))).alias("text"))


@query(f"WITH {N.WORDS} SELECT doc_id, {N.ALL.format('text')} AS text FROM documents, spoken")
def spelled_numbers(spark, sf):
    return texts(spark, sf).select("doc_id", numbers.spelled_numbers(F.col("text")).alias("text"))


@query(
    f"""WITH {N.WORDS}, n AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, o_custkey || '.' || o_orderkey AS b, '9' || o_orderkey || '000' || o_custkey || '000000' || o_orderkey AS c FROM orders)
SELECT o_orderkey, {N.ALL.format('a')} AS one, {N.ALL.format('b')} AS two, {N.ALL.format('c')} AS three FROM n, spoken"""
)
def spelled_keys(spark, sf):
    """Keys of orders, and longer numbers made of them, in words."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    n = table(spark, sf, "orders").select("o_orderkey", k.alias("a"), F.concat(c, F.lit("."), k).alias("b"), F.concat(F.lit("9"), k, F.lit("000"), c, F.lit("000000"), k).alias("c"))
    return n.select("o_orderkey", numbers.spelled_numbers(F.col("a")).alias("one"), numbers.spelled_numbers(F.col("b")).alias("two"), numbers.spelled_numbers(F.col("c")).alias("three"))


@query(f"SELECT doc_id, {SQL_CAPITALS.format('text')} AS text FROM documents")
def capitalise_acronyms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.capitalise_acronyms(F.col("text")).alias("text"))


@query(
    SQL_SEGMENTS
    + """, segs AS (SELECT doc_id, para, len(s) AS n, unnest(range(len(s))) AS idx, unnest(list_transform(s, lambda x: x.t)) AS text, unnest(list_transform(s, lambda x: x.e)) AS ends FROM seg)
SELECT doc_id, para, idx, CAST(round_even(CASE WHEN idx = n - 1 THEN 800 WHEN ends THEN 380 ELSE 250 END * 1.25, 0) AS BIGINT) AS pause_after_ms,
  sum(length(text)) OVER (PARTITION BY doc_id ORDER BY para, idx) :: BIGINT AS chars_so_far FROM segs"""
)
def segment_pauses(spark, sf):
    """Silences at 1.25 times their length, rounded half to even."""
    segs = doc_segments(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "para")))
    base = F.when(F.col("idx") == F.col("n") - 1, T.PAUSE_PARAGRAPH).when(F.col("ends"), T.PAUSE_SENTENCE).otherwise(T.PAUSE_SEGMENT)
    run = Window.partitionBy("doc_id").orderBy("para", "idx").rowsBetween(Window.unboundedPreceding, 0)
    return segs.select("doc_id", "para", "idx", F.bround(base * F.lit(1.25)).cast("long").alias("pause_after_ms"), F.sum(F.length("text")).over(run).alias("chars_so_far"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '^\\s*(?:[—–-](?:\\s|[\\p{L}_])|[«“\"])') THEN 'dialogue' ELSE 'narrateur' END AS role FROM conversations")
def role_tagging(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.role_of(F.col("text")).alias("role"))


@query(
    """
SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'system' THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) WHEN turn % 5 = 3 THEN '' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '') AS reader
FROM conversations QUALIFY role <> 'system'
"""
)
def persona_forward_fill(spark, sf):
    """System turns mark who reads what follows; every fifth turn gives back to the narrator. Markers go."""
    c = table(spark, sf, "conversations")
    mark = F.when(F.col("role") == "system", F.concat(F.lit("@"), F.col("text"))).when(F.col("turn") % 5 == 3, "@narrateur")
    filled = forward_fill(c.withColumn("m", T.persona_of(F.regexp_replace(mark, "\\s+", " "))), ["conv_id"], ["turn"], "m")
    return filled.where("role <> 'system'").select("conv_id", "turn", F.coalesce("m_filled", F.lit("")).alias("reader"))


def forward_fill(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """The last value that isn't null, up to each row; an empty string is a value."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(f"{column}_filled", F.last(column, ignorenulls=True).over(w))


@query("SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def role_counts(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH para AS ({SQL_PARAGRAPHS}) SELECT doc_id, para, p FROM para WHERE NOT regexp_matches(p, '(?i)^\\s*(?:page\\s*)?\\d{{1,4}}\\s*$')")
def page_number_filter(spark, sf):
    return lines(spark, sf).where(~F.col("p").rlike(T.PAGE_NUMBER))


@query(
    f"""
WITH para AS ({SQL_PARAGRAPHS}), f AS (SELECT doc_id, para, p, CAST(length(p) <= 70 AND right(p, 1) NOT IN ('.', ',', ';', ':', '!', '?', '«', '»')
  AND (regexp_matches(p, '(?i)^\\s*(?:chapitre|chapter|cap[ií]tulo|kapitel)\\b') OR upper(p) = p) AS INT) AS h FROM para)
SELECT doc_id, chapter, count(*) AS n_lines, CAST(sum(length(p)) AS BIGINT) AS chars FROM
  (SELECT *, CAST(sum(h) OVER (PARTITION BY doc_id ORDER BY para) AS BIGINT) AS chapter FROM f) GROUP BY doc_id, chapter
"""
)
def heading_sessions(spark, sf):
    """Chapters of a text: a heading-like line opens one."""
    w = Window.partitionBy("doc_id").orderBy("para").rowsBetween(Window.unboundedPreceding, 0)
    flagged = lines(spark, sf).withColumn("chapter", F.sum(T.heading_like(F.col("p")).cast("int")).over(w))
    return flagged.groupBy("doc_id", "chapter").agg(F.count("*").alias("n_lines"), F.sum(F.length("p")).alias("chars"))


SQL_TOKENS = r"""
parts AS (SELECT doc_id, string_split(regexp_replace(text, '([A-Za-zÀ-ÿœŒæÆ''’-]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS l FROM documents),
cut AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS word FROM parts),
toks AS (SELECT doc_id, word, CAST(coalesce(o, 0) AS BIGINT) AS "offset" FROM
  (SELECT *, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM cut)
  WHERE regexp_full_match(word, '[A-Za-zÀ-ÿœŒæÆ''’-]{2,}'))
"""


def _tokens(spark, sf) -> DataFrame:
    return review.tokens(texts(spark, sf))


@query(f"WITH {SQL_TOKENS} SELECT word, count(*) AS n FROM toks GROUP BY word")
def token_frequency(spark, sf):
    return review.word_frequency(_words(spark, sf))


@query(f"WITH {SQL_TOKENS} SELECT DISTINCT lower(word) AS form FROM (SELECT word, count(*) AS n FROM toks GROUP BY word) WHERE n >= 2 AND word[1] = upper(word[1]) AND word[1] <> lower(word[1])")
def proper_nouns(spark, sf):
    return review.proper_nouns(review.word_frequency(_words(spark, sf)))


#: Lexicon: lower-case words that stand in three documents at least.
SQL_SUSPECTS = (
    f"WITH {SQL_TOKENS}, "
    r"""
lexicon AS (SELECT lower(word) AS form FROM toks GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
proper AS (SELECT DISTINCT lower(word) AS form FROM (SELECT word, count(*) AS n FROM toks GROUP BY word) WHERE n >= 2 AND word[1] = upper(word[1]) AND word[1] <> lower(word[1])),
words AS (SELECT DISTINCT word FROM toks),
pat AS (SELECT word, CASE WHEN regexp_matches(word, '[a-zà-ÿ][A-ZÀ-Ý]') THEN 'inner case' WHEN regexp_matches(word, '[A-ZÀ-Ý]{2,}[a-zà-ÿ]') THEN 'capitals before small letters'
  WHEN regexp_matches(word, '\d[A-Za-zÀ-ÿ]|[A-Za-zÀ-ÿ]\d') THEN 'digit in a word' WHEN regexp_matches(word, 'ï[aeiouy]|[aeiouy]ï[a-z]') THEN 'odd diaeresis' END AS reason FROM words),
core AS (SELECT word, replace(replace(replace(lower(regexp_replace(word, '^[''’-]+|[''’-]+$', '', 'g')), '’', ''''), 'œ', 'oe'), 'æ', 'ae') AS c FROM pat WHERE reason IS NULL AND lower(word) NOT IN (SELECT form FROM proper)),
forms AS (SELECT word, c, list_filter(string_split(replace(c, '-', ''''), ''''), lambda x: x <> '' AND x NOT IN ('l','d','j','n','m','t','s','c','qu','jusqu','lorsqu','puisqu','quelqu')) AS f FROM core),
each AS (SELECT word, unnest(CASE WHEN len(f) > 0 THEN f ELSE [c] END) AS form FROM forms),
unknown AS (SELECT DISTINCT word FROM each WHERE length(form) >= 2 AND form NOT IN (SELECT form FROM lexicon) AND form NOT IN (SELECT form FROM proper)),
judged AS (SELECT word, reason FROM pat WHERE reason IS NOT NULL UNION ALL SELECT word, 'not in the lexicon' FROM unknown),
found AS (SELECT doc_id, "offset", toks.word, reason FROM toks JOIN judged ON toks.word = judged.word)
"""
)


def _words(spark, sf) -> DataFrame:
    return review.words(texts(spark, sf))


def _judged(spark, sf) -> DataFrame:
    lexicon = review.document_frequency(texts(spark, sf)).where("d >= 3").select("form")
    frequency = review.word_frequency(_words(spark, sf))
    return review.judged_words(frequency, lexicon, review.proper_nouns(frequency))


@query(SQL_SUSPECTS + "SELECT * FROM found")
def suspects(spark, sf):
    return review.suspects(_tokens(spark, sf), _judged(spark, sf))


SQL_GATE = SQL_SUSPECTS + ", rare AS (SELECT word AS w, count(*) AS recurrence FROM found GROUP BY word HAVING count(*) < 4) "


@query(SQL_GATE + "SELECT found.*, recurrence FROM found JOIN rare ON word = w")
def recurrence_gate(spark, sf):
    return review.recurrence_gate(_tokens(spark, sf), _judged(spark, sf))


@query(
    SQL_GATE
    + """SELECT f.doc_id, "offset", f.word, replace(substring(text, greatest(0, "offset" - 45) + 1, "offset" + length(f.word) + 45 - greatest(0, "offset" - 45)), chr(10), ' ') AS context
FROM found f JOIN rare ON f.word = w JOIN documents d ON d.doc_id = f.doc_id"""
)
def suspect_context(spark, sf):
    rare = review.recurrence_gate(_tokens(spark, sf), _judged(spark, sf)).select("doc_id", "offset", "word")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return rare.join(docs, "doc_id").select("doc_id", "offset", "word", review.context(F.col("text"), F.col("offset"), F.col("word")).alias("context"))


#: DuckDB measures distance in bytes: letters outside ASCII take the place of signs that no word has.
SQL_BYTES = "translate(lower({0}), 'àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœß’', '0123456789!#$%&()*+,./:;<=>?@[]^_{{|}}')"
SQL_GAP = f"levenshtein({SQL_BYTES.format('word')}, {SQL_BYTES.format('asked')})"
SQL_LIMIT = "least(3, greatest(1, length(word) // 2))"


@query(
    f"""
WITH {SQL_TOKENS}, freq AS (SELECT word, count(*) AS n, left(word, 4) AS head, length(word) AS size FROM toks GROUP BY word),
common AS (SELECT head, size, arg_max(word, (n, word)) AS proposal FROM freq WHERE n >= 20 GROUP BY head, size),
pairs AS (SELECT word, proposal, CASE WHEN contains(word, '’') THEN replace(proposal, '''', '’') ELSE proposal END AS asked FROM freq JOIN common USING (head, size) WHERE n = 1),
judged AS (SELECT word, proposal, asked, CASE WHEN asked = word THEN '' WHEN {SQL_GAP} > {SQL_LIMIT} THEN {SQL_GAP} || ' > ' || {SQL_LIMIT}
  WHEN word[1] = upper(word[1]) AND word[1] <> lower(word[1]) AND asked[1] = lower(asked[1]) AND asked[1] <> upper(asked[1]) THEN 'capital lost' ELSE '' END AS cause FROM pairs)
SELECT word, proposal, cause, CASE WHEN cause = '' AND asked <> word THEN asked ELSE '' END AS replacement FROM judged
"""
)
def guard_rails(spark, sf):
    """Each word that stands once is judged against the most frequent word of its length and first four letters, if that stands twenty times."""
    freq = review.word_frequency(_words(spark, sf)).withColumn("head", F.substring("word", 1, 4)).withColumn("size", F.length("word"))
    common = freq.where("n >= 20").groupBy("head", "size").agg(F.max(F.struct("n", "word")).alias("m")).select("head", "size", F.col("m.word").alias("proposal"))
    judged = freq.where("n = 1").select("word", "head", "size").join(common, ["head", "size"]).withColumn("g", review.guard(F.col("word"), F.col("proposal"), F.lit(True)))
    return judged.select("word", "proposal", "g.cause", "g.replacement")


@query(
    f"""
WITH {SQL_TOKENS}, hits AS (SELECT doc_id, "offset" FROM toks WHERE word IN ('the', 'de', 'der')),
chars AS (SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_edits, CAST(length(text) + coalesce(n * 0, 0) AS BIGINT) AS n_chars,
  array_to_string(list_transform(string_split(regexp_replace(text, '([A-Za-zÀ-ÿœŒæÆ''’-]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)),
    lambda w: CASE w WHEN 'the' THEN 'THE' WHEN 'de' THEN 'DE' WHEN 'der' THEN 'DER' ELSE w END), '') AS text
FROM documents d LEFT JOIN chars USING (doc_id)
"""
)
def apply_substitutions(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    edits = (
        _tokens(spark, sf).where(F.col("word").isin("the", "de", "der"))
        .groupBy("doc_id").agg(F.collect_list(F.struct(F.col("offset").cast("int").alias("offset"), "word", F.upper("word").alias("replacement"))).alias("edits"))
    )
    joined = docs.join(edits, "doc_id", "left").withColumn("edits", F.coalesce("edits", F.array().cast("array<struct<offset:int,word:string,replacement:string>>")))
    return joined.select("doc_id", F.size("edits").cast("long").alias("n_edits"), F.length("text").cast("long").alias("n_chars"), T.apply_substitutions(F.col("text"), F.col("edits")).alias("text"))


#: Lines of orders stand for a bench: suggestions are lines with a discount, truth lines returned, flagged lines with tax.
SQL_BENCH = """
WITH s AS (SELECT l_orderkey AS chapter, l_linenumber AS o, l_returnflag AS replacement FROM lineitem WHERE l_discount > 0.05),
t AS (SELECT l_orderkey AS chapter, l_linenumber AS o, CASE WHEN l_quantity > 25 THEN 'R' ELSE 'A' END AS expected FROM lineitem WHERE l_returnflag <> 'N'),
f AS (SELECT DISTINCT l_orderkey AS chapter, l_linenumber AS o FROM lineitem WHERE l_tax > 0.04),
sd AS (SELECT * FROM s), j AS (SELECT replacement, expected FROM sd LEFT JOIN t USING (chapter, o)),
m AS (SELECT t.*, f.o IS NOT NULL AS seen FROM t ANTI JOIN s USING (chapter, o) LEFT JOIN f USING (chapter, o))
"""


@query(
    SQL_BENCH
    + """, n AS (SELECT (SELECT count(*) FROM j WHERE expected = replacement) AS fixed, (SELECT count(*) FROM j WHERE expected <> replacement) AS inexact, (SELECT count(*) FROM j WHERE expected IS NULL) AS undue,
  (SELECT count(*) FROM m WHERE seen) AS missed_flagged, (SELECT count(*) FROM m WHERE NOT seen) AS missed_unflagged)
SELECT *, fixed + inexact + missed_flagged + missed_unflagged AS corrections, fixed / (fixed + inexact + undue) AS precision, fixed / (fixed + inexact + missed_flagged + missed_unflagged) AS recall FROM n"""
)
def bench_outcome(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("offset"), "*")
    key = ["chapter", "offset"]
    s = li.where("l_discount > 0.05").select(*key, F.col("l_returnflag").alias("replacement"))
    t = li.where("l_returnflag <> 'N'").select(*key, F.when(F.col("l_quantity") > 25, "R").otherwise("A").alias("expected"))
    return review.outcome(s, t, li.where("l_tax > 0.04").select(*key))


SQL_PAIR_TOKENS = r"""(SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos, CAST(coalesce(o, 0) AS BIGINT) AS "offset", word, lower(word) AS low FROM (
  SELECT *, sum(length(word)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM (
    SELECT id, unnest(range(len(l))) AS i, unnest(l) AS word FROM (
      SELECT id, string_split(regexp_replace({0}, '([A-Za-zÀ-ÿœŒæÆ0-9''’-]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS l FROM pairs)))
  WHERE regexp_full_match(word, '[A-Za-zÀ-ÿœŒæÆ0-9''’-]+'))"""


@query(
    f"""WITH heads AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS head FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT h.doc_id AS id, h.text AS raw, f.text AS clean FROM heads h JOIN (SELECT head, min(doc_id) AS first FROM heads GROUP BY head) g USING (head) JOIN heads f ON f.doc_id = g.first WHERE h.doc_id <> g.first),
l AS {SQL_PAIR_TOKENS.format("raw")}, r AS {SQL_PAIR_TOKENS.format("clean")},
l1 AS (SELECT id, low, min(pos) AS i FROM l GROUP BY id, low HAVING count(*) = 1), r1 AS (SELECT id, low, min(pos) AS j FROM r GROUP BY id, low HAVING count(*) = 1),
met AS (SELECT id, i, j, max(j) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(j) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM l1 JOIN r1 USING (id, low)),
anchors AS (SELECT id, i, j FROM met WHERE j > coalesce(b, -1) AND j < coalesce(a, j + 1)),
lg AS (SELECT l.*, count(i) OVER (PARTITION BY l.id ORDER BY pos) AS gap FROM l LEFT JOIN anchors ON l.id = anchors.id AND pos = i),
rg AS (SELECT r.*, count(j) OVER (PARTITION BY r.id ORDER BY pos) AS gap FROM r LEFT JOIN anchors ON r.id = anchors.id AND pos = j),
la AS (SELECT id, gap, list(low ORDER BY pos) AS x, list(word ORDER BY pos) AS w, list("offset" ORDER BY pos) AS o FROM lg GROUP BY id, gap),
ra AS (SELECT id, gap, list(low ORDER BY pos) AS y, list(word ORDER BY pos) AS v FROM rg GROUP BY id, gap),
s AS (SELECT la.*, coalesce(y, []) AS y, coalesce(v, []) AS v, len(x) AS n, coalesce(len(y), 0) AS m FROM la LEFT JOIN ra ON la.id = ra.id AND la.gap = ra.gap),
p AS (SELECT *, coalesce(list_position(list_transform(range(1, least(n, m) + 1), lambda k: x[k] = y[k]), false) - 1, least(n, m)) AS pre FROM s),
q AS (SELECT *, coalesce(list_position(list_transform(range(0, least(n, m) - pre), lambda k: x[n - k] = y[m - k]), false) - 1, least(n, m) - pre) AS suf FROM p),
e AS (SELECT id, n, m, pre, suf, v, array_to_string(v[pre + 1:m - suf], ' ') AS whole, unnest(range(n)) AS k, unnest(w) AS word, unnest(o) AS "offset" FROM q)
SELECT id, "offset", word, expected FROM (SELECT id, "offset", word, CASE WHEN k < pre OR n = m THEN v[k + 1] WHEN k >= n - suf THEN v[m - n + k + 1] ELSE whole END AS expected FROM e) WHERE word <> expected"""
)
def alignment_truth(spark, sf):
    """Corrections that turn each text into the first text with the same first line."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("head"), F.col("text").alias("raw"))
    return review.alignment_to_first(d)
