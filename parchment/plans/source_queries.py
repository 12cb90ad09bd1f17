"""Queries through readers: chapters of plain texts, Markdown there and back, blocks of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import pages as P
from ..sources import plain, services
from .registry import query, table


@query(
    r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, trim(unnest(x)) AS line FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS x FROM documents)),
k AS (SELECT * FROM l WHERE line <> '' AND NOT regexp_matches(line, '(?i)^\s*(?:page\s*)?\d{1,4}\s*$')),
f AS (SELECT *, length(line) <= 70 AND right(line, 1) NOT IN ('.', ',', ';', ':', '!', '?', '«', '»') AND (regexp_matches(line, '(?i)^\s*(?:chapitre|chapter|cap[ií]tulo|kapitel)\b') OR upper(line) = line) AS look FROM k),
h AS (SELECT *, look AND coalesce(NOT lag(look) OVER (PARTITION BY doc_id ORDER BY pos), false) AS h FROM f),
c AS (SELECT *, CAST(sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS chapter FROM h),
t AS (SELECT *, CASE WHEN h THEN regexp_replace(regexp_replace(line, '\s+', ' ', 'g'), '^[ .:\-—–_*#]+|[ .:\-—–_*#]+$', '', 'g') END AS title FROM c)
SELECT doc_id, chapter, max(CASE WHEN upper(title) = title THEN upper(title[1]) || lower(title[2:]) ELSE title END) AS title, count(*) FILTER (NOT h)::INT AS n_paragraphs FROM t GROUP BY doc_id, chapter
"""
)
def plain_chapters(spark, sf):
    """Documents read as plain books."""
    c = plain.chapters(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return c.select("doc_id", "chapter", "title", F.size("paragraphs").alias("n_paragraphs"))


@query("SELECT doc_id, CAST(doc_id AS INT) AS chapter, source AS title, len(l) AS n_paragraphs, CAST(list_sum(list_transform(l, lambda x: length(x))) AS BIGINT) AS chars FROM (SELECT doc_id, source, list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) WHERE len(l) > 0")
def markdown_round_trip(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", T.lines_of(F.col("text")).alias("l")).where(F.size("l") > 0)
    back = d.select("doc_id", plain.from_markdown(plain.to_markdown(F.col("doc_id"), F.col("source"), F.col("l"))).alias("m"))
    chars = F.aggregate("m.paragraphs", F.lit(0).cast("long"), lambda a, p: a + F.length(p))
    return back.select("doc_id", "m.chapter", "m.title", F.size("m.paragraphs").cast("long").alias("n_paragraphs"), chars.alias("chars"))


#: Blocks by patterns, for pages whose silent elements hold no others of their kind.
SQL_BLOCKS = "html"
for _gone, _by in ((r"<script\b.*?</script>", ""), (r"<style\b.*?</style>", ""), (r"<!--.*?-->", ""), (r"<!DOCTYPE[^>]*>", ""), (r"<head\b.*?(</head>|\z)", "\x01"), (r"<nav\b.*?(</nav>|\z)", "\x01"),
    (r"<footer\b.*?(</footer>|\z)", "\x01"), (r"</?(p|div|blockquote|li|h[1-6])\b[^>]*>", "\x01"), (r"<br\b[^>]*>", " "), (r"</?[a-zA-Z][^>]*>", ""), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;?", "&")):
    SQL_BLOCKS = f"regexp_replace({SQL_BLOCKS}, '{_gone}', '{_by}', 'gsi')"


@query(f"SELECT page_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS text FROM (SELECT page_id, list_filter(list_transform(string_split({SQL_BLOCKS}, chr(1)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM pages)")
def html_blocks(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(P.paragraphs(F.col("html"), all_references=False)).alias("pos", "text"))


@query(r"SELECT page_id, length(regexp_replace(regexp_replace(html, '<script\b.*?</script>', '', 'gsi'), '<meta\b[^>]*>', '', 'gi')) + length('<base href=\"' || url || '\">') AS n FROM pages".replace('\\"', '"'))
def clean_pages(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.length(P.clean_html(F.col("html"), F.col("url"))).cast("long").alias("n"))


@query("SELECT doc_id, floor(50 * (length(text) / 18.0::DOUBLE + 0.15::DOUBLE)) / 50 AS seconds FROM documents")
def synthesised_lengths(spark, sf):
    """Documents through the stand-in for speech, at fifty samples a second, and what they come to in seconds."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return services.synthesised(d, lambda: services.Tone(sample_rate=50)).select("doc_id", F.when(F.col("text").isNotNull(), F.size("audio") / 50).alias("seconds"))


@query("SELECT doc_id, '[\"' || source || '\"]' AS reply FROM documents")
def model_replies(spark, sf):
    said = F.concat(F.lit("<think>[hm]</think> here: "), F.when(F.col("doc_id") % 2 == 0, F.lit("```json\n")).otherwise(""), F.lit('["'), F.col("source"), F.lit('"]'), F.when(F.col("doc_id") % 2 == 0, F.lit("\n```")).otherwise(" done"))
    return table(spark, sf, "documents").select("doc_id", services.reply_json(said).alias("reply"))
