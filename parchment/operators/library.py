"""Shelves of books: titles, casts, filters of the screens, joins of inventories, sets of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.misc import dehyphenated

# Fixed value: price of a thousand characters of remote speech.
PRICE = 0.016


def page_chars(spans: DataFrame, low: Column, high: Column, top: Column, bottom: Column) -> DataFrame:
    """page, chars: characters of a page's spans in the body's band and sizes."""
    inside = (F.col("y") >= top) & (F.col("y") < bottom) & F.col("size").between(low, high)
    return spans.groupBy("page").agg(F.sum(F.when(inside, F.length(F.trim("text"))).otherwise(0)).alias("chars"))


def page_lines(spans: DataFrame) -> DataFrame:
    """page, line, y, x, size (upper median), top_size, text of spans (page, line, x, y, size, text)."""
    packed = spans.groupBy("page", "line").agg(F.min("y").alias("y"), F.min("x").alias("x"), F.array_sort(F.collect_list("size")).alias("s"), F.array_sort(F.collect_list(F.struct("x", "text"))).alias("t"))
    return packed.select("page", "line", "y", "x", F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1).alias("size"), F.element_at("s", -1).alias("top_size"), F.array_join(F.transform("t", lambda z: z["text"]), "").alias("text"))


def native_paragraphs(lines: DataFrame, margin: Column) -> DataFrame:
    """page, paragraph, text: a line opens one if it is indented by more than four points or starts with a dash or quote."""
    w = Window.partitionBy("page").orderBy("line")
    opens = (F.col("x") > margin + 4) | F.col("text").rlike(r"^\s*[—–«]")
    numbered = lines.withColumn("paragraph", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    packed = numbered.groupBy("page", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return packed.select("page", "paragraph", dehyphenated(F.transform("l", lambda z: z["text"])).alias("text"))


def scan_paragraphs(lines: DataFrame) -> DataFrame:
    """page, paragraph, text of scanned lines (page, line, x, width, text): a line opens one at a dash, an indent, or behind a short line that closes a sentence.

    Margins and the usual width are the page's own.
    """
    page = lines.groupBy("page").agg(F.min("x").alias("__m"), F.median(F.when(F.col("width") > 0, F.col("width"))).alias("__w"))
    w = Window.partitionBy("page").orderBy("line")
    closed = (F.col("width") > 0) & (F.col("width") < 0.8 * F.col("__w")) & F.col("text").rlike("[.!?…»”\"’]\\s*$")
    opens = F.col("text").rlike("^\\s*[—–-]\\s") | (F.col("x") > F.col("__m") + 4) | F.coalesce(F.lag(closed).over(w), F.lit(False))
    numbered = lines.join(page, "page").withColumn("__o", opens.cast("int")).withColumn("paragraph", F.sum("__o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    packed = numbered.groupBy("page", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return packed.select("page", "paragraph", dehyphenated(F.transform("l", lambda z: z["text"])).alias("text"))


def heading_starts(lines: DataFrame, body: Column) -> DataFrame:
    """page, title: pages whose first line is large and short."""
    first = lines.groupBy("page").agg(F.min_by(F.struct("text", "size"), "line").alias("f"))
    return first.where((F.col("f.size") >= 1.25 * body) & (F.length("f.text") < 90)).select("page", F.col("f.text").alias("title"))


def bookmark_starts(bookmarks: DataFrame) -> DataFrame:
    """page (from 0), title of first-level bookmarks (level, title, page from 1)."""
    return bookmarks.where("level = 1 and page > 0").select((F.col("page") - 1).alias("page"), F.trim("title").alias("title")).distinct()


def picked_title(toc: Column, paragraphs: Column, document: Column) -> Column:
    """struct<title, paragraphs>: the contents' title unless it only counts; else a short first paragraph that ends no sentence, which is taken out; else the document's."""
    generic = F.coalesce(toc.rlike(r"(?i)^\s*chapitres?\s*\d+\s*$"), F.lit(True))
    first = F.try_element_at(paragraphs, F.lit(1))
    fits = F.coalesce((F.length(first) <= 60) & ~F.right(first, F.lit(1)).isin(*".!?;:,"), F.lit(False))
    title = F.when(~generic, toc).when(fits, first).otherwise(F.coalesce(toc, document))
    return F.struct(title.alias("title"), F.when(generic & fits, F.slice(paragraphs, F.lit(2), F.greatest(F.lit(0), F.size(paragraphs) - 1))).otherwise(paragraphs).alias("paragraphs"))


def service_file(name: Column, listed: Column, chars: Column) -> Column:
    return (name.rlike(r"(?i)cover|title[-_]?page|copyright|colophon|nav\b|toc\b|contents|index|acknowledg") & ~listed) | (chars < 200)


def voiced(segments: DataFrame, cast: DataFrame, default: Column) -> DataFrame:
    """segments with `voice`: that of the role, case aside, else the narrator's."""
    c = cast.groupBy(F.lower("role").alias("__r")).agg(F.max("voice").alias("__v"))
    return segments.join(c, F.lower("role") == F.col("__r"), "left").withColumn("voice", F.coalesce("__v", default)).drop("__r", "__v")


def inventory(catalogue: DataFrame, containers: DataFrame) -> DataFrame:
    """catalogue (service) with the state of its container; absent where there is none."""
    c = containers.groupBy("service").agg(F.max("state").alias("state"))
    return catalogue.join(c, "service", "left").withColumn("state", F.coalesce("state", F.lit("absent")))


def search(cards: DataFrame, columns: list[str], wanted: str) -> DataFrame:
    """Cards that have the words somewhere, case aside."""
    return cards.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(wanted.lower())))


def flagged_causes(timing: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, causes: takes that aren't clean and why."""
    return timing.where(~F.coalesce("clean", F.lit(True))).groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("cause")).alias("causes"))


def speaks(languages: Column, wanted: Column) -> Column:
    return wanted.isNull() | languages.isNull() | (F.size(languages) == 0) | F.exists(languages, lambda x: F.startswith(x, wanted))


def available(engines: DataFrame, chosen: Column) -> DataFrame:
    return engines.where(F.col("available") & (chosen.isNull() | F.array_contains(chosen, F.col("key"))))


def allowed_words(vocabulary: DataFrame, corpus: DataFrame, suspects: DataFrame) -> DataFrame:
    """Words (form) of the vocabulary and of the corpus, without what is under suspicion."""
    return vocabulary.select("form").union(corpus.select("form")).distinct().join(suspects.select("form").distinct(), "form", "left_anti")


def joiner(before: Column, after: Column, halves_known: Column, whole_known: Column) -> Column:
    """What stands between two fragments of a line."""
    glued = F.endswith(before, F.lit(" ")) | after.rlike(r"^[-,.;:!?»)]")
    return F.when(glued | (~halves_known & whole_known), "").otherwise(" ")


def marked(text: Column, offset: Column, word: Column, around: int = 90) -> Column:
    """The word in a frame, with what stands around it."""
    start = F.greatest(F.lit(0), offset - around)
    flat = lambda c: F.replace(c, F.lit("\n"), F.lit(" "))
    left, right = F.substring(text, start + 1, offset - start), F.substring(text, offset + F.length(word) + 1, F.lit(around))
    return F.concat(F.lit("…"), flat(left), F.lit("⟦"), word, F.lit("⟧"), flat(right), F.lit("…"))


def relocated(text: Column, word: Column, offset: Column) -> Column:
    """Where a word stands now, from 0: at its place, else at the whole word nearest to it; null if nowhere."""
    pieces = F.split(text, r"(?U)(?<!\w)(?=\w)|(?<=\w)(?!\w)")
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("best"))

    def step(a, p):
        nearer = (p == word) & (a["best"].isNull() | (F.abs(a["at"] - offset) < F.abs(a["best"] - offset)))
        return F.struct((a["at"] + F.length(p)).alias("at"), F.when(nearer, a["at"]).otherwise(a["best"]).alias("best"))

    found = F.aggregate(pieces, start, step, lambda a: a["best"])
    first = F.nullif(F.instr(text, word) - 1, F.lit(-1))
    here = (offset >= 0) & (F.substring(text, offset + 1, F.length(word)) == word)  # a place before the text would count from its end
    return F.when(here, offset).otherwise(F.coalesce(found, first))


def assigned(paragraphs: Column, first: Column, last: Column, name: Column) -> Column:
    """Paragraphs with those from first to last (from 0) read by a name: markers inside and next to them go, new ones stand around them."""
    mark = lambda c: c.rlike(r"^@")
    tagged = F.transform(paragraphs, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    kept = F.filter(tagged, lambda t: ~(mark(t["p"]) & t["i"].between(first - 1, last + 1)))
    part = lambda f: F.transform(F.filter(kept, f), lambda t: t["p"])
    return F.concat(part(lambda t: t["i"] < first), F.array(F.concat(F.lit("@"), name)), part(lambda t: t["i"].between(first, last)), F.array(F.lit("@")), part(lambda t: t["i"] > last))


def designed(traits: Column, vocabulary: list[str]) -> Column:
    return F.array_join(F.filter(traits, lambda t: t.isin(*vocabulary)), ", ")


def chapter_announcement(number: Column, words: Column, title: Column, single: Column) -> Column:
    """What is said before a chapter; nothing before chapter 0."""
    named = F.regexp_replace(F.trim(title), r"[.\s]+$", "")
    named = F.when(F.coalesce(named, F.lit("")).rlike(r"(?i)^(chapitres?\s*\d+)?$"), "").otherwise(named)
    spoken = F.concat(F.lit("Chapitre "), words, F.lit("."))
    full = F.when(named != "", F.concat(spoken, F.lit(" "), named, F.lit("."))).otherwise(spoken)
    alone = F.when(named != "", F.concat(named, F.lit("."))).otherwise("")
    return F.when(number == 0, "").when(single, alone).otherwise(full)


def project_status() -> Column:
    """The first that holds of: at work, bound, failed, recorded, to review, segmented; else new."""

    c = F.col
    return F.when(c("active"), "at work").when(c("bound"), "bound").when(c("last_failed"), "failed").when(c("tracks") > 0, "recorded").when(c("needs_review"), "to review").when(c("segments") > 0, "segmented").otherwise("new")
