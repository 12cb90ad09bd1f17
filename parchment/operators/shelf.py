"""What stands around the books: casts and their forms, proposals, reports, samples, catalogues, guards of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles of the cast; unread signs from which a text wants a review; types of files that are shown.
NARRATOR, DIALOGUE = "narrateur", "dialogue"
LEAST_UNREAD = 5
ASSETS = {"css": "text/css", "js": "text/javascript", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "svg": "image/svg+xml", "gif": "image/gif", "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf"}


def unread(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, unread, needs_review: signs that nothing could read, and whether they are enough to ask for a review."""
    signs = F.length(text) - F.length(F.replace(text, F.lit("�")))
    return pages.groupBy(*keys).agg(F.sum(signs).alias("unread")).withColumn("needs_review", F.col("unread") >= LEAST_UNREAD)


def occurrence_rank(paragraphs: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """paragraphs with `rank`: which of the equal paragraphs, from 0, it is."""
    return paragraphs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, text).orderBy(order)) - 1)


def pending_review(chapters: DataFrame, key: str) -> DataFrame:
    """key, pending: chapters not reviewed, of books that want a review; else 0. chapters has reviewed and needs_review."""
    return chapters.groupBy(key).agg(F.count_if(F.col("needs_review") & ~F.col("reviewed")).alias("pending"))


def discovered_names(report: Column) -> Column:
    """Names in a report of readers; none if it can't be read."""
    people = F.from_json(report, "personas array<struct<name:string>>")["personas"]
    return F.coalesce(F.filter(F.transform(people, lambda p: p["name"]), lambda n: F.coalesce(n, F.lit("")) != ""), F.array().cast("array<string>"))


def migrated_voices(voices: Column, dialogue: Column) -> Column:
    """A cast from the time when dialogues had the only second voice: it becomes theirs, unless they have one."""
    voices = F.coalesce(voices, F.create_map().cast("map<string,string>"))
    wanted = F.coalesce(dialogue, F.lit("")) != ""
    return F.when(wanted & ~F.coalesce(F.map_contains_key(voices, DIALOGUE), F.lit(False)), F.map_concat(voices, F.create_map(F.lit(DIALOGUE), dialogue))).otherwise(voices)


def cast_form(names: Column, voices: Column) -> Column:
    """Two lists of a form as a cast: names bare of their mark, without the narrator; of equal names the last counts."""
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    pairs = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.size(voices))), lambda i: F.struct(F.regexp_replace(trimmed(F.element_at(names, i)), "^@+", "").alias("k"), trimmed(F.element_at(voices, i)).alias("v"), i.alias("i")))
    pairs = F.when(F.least(F.size(names), F.size(voices)) > 0, pairs).otherwise(F.array().cast("array<struct<k:string,v:string,i:int>>"))
    named = F.filter(pairs, lambda p: (p["k"] != "") & (F.lower(p["k"]) != NARRATOR))
    last = F.filter(named, lambda p: ~F.exists(named, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"])))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def report_json(suggestions: Column, rejected: Column, suspects: Column, asked: Column, skipped: Column, error: Column) -> Column:
    return F.to_json(F.struct(suggestions.alias("suggestions"), rejected.alias("rejected"), suspects.alias("suspects"), asked.alias("asked"), skipped.alias("skipped"), error.alias("error")))


REPORT = (
    "suggestions array<struct<offset:bigint,word:string,replacement:string,reason:string,recurrence:bigint,context:string>>,"
    "rejected array<struct<word:string,proposal:string,cause:string>>,suspects bigint,asked bigint,skipped array<string>,error string"
)


def report_of(json: Column) -> Column:
    """A report read back; what it doesn't say is null, and all of it if it can't be read."""
    return F.from_json(json, REPORT)


def numbered(paragraphs: Column, known: Column, first: int = 0) -> Column:
    """What a model is asked about a chapter: readers known already, then the paragraphs with their numbers."""
    lines = F.array_join(F.transform(paragraphs, lambda p, i: F.concat(F.lit("["), (i + first).cast("string"), F.lit("] "), p)), "\n")
    return F.concat(F.when(F.size(known) > 0, F.concat(F.lit("Known: "), F.array_join(known, ", "), F.lit(".\n\n"))).otherwise(""), lines)


def same_name(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def open_proposals(blocks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """blocks (id, chapter, persona, first, opening, closing) with found, last, rank and done.

    A block begins at the paragraph equal to its opening that is nearest to `first` (of two, the earlier) and ends at the
    next paragraph equal to its closing; rank says which of the equal openings that is. It is done if one reader,
    its own, has all of it. paragraphs has chapter, i, text, reader. Stretches of one reader are numbered, so that two
    lookups tell whether a block lies inside one: its paragraphs are never gathered.
    """
    run = Window.partitionBy("chapter").orderBy("i")
    who = F.lower(F.trim("reader"))
    p = paragraphs.withColumn("who", who).withColumn("new", F.coalesce((F.col("who") != F.lag("who").over(run)).cast("int"), F.lit(1)))
    p = occurrence_rank(p.withColumn("stretch", F.sum("new").over(run.rowsBetween(Window.unboundedPreceding, 0))), ["chapter"], "i")
    at = p.select(F.col("chapter").alias("p_c"), F.col("i").alias("p_i"), F.col("text").alias("p_t"), "stretch", "who", "rank")
    here = (F.col("chapter") == F.col("p_c")) & (F.col("opening") == F.col("p_t"))
    opened = blocks.join(at, here).groupBy(*blocks.columns).agg(F.min(F.struct(F.abs(F.col("p_i") - F.col("first")).alias("far"), F.col("p_i").alias("i"), "stretch", "who", "rank")).alias("o"))
    ends = at.select(F.col("p_c").alias("e_c"), F.col("p_i").alias("e_i"), F.col("p_t").alias("e_t"), F.col("stretch").alias("e_s"))
    there = (F.col("chapter") == F.col("e_c")) & (F.col("closing") == F.col("e_t")) & (F.col("e_i") >= F.col("o.i"))
    closed = opened.join(ends, there).groupBy(*blocks.columns, "o").agg(F.min(F.struct("e_i", "e_s")).alias("e"))
    done = (F.col("e.e_s") == F.col("o.stretch")) & (F.lower(F.trim("persona")) == F.col("o.who"))
    return closed.select(*blocks.columns, F.col("o.i").alias("found"), F.col("e.e_i").alias("last"), F.col("o.rank").alias("rank"), done.alias("done"))


def sample(path: Column, backend: Column, voice: Column) -> Column:
    """struct<backend, voice, label, chosen> of a sample's file, named backend--voice; chosen if the book has just these."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    engine, rest = F.substring_index(stem, "--", 1), F.when(F.contains(stem, F.lit("--")), F.regexp_replace(stem, "^.*?--", "")).otherwise("")
    chosen = (engine == backend) & (rest == F.replace(F.coalesce(voice, F.lit("")), F.lit(" "), F.lit("_")))
    return F.struct(engine.alias("backend"), F.replace(rest, F.lit("_"), F.lit(" ")).alias("voice"), chosen.alias("chosen"))


def file_label(path: Column) -> Column:
    """A file's name without its suffix, dashes and underscores as spaces."""
    return F.translate(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), "_-", "  ")


def sound_files(paths: DataFrame) -> DataFrame:
    """path, label of the sound files of a listing (path)."""
    return paths.where(F.col("path").rlike(r"(?i)\.(wav|mp3|flac|ogg|m4a)$")).select("path", file_label(F.col("path")).alias("label"))


def catalogue(static: DataFrame, remote: DataFrame) -> DataFrame:
    """engine, name: a service's own list takes the place of the static one, where it gave any."""
    return static.join(remote.select("engine").distinct(), "engine", "left_anti").select("engine", "name").unionByName(remote.select("engine", "name"))


def availability(engines: DataFrame, packages: DataFrame, addresses: DataFrame) -> DataFrame:
    """engines (engine, package) with `available`: the package is there, or an address is set."""
    p = packages.select("package").distinct().withColumn("__p", F.lit(True))
    a = addresses.where(F.coalesce("address", F.lit("")) != "").select("engine").distinct().withColumn("__a", F.lit(True))
    return engines.join(p, "package", "left").join(a, "engine", "left").withColumn("available", F.coalesce("__p", "__a", F.lit(False))).drop("__p", "__a")


def inside(name: Column) -> Column:
    """Whether a relative path stays below its root: it never climbs out of it, and isn't absolute."""
    depth = F.aggregate(
        F.split(name, r"[/\\]"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda a, p: F.transform(F.array(a["at"] + F.when(p == "..", -1).when((p == "") | (p == "."), 0).otherwise(1)), lambda x: F.struct(x.alias("at"), F.least(a["low"], x).alias("low")))[0],
        lambda a: a["low"],
    )
    return ~name.rlike(r"^([/\\]|[A-Za-z]:)") & (depth >= 0)


def page_source(source: Column, layout: Column) -> Column:
    """What a book's pages are shown from: pdf, epub if its pages are fixed; else null."""
    return F.when(F.lower(source).endswith(".pdf"), "pdf").when(F.lower(source).endswith(".epub") & (layout == "fixed"), "epub")


def asset_type(name: Column) -> Column:
    """The type of a file that may be shown; null for others, and for what lies outside."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in ASSETS.items() for x in pair])
    return F.when(inside(name), F.try_element_at(known, suffix))


def served_url(configured: Column, state: Column, default: Column) -> Column:
    """The address of an engine: the one that is set, else its container's, if there is a container."""
    return F.when(F.coalesce(configured, F.lit("")) != "", configured).when(F.coalesce(state, F.lit("absent")) != "absent", default)


def still_valid(age: Column, seen: Column, now: Column, seconds: float = 30.0) -> Column:
    """Whether a remembered answer holds: young enough, and its folder is as it was."""
    return (age < seconds) & seen.eqNullSafe(now)


def placeholders(glyphs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, font, code, id: unread glyphs numbered by where they are seen first. glyphs has font and code."""
    first = glyphs.groupBy(*keys, "font", "code").agg(F.min(order).alias("__at"))
    return first.withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy("__at", "font", "code")) - 1).drop("__at")


def opening_headings(lines: DataFrame, keys: list[str], least: int = 40) -> DataFrame:
    """keys, page, title: pages that open with a heading and say enough. lines has page, pos, text, running, heading."""
    seen = lines.where(~F.col("running")).groupBy(*keys, "page").agg(F.min(F.struct("pos", "text", "heading")).alias("f"), F.sum(F.length("text")).alias("n"))
    return seen.where(F.col("f.heading") & (F.col("n") >= least)).select(*keys, "page", F.col("f.text").alias("title"))


def cover_source(path: Column) -> Column:
    """How a book's cover is got: an image is copied, a PDF gives its first page, an e-book is searched; else null."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin("png", "jpg", "jpeg", "webp"), "copy").when(suffix == "pdf", "first page").when(suffix == "epub", "archive")


PROJECT = "title string, backend string, voice string, speed double, voices map<string,string>, dialogue_voice string"


def projects(saves: DataFrame) -> DataFrame:
    """name and settings of every project, as saved last. saves (name, version, config) is only ever appended to.

    A save is a new version, so nothing is updated. What isn't a project's JSON is left out; a missing speed is 1, and the
    only second voice of old projects becomes the dialogues'.
    """
    last = saves.groupBy("name").agg(F.max_by("config", "version").alias("config"))
    read = last.select("name", F.from_json("config", PROJECT).alias("p")).where("p.title is not null")
    return read.select("name", "p.title", "p.backend", "p.voice", F.coalesce("p.speed", F.lit(1.0)).alias("speed"), migrated_voices(F.col("p.voices"), F.col("p.dialogue_voice")).alias("voices"))


def saved(saves: DataFrame, changed: DataFrame) -> DataFrame:
    """The rows to append to saves so that changed (name, config) is what they say: those that differ from the last save."""
    last = saves.groupBy(F.col("name").alias("__n")).agg(F.max("version").alias("__v"), F.max_by("config", "version").alias("__c"))
    both = changed.join(last, F.col("name") == F.col("__n"), "left").where(~F.col("config").eqNullSafe(F.col("__c")))
    return both.select("name", (F.coalesce("__v", F.lit(0)) + 1).alias("version"), "config")


def unknown_by_language(words: DataFrame, lexicons: DataFrame) -> DataFrame:
    """words (lang, form) that the lexicon of their own language (lang, form) doesn't have."""
    return words.join(lexicons.select("lang", "form").distinct(), ["lang", "form"], "left_anti")


def speakers(listed: Column) -> Column:
    """A service's list of voices as names: trimmed, without empty ones, each once, by name, case aside."""
    names = F.array_distinct(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))
    return F.transform(F.array_sort(F.transform(names, lambda x: F.struct(F.lower(x).alias("k"), x.alias("x")))), lambda s: s["x"])
