"""Review of texts: tokens with offsets, suspects against a lexicon, guards on proposals, outcome of a bench."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions import text as T
from ..session import BATCH_BYTES, checkpointed

# Limits of the guards.
MAX_DISTANCE, MAX_WORDS, RECURRENCE_LIMIT, CONTEXT = 3, 2, 4, 45
FORBIDDEN = r"""[.,;:!?…()\[\]{}«»“”"/\\<>=+*_#@&%$€0-9]"""


_WORD = re.compile(T.WORD)


def placed(texts: pa.Array, pattern: re.Pattern, step: int = 64) -> pa.Array:
    """offset, word of all matches in each text; a few texts at a time become Arrow arrays, so no batch of them stands as Python objects."""
    parts = []
    for at in range(0, max(1, len(texts)), step):
        ends, starts, found = [0], [], []
        for t in texts.slice(at, step).to_pylist():
            for m in pattern.finditer(t or ""):
                starts.append(m.start())
                found.append(m.group())
            ends.append(len(starts))
        each = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(found, pa.string())], names=["offset", "word"])
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each))
    return pa.concat_arrays(parts)


@F.arrow_udf(ArrayType(StructType([StructField("offset", LongType()), StructField("word", StringType())])))
def word_places(texts: pa.Array) -> pa.Array:
    return placed(texts, _WORD)


def tokens(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, offset (from 0), word of every word of a text; a text has its places in one go, so nothing is sorted or summed up.

    Spark has no function that says where matches stand. Summing lengths of pieces by a window moves and sorts all pieces,
    and higher-order functions that sum inside the row take 2.4 times as long as this Arrow function (3.3 s to 1.35 s, sf0.1).
    """
    return df.select(key, F.explode(word_places(text)).alias("t")).select(key, "t.offset", "t.word")


def words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word of every word, where nothing asks for places."""
    return df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(T.WORD), F.lit(0))).alias("word"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŒ"


def document_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    """form, d: in how many texts a lower-case word stands. Repeats go inside each text, so rows are counted, not pairs told apart."""
    low = F.translate(F.col(text), UPPER, UPPER.lower())
    return df.select(F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(T.WORD), F.lit(0)))).alias("form")).groupBy("form").agg(F.count("*").alias("d"))


def word_frequency(toks: DataFrame) -> DataFrame:
    return toks.groupBy("word").agg(F.count("*").alias("n"))


def proper_nouns(frequency: DataFrame, least: int = 2) -> DataFrame:
    """Lower-case forms of capitalised words that come up often enough."""
    first = F.substring("word", 1, 1)
    return frequency.where((F.col("n") >= least) & (first == F.upper(first)) & (first != F.lower(first))).select(F.lower("word").alias("form")).distinct()


def judged_words(frequency: DataFrame, lexicon: DataFrame, proper: DataFrame) -> DataFrame:
    """word, reason, n of suspicious words, each judged once.

    frequency has word and n; lexicon and proper have `form`. Patterns of misread text come
    first; else a word is suspicious if any of its forms, two letters or longer, is unknown.
    """
    # asking for n as well keeps the patterns above the count: they see each word once, not each of its places
    marked = frequency.withColumn("reason", F.when(F.col("n") > 0, T.ocr_reason(F.col("word"))))
    forms = (
        marked.where("reason is null").join(proper.select(F.col("form").alias("p")), F.lower("word") == F.col("p"), "left_anti")
        .select("word", "n", F.explode(T.candidates(F.col("word"))).alias("form")).where(F.length("form") >= 2)
    )
    unknown = forms.join(lexicon.select("form").union(proper).distinct(), "form", "left_anti").select("word", "n").distinct()
    return marked.where("reason is not null").select("word", "reason", "n").unionByName(unknown.select("word", F.lit("not in the lexicon").alias("reason"), "n"))


def suspects(toks: DataFrame, judged: DataFrame) -> DataFrame:
    """toks (with word) that are suspicious, and why."""
    return _at_places(toks, judged.select(F.col("word").alias("w"), "reason"))


#: Words that may be broadcast, of WORD_CHARS characters in the mean.
BROADCAST_WORDS, WORD_CHARS = 300_000, 16


def _at_places(toks: DataFrame, found: DataFrame) -> DataFrame:
    """toks whose word is `w` of found. The words are judged and counted first: while they are few they are broadcast and no place moves.

    Beyond that places are exchanged; sizes of exploded texts are guessed far too low, so a merge is asked for.
    """
    known = checkpointed(found)
    size = known.agg(F.count("*").alias("n"), F.sum(F.length("w")).alias("chars")).first()
    few = size.n <= BROADCAST_WORDS and (size.chars or 0) <= BROADCAST_WORDS * WORD_CHARS
    return toks.join(F.broadcast(known) if few else known.hint("merge"), F.col("word") == F.col("w")).drop("w")


def recurrence_gate(toks: DataFrame, judged: DataFrame, limit: int = RECURRENCE_LIMIT) -> DataFrame:
    """Suspects whose exact form comes up less often than `limit`. The gate closes on words, before any place is looked up."""
    rare = judged.where(F.col("n") < limit).select(F.col("word").alias("w"), "reason", F.col("n").alias("recurrence"))
    return _at_places(toks, rare)


def context(text: Column, offset: Column, word: Column, around: int = CONTEXT) -> Column:
    """The word with what stands around it, line ends as spaces."""
    start = F.greatest(F.lit(0), offset - around)
    return F.replace(F.substring(text, start + 1, offset + F.length(word) + around - start), F.lit("\n"), F.lit(" "))


def guard(word: Column, proposal: Column, parts_known: Column) -> Column:
    """struct<replacement, cause>: the first rule that a proposal breaks; both empty where there's nothing to change."""
    asked = F.trim(proposal)
    asked = F.when(word.contains("’"), F.replace(asked, F.lit("'"), F.lit("’"))).otherwise(asked)
    limit = F.least(F.lit(MAX_DISTANCE), F.greatest(F.lit(1), F.floor(F.length(word) / 2))).cast("int")
    gap = F.levenshtein(F.lower(word), F.lower(asked))
    first, new = F.substring(word, 1, 1), F.substring(asked, 1, 1)
    lost = (first == F.upper(first)) & (first != F.lower(first)) & (new == F.lower(new)) & (new != F.upper(new))
    cause = (
        F.when(asked.isNull() | (asked == "") | (asked == word), "")
        .when(asked.rlike(FORBIDDEN), "punctuation brought in")
        .when(T.word_count(asked) > MAX_WORDS, F.concat(T.word_count(asked).cast("string"), F.lit(" words")))
        .when(gap > limit, F.concat_ws(" > ", gap.cast("string"), limit.cast("string")))
        .when(lost, "capital lost")
        .when(~parts_known, "not in the lexicon")
        .otherwise("")
    )
    good = (cause == "") & asked.isNotNull() & (asked != word)
    return F.struct(F.when(good, asked).otherwise("").alias("replacement"), cause.alias("cause"))


def outcome(suggestions: DataFrame, truth: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row: fixed, inexact, undue, missed_flagged, missed_unflagged, corrections, precision, recall.

    suggestions: chapter, offset, replacement; truth: chapter, offset, expected; flagged: chapter, offset.
    """
    key = ["chapter", "offset"]
    judged = suggestions.join(truth, key, "left").select(
        F.when(F.col("expected").isNull(), "undue").when(F.col("expected") == F.col("replacement"), "fixed").otherwise("inexact").alias("kind")
    )
    missed = truth.join(suggestions, key, "left_anti").join(flagged.select(*key).distinct().withColumn("seen", F.lit(True)), key, "left")
    kinds = judged.unionByName(missed.select(F.when(F.col("seen"), "missed_flagged").otherwise("missed_unflagged").alias("kind")))
    count = lambda k: F.count_if(F.col("kind") == k)
    names = ("fixed", "inexact", "undue", "missed_flagged", "missed_unflagged")
    sums = kinds.agg(*[count(k).alias(k) for k in names], truth_rows(F).alias("corrections"))
    given = F.col("fixed") + F.col("inexact") + F.col("undue")
    return sums.withColumn("precision", F.coalesce(F.try_divide("fixed", given), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("fixed", "corrections"), F.lit(0.0)))


def truth_rows(f) -> Column:
    """Corrections are what was fixed or inexact on a real place, or missed."""
    return f.count_if(f.col("kind") != "undue")


TOKEN = r"[A-Za-zÀ-ÿœŒæÆ0-9'’-]+"  # fixed value: a word of the comparison
_TOKEN = re.compile(TOKEN)


class Read(NamedTuple):
    """A text's tokens: where they stand, as they stand and in small letters; the places of those that stand once, in order."""

    offsets: list[int]
    words: list[str]
    lows: list[str]
    once: dict[str, int]


def _read(text: str | None) -> Read:
    found = [(m.start(), m.group()) for m in _TOKEN.finditer(text or "")]
    lows = [w.lower() for _, w in found]
    places: dict[str, int] = {}
    for at, low in enumerate(lows):
        places[low] = -1 if low in places else at
    return Read([o for o, _ in found], [w for _, w in found], lows, {low: at for low, at in places.items() if at >= 0})


def _anchors(raw: Read, clean: Read) -> list[tuple[int, int]]:
    """Places of words that either text has once, without those that any other anchor crosses."""
    met = [(i, clean.once[low]) for low, i in raw.once.items() if low in clean.once]
    after = [len(clean.words)]
    for _, j in reversed(met):
        after.append(min(after[-1], j))
    found, before = [], -1
    for (i, j), least in zip(met, after[-2::-1]):
        if before < j < least:
            found.append((i, j))
        before = max(before, j)
    return found


def corrections(raw: Read, clean: Read) -> Iterator[tuple[str, list[tuple[int, str, str | None]]]]:
    """whole, [(offset, word, expected)] from anchor to anchor: what turns raw into clean; where expected is None, it is whole."""
    anchors = _anchors(raw, clean)
    for (i, j), (i_end, j_end) in zip([(0, 0), *anchors], [*anchors, (len(raw.words), len(clean.words))]):
        x, y = raw.lows[i:i_end], clean.lows[j:j_end]
        n, m, least = len(x), len(y), min(len(x), len(y))
        pre = next((k for k in range(least) if x[k] != y[k]), least)
        suf = next((k for k in range(least - pre) if x[n - 1 - k] != y[m - 1 - k]), least - pre)
        whole = " ".join(clean.words[j + pre : j_end - suf]) if n != m else ""
        found = []
        for k in range(n):
            at = k if k < pre or n == m else m - n + k if k >= n - suf else None
            expected = None if at is None else clean.words[j + at]
            if raw.words[i + k] != (whole if expected is None else expected):
                found.append((raw.offsets[i + k], raw.words[i + k], expected))
        if found:
            yield whole, found


_FOUND = StructType([StructField("offset", LongType()), StructField("word", StringType()), StructField("expected", StringType())])


def _told(found: Iterator[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (id, whole, found) in pieces, so that a batch's aren't held at once."""
    each = pa.list_(pa.struct([("offset", pa.int64()), ("word", pa.string()), ("expected", pa.string())]))
    schema = pa.schema([("id", kind), ("whole", pa.string()), ("found", each)])
    told = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    rows: list[tuple] = []
    size = 0
    for row in found:
        rows.append(row)
        size += len(row[1]) + 64 * len(row[2])
        if size >= BATCH_BYTES // 4:
            yield told(rows)
            rows, size = [], 0
    if rows:
        yield told(rows)


def _aligned(df: DataFrame, run) -> DataFrame:
    """id, offset, word, expected. Many words may be to become one long stretch: it comes out of Python once and is given to each word after that."""
    told = df.mapInArrow(run, StructType([df.schema["id"], StructField("whole", StringType()), StructField("found", ArrayType(_FOUND))]))
    return told.select("id", "whole", F.explode("found").alias("f")).select("id", "f.offset", "f.word", F.coalesce("f.expected", "whole").alias("expected"))


def alignment_truth(pairs: DataFrame) -> DataFrame:
    """id, offset, word, expected: what turns `raw` into `clean`, for pairs of texts (id, raw, clean).

    Words that stand once in either text, in the same order, are anchors. Between anchors, tokens that agree from either end
    are matched (but for case); of what is left as many tokens are matched one by one, else all are to be what clean has there.
    A pair is aligned where it is, so no word is exchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = zip(b.column("id"), b.column("raw"), b.column("clean"))
            yield from _told(((i.as_py(), *c) for i, r, t in each for c in corrections(_read(r.as_py()), _read(t.as_py()))), b.schema.field("id").type)

    return _aligned(pairs.select("id", "raw", "clean"), run)


#: Texts of a head that are aligned by one task at most, about; a larger head is dealt out, its first text with each part.
HEAD_TEXTS = 100


def alignment_to_first(texts: DataFrame) -> DataFrame:
    """alignment_truth of texts (id, head, raw), each against the text of the smallest id that has its head.

    Each text is exchanged once, to where the first of its head is. Heads may be whole texts, so digests stand for them.
    """
    t = texts.where("id is not null and head is not null and raw is not null").select("id", F.unhex(F.sha2("head", 256)).alias("head"), "raw")
    large = t.groupBy("head").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") > HEAD_TEXTS)
    parts = F.ceil(F.col("n") / HEAD_TEXTS).cast("int")
    part = (
        F.when(F.col("n").isNull(), F.array(F.lit(0))).when(F.col("id") == F.col("first"), F.sequence(F.lit(0), parts - 1))
        .otherwise(F.array(F.pmod(F.xxhash64("id"), parts).cast("int")))
    )
    dealt = t.join(F.broadcast(large), "head", "left").select("head", F.explode(part).alias("part"), "id", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = first = clean = read = None
        for b in batches:

            def found(b=b):
                nonlocal at, first, clean, read
                for head, part, i, raw in zip(*[b.column(c).to_pylist() for c in ("head", "part", "id", "raw")]):
                    if (head, part) != at:
                        at, first, clean, read = (head, part), i, raw, None
                    elif i != first and raw != clean:  # of equal texts nothing is to be corrected
                        read = read or _read(clean)
                        yield from ((i, *c) for c in corrections(_read(raw), read))

            yield from _told(found(), b.schema.field("id").type)

    return _aligned(dealt.repartition("head", "part").sortWithinPartitions("head", "part", "id"), run)
