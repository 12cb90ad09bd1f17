"""Proofreading from texts to a report: suspects, gate, context, model, guards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored
from ..sources.services import Model, asked
from . import review
from .library import allowed_words
from .shelf import report_json


def known_parts(proposals: DataFrame, allowed: DataFrame) -> DataFrame:
    """proposal, known: whether all forms of a proposal, two letters or longer, are allowed (form)."""
    each = proposals.select("proposal").where("proposal is not null").distinct()
    forms = each.select("proposal", F.explode(T.candidates(F.col("proposal"))).alias("form")).where(F.length("form") >= 2)
    unknown = forms.join(allowed.select("form"), "form", "left_anti").select(F.col("proposal").alias("u")).distinct()
    return each.join(unknown, F.col("proposal") == F.col("u"), "left").select("proposal", F.col("u").isNull().alias("known"))


def proofread(texts: DataFrame, lexicon: DataFrame, make: Callable[[], Model], vocabulary: DataFrame | None = None, key: str = "doc_id", limit: int = review.RECURRENCE_LIMIT, size: int = 12) -> DataFrame:
    """key, offset, word, reason, recurrence, context, proposal, replacement, cause of every suspect of texts (key, text).

    Suspects whose form comes up `limit` times or more aren't asked about: proposal, replacement and cause are null. Others
    go to the model with what stands around them, `size` at a time; the guards keep a replacement or say why not. Allowed
    are the vocabulary, the lexicon (form) and the texts' own words, without what is under suspicion. What several steps read
    (counts, verdicts, suspects, replies) is computed once, so texts are cut into words once, and the model is asked once.
    """
    toks = review.tokens(texts, key)
    frequency = stored(review.word_frequency(review.words(texts, key)), "frequency")
    lexicon = stored(lexicon.select("form"), "lexicon")
    judged = stored(review.judged_words(frequency, lexicon, review.proper_nouns(frequency)), "judged")
    found = review.suspects(toks, judged.select("word", F.struct("reason", "n").alias("reason"))).select(key, "offset", "word", "reason.reason", F.col("reason.n").alias("recurrence"))
    found = stored(found, "found")
    pending = found.where(F.col("recurrence") < limit).join(texts.select(F.col(key).alias("__k"), F.col("text").alias("__t")), F.col(key) == F.col("__k"))
    around = pending.withColumn("context", review.context(F.col("__t"), F.col("offset"), F.col("word"))).drop("__k", "__t")
    replies = stored(asked(around, make, size), "replies")
    own = frequency.select(F.lower("word").alias("form")).union(lexicon.select("form"))
    allowed = allowed_words(vocabulary if vocabulary is not None else lexicon.limit(0), own, judged.select(F.lower("word").alias("form")))
    known = known_parts(replies, allowed)
    judged_replies = (
        replies.join(known.withColumnRenamed("proposal", "__p"), F.col("proposal") == F.col("__p"), "left")
        .withColumn("g", review.guard(F.col("word"), F.col("proposal"), F.coalesce("known", F.lit(False))))
        .select(key, "offset", "word", "reason", "recurrence", "context", "proposal", "g.replacement", "g.cause")
    )
    empty = [F.lit(None).cast("string").alias(c) for c in ("context", "proposal", "replacement", "cause")]
    return judged_replies.unionByName(found.where(F.col("recurrence") >= limit).select(key, "offset", "word", "reason", "recurrence", *empty))


def reports(proofs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, report: a JSON report for each text that has suspects."""
    asked_for = F.col("cause").isNotNull()
    suggestion = F.struct("offset", "word", "replacement", "reason", "recurrence", "context")
    kept = F.array_sort(F.collect_list(F.when(F.col("replacement") != "", suggestion)))
    refused = F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(F.col("cause") != "", F.lit(False)), F.struct("offset", "word", "proposal", "cause")))), lambda x: F.struct(x["word"], x["proposal"], x["cause"]))
    skipped = F.array_sort(F.collect_set(F.when(~asked_for, F.col("word"))))
    return proofs.groupBy(key).agg(report_json(kept, refused, F.count("*"), F.count_if(asked_for), skipped, F.lit("")).alias("report"))


def applied(texts: DataFrame, proofs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text, n_edits: texts with the replacements that the guards kept."""
    edits = proofs.where("replacement <> ''").groupBy(F.col(key).alias("__k")).agg(F.collect_list(F.struct(F.col("offset").cast("int").alias("offset"), "word", "replacement")).alias("edits"))
    none = F.array().cast("array<struct<offset:int,word:string,replacement:string>>")
    both = texts.join(edits, F.col(key) == F.col("__k"), "left").withColumn("edits", F.coalesce("edits", none))
    return both.select(key, T.apply_substitutions(F.col("text"), F.col("edits")).alias("text"), F.size("edits").cast("long").alias("n_edits"))
