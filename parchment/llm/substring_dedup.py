"""Substring dedup with compressed FM-indexes, one for each shard.

Every window of `threshold` words picks an anchor, the least of its hashed
word runs. Equal windows pick equal anchors, so windows can only repeat where
anchors do. The windows of a place that pick one anchor form a segment.

Equal segments are one before any search: a document that isn't the first with
a segment loses all its windows at once. Only where an anchor has several
different segments are words fetched and dealt by anchor to shards. A shard
builds an FM-index of its segments and streams them through it: backward search
over the wavelet matrix gives matching statistics, and places that match at
least `threshold` words of a smaller document are reported, at every place where
the first document has the segment.

An anchor with more than SEGMENTS_MOST different segments doesn't go to a shard.
Its windows take another exact way, two 64-bit hashes with pre-aggregated minima.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_batches
from .fm_index import FMIndex

THRESHOLD = 50
RUN = 10  # words of a hashed run
SEGMENTS_MOST = 2000  # different segments of an anchor in a shard
SHARD_WORDS = 300_000
NO_ID = (1 << 63) - 1  # stands for a null doc_id: after all others

_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BACK = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASE)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Hashed:
    """Hashes of any word range of a text, from prefix sums modulo 2**64."""

    def __init__(self, words: list[bytes]):
        from xxhash import xxh64_intdigest

        h = np.array([xxh64_intdigest(w) for w in words], dtype=np.uint64)
        n = len(words)
        self.sums, self.back = [], []
        for base, back in zip(_BASE, _BACK):
            power = np.full(n, base)
            power[:1] = 1
            np.multiply.accumulate(power, out=power)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(h * power, out=total[1:])
            inverse = np.full(n, back)
            inverse[:1] = 1
            self.sums.append(total)
            self.back.append(np.multiply.accumulate(inverse))

    def of(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        x = (self.sums[which][b] - self.sums[which][a]) * self.back[which][a]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def segments(words: list[bytes], threshold: int = THRESHOLD, run: int = RUN):
    """For each anchor of a text: its hash, where it stands in its segment, the segment's first window, windows, hash."""
    hashed = Hashed(words)
    at = np.arange(len(words) - run + 1)
    runs = hashed.of(at, at + run)
    wide = threshold - run + 1
    low = np.lib.stride_tricks.sliding_window_view(runs, wide).argmin(axis=1) + np.arange(len(words) - threshold + 1)
    anchors, first, count = np.unique(low, return_index=True, return_counts=True)
    return runs[anchors].view(np.int64), anchors - first, first, count, hashed.of(first, first + count + threshold - 1, 1).view(np.int64)


def _occurrences(threshold: int):
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for d, th, text in zip(b["d"], b["th"], b["text"]):
                words = words_of(text)
                if len(words) >= threshold:
                    a, off, lo, n, sh = segments(words, threshold)
                    out.append((np.full(len(a), d), np.full(len(a), th), lo, n, off, a, sh))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 7
            yield pd.DataFrame(dict(zip(("d", "th", "lo", "n", "off", "a", "sh"), columns)))

    return found


def _fetch(threshold: int):
    """Words of the wanted segments; for crowded anchors hashes of single windows."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, th, text, wanted in zip(b["d"], b["th"], b["text"], b["wanted"]):
                words = words_of(text)
                hashed = None
                for w in wanted:
                    lo, n = w["lo"], w["n"]
                    if not w["crowded"]:
                        rows.append((w["shard"], d, th, lo, 0, b" ".join(words[lo : lo + n + threshold - 1]), None, None))
                        continue
                    hashed = hashed or Hashed(words)
                    at = np.arange(lo, lo + n)
                    one, two = (hashed.of(at, at + threshold, k).view(np.int64) for k in (0, 1))
                    rows += [(None, d, th, lo, int(p) - lo, None, int(x), int(y)) for p, x, y in zip(at, one, two)]
            columns = list(zip(*rows)) or [()] * 8
            kinds = ("Int64", "int64", "int64", "int64", "int64", object, "Int64", "Int64")  # a column of None and numbers would turn to floats
            names = ("shard", "d", "th", "lo", "at", "words", "w1", "w2")
            yield pd.DataFrame({n: pd.array(list(c), dtype=k) if k == "Int64" else pd.Series(list(c), dtype=k) for n, c, k in zip(names, columns, kinds)})

    return found


def _search(threshold: int):
    """A shard's repeated windows, from its FM-index: window `at` of the segment from lo on."""

    def found(b: pd.DataFrame) -> pd.DataFrame:
        words = [w.split(b" ") for w in b["words"]]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols, known = pd.factorize(np.array([x for w in words for x in w], dtype=object))
        symbols, docs = symbols.astype(np.int64), b["d"].to_numpy()
        index = FMIndex(symbols, lengths, docs, len(known), threshold)
        text, place = index.stream(symbols, lengths, docs)
        own = b.iloc[text]
        return pd.DataFrame({"d": own["d"].to_numpy(), "th": own["th"].to_numpy(), "lo": own["lo"].to_numpy(), "at": place})

    return found


def repeated_windows(docs: DataFrame, threshold: int = THRESHOLD, most: int = SEGMENTS_MOST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """d, th, lo, n: n windows from word lo on, of the text with hash th in document d, that also start in a smaller document.

    docs has d, th and text.
    """
    occurrences = materialize(docs.mapInPandas(_occurrences(threshold), "d long, th long, lo int, n int, off int, a long, sh long"), "substring-anchors")
    # all different segments, each with the first document that has it
    distinct = materialize(
        occurrences.groupBy("a", "sh", "n", "off").agg(F.min(F.struct("d", "th", "lo")).alias("first"), F.count("*").alias("times")),
        "substring-segments",
    )
    copied = distinct.where("times > 1").select(
        F.col("a").alias("c_a"), F.col("sh").alias("c_sh"), F.col("n").alias("c_n"), F.col("off").alias("c_off"), F.col("first.d").alias("c_d"),
        F.col("first.th").alias("c_th"), F.col("first.lo").alias("c_lo"),
    )
    # other places of a segment than its first; those in the first document itself name that place, whose hits are theirs too
    inside = F.col("d") == F.col("c_d")
    again = materialize(
        occurrences.join(
            copied, (F.col("a") == F.col("c_a")) & (F.col("sh") == F.col("c_sh")) & (F.col("n") == F.col("c_n")) & (F.col("off") == F.col("c_off"))
        )
        .where((F.col("d") > F.col("c_d")) | (F.col("th") != F.col("c_th")) | (F.col("lo") != F.col("c_lo")))
        .select("d", "th", "lo", "n", F.when(inside, F.col("c_th")).alias("c_th"), F.when(inside, F.col("c_lo")).alias("c_lo")),
        "substring-again",
    )
    whole = again.where("c_lo is null").select("d", "th", "lo", "n")
    own = again.where("c_lo is not null").select(F.col("d").alias("o_d"), F.col("th").alias("o_th"), F.col("lo").alias("o_lo"), "c_th", "c_lo")

    several = materialize(
        distinct.groupBy(F.col("a").alias("s_a")).agg(F.count("*").alias("s_n"), F.sum(F.col("n") + threshold - 1).alias("s_words")).where("s_n > 1"),
        "substring-shared",
    )
    total = several.where(F.col("s_n") <= most).agg(F.sum("s_words")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_words))
    wanted = (
        distinct.join(several, F.col("a") == F.col("s_a"))
        .select(
            F.col("first.d").alias("w_d"), F.col("first.th").alias("w_th"),
            F.struct(F.col("first.lo").alias("lo"), "n", (F.col("s_n") > most).alias("crowded"), F.pmod(F.xxhash64("a"), F.lit(shards)).alias("shard")).alias("w"),
        )
        .groupBy("w_d", "w_th").agg(F.collect_list("w").alias("wanted"))  # segments of one text
    )
    fetched = materialize(
        docs.join(wanted, (F.col("d") == F.col("w_d")) & (F.col("th") == F.col("w_th")))
        .select("d", "th", "text", "wanted")
        .mapInPandas(_fetch(threshold), "shard long, d long, th long, lo int, at int, words binary, w1 long, w2 long"),
        "substring-fetched",
    )
    searched = fetched.where("words is not null").groupBy("shard").applyInPandas(_search(threshold), "d long, th long, lo int, at int")
    windows = fetched.where("words is null")
    least = windows.groupBy(F.col("w1").alias("l1"), F.col("w2").alias("l2")).agg(F.min("d").alias("l_d"), F.count("*").alias("times")).where("times > 1")
    single = windows.join(least, (F.col("w1") == F.col("l1")) & (F.col("w2") == F.col("l2"))).where("d > l_d").select("d", "th", "lo", "at")
    hits = materialize(searched.unionByName(single), "substring-hits")
    first = hits.select("d", "th", (F.col("lo") + F.col("at")).alias("lo"), F.lit(1).alias("n"))
    others = hits.join(own, (F.col("d") == F.col("o_d")) & (F.col("th") == F.col("c_th")) & (F.col("lo") == F.col("c_lo"))).select(
        "d", F.col("o_th").alias("th"), (F.col("o_lo") + F.col("at")).alias("lo"), F.lit(1).alias("n")
    )
    return whole.unionByName(first).unionByName(others)


def keep(text: str | None, ranges, threshold: int = THRESHOLD) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = words_of(text)
    if ranges is None or not len(ranges):
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for r in ranges:
        edge[r["lo"]] += 1
        edge[r["lo"] + r["n"] + threshold - 1] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone) if not g], len(words)


def _with_ranges(docs: DataFrame, threshold: int, most: int, shard_words: int) -> DataFrame:
    keyed = docs.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("th", F.xxhash64("text"))
    found = repeated_windows(keyed.select("d", "th", "text"), threshold, most, shard_words)
    ranges = found.groupBy(F.col("d").alias("r_d"), F.col("th").alias("r_th")).agg(F.collect_set(F.struct("lo", "n")).alias("ranges"))
    return keyed.join(ranges, (F.col("d") == F.col("r_d")) & (F.col("th") == F.col("r_th")), "left")


SCHEMA = "n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, most: int = SEGMENTS_MOST, shard_words: int = SHARD_WORDS, with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, with_text, kept.

    Defined cases: null, empty and short texts lose nothing (the hash of an
    empty rest is that of the empty string); rows with one doc_id are one
    document and take nothing from each other; a null doc_id comes after all
    others; windows that repeat inside one document stay; an empty table gives
    no rows; columns beyond doc_id and text are not read. Windows are judged on
    the input, not on what is left.
    """

    @F.pandas_udf(SCHEMA)
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        rows = []
        for text, r in zip(texts, ranges):
            left, n = keep(text, r, threshold)
            rest = b" ".join(left)
            rows.append((n, n - len(left), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "surrogatepass") if with_text else None))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    text_batches(docs.sparkSession)
    out = _with_ranges(docs, threshold, most, shard_words).select("doc_id", cut("text", "ranges").alias("r")).select("doc_id", "r.*")
    return out if with_text else out.drop("kept")
