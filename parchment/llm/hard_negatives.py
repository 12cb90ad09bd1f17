"""Hard-negative mining: dense products of anchor blocks with candidate blocks.

Anchors are dealt into blocks of a bounded size. A block is broadcast, every task
multiplies it with its own candidates, a chunk at a time, and keeps the few best of
each anchor; what tasks kept is merged by a ranked window. The first pass finds each anchor's positives, the second the
negatives inside the window that each positive's score opens.

Products are taken in float64, which is exact while the norms' product is below
2^53; chunks beyond that are multiplied with Python's whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_batches
from .vectors import matrix, scaled, whole

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
ANCHOR_BYTES = 32 << 20  # of the float64 matrix of a block, which is what is broadcast
CELLS = 1 << 20  # scores held at once
EXACT = 2.0**53
_LONG = 2**63 - 1

KEPT = "slot long, n long, label long, vec_id long, score decimal(38,0)"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers: float64 where that is exact, else Python's integers."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    most = np.sqrt((x * x).sum(1).max(initial=0)) * np.sqrt((y * y).sum(1).max(initial=0))
    return x @ y.T if most * (1 + 1e-9) < EXACT else a.astype(object) @ b.astype(object).T


class Best:
    """The `most` best candidates of each slot, by falling score, then vec_id; a vec_id counts once a slot."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.slot, self.ids, self.labels = (np.zeros(0, np.int64) for _ in range(3))
        self.scores: np.ndarray = np.zeros(0)
        self.least = np.full(slots, -np.inf)  # what a candidate has to reach

    def add(self, slot: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        if not len(slot):
            return
        if scores.dtype == object or self.scores.dtype == object:
            scores, self.scores = scores.astype(object), self.scores.astype(object)
        slot, scores, ids, labels = (np.concatenate(x) for x in ((self.slot, slot), (self.scores, scores), (self.ids, ids), (self.labels, labels)))
        order = np.lexsort((ids, -scores, slot))
        slot, scores, ids, labels = slot[order], scores[order], ids[order], labels[order]
        again = np.zeros(len(slot), bool)
        if len(slot) > 1:
            by = np.lexsort((np.arange(len(slot)), ids, slot))  # the best row of a vec_id comes first
            again[by[1:]] = (slot[by][1:] == slot[by][:-1]) & (ids[by][1:] == ids[by][:-1])
        slot, scores, ids, labels = slot[~again], scores[~again], ids[~again], labels[~again]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        full = rank == self.most - 1
        self.least[slot[full]] = scores[full].astype(float)
        keep = rank < self.most
        self.slot, self.scores, self.ids, self.labels = slot[keep], scores[keep], ids[keep], labels[keep]

    def batch(self, n: np.ndarray, sub: np.ndarray) -> pa.RecordBatch:
        scores = pa.array([int(s) for s in self.scores], pa.decimal128(38, 0))
        return pa.RecordBatch.from_arrays(
            [pa.array(n[self.slot]), pa.array(sub[self.slot]), pa.array(self.labels), pa.array(self.ids), scores], names=["slot", "n", "label", "vec_id", "score"]
        )


def _chunks(batch: pa.RecordBatch, width: int, anchors: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    step = max(1, CELLS // max(1, anchors))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield matrix(part.column("x"), width), part.column("vec_id").to_numpy(), part.column("label").to_numpy()


def _positives(block, width: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, ids, labels, x = block.value
        best = Best(len(ids), most)
        for b in batches:
            for y, own, own_labels in _chunks(b, width, len(ids)):
                s = products(x, y)
                wanted = (labels[:, None] == own_labels) & (ids[:, None] != own) & (s >= best.least[:, None])
                i, j = np.nonzero(wanted)
                best.add(i, s[i, j], own[j], own_labels[j])
        yield best.batch(slot, np.zeros(len(slot), np.int64))

    return run


def window(score: int) -> tuple[int, int]:
    """Least and largest negative score for a positive's: 50 % to 95 % of it, in whole numbers."""
    return -(-LOW * score // 100), HIGH * score // 100


def _negatives(block, width: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, ids, labels, x, owner, place, score = block.value  # owner: a positive's anchor by its place in ids
        best = Best(len(owner), most)
        bounds = np.array([window(s) for s in score], object).reshape(-1, 2)
        low, high = (np.clip(bounds[:, k].astype(float), -EXACT, EXACT) for k in (0, 1))
        turns = [np.flatnonzero(place == p) for p in np.unique(place)]
        for b in batches:
            for y, own, own_labels in _chunks(b, width, len(ids)):
                s = products(x, y)
                unlike = labels[:, None] != own_labels
                for turn in turns:  # at most one positive of an anchor
                    at = owner[turn]
                    t = s[at]
                    if s.dtype == object:
                        fits = unlike[at] & (t >= bounds[turn, :1]) & (t <= bounds[turn, 1:])
                    else:
                        fits = (t >= np.maximum(low[turn], best.least[turn])[:, None]) & (t <= high[turn][:, None])
                        fits &= unlike[at]
                    i, j = np.nonzero(fits)
                    best.add(turn[i], t[i, j], own[j], own_labels[j])
        yield best.batch(slot[owner], place)

    return run


def ranked(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first rows of each group as `rank` from 1, a vec_id once (its best score)."""
    own = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    once = df.repartition(*by).groupBy(*by, "vec_id").agg(F.max("score").alias("score"))  # tasks keep `most` rows a slot, so one exchange serves both
    return once.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most)


def prepared(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, x of the rows that take part; x holds longs."""
    label = F.col("label").cast("long")
    turned = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return whole(df.where("label is not null and vec_id is not null"), vector).select(F.col("vec_id").cast("long"), turned.alias("label"), scaled(vector, SCALE).alias("x"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _as_long(score: str) -> Column:
    return F.greatest(F.lit(-_LONG), F.least(F.lit(_LONG), F.col(score))).cast("long")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, label, x) and a condition for anchors.

    Anchors are told by (vec_id, label, x); repeated ones are one. The driver holds one block of anchors at a time.
    """
    spark = vectors.sparkSession
    text_batches(spark)
    chosen = vectors.where(is_anchor).distinct()
    row = vectors.agg(F.max(F.size("x")).alias("width")).first()
    size = chosen.agg(F.count("*").alias("n")).first().n
    width = row.width or 0
    blocks = max(1, -(-size * max(1, width) * 8 // anchor_bytes))
    anchors = materialize(
        chosen.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(blocks))).repartition("block"), "anchors"
    )
    out = []
    for k in range(blocks):
        rows = anchors.where(F.col("block") == k).select("vec_id", "label", "x").toArrow().sort_by([("vec_id", "ascending"), ("label", "ascending")])
        if not rows.num_rows:
            continue
        ids, labels, x = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["x"], width)
        slot = np.arange(len(ids))
        held = spark.sparkContext.broadcast((slot, ids, labels, x))
        found = materialize(ranked(vectors.mapInArrow(_positives(held, width, positives), KEPT), ["slot"], positives), "positives")
        own = found.select("slot", "rank", "vec_id", F.col("score").cast("string").alias("score")).toArrow().sort_by([("slot", "ascending"), ("rank", "ascending")])
        held.unpersist()
        if not own.num_rows:
            continue
        scores = [int(s) for s in own["score"].to_pylist()]
        held = spark.sparkContext.broadcast((slot, ids, labels, x, own["slot"].to_numpy(), own["rank"].to_numpy().astype(np.int64), scores))
        last = ranked(vectors.mapInArrow(_negatives(held, width, negatives), KEPT), ["slot", "n"], negatives)
        names = spark.createDataFrame(pa.table({"slot": slot, "anchor_id": ids}))
        pairs = found.select("slot", F.col("rank").cast("long").alias("n"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive"))
        out.append(
            materialize(
                last.join(F.broadcast(pairs), ["slot", "n"]).join(F.broadcast(names), "slot").select(
                    "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    _as_long("positive").alias("positive_score"), _as_long("score").alias("negative_score"),
                ),
                "negatives",
            )
        )
        held.unpersist()
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return _all(out)


def hard_negatives(df: DataFrame, vector: str = "embedding", every: int = 50) -> DataFrame:
    """Negatives of the first positives of every anchor (vec_id divisible by `every`), over all rows.

    Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite entry, take no part; shorter vectors
    are filled up with zeros, empty ones score 0 with all; entries are clamped at 2^53, scores beyond a long at its ends; of
    rows that share a vec_id the best-scored counts, once, and never for an anchor of that vec_id; anchors that
    share a vec_id but differ each have their rows; a positive or anchor without a fitting negative has no row; an empty
    table gives none; other columns are not read.
    """
    return mine(prepared(df, vector), F.col("vec_id") % every == 0)
