"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a whole text are standardised and mapped to random Fourier
features, whose inner products approximate a Gaussian kernel. Partitions sum
their part of the normal equations, ridge regression solves the sum, and
isotonic regression on a fold of its own turns raw values into probabilities.

The fit reads at most MAX_FIT labelled documents, the first by a hash of their
id; that bound is what is broadcast. Scoring reads every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, materialize, text_batches

MAX_FIT = 20_000  # labelled rows that the classifier may learn from
FEATURES = 256
RIDGE = 1e-2
CALIBRATION_FOLD = 1  # of crc32 modulo 5; fold 0 is held out
ACCEPT = 0.3

_MARKS = [ord(c) for c in "!?.,;:|#$%&*@/\\<>{}[]()=_-+\"'~^"]
_DIGITS, _UPPER, _LOWERS = slice(0x30, 0x3A), slice(0x41, 0x5B), slice(0x61, 0x7B)


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; those of an empty one are zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * N_STATISTICS
    n, w = len(raw), len(words)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, w)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    p = bytes_[bytes_ > 0] / n
    letters = bytes_[_UPPER].sum() + bytes_[_LOWERS].sum() + bytes_[0x80:].sum()
    marks = bytes_[_MARKS]
    ends = Counter(x[-1] for x in words)
    plain_end = sum(c for b, c in ends.items() if 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 or b >= 0x80)
    top = max(counts.values())
    return [
        np.log1p(w), np.log1p(n), lengths.mean(), lengths.std(), (lengths <= 3).mean(), (lengths >= 12).mean(), (lengths == 1).mean(),
        bytes_[_UPPER].sum() / max(1, letters), bytes_[_DIGITS].sum() / n, bytes_[0x80:].sum() / n, letters / n,
        marks.sum() / n, marks.max() / n, bytes_[0x21] / w, bytes_[0x7C] / w, bytes_[[0x23, 0x24, 0x25, 0x26, 0x2A]].sum() / w,
        (bytes_[0x2E] + bytes_[0x2C]) / w, plain_end / w, len(counts) / w, top / w, sum(c for c in counts.values() if c > 1) / w,
        -(p * np.log2(p)).sum(), len(lines) / w, 1 - len(set(lines)) / len(lines), np.log1p(len(lines)),
    ]


N_STATISTICS = 25


@dataclass
class Model:
    """rate is the answer where there was nothing to learn from."""

    rate: float = 0.5
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    frequency: np.ndarray | None = None
    phase: np.ndarray | None = None
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = field(default=None)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / FEATURES) * np.cos(((x - self.mean) / self.scale).clip(-8, 8) @ self.frequency + self.phase)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.rate)
        return np.interp(self.raw(x), *self.steps).clip(0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots x and rising values y."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, first x, last x
    for a, b in zip(x[order], y[order]):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], last]
    knots, values = [], []
    for s, n, first, last in blocks:
        knots += [first, last]
        values += [s / n, s / n]
    return np.array(knots), np.array(values)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_fit: int = MAX_FIT, seed: int = 5) -> Model:
    """Learn `target` from labelled documents outside the held-out fold, max_fit of them at most."""
    text_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 0))
        .select(F.col("doc_id").alias("l_id"), F.col(target).cast("double").alias("y"), crc_fold(F.col("doc_id")).alias("fold"))
        .orderBy(F.xxhash64("l_id"), "l_id", "y").limit(max_fit)
        .select(F.monotonically_increasing_id().alias("l_row"), "*")
    )

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"l_row": b.l_row, "y": b.y, "fold": b.fold, "th": b.th, "x": [np.array(statistics(t), dtype=float) for t in b.text]})

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("l_row", "y", "fold", F.xxhash64("text").alias("th"), "text")
    # the scan keeps its splits; only statistics move, one row a label, in an order of their own, so that sums repeat
    known = materialize(
        rows.mapInPandas(measured, "l_row long, y double, fold long, th long, x array<double>")
        .groupBy("l_row", "y", "fold").agg(F.min(F.struct("th", "x")).alias("m"))
        .select("l_row", "y", "fold", "m.x").sortWithinPartitions("l_row"),
        "quality-fit",
    )

    def sums(of) -> np.ndarray:
        """`of` (matrix and labels of the fit folds -> array), summed over partitions."""

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = 0
            for b in batches:
                if len(b):
                    total = total + of(np.stack(b.x), b.y.to_numpy())
            if not np.isscalar(total):
                yield pd.DataFrame({"s": [total.ravel()]})

        found = [np.array(r.s) for r in known.where(F.col("fold") != CALIBRATION_FOLD).mapInPandas(part, "s array<double>").collect()]
        return sum(found) if found else np.zeros(0)

    moments = sums(lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x**2).sum(0)]))
    if not len(moments) or not 0 < moments[1] < moments[0]:
        return Model(rate=float(moments[1] / moments[0]) if len(moments) else 0.5)
    n = moments[0]
    mean = moments[2 : 2 + N_STATISTICS] / n
    scale = np.sqrt(np.maximum(moments[2 + N_STATISTICS :] / n - mean**2, 1e-12)) + 1e-6
    rng = np.random.default_rng(seed)
    model = Model(
        rate=float(moments[1] / n), mean=mean, scale=scale,
        frequency=rng.normal(size=(N_STATISTICS, FEATURES)) / np.sqrt(N_STATISTICS), phase=rng.uniform(0, 2 * np.pi, FEATURES),
    )

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.hstack([model.lift(x), np.ones((len(x), 1))])
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    solved = sums(normal).reshape(FEATURES + 1, FEATURES + 2)
    model.weights = np.linalg.solve(solved[:, :-1] + RIDGE * np.eye(FEATURES + 1), solved[:, -1])

    own = known.where(F.col("fold") == CALIBRATION_FOLD).toPandas()  # a part of max_fit rows
    if not len(own):
        own = known.toPandas()
    model.steps = isotonic(model.raw(np.stack(own.x)), own.y.to_numpy())
    return model


def score_of(model: Model, text: str = "text") -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.array([statistics(t) for t in texts])))

    return score(text)


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Defined cases: a null or empty text is scored like any other, by its zero
    statistics; a null doc_id isn't held out and never learned from; labels
    that repeat count each time, and of documents that share a doc_id one is
    learned from (the first by hash of text); without labels of both kinds every score is
    the rate of label 1, or 0.5 without any; empty documents give no rows;
    columns beyond doc_id and text are not read.
    """
    model = fit(docs, labels, **options)
    text_batches(docs.sparkSession)
    return docs.select(
        "doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), score_of(model).alias("score")
    ).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that the classifier rejects.

    Null and empty texts are judged by their zero statistics; repeated rows stay or go together; cases of learning are those of
    quality_scores(); an empty table stays empty; columns beyond doc_id and text pass through, whatever their names.
    """
    model = fit(docs, labels)
    text_batches(docs.sparkSession)
    return docs.where(score_of(model) >= ACCEPT)
