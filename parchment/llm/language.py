"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads windows of a text's bytes in both directions and gives every
position a distribution over the learned languages; a document's probabilities
are the mean over all its positions. It is trained in numpy by backpropagation
through time. x / (1 + |x|) takes the place of tanh, and half of it plus one
half that of the logistic function: numpy computes both in few passes.

The fit reads at most STRATA snippets of each language: texts are dealt into
strata by a hash of their id, and each stratum gives one snippet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, text_batches

HIDDEN = 8
WINDOW = 128  # bytes of a window that is labelled
STRATA = 1000  # snippets of a language that the network may learn from
SNIPPET = 256  # characters of a snippet
FIT_WINDOW, FIT_BATCH, FIT_STEPS, RATE = 64, 256, 240, 0.02
BATCH = 4096  # windows at once


def soft(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place; room is of x's shape."""
    np.abs(x, out=room)
    room += 1
    x /= room
    return x


class Direction:
    """One gated recurrent layer; columns are windows. e: input weights and bias of each byte; u: recurrent weights."""

    def __init__(self, rng: np.random.Generator, hidden: int = HIDDEN):
        self.h = hidden
        self.e = (rng.normal(size=(3 * hidden, 256)) * 0.3).astype(np.float32)
        self.u = (rng.normal(size=(3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)

    def run(self, x: np.ndarray, keep: bool = False):
        """States (steps, hidden, windows) for bytes x (steps, windows); with keep, what back() needs."""
        k, n_windows = self.h, x.shape[1]
        out = np.empty((len(x), k, n_windows), np.float32)
        h = np.zeros((k, n_windows), np.float32)
        a, g, room = (np.empty((3 * k, n_windows), np.float32) for _ in range(3))
        kept = []
        for t in range(len(x)):
            np.take(self.e, x[t], axis=1, out=a, mode="clip")
            np.matmul(self.u, h, out=g)
            zr, gn = a[: 2 * k], g[2 * k :]
            zr += g[: 2 * k]
            soft(zr, room[: 2 * k])
            zr *= 0.5
            zr += 0.5
            z, r, n = zr[:k], zr[k:], a[2 * k :]
            np.multiply(r, gn, out=room[2 * k :])
            n += room[2 * k :]
            soft(n, room[2 * k :])
            if keep:
                kept.append((h, z.copy(), r.copy(), gn.copy(), n.copy()))
            np.subtract(h, n, out=out[t])
            h = out[t]
            h *= z
            h += n
        return (out, kept) if keep else out

    def back(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of e and u."""
        k = self.h
        d_a = np.empty((3 * k, *x.shape), np.float32)
        d_u = np.zeros_like(self.u)
        carry = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, gn, n = kept[t]
            dh = d_out[t] + carry
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            dz = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dn * gn * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            dg = np.vstack([dz, dr, dn * r])
            d_a[:, t] = np.vstack([dz, dr, dn])
            d_u += dg @ h.T
            carry = dh * z + self.u.T @ dg
        where = x.ravel()
        d_e = np.stack([np.bincount(where, d_a[j].ravel(), minlength=256) for j in range(3 * k)])
        return d_e.astype(np.float32), d_u


class Network:
    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forth, self.back = Direction(rng), Direction(rng)
        self.v = (rng.normal(size=(len(languages), 2 * HIDDEN)) * 0.3).astype(np.float32)
        self.c = np.zeros((len(languages), 1), np.float32)

    def _softmax(self, f: np.ndarray, r: np.ndarray) -> np.ndarray:
        p = self.v[:, :HIDDEN] @ f
        p += self.v[:, HIDDEN:] @ r
        p += self.c
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (steps, languages, windows) at every position of bytes x (steps, windows)."""
        return self._softmax(self.forth.run(x), self.back.run(x[::-1])[::-1])

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = FIT_STEPS, seed: int = 4) -> None:
        """x: windows of bytes (windows, steps), 0 where a text has ended; y: languages' numbers."""
        rng = np.random.default_rng(seed)
        params = [self.forth.e, self.forth.u, self.back.e, self.back.u, self.v, self.c]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), FIT_BATCH)
            b, labels = np.ascontiguousarray(x[pick].T), y[pick]
            f, f_kept = self.forth.run(b, True)
            r, r_kept = self.back.run(b[::-1], True)
            r = r[::-1]
            d = self._softmax(f, r)
            d[:, labels, np.arange(len(labels))] -= 1
            d *= (b > 0)[:, None, :] / max(1, (b > 0).sum())
            grads = [
                *self.forth.back(b, f_kept, self.v[:, :HIDDEN].T @ d),
                *self.back.back(b[::-1], r_kept, (self.v[:, HIDDEN:].T @ d)[::-1]),
                np.hstack([np.tensordot(d, s, ((0, 2), (0, 2))) for s in (f, r)]),
                d.sum(axis=(0, 2))[:, None],
            ]
            size = np.sqrt(sum((g**2).sum() for g in grads))
            rate = RATE * (1 - 0.9 * step / steps)
            for p, g, m, s in zip(params, grads, first, second):
                g = g * min(1.0, 1.0 / max(size, 1e-12))
                m += 0.1 * (g - m)
                s += 0.01 * (g**2 - s)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (texts, languages) over all bytes of each text."""
        total = np.zeros((len(texts), len(self.languages)))
        owner, rows = [], []

        def flush() -> None:
            x = np.zeros((len(rows), WINDOW), np.uint8)
            for i, r in enumerate(rows):
                x[i, : len(r)] = r
            x = np.ascontiguousarray(x.T)
            p = self.positions(x)
            p *= (x > 0)[:, None, :]
            np.add.at(total, owner, p.sum(axis=0).T)
            owner.clear()
            rows.clear()

        for i, t in enumerate(texts):
            raw = np.frombuffer(t, np.uint8)
            for at in range(0, len(raw), WINDOW):
                owner.append(i)
                rows.append(raw[at : at + WINDOW])
                if len(rows) == BATCH:
                    flush()
        if rows:
            flush()
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(docs: DataFrame, strata: int = STRATA, steps: int = FIT_STEPS) -> Network | None:
    """Learn from text and lang outside the held-out fold; None where no text has both."""
    start = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - SNIPPET + 1)) + 1).cast("int")
    snippets = (
        docs.where("lang is not null and text is not null and doc_id is not null")
        .where(crc_fold(F.col("doc_id")) != 0)
        .select("lang", F.xxhash64("doc_id").alias("h"), F.substring("text", start, F.lit(SNIPPET)).alias("s"))
        .groupBy("lang", F.pmod("h", F.lit(strata)).alias("stratum"))
        .agg(F.min(F.struct("h", "s")).alias("m"))
        .select("lang", "stratum", "m.s")
    )
    rows = sorted((r.lang, r.stratum, r.s) for r in snippets.toLocalIterator() if has_letter(r.s))
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    network = Network(languages)
    x, y = [], []
    for lang, _, s in rows:
        raw = s.encode("utf-8", "surrogatepass")
        for at in range(0, len(raw), FIT_WINDOW):
            x.append(raw[at : at + FIT_WINDOW].ljust(FIT_WINDOW, b"\0"))
            y.append(languages.index(lang))
    if len(languages) > 1:
        network.train(np.frombuffer(b"".join(x), np.uint8).reshape(len(x), FIT_WINDOW), np.array(y), steps)
    return network


def language_of(network: Network | None, text: str = "text") -> Column:
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        known = [t if t is not None and has_letter(t) else None for t in texts]
        lang, score = ["und"] * len(known), [0.0] * len(known)
        at = [i for i, t in enumerate(known) if t is not None]
        if at and network is not None:
            p = network.documents([known[i].encode("utf-8", "surrogatepass") for i in at])
            for i, best, top in zip(at, p.argmax(axis=1), p.max(axis=1)):
                lang[i], score[i] = network.languages[best], float(min(1.0, top))
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return predict(text)


def languages(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Defined cases: a null text and one without a letter are `und` with score 0,
    as is every text where there was nothing to learn from; a null doc_id isn't
    held out and never learned from; repeated rows each get their row; an empty
    table gives no rows; columns beyond doc_id, text and lang are not read.
    Every byte of a text is read; windows bound what is held at once.
    """
    network = fit(docs, **options)
    text_batches(docs.sparkSession)
    return docs.select(
        "doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), language_of(network).alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")
