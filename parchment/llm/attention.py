"""Language-model scores: causal self-attention over subword ids, trained in numpy.

Subwords come from a public tokenizer. The network reads the kinds of subwords before a
place (the KINDS most frequent ids; the others are one kind) and says the class of the
next: frequent ids are classes of their own, the others share classes of ids that stand
near the same frequent ids. A token's probability is that of its class in its context
times its share of the class after the subword before it. A place attends to LEFT + STRIDE
before it at most; windows overlap by LEFT, so each token is scored once and has LEFT of
context at least.

Everything is learned from all training texts. Texts are coded once; what stands near what,
which kind follows which, and shares are counted over all of them, and so is the network's
table of the last subword. What attention adds is learned in ROUNDS rounds, each of twice the
texts of the one before, so that each text is learned from once: in a round every task takes
steps over its own texts from the same network, and the next round starts from their mean,
weighted by windows.

Words are counted over all training texts. The HOT most frequent, at most, are broadcast with
their subwords; the rest of a text's words meet their counts in a join.
"""

from __future__ import annotations

import base64
import copy
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"  # ranks of a public byte-level vocabulary
#: What splits text before merges; fixed, it belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

HELD_OUT = 10  # crc32 of the id modulo 10 is 0
KINDS = 1024  # ids that the network tells apart
OWN, OPENING, INNER = 40, 12, 11  # classes of one id, classes of many that open a word, of many inside words; one more is the end of a text
NEAR = 6  # places on either side by which ids are put into classes
PRIOR = 2.0  # counts that smoothing adds
LEFT, STRIDE = 8, 24
KEY, VALUE = 8, 16
BATCH = 128  # windows at once
FIT_BATCH, RATE = 128, 0.02
ROUNDS = 6
GRAIN = 1 << 16  # parts of one that networks are summed in: whole numbers give the same sum in any order
HOT = 200_000
LONG = 64  # bytes of a word beyond which its hash stands for it in joins
STEADY = 60.0  # exponents of float32 below which no maximum need be taken off

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_UPPER_LETTERS, _LOWER_LETTERS = (bytes(range(a, a + 26)).decode() for a in (0x41, 0x61))


class Network:
    """One layer: tables q, k, v by kind, a bias by distance, a table by the last kind, and what attention adds to it."""

    def __init__(self, start: np.ndarray, seed: int = 7):
        """start: log probabilities of classes after each kind."""
        rng = np.random.default_rng(seed)
        kinds, classes = start.shape
        draw = lambda *shape: (rng.normal(size=shape) * 0.2).astype(np.float32)
        self.q, self.k, self.v, self.u = draw(kinds, KEY), draw(kinds, KEY), draw(kinds, VALUE), draw(VALUE, classes) * 0.1
        self.far = np.zeros(LEFT + STRIDE, np.float32)
        self.t = start.astype(np.float32)
        self.highest = float(np.abs(self.t).max())  # the table isn't learned

    def parameters(self) -> list[np.ndarray]:
        return [self.q, self.k, self.v, self.u, self.far, self.t]

    def bias(self) -> np.ndarray:
        """(STRIDE, LEFT + STRIDE): by distance, and what lies ahead is masked."""
        gap = np.arange(STRIDE)[:, None] + LEFT - np.arange(LEFT + STRIDE)
        return np.where(gap >= 0, self.far[np.maximum(gap, 0)], np.float32(-1e4)).astype(np.float32)

    def steady(self) -> bool:
        """Whether no exponent can leave float32's range: attention averages values, so a logit is bounded by table and value."""
        scores = np.abs(self.q @ self.k.T).max() + np.abs(self.far).max()
        logits = np.abs(self.t).max() + np.abs(self.v @ self.u).max()
        return bool(max(scores, logits) < STEADY)

    def calm(self) -> bool:
        """The same by a bound that costs little: lengths of vectors."""
        longest = lambda m: float(np.sqrt((m * m).sum(axis=1).max()))
        scores = longest(self.q) * longest(self.k) + float(np.abs(self.far).max())
        return scores < STEADY and self.highest + longest(self.v) * longest(self.u.T) < STEADY

    def forward(self, x: np.ndarray, steady: bool = False):
        """Queries, keys, values, attention, its totals, outputs and logits (n * STRIDE, classes) for windows x (n, LEFT + STRIDE) of kinds."""
        own = x[:, LEFT:]
        queries, keys, values = self.q.take(own, axis=0), self.k.take(x, axis=0), self.v.take(x, axis=0)
        a = queries @ keys.swapaxes(1, 2)
        a += self.bias()
        if not steady:
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        o = a @ values
        total = (a @ np.ones(LEFT + STRIDE, a.dtype))[:, :, None]  # sums of short rows are quicker as products
        o /= total
        logits = self.t.take(own.ravel(), axis=0)
        logits += o.reshape(-1, VALUE) @ self.u
        return queries, keys, values, a, total, o, logits

    def losses(self, x: np.ndarray, y: np.ndarray, steady: bool = False) -> np.ndarray:
        """Natural log probabilities (n, STRIDE) of classes y."""
        logits = self.forward(x, steady)[-1]
        if not steady:
            logits -= logits.max(axis=1, keepdims=True)
        picked = logits.ravel().take(np.arange(y.size) * logits.shape[1] + y.ravel())
        np.exp(logits, out=logits)
        return (picked - np.log(logits @ np.ones(logits.shape[1], logits.dtype))).reshape(y.shape)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, table: bool = True, steady: bool = False) -> list[np.ndarray]:
        """Of the mean negative log probability of y over positions of weight 1, in the order of parameters(); the table's only if asked for."""
        kinds = len(self.q)
        own = x[:, LEFT:]
        queries, keys, values, a, total, o, d = self.forward(x, steady)
        a /= total
        if not steady:
            d -= d.max(axis=1, keepdims=True)
        np.exp(d, out=d)
        w = (weight / max(1, weight.sum())).ravel().astype(d.dtype)
        d *= (w / (d @ np.ones(d.shape[1], d.dtype)))[:, None]
        d[np.arange(y.size), y.ravel()] -= w
        d_o = (d @ self.u.T).reshape(o.shape)
        d_s = d_o @ values.swapaxes(1, 2)
        d_s -= ((d_o * o) @ np.ones(VALUE, d.dtype))[:, :, None]
        d_s *= a
        gap = np.maximum(np.arange(STRIDE)[:, None] + LEFT - np.arange(LEFT + STRIDE), 0)
        seen = np.arange(STRIDE)[:, None] + LEFT >= np.arange(LEFT + STRIDE)
        of_x = np.empty((*x.shape, 2 * KEY + VALUE), d.dtype)  # one sort serves all three tables
        of_x[:, :LEFT, :KEY] = 0
        of_x[:, LEFT:, :KEY] = d_s @ keys
        of_x[:, :, KEY : 2 * KEY] = d_s.swapaxes(1, 2) @ queries
        of_x[:, :, 2 * KEY :] = a.swapaxes(1, 2) @ d_o
        q, k, v = np.split(by_row(x, of_x, kinds), [KEY, 2 * KEY], axis=1)
        found = [q, k, v, o.reshape(-1, VALUE).T @ d, np.bincount(gap[seen], d_s.sum(axis=0)[seen], minlength=LEFT + STRIDE).astype(d.dtype)]
        return found + [by_row(own, d, kinds)] if table else found

    def learner(self, rate: float):
        """A function that takes one step of Adam over windows; the table, which is counted, stays."""
        learned = self.parameters()[:-1]
        first, second = ([np.zeros_like(p) for p in learned] for _ in range(2))
        taken, calm = 0, False

        def step(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
            nonlocal taken, calm
            taken += 1
            calm = self.calm() if taken % 8 == 1 else calm  # a step moves little, and STEADY leaves room
            grads = self.gradients(x, y, weight, False, calm)
            keep = min(1.0, 1.0 / max(np.sqrt(sum(float((g * g).sum()) for g in grads)), 1e-12))
            for p, g, m, s in zip(learned, grads, first, second):
                g = g * np.float32(keep)
                m += np.float32(0.1) * (g - m)
                s += np.float32(0.01) * (g * g - s)
                p -= (rate * (m / (1 - 0.9**taken)) / (np.sqrt(s / (1 - 0.99**taken)) + 1e-6)).astype(np.float32)

        return step


def by_row(rows: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Sums of d's vectors by row number: the gradient of a table that was read by those rows."""
    flat, d = rows.ravel(), d.reshape(rows.size, -1)
    flat = flat.astype(np.uint16) if n <= 1 << 16 else flat  # short numbers are sorted by digits
    order = np.argsort(flat, kind="stable")
    flat = flat[order].astype(np.int64)
    starts = np.flatnonzero(np.diff(flat, prepend=-1))
    out = np.zeros((n, d.shape[1]), d.dtype)
    out[flat[starts]] = np.add.reduceat(d.take(order, axis=0), starts, axis=0)
    return out


class Subwords:
    """Ids of words, each with the space before it; the encoder is built where it is used."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self._encoder = ranks, None
        self.opens = np.zeros(max(ranks.values(), default=-1) + 1, bool)
        self.opens[[i for piece, i in ranks.items() if piece[:1] == b" "]] = True

    @staticmethod
    def load(path: str = TOKENIZER) -> Subwords:
        with open(path, "rb") as f:
            return Subwords({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoder": None}

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each word has."""
        import tiktoken

        if self._encoder is None:
            self._encoder = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = (b" " + b" ".join(words)).decode("utf-8", "replace")
        if len(text.split()) == len(words):  # else a word holds white space that isn't ASCII, and stands alone
            ids = np.array(self._encoder.encode_ordinary(text), np.int64)
            opens = np.flatnonzero(self.opens[ids])
            if len(opens) == len(words):
                return ids, np.diff(opens, append=len(ids))
        each = [self._encoder.encode_ordinary((b" " + w).decode("utf-8", "replace")) for w in words]
        return np.concatenate([np.array(e, np.int64) for e in each]), np.array([len(e) for e in each])


def short(word: bytes) -> bytes:
    """What stands for a word in joins: itself, or a blank and its hash if it is long."""
    return word if len(word) <= LONG else b" " + hashlib.sha256(word).hexdigest().encode()


def short_column(word: Column) -> Column:
    return F.when(F.octet_length(word) <= LONG, word).otherwise(F.concat(F.lit(" "), F.sha2(word.cast("binary"), 256)))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over all rows of docs; words are told before A-Z are lower-cased, so that each is lower-cased once."""
    words = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    return (
        words.groupBy("word").agg(F.count("*").alias("c"))
        .groupBy(F.translate("word", _UPPER_LETTERS, _LOWER_LETTERS).alias("word")).agg(F.sum("c").alias("c"))
    )


def _coded(batches: Iterator[pa.RecordBatch], subwords: Subwords):
    """Ids of counted words, how many each has, and the words' counts, some thousand words at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 8192):
            part = b.slice(at, 8192)
            yield *subwords.encode([w.encode() for w in part.column("word").to_pylist()]), part.column("c").to_numpy()


def _sparse(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "c"])


def _summed(rows: DataFrame, run, size: int) -> np.ndarray:
    """What tasks count in arrays of one size, summed: a row a filled cell."""
    total = np.zeros(size, np.int64)
    found = rows.mapInArrow(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    total[found["at"].to_numpy()] = found["c"].to_numpy()
    return total


def subword_counts(counts: DataFrame, subwords) -> np.ndarray:
    """How often each id stands in the counted words."""
    size = len(subwords.value.opens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for ids, lengths, c in _coded(batches, subwords.value):
            np.add.at(total, ids, np.repeat(c, lengths))
        yield _sparse(total)

    return _summed(counts.select("word", "c"), run, size)


def pair_counts(counts: DataFrame, subwords, kind: np.ndarray, kinds: int) -> np.ndarray:
    """How often a kind follows a kind inside words, (kinds, kinds + 1); the last column: how often a kind ends a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kinds, kinds + 1), np.int64)
        for ids, lengths, c in _coded(batches, subwords.value):
            k, c = kind[ids], np.repeat(c, lengths)
            last = np.zeros(len(k), bool)
            last[np.cumsum(lengths) - 1] = True
            np.add.at(total, (k, np.where(last, kinds, np.roll(k, -1))), c)
        yield _sparse(total)

    return _summed(counts.select("word", "c"), run, kinds * (kinds + 1)).reshape(kinds, kinds + 1)


def clusters(points: np.ndarray, mass: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart starts; the number of each point's cluster."""
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    if len(unit) <= k:
        return np.arange(len(unit))
    centres = [unit[mass.argmax()]]
    for _ in range(k - 1):
        far = (1 - np.max(unit @ np.array(centres).T, axis=1)) * np.sqrt(mass)
        centres.append(unit[far.argmax()])
    centres = np.array(centres)
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(axis=1)
        for j in np.unique(own):
            c = (unit[own == j] * mass[own == j, None]).sum(axis=0)
            centres[j] = c / max(np.linalg.norm(c), 1e-12)
    return own


def ranked(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids by falling count, the kind of each id, and how many kinds there are; what is not frequent is one kind, the last."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    kinds = min(KINDS, len(order)) + 1
    kind = np.full(len(counts), kinds - 1)
    kind[order[: kinds - 1]] = np.arange(kinds - 1)
    return order, kind, kinds


class Classes:
    """Kinds and classes of ids, and the log share of an id in its class after a kind. The end of a text is the last kind and the last class."""

    def __init__(self, counts: np.ndarray, ends: int, opens: np.ndarray, near: np.ndarray):
        """counts: of ids, over the corpus; near: how often a kind stands near a frequent one, (kinds, OWN)."""
        order, self.kind, self.kinds = ranked(counts)
        self.n = OWN + OPENING + INNER + 1
        self.end_kind, self.end = self.kinds, self.n - 1
        self.opens = opens
        self.of = np.where(opens, OWN + OPENING - 1, self.n - 2)
        self.of[order[:OWN]] = np.arange(min(OWN, len(order)))
        mass = counts + 0.1
        rest = order[OWN : self.kinds - 1]
        for flag, first, many in ((True, OWN, OPENING), (False, OWN + OPENING, INNER)):
            ids = rest[opens[rest] == flag]
            if len(ids):
                self.of[ids] = first + clusters(np.sqrt(near[self.kind[ids]]), mass[ids], many)
        total = np.bincount(self.of, mass, minlength=self.n)
        self.share = np.where(self.of < OWN, 0.0, np.log(mass / total[self.of]))
        self.sums = np.bincount(self.of, counts, minlength=self.n).astype(float)
        self.sums[self.end] = ends

    def follow(self, pairs: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Take in how kinds follow each other inside words (pairs) and in texts (after, as neighbours() has it); log probabilities of classes after each kind."""
        frequent = np.zeros(self.kinds - 1, np.int64)
        ids = np.flatnonzero(self.kind < self.kinds - 1)
        frequent[self.kind[ids]] = ids
        of = np.append(self.of[frequent], self.n - 2)  # the one kind of all others inside a word has the last class of those
        told = np.zeros((self.kinds, self.n))
        np.add.at(told.T, of, pairs[:, : self.kinds].T)
        told[:, self.n - 2] -= pairs[:, self.kinds - 1]
        self.pairs, self.told = pairs[:, : self.kinds - 1].astype(np.float32), told  # shares after a kind: what is not frequent has its prior alone
        by_class = np.zeros((self.kinds + 1, self.n))
        np.add.at(by_class.T, np.concatenate([of, [self.end, OWN + OPENING - 1]]), after.T)
        by_class += PRIOR * (self.sums + 0.1) / (self.sums + 0.1).sum()
        return np.log(by_class / by_class.sum(axis=1, keepdims=True))

    def shares(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log shares of the ids of words in their classes: those that open a word by all counts, others after the one before."""
        heads = self.opens[ids]
        heads[np.cumsum(lengths) - lengths] = True
        return self.shares_by_heads(ids, heads)

    def shares_by_heads(self, ids: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """The same, where it is told which ids open a word or stand first in one."""
        share, of, kind = self.share[ids], self.of[ids], self.kind[ids]
        at = np.flatnonzero(~heads & (of >= OWN))
        before = kind[at - 1]
        n = np.where(kind[at] < self.kinds - 1, self.pairs[before, np.minimum(kind[at], self.kinds - 2)], 0)
        share[at] = np.log((n + PRIOR * np.exp(share[at])) / (self.told[before, of[at]] + PRIOR))
        return share


class Coder:
    """Subwords, and the frequent words with theirs and with logs of counts."""

    def __init__(self, subwords: Subwords, hot: list[tuple[bytes, int]]):
        self.subwords = subwords
        self.place = {w: i for i, (w, _) in enumerate(hot)}
        self.flat, self.lengths = subwords.encode([w for w, _ in hot])
        self.log = np.log10(np.array([c for _, c in hot], float) + 0.1)
        self.type = np.dtype("<u2" if len(subwords.opens) <= 1 << 16 else "<u4")  # of stored ids

    def tokens(self, docs: list[list[bytes]]):
        """Of many texts' words: ids of all tokens, ids of each word, tokens of each text without its end, and places of words (-1: not frequent)."""
        n = np.array([len(d) for d in docs], np.int64)
        get = self.place.get
        at = np.fromiter((get(w, -1) for d in docs for w in d), np.int64, n.sum())
        rare = np.flatnonzero(at < 0)
        lengths, flat, places = self.lengths, self.flat, at
        if len(rare):
            words = [w for d in docs for w in d]
            ids, own = self.subwords.encode([words[i] for i in rare.tolist()])
            places = at.copy()
            places[rare] = len(lengths) + np.arange(len(rare))
            lengths, flat = np.concatenate([lengths, own]), np.concatenate([flat, ids])
        starts = np.cumsum(lengths) - lengths
        each = lengths[places]
        ends = np.cumsum(each)
        take = np.repeat(starts[places] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)
        by_doc = np.concatenate([[0], ends])[np.cumsum(n)] if len(n) else np.zeros(0, np.int64)
        return flat[take], each, np.diff(by_doc, prepend=0), at

    def read(self, part: pa.RecordBatch):
        """Ids of all tokens of coded texts, which of them don't follow inside a word, and tokens of each text."""
        ids = [np.frombuffer(b, self.type) for b in part.column("ids").to_pylist()]
        n = np.array([len(i) for i in ids], np.int64)
        flat = np.concatenate([np.zeros(0, self.type), *ids]).astype(np.int64)
        heads = self.subwords.opens[flat]  # what opens a word; where words begin otherwise is told beside
        for i, odd in zip((np.cumsum(n) - n).tolist(), part.column("odd").to_pylist()):
            if odd:
                heads[i + np.array(odd)] = True
        return flat, heads, n


class Model:
    """What scoring needs: how texts are coded, classes, the network."""

    def __init__(self, coder: Coder, classes: Classes, network: Network):
        self.coder, self.subwords, self.classes, self.network = coder, coder.subwords, classes, network
        self.steady = network.steady()

    def tokens(self, docs: list[list[bytes]]):
        """Of many texts' words: ids and shares of all tokens, tokens of each text without its end, and places of words (-1: not frequent)."""
        flat, lengths, n, at = self.coder.tokens(docs)
        return flat, self.classes.shares(flat, lengths), n, at

    def windows(self, flat: np.ndarray, n: np.ndarray):
        """Windows x of kinds, classes y, weights and windows of each text, from ids; a text's end is added."""
        end, m = self.classes.end, n + 1
        per = -(-m // STRIDE)
        base = (np.cumsum(per) - per) * STRIDE
        y = np.full(int(per.sum()) * STRIDE, end, np.int64)
        weight = np.zeros(len(y), bool)
        place = np.arange(len(flat)) + np.repeat(base - (np.cumsum(n) - n), n)
        y[place] = self.classes.of[flat]
        weight[place] = True
        weight[base + n] = True
        context = np.full(LEFT + 1 + len(y), self.classes.end_kind)
        context[LEFT + 1 + place] = self.classes.kind[flat]
        x = context[(np.arange(len(y) // STRIDE) * STRIDE)[:, None] + np.arange(LEFT + STRIDE)]
        x[base // STRIDE, : LEFT + 1] = self.classes.end_kind
        return x, y.reshape(-1, STRIDE), weight.reshape(-1, STRIDE), per

    def log10(self, flat: np.ndarray, heads: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probabilities of texts of n tokens each, from all ids and where words begin."""
        x, y, weight, per = self.windows(flat, n)
        logs = np.zeros(len(x))
        for a in range(0, len(x), BATCH):
            own = self.network.losses(x[a : a + BATCH], y[a : a + BATCH], self.steady)
            logs[a : a + BATCH] = np.where(weight[a : a + BATCH], own, 0).sum(axis=1, dtype=np.float64)
        docs = np.arange(len(n))
        total = np.bincount(np.repeat(docs, per), logs, minlength=len(n))
        total += np.bincount(np.repeat(docs, n), self.classes.shares_by_heads(flat, heads), minlength=len(n))
        return total / np.log(10)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT == 0, F.lit(False))


def learned(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def frequent(counts: DataFrame, hot: int) -> list[tuple[bytes, int]]:
    """The most frequent words and their counts, hot of them at most: all whose count is in a band of an eighth of a doubling that still fits."""
    band = F.floor(F.log2("c") * 8)
    short_words = counts.where(F.octet_length("word") <= LONG)
    room, least = hot, None
    for b, n in sorted(((r.b, r.n) for r in short_words.groupBy(band.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True):
        if n > room:
            break
        room, least = room - n, b
    return [] if least is None else sorted((r.word.encode(), r.c) for r in short_words.where(band >= least).select("word", "c").collect())


CODED = "held_out boolean, round int, n_tokens long, hot long, hot_log double, rare array<struct<key: string, k: int>>, ids binary, odd array<int>"


def coded(docs: DataFrame, shipped) -> DataFrame:
    """doc_id, held_out, round (null: not learned from), n_tokens, hot, hot_log, rare, ids, odd: each text as ids of its subwords and what its base score needs."""
    seen = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit((1 << ROUNDS) - 1)) + 1  # half of these numbers have ROUNDS digits, a fourth one digit less
    columns = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(seen, F.floor(F.log2(drawn)).cast("int")).alias("round"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                docs = [words_of(t) for t in part.column("text").to_pylist()]
                flat, lengths, n, places = own.tokens(docs)
                first = np.zeros(len(flat), bool)
                first[np.cumsum(lengths) - lengths] = True
                first &= ~own.subwords.opens[flat]
                ends = np.cumsum(n)
                rows, known, sums, ids, odd, start = [], [], [], [], [], 0
                for d, a, e in zip(docs, (ends - n).tolist(), ends.tolist()):
                    here = places[start : start + len(d)]
                    start += len(d)
                    rare = Counter(short(d[i]) for i in np.flatnonzero(here < 0).tolist())
                    hot = here[here >= 0]
                    known.append(len(hot))
                    sums.append(float(own.log[hot].sum()))
                    rows.append([{"key": w.decode("utf-8", "replace"), "k": k} for w, k in rare.items()])
                    ids.append(flat[a:e].astype(own.type).tobytes())
                    odd.append(np.flatnonzero(first[a:e]).tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("held_out"), part.column("round"), pa.array([len(d) + 1 for d in docs], pa.int64()),
                        pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(rows, pa.list_(pa.struct([("key", pa.string()), ("k", pa.int32())]))),
                        pa.array(ids, pa.binary()), pa.array(odd, pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "held_out", "round", "n_tokens", "hot", "hot_log", "rare", "ids", "odd"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return columns.mapInArrow(run, f"doc_id {kind}, {CODED}").withColumn("row", F.monotonically_increasing_id())


def neighbours(texts: DataFrame, shipped, kind: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """How often a kind stands NEAR an id of a class of its own, (kinds, OWN), and after a kind, the start (the last row) or before the end, (kinds + 1, kinds + 2).

    The last two columns: how often the end follows, and how often what isn't frequent and opens a word.
    """
    width = kinds + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        near, after = np.zeros((kinds + 1) * OWN, np.int64), np.zeros((kinds + 1) * width, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                flat, _, n = own.read(b.slice(at, 512))
                gaps = np.repeat(np.arange(len(n)) * NEAR, n)  # NEAR ends stand between texts
                k = np.full(len(flat) + (len(n) + 1) * NEAR, kinds)
                place = np.arange(len(flat)) + gaps + NEAR
                k[place] = kind[flat]
                to = k.copy()
                to[place[(k[place] == kinds - 1) & own.subwords.opens[flat]]] = kinds + 1
                before = np.concatenate([place, np.cumsum(n) + np.arange(len(n)) * NEAR + NEAR])  # of each token and of each text's end: the place itself
                after += np.bincount(k[before - 1] * width + to[before], minlength=len(after))
                at_own = np.flatnonzero(k < min(OWN, kinds))
                c = k[at_own]
                for gap in (*range(-NEAR, 0), *range(1, NEAR + 1)):
                    near += np.bincount(k[at_own + gap] * OWN + c, minlength=len(near))
        yield _sparse(np.concatenate([near[: kinds * OWN], after]))  # the row of ends is left out

    total = _summed(texts.select("ids", "odd"), run, kinds * OWN + (kinds + 1) * width)
    return total[: kinds * OWN].reshape(kinds, OWN), total[kinds * OWN :].reshape(kinds + 1, width)


def learned_round(texts: DataFrame, model: Model, rate: float, steps: int | None) -> None:
    """Every task takes steps over all windows of its texts; the network becomes the mean of theirs, weighted by windows."""
    shipped = texts.sparkSession.sparkContext.broadcast(model)
    start = model.network.parameters()[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        network = copy.deepcopy(own.network)  # a worker's next task starts from what was shipped, too
        rng, step, seen, taken = np.random.default_rng(8), network.learner(rate), 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                flat, _, n = own.coder.read(b.slice(at, 1024))
                x, y, weight, _ = own.windows(flat, n)
                order = rng.permutation(len(x))
                for i in range(0, len(x), FIT_BATCH):
                    if steps is None or taken < steps:
                        pick = order[i : i + FIT_BATCH]
                        step(x[pick], y[pick], weight[pick])
                        seen, taken = seen + len(pick), taken + 1
        moved = np.concatenate([p.ravel() for p in network.parameters()[:-1]]).astype(np.float64)
        yield _sparse(np.append(np.rint(moved * GRAIN).astype(np.int64) * seen, seen))

    size = sum(p.size for p in start)
    total = _summed(texts.select("ids", "odd"), run, size + 1)
    shipped.unpersist()
    if total[-1]:
        mean = (total[:-1] / total[-1] / GRAIN).astype(np.float32)
        for p, new in zip(start, np.split(mean, np.cumsum([p.size for p in start])[:-1])):
            p[...] = new.reshape(p.shape)
        model.steady = model.network.steady()


def learn(table: DataFrame, counts: DataFrame, ends: int, coder: Coder, shipped, sample: int | None = None, steps: int | None = None) -> Model:
    """The model of coded texts. Trials may bound what the network learns from: one text of each of `sample` strata of ids, `steps` of a task in a round."""
    subwords = table.sparkSession.sparkContext.broadcast(coder.subwords)
    texts = table.where("round is not null")
    found = subword_counts(counts, subwords)
    _, kind, kinds = ranked(found)
    near, after = neighbours(texts, shipped, kind, kinds)
    classes = Classes(found, ends, coder.subwords.opens, near)
    model = Model(coder, classes, Network(classes.follow(pair_counts(counts, subwords, kind, kinds), after)))
    subwords.unpersist()
    if sample is not None:
        h = F.xxhash64("doc_id")
        texts = texts.join(texts.groupBy(F.pmod(h, F.lit(sample))).agg(F.min(h).alias("h")).select("h"), h == F.col("h"), "left_semi")
    for r in range(ROUNDS):
        learned_round(texts.where(F.col("round") == r), model, RATE * (1 - 0.95 * r / ROUNDS), steps)
    return model


def prepared(docs: DataFrame, counts: DataFrame, ends: int, tokenizer: str, hot: int) -> tuple[Coder, int, int]:
    """How texts are coded, N and V; counts: word, c of the training texts, ends: how many those are."""
    totals = counts.agg(F.sum("c").alias("c"), F.count("*").alias("v")).first()
    return Coder(Subwords.load(tokenizer), frequent(counts, hot)), (totals.c or 0) + ends, totals.v + (ends > 0)


def fit(docs: DataFrame, counts: DataFrame, ends: int, tokenizer: str = TOKENIZER, hot: int = HOT, **options) -> tuple[Model, int, int]:
    """The model, N and V of texts that aren't coded yet."""
    coder, n, v = prepared(docs, counts, ends, tokenizer, hot)
    shipped = docs.sparkSession.sparkContext.broadcast(coder)
    return learn(materialize(coded(docs, shipped), "coded"), counts, ends, coder, shipped, **options), n, v


def scores(docs: DataFrame, tokenizer: str = TOKENIZER, hot: int = HOT, **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Defined cases: a null or empty text is its end alone; a null doc_id isn't held out and never learned from; repeated rows
    each get their row, and count each time; without anything to learn from every token is as likely as any other and base
    scores are 0 for log10 of 1; a word of any length is a token; empty documents give no rows; columns beyond doc_id and
    text are not read.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col("doc_id"), F.col("text"))
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # a table of few splits would keep most cores idle; where there are enough no row moves
        docs = docs.repartition(cores)
    train = learned(docs)
    counts = materialize(word_counts(train), "words")
    ends = train.count()
    coder, n, v = prepared(docs, counts, ends, tokenizer, hot)
    coding = spark.sparkContext.broadcast(coder)
    table = materialize(coded(docs, coding), "coded")
    shipped = spark.sparkContext.broadcast(learn(table, counts, ends, coder, coding, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(own.log10(*own.coder.read(part)))], names=["row", "score"])

    scored = table.select("row", "ids", "odd").mapInArrow(run, "row long, score double")
    tail = (
        table.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.k")
        .join(counts.select(short_column(F.col("word")).alias("key"), "c"), "key", "left")
        .groupBy("row").agg(
            F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rare_known")
        )
    )
    measured = table.select("row", "doc_id", "held_out", "n_tokens", "hot", "hot_log").join(materialize(scored, "scored"), "row")
    whole = float(np.log10(n + 0.1 * (v + 1)))
    return measured.join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("hot") + F.coalesce("rare_known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("hot_log") + F.coalesce("rare_log", F.lit(0.0)) + float(np.log10(ends + 0.1)) - F.col("n_tokens") * whole).alias("base_score"), "score",
    )
