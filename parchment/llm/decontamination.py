"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces: wherever
the item occurs with at most k edits, one piece at least occurs unchanged. An
Aho-Corasick automaton finds piece hits in one pass over a document; each hit
says where the item would stand, and Myers' bit-parallel algorithm gives the
least edit distance of the item to any substring there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches

ERROR_RATE = 0.06  # edits a character of the item
BLOCK_CHARS = 4_000_000  # characters of items in one automaton; more items mean more passes

HITS = "doc_id long, item_id long, distance long, item_chars long, first_char long, end_char long"

#: A-Z lowered, ASCII white space to spaces.
_TABLE = {**{c: c + 32 for c in range(0x41, 0x5B)}, **{c: 0x20 for c in range(0x09, 0x0E)}}


def normal(text: str) -> str:
    """Lower-case A-Z, white space runs to one space."""
    return " ".join(w for w in text.translate(_TABLE).split(" ") if w)


def budget(item: str) -> int:
    return int(len(item) * ERROR_RATE)


def cut(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    edges = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:]) if b > a]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of pattern to a substring of text, and where the first such substring ends."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        h_plus, h_minus = (minus | ~(d | plus)) & full, plus & d
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = (h_plus << 1) & full  # the first row is free: a match may start anywhere
        plus, minus = ((h_minus << 1) | ~(d | h_plus)) & full, h_plus & d
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    """Items (item_id, normal text) and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, t, budget(t)) for i, t in items if t]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for offset, piece in cut(t, k):
                places.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def hits(self, text: str | None, first: bool = False) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, item length, start, end) of every item within its budget, at its best place."""
        text = normal(text or "")
        if not text or not self.items:
            return []
        places: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                places.setdefault(n, set()).add(end + 1 - size - offset)
        found = []
        for n, starts in places.items():
            item_id, item, k = self.items[n]
            best, done = None, -1
            for s in sorted(starts):
                if s <= done:  # within the window of the last place: looked at already
                    continue
                lo, hi = max(0, s - k), s + len(item) + 3 * k
                done = s + k
                distance, end = (0, s - lo + len(item)) if s >= 0 and text.startswith(item, s) else myers(item, text[lo:hi])
                if distance <= k and (best is None or distance < best[1]):
                    best = (item_id, distance, len(item), max(0, lo + end - len(item)), lo + end)
                if best and best[1] == 0:
                    break
            if best:
                found.append(best)
                if first:
                    break
        return sorted(found)


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, so that a worker holds one block's automaton at most."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        block.append((r.item_id, normal(r.text)))
        size += len(block[-1][1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


_matcher: dict[int, Matcher] = {}


def _own(items: list[tuple[int, str]]) -> Matcher:
    """The block's matcher, made once for each batch of a worker's task."""
    key = hash(tuple(items))
    if key not in _matcher:
        _matcher.clear()
        _matcher[key] = Matcher(items)
    return _matcher[key]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that occurs in it within the item's error budget:
    doc_id, item_id, distance, item_chars, first_char, end_char (places in the normal text).

    Defined cases: null or empty texts have no hits and null or empty items
    hit nothing; a repeated row has its own hits; of equally good places the
    first counts; an empty table on either side gives no rows; columns beyond
    doc_id, text and item_id are not read. All documents meet all items, one
    block of items at a time.
    """
    text_batches(docs.sparkSession)
    out = docs.sparkSession.createDataFrame([], HITS)
    for items in item_blocks(benchmark):

        def match(batches, items=items):
            own = _own(items)
            for b in batches:
                rows = [(d, i, n, size, a, e) for d, t in zip(b.doc_id, b.text) for i, n, size, a, e in own.hits(t)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in HITS.split(", ")])

        out = out.unionByName(docs.select("doc_id", "text").mapInPandas(match, HITS))
    return out


def contaminated(items: list[tuple[int, str]], text: str = "text") -> Column:
    """True where a text holds one of the block's items."""

    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        own = _own(items)
        return texts.map(lambda t: bool(own.hits(t, first=True))).astype(bool)

    return hit(text)


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that hold a benchmark item; order of blocks doesn't matter."""
    text_batches(docs.sparkSession)
    for items in item_blocks(benchmark):
        docs = docs.where(~contaminated(items))
    return docs
