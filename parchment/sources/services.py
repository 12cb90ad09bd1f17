"""Outside models behind small interfaces, with deterministic stand-ins."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType, StringType, StructField, StructType

from ..operators.sequence import budget_slices


class Speech(Protocol):
    def say(self, text: str) -> np.ndarray: ...


class Model(Protocol):
    def ask(self, prompt: str) -> str: ...


class Moderator(Protocol):
    def judge(self, texts: list[str]) -> list[dict[str, bool]]: ...


class Unavailable(Exception):
    """A service that didn't answer; another try may help."""


def retried(call: Callable, *args, tries: int = 3, wait: float = 2.0):
    """call(*args), again after wait, 2 * wait ... seconds while the service is unavailable; the last failure is raised."""
    for k in range(tries):
        try:
            return call(*args)
        except Unavailable:
            if k == tries - 1:
                raise
            time.sleep(wait * (k + 1))


class Tone:
    """A tone as long as the text would take."""

    def __init__(self, rate: float = 18.0, sample_rate: int = 24_000):
        self.rate, self.sample_rate = rate, sample_rate

    def say(self, text: str) -> np.ndarray:
        t = np.arange(int(self.sample_rate * (len(text) / self.rate + 0.15))) / self.sample_rate
        return (0.3 * np.sin(2 * np.pi * 220 * t)).astype(np.float32)


class Echo:
    """Answers each entry of a JSON list with its own word."""

    def ask(self, prompt: str) -> str:
        entries = json.loads(re.search(r"\[.*\]", prompt, re.DOTALL)[0])
        return json.dumps([{"id": e["id"], "correction": e["word"]} for e in entries])


class Cutter:
    """Proposes each word without its last letter."""

    def ask(self, prompt: str) -> str:
        return json.dumps([{"id": e["id"], "correction": e["word"][:-1]} for e in json.loads(prompt)])


class Roles:
    """Takes a paragraph's word before a colon for its reader; paragraphs that follow each other are one block."""

    def ask(self, prompt: str) -> str:
        blocks: list[dict] = []
        for n, who in re.findall(r"(?m)^\[(\d+)\] (\w+):", prompt):
            if blocks and blocks[-1]["name"] == who and blocks[-1]["to"] == int(n) - 1:
                blocks[-1]["to"] = int(n)
            else:
                blocks.append({"name": who, "from": int(n), "to": int(n)})
        return json.dumps({"blocks": blocks})


class WordList:
    """Categories by words, from a service that is unavailable at every other call."""

    def __init__(self, words: dict[str, str]):
        self.words, self.calls = words, 0

    def judge(self, texts: list[str]) -> list[dict[str, bool]]:
        self.calls += 1
        if self.calls % 2:
            raise Unavailable
        return [{name: word in t for name, word in self.words.items()} for t in texts]


def _with(df: DataFrame, name: str, kind: DataType) -> StructType:
    return StructType([*df.schema.fields, StructField(name, kind)])


SAID_BYTES = 4 << 20  # of audio that a worker holds at once


def synthesised(segments: DataFrame, make: Callable[[], Speech]) -> DataFrame:
    """segments with `audio`; an engine is made once for each task. Filter before: nothing is pushed below it.

    Audio is many times its text, so what is said goes on in pieces of SAID_BYTES or one text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for b in batches:
            said: list[np.ndarray] = []
            size = first = 0
            for k, t in enumerate(b["text"], 1):
                said.append(engine.say(t or ""))
                size += said[-1].nbytes
                if size >= SAID_BYTES or k == len(b):
                    yield b.iloc[first:k].assign(audio=said)
                    said, size, first = [], 0, k

    return segments.mapInPandas(run, _with(segments, "audio", ArrayType(FloatType())))


def asked(items: DataFrame, make: Callable[[], Model], size: int = 12) -> DataFrame:
    """items (word, context, more) with `proposal`. Batches of `size` go to the model; a reply that fails leaves null, the rest goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            proposals: list[str | None] = []
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                entries = [{"id": i, "word": w, "context": c} for i, (w, c) in enumerate(zip(part["word"], part["context"]))]
                try:
                    replies = {r["id"]: r.get("correction") for r in json.loads(model.ask(json.dumps(entries))) if isinstance(r.get("id"), int)}
                except (ValueError, AttributeError, TypeError):
                    replies = {}
                proposals += [p if isinstance(p := replies.get(i), str) else None for i in range(len(part))]
            yield b.assign(proposal=proposals)

    return items.mapInPandas(run, _with(items, "proposal", StringType()))


def moderated(texts: DataFrame, make: Callable[[], Moderator], size: int = 32, wait: float = 2.0) -> DataFrame:
    """texts (text) with `flags`: sorted names of the categories that a text breaks. `size` texts go at a time, three tries each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make()
        for b in batches:
            flags: list[list[str]] = []
            for at in range(0, len(b), size):
                found = retried(judge.judge, [t or "" for t in b["text"].iloc[at : at + size]], wait=wait)
                flags += [sorted(k for k, broken in f.items() if broken) for f in found]
            yield b.assign(flags=flags)

    return texts.mapInPandas(run, _with(texts, "flags", ArrayType(StringType())))


SLICE_CHARS = 24_000  # fixed value: characters of a chapter that a model is shown at once
DISCOVERED = "book long, chapter long, persona string, first long, last long, opening string, closing string"


def shown_slices(chapters: DataFrame) -> DataFrame:
    """book, chapter, slice, first, shown: the runs of a chapter's paragraphs that a model is shown at once, each a row, and the number of its first."""
    sizes = F.transform("paragraphs", F.length)
    each = chapters.select("book", "chapter", F.posexplode(F.arrays_zip("paragraphs", budget_slices(sizes, SLICE_CHARS).alias("cut"))).alias("at", "p"))
    rows = each.groupBy("book", "chapter", F.col("p.cut").alias("slice")).agg(F.array_sort(F.collect_list(F.struct("at", F.col("p.paragraphs").alias("text")))).alias("r"))
    return rows.select("book", "chapter", "slice", F.col("r")[0]["at"].cast("long").alias("first"), F.transform("r", lambda x: x["text"]).alias("shown"))


def discovered(chapters: DataFrame, make: Callable[[], Model]) -> DataFrame:
    """book, chapter, persona, first, last, opening, closing: blocks that a model gives to readers.

    chapters has book, chapter and paragraphs. Names known from one slice go into the questions about the next, and keep
    the spelling they had first; so a book's slices are read in order, by one task, and only books run beside each other.
    Blocks of the narrator, without a name, or outside of what was shown are left out; a reply that can't be read gives none.
    """

    def read(b: pd.DataFrame) -> pd.DataFrame:
        model, known, rows = make(), {}, []
        for s in b.sort_values(["chapter", "slice"]).itertuples(index=False):
            numbered = {int(s.first) + i: p for i, p in enumerate(s.shown)}
            asked_ = [f"Known: {', '.join(known.values())}.", ""] if known else []
            reply = model.ask("\n".join(asked_ + [f"[{i}] {p}" for i, p in numbered.items()]))
            for name, a, z in _blocks(reply):
                if a in numbered and z in numbered and a <= z:
                    rows.append((s.book, s.chapter, known.setdefault(name.casefold(), name), a, z, numbered[a], numbered[z]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in DISCOVERED.split(", ")])

    return shown_slices(chapters).groupBy("book").applyInPandas(read, DISCOVERED)


def _blocks(reply: str) -> list[tuple]:
    """(name, from, to) of a reply's blocks that have a reader of their own."""
    try:
        blocks = json.loads(reply)["blocks"]
        named = [(str(x.get("name") or "").strip(), x.get("from"), x.get("to")) for x in blocks]
    except (ValueError, KeyError, TypeError, AttributeError):
        return []
    return [b for b in named if b[0] and b[0].casefold() != "narrateur"]


def reply_json(c: Column) -> Column:
    """The JSON in a model's reply: without thoughts, inside a fence if there is one, else between the outermost brackets."""
    said = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(said, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(fenced != "", F.regexp_replace(fenced, r"^\s+|\s+$", "")).otherwise(F.regexp_extract(said, r"(?s)([\[{].*[\]}])", 1))


def batch_limits(confs: dict[str, str] | None = None) -> dict[str, str]:
    """Session settings that keep batches of audio small."""
    return {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"} | (confs or {})
