"""Table functions for SQL (greedy packing, nested contents), reports that don't all parse, and progress observed on plans."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class Packed:
    """packed(TABLE(key, place, size), budget): key, place, slice.

    A key's rows are read by place and kept one at a time: a new slice opens where the last has something and would pass the
    budget. The function says itself how its table is dealt and ordered. A null size is 0.
    """

    def __init__(self):
        self.size, self.slice = 0, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        columns = {f.name: f for f in rows.dataType.fields} if rows.isTable else {}
        if not {"key", "place", "size"} <= set(columns):
            raise ValueError("packed() takes a table of key, place and size")
        schema = StructType([columns["key"], columns["place"], StructField("slice", LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("key")], orderBy=[OrderingColumn("place")])

    def eval(self, row, budget: int) -> Iterator[tuple]:
        size = row["size"] or 0
        if self.size and self.size + size > budget:
            self.size, self.slice = 0, self.slice + 1
        self.size += size
        yield row["key"], row["place"], self.slice


class Contents:
    """contents(json): place, depth, title, href of nested contents, parents before their children; JSON that can't be read has no rows."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        try:
            stack = [(0, e) for e in reversed(json.loads(text or "[]"))]
        except (ValueError, TypeError, RecursionError):
            return
        place = 0
        while stack:
            depth, e = stack.pop()
            if isinstance(e, dict):
                yield place, depth, str(e.get("title") or ""), str(e.get("href") or "")
                place += 1
                below = e.get("children")
                stack += [(depth + 1, c) for c in reversed(below)] if isinstance(below, list) else []


def register(spark: SparkSession) -> None:
    """Make packed() and contents() known to a session's SQL."""
    spark.udtf.register("packed", F.udtf(Packed))
    spark.udtf.register("contents", F.udtf(Contents, returnType="place int, depth int, title string, href string"))


def told_reports(line: Column, schema: str) -> Column:
    """struct<report, more, broken>: a line of JSON by a schema; fields that the schema doesn't know, as text; the line itself if it can't be read.

    So a report that has grown loses nothing, and one that is cut off is kept for a look.
    """
    names = [f.name for f in _parse_datatype_string(schema).fields]
    read = F.from_json(line, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    more = F.map_filter(F.from_json(line, "map<string,string>"), lambda k, v: ~k.isin(*names))
    report = F.struct(*[read[n].alias(n) for n in names])
    whole = F.coalesce(F.when(read["_broken"].isNull(), more), F.create_map().cast("map<string,string>"))
    return F.struct(report.alias("report"), whole.alias("more"), read["_broken"].alias("broken"))


@dataclass
class Progress:
    """What passes the stages of a plan, counted while it runs and read from the listener afterwards: no job of its own, no callback in a task.

    watch() marks a stage; once an action has run, report() calls `then` with each stage's name and metrics, in order.
    """

    then: Callable[[str, dict], None] | None = None
    stages: list[tuple[str, Observation]] = field(default_factory=list)

    def watch(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        seen = Observation(stage)
        self.stages.append((stage, seen))
        return df.observe(seen, *[c.alias(name) for name, c in metrics.items()])

    def report(self) -> dict[str, dict]:
        out = {}
        for stage, seen in self.stages:
            out[stage] = seen.get
            if self.then:
                self.then(stage, out[stage])
        return out
