"""Lines of scanned and fixed pages: which run along the page, how they join, which chapter they are in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.misc import lettering


def classify(lines: DataFrame, keys: list[str], body: Column, height: Column, rare: Column) -> DataFrame:
    """lines (text, y from the bottom, h) with `running` and `heading`.

    Repeated heads are counted by aggregation over normalised text and joined back.
    """
    edge = (F.col("y") > 0.86 * height) | (F.col("y") < 0.14 * height)
    norm = T.head_letters(F.col("text"))
    marked = lines.withColumn("__edge", edge).withColumn("__norm", norm)
    heads = marked.where(F.col("__edge") & (F.col("__norm") != "")).groupBy(*keys, "__norm").agg(F.count("*").alias("__times"))
    seen = marked.join(heads, [*keys, "__norm"], "left")
    h, t = F.col("h"), F.col("text")
    folio = t.rlike(r"^\s*\d{1,4}\s*$")
    repeated = F.coalesce(F.col("__edge") & (F.col("__times") >= 3), F.lit(False))
    label = rare & (F.length(t) <= 60) & (h < 1.25 * body)
    caps = T.no_small(t) & (F.lower(t) != t)
    running = folio | ((F.length(F.trim(t)) <= 2) & (h < 1.8 * body)) | ~t.rlike(r"[\p{L}\p{N}]") | lettering(t) | repeated | label | (F.col("__edge") & ((h < 0.85 * body) | caps))
    drop_cap = (h >= 1.8 * body) & F.trim(t).rlike(r"^\p{L}['’]?$")
    return seen.withColumn("running", running).withColumn("heading", ~running & (h >= 1.25 * body) & ~drop_cap).drop("__edge", "__norm", "__times")


def chapter_of_pages(pages: DataFrame, keys: list[str], order: str, number: Column) -> DataFrame:
    """pages (header) with `chapter`: that of the last numbered head; before the first that one; pages in front of a new number belong to it once their head differs from the old title.

    The title of a chapter is the most frequent head that isn't a number, of equals the first.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    anchored = pages.withColumn("__a", number)
    filled = anchored.withColumn("__last", F.last("__a", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__next", F.first("__a", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    counts = filled.where("__a is null and header <> '' and __last is not null").groupBy(*keys, "__last", "header").agg(F.count("*").alias("n"), F.min(order).alias("f"))
    titles = counts.groupBy(*keys, F.col("__last").alias("__t")).agg(F.max(F.struct("n", (-F.col("f")).alias("neg"), "header")).alias("m")).select(*keys, "__t", F.col("m.header").alias("__title"))
    known = filled.join(titles.withColumnRenamed("__t", "__last"), [*keys, "__last"], "left")
    part = Window.partitionBy(*keys, "__last")
    last_same = F.max(F.when((F.col("header") == F.col("__title")) | F.col("__a").isNotNull(), F.col(order))).over(part)
    chapter = F.when(F.col("__last").isNull(), F.col("__next")).when((F.col(order) > last_same) & F.col("__next").isNotNull(), F.col("__next")).otherwise(F.col("__last"))
    return known.withColumn("chapter", chapter).drop("__a", "__last", "__next", "__title")


def borrowed_from_neighbours(pages: DataFrame, keys: list[str], order: str, column: str, wanting: Column) -> DataFrame:
    """A page that wants one takes the value of the page before, else after."""
    w = Window.partitionBy(*keys).orderBy(order)
    return pages.withColumn(column, F.when(wanting, F.coalesce(F.lag(column).over(w), F.lead(column).over(w))).otherwise(F.col(column)))


def _merge(lines: list[dict]) -> list[dict]:
    out: list[dict] = []
    for line in lines:
        last = out[-1] if out else None
        if last and last["rare"] == line["rare"]:
            high, low = max(last["h"], line["h"]), min(last["h"], line["h"])
            if abs(last["y"] - line["y"]) <= 0.15 * high and low > 0.6 * high:
                last["text"] = f"{last['text']} {line['text']}".strip()
                last["h"] = high
                continue
        out.append(dict(line))
    return out


def merged_baselines(lines: DataFrame) -> DataFrame:
    """page, pos, text, y, h, rare of lines (page, x, y, h, text, rare): fragments on one base line as one.

    A merged line's height decides about the next, so a page is folded in
    order; pages are one array each and never meet.
    """
    kind = "array<struct<text:string,y:double,h:double,rare:boolean>>"

    @F.pandas_udf(kind)
    def fold(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: _merge([dict(zip(("text", "y", "h", "rare"), (x["text"], x["y"], x["h"], x["rare"]))) for x in p]))

    packed = lines.groupBy("page").agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("neg"), "x", "text", "y", "h", "rare"))).alias("l"))
    return packed.select("page", F.posexplode(fold(F.transform("l", lambda x: F.struct(x["text"].alias("text"), x["y"].alias("y"), x["h"].alias("h"), x["rare"].alias("rare")))).cast(kind)).alias("pos", "z")).select("page", "pos", "z.*")


def fixed_paragraphs(body: float):
    """mapInPandas function over pages packed as (chapter, lines array<struct<page, text, x, y, h>>) -> (chapter, pos, text).

    A paragraph opens at a wide gap, or at an indent unless the line goes on in
    lower case; a drop cap joins the line beside it; hyphens at line ends go
    where the next line is lower case.
    """

    def one(lines: list[dict]) -> list[str]:
        by_page: dict[int, list[dict]] = {}
        for x in lines:
            by_page.setdefault(x["page"], []).append(x)
        out: list[str] = []
        cap = ""
        for page in sorted(by_page):
            rows = sorted(by_page[page], key=lambda r: (-r["y"], r["x"]))
            margin = min(r["x"] for r in rows)
            gaps = sorted(a["y"] - b["y"] for a, b in zip(rows, rows[1:]) if a["y"] > b["y"])
            pitch = gaps[len(gaps) // 2] if gaps else 0.0
            above = None
            for r in rows:
                text = r["text"].strip()
                if r["h"] >= 1.8 * body and len(text.strip("'’")) == 1:
                    cap = text
                    continue
                wide = above is not None and pitch and above - r["y"] > 1.6 * pitch
                indent = r["x"] - margin > 0.3 * body and not text[:1].islower()
                above = r["y"]
                if cap or not out or wide or indent:
                    out.append(cap + text)
                    cap = ""
                elif out[-1].endswith("-") and text[:1].islower():
                    out[-1] = out[-1][:-1] + text
                else:
                    out[-1] = f"{out[-1]} {text}"
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, i, t) for c, lines in zip(b["chapter"], b["lines"]) for i, t in enumerate(one(list(lines)))]
            yield pd.DataFrame(rows, columns=["chapter", "pos", "text"])

    return run
