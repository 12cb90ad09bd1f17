"""Statistics of page layout, and the rules that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """For each name the element at floor(n * fraction) of the sorted values, the last at most: an upper percentile.

    Values are counted first, so a group is as many rows as it has different values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("__end", F.sum("__c").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("__c").over(w))
    at = lambda f: F.least(F.col("__n") - 1, F.floor(F.col("__n") * f))
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("__end") > at(f), F.col("__v"))).alias(name) for name, f in fractions.items()])


def dominant(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`dominant`: the least value with half of the rows at or below it."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("dominant"))


def layout_bands(df: DataFrame, keys: list[str], y: str, size: str, height: Column) -> DataFrame:
    """body_min, body_max, header_y, footer_y, margin of a group of lines.

    Body is from 0.78 to 1.32 of the dominant size; lines under 0.85 of it in
    the upper or lower 14 % run along the page; a border lies between the upper
    medians of running lines and body lines of a zone, where they are in order.
    """
    body = dominant(df, keys, size)
    lines = df.withColumn("__h", height).join(body, keys)
    small = F.col(size) < 0.85 * F.col("dominant")
    top, bottom = F.col(y) < 0.14 * F.col("__h"), F.col(y) > 0.86 * F.col("__h")
    zone = F.when(top, "top").when(bottom, "bottom")
    named = lines.withColumn("__zone", F.concat_ws("_", zone, F.when(small, "run").otherwise("body")))
    medians = nearest_rank(named.where(zone.isNotNull()), [*keys, "__zone"], y, {"m": 0.5})
    of = lambda z: F.max(F.when(F.col("__zone") == z, F.col("m")))
    wide = medians.groupBy(*keys).agg(of("top_run").alias("tr"), of("top_body").alias("tb"), of("bottom_run").alias("br"), of("bottom_body").alias("bb"))
    border = lambda a, b: F.when(F.col(a) < F.col(b), (F.col(a) + F.col(b)) / 2)
    heights = lines.groupBy(*keys).agg(F.max("__h").alias("__h"))
    return body.join(heights, keys).join(wide, keys, "left").select(
        *keys, (0.78 * F.col("dominant")).alias("body_min"), (1.32 * F.col("dominant")).alias("body_max"),
        F.coalesce(border("tr", "tb"), F.lit(0.0)).alias("header_y"), F.coalesce(border("bb", "br"), F.col("__h")).alias("footer_y"),
    )


def rare(df: DataFrame, keys: list[str], group: str, weight: Column, share: float = 0.05) -> DataFrame:
    """Groups with less than `share` of the weight."""
    sums = df.groupBy(*keys, group).agg(F.sum(weight).alias("w"))
    return sums.withColumn("__t", F.sum("w").over(Window.partitionBy(*keys))).where(F.col("w") < share * F.col("__t")).drop("__t")


def mode_first_seen(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value, of equals the one seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first")).alias("neg"), F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias(value), F.col("m.n").alias("n"))


def weighted_mode(df: DataFrame, keys: list[str], value: Column, weight: Column, order: str) -> DataFrame:
    """`mode`: the value with most weight, of equals the one seen first."""
    sums = df.groupBy(*keys, value.alias("__v")).agg(F.sum(weight).alias("w"), F.min(order).alias("first"))
    return sums.groupBy(*keys).agg(F.max(F.struct("w", (-F.col("first")).alias("neg"), F.col("__v").alias("v"))).alias("m")).select(*keys, F.col("m.v").alias("mode"))


def skew(df: DataFrame, key: str, x: str, y: str, least: Column) -> DataFrame:
    """Theil-Sen angle of a page's lines: the median of slopes of pairs far enough apart, three at least; else 0.

    Pairs are made inside one row, whose array is one page's lines.
    """
    page = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(y, x))).alias("p"), F.max(least).alias("far"))
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice(F.col("p"), i + 2, F.size("p")), lambda b: F.struct((b[x] - a[x]).alias("dx"), (b[y] - a[y]).alias("dy")))))
    slopes = page.withColumn("s", F.array_sort(F.transform(F.filter(pairs, lambda d: F.abs(d["dy"]) >= F.col("far")), lambda d: d["dx"] / d["dy"])))
    n = F.size("s")
    mid = (F.element_at("s", F.floor((n + 1) / 2).cast("int")) + F.element_at("s", F.floor(n / 2).cast("int") + 1)) / 2
    return slopes.select(key, F.when(n >= 3, -F.atan(mid)).otherwise(0.0).alias("angle"))


def line_groups(df: DataFrame, keys: list[str], y: str, order: list[str], gap: float = 3.0) -> DataFrame:
    """`line`: a new line opens where y moves by more than `gap` from the span before."""
    w = Window.partitionBy(*keys).orderBy(y, *order)
    new = F.coalesce((F.col(y) - F.lag(y).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn("line", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def paragraph_groups(df: DataFrame, keys: list[str], order: list[str], opens: Column, closed: Column) -> DataFrame:
    """`paragraph`: a line opens one if `opens` holds for it or `closed` for the line before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("__o", F.coalesce((opens | F.lag(closed).over(w)).cast("int"), F.lit(0)))
    return flagged.withColumn("paragraph", F.sum("__o").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__o")


def glyph_votes(words: DataFrame, lexicon: DataFrame, mark: str = "?", alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> DataFrame:
    """mark in words (word) with exactly one mark: votes for each letter, a vote for each different word that it completes (three letters at least)."""
    one = words.select("word").distinct().where((F.length("word") - F.length(F.replace("word", F.lit(mark), F.lit("")))) == 1)
    tried = one.select("word", F.explode(F.split(F.lit(alphabet), "")).alias("letter")).where("letter <> ''").withColumn("form", F.lower(F.expr(f"replace(word, '{mark}', letter)")))
    return tried.where(F.length("form") >= 3).join(lexicon.select("form").distinct(), "form", "left_semi").groupBy("letter").agg(F.count("*").alias("votes"))
