"""Operators over ordered rows: islands, bounds, timelines, context, samples, batches, takes, evictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def envelope_trim(df: DataFrame, keys: list[str], order: str, start: Column, end: Column) -> DataFrame:
    """Rows after the first start (all, if there is none) and before the first end behind it.

    First places are found by aggregation and joined back, so no group is sorted.
    """
    first = df.groupBy(*keys).agg(F.min(F.when(start, F.col(order))).alias("__s"))
    marked = df.join(first, keys).where(F.col("__s").isNull() | (F.col(order) > F.col("__s")))
    last = marked.groupBy(*keys).agg(F.min(F.when(end, F.col(order))).alias("__e"))
    return marked.join(last, keys).where(F.col("__e").isNull() | (F.col(order) < F.col("__e"))).drop("__s", "__e")


def dense_range(df: DataFrame, keys: list[str], order: str, size: str, gap: int = 2, floor: float = 60.0, share: float = 0.35) -> DataFrame:
    """keys, first, last: the longest run of dense rows, sparse ones up to `gap` inside; ties to the earliest; all rows if none is dense.

    Dense: size at least max(floor, share * upper median).
    """
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(size)) - 1)
    median = ranked.where(F.col("__r") == F.floor(F.col("__n") / 2)).select(*keys, F.col(size).alias("__m"))
    bounds = df.groupBy(*keys).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    dense = df.join(median, keys).where(F.col(size) >= F.greatest(F.lit(floor), share * F.col("__m")))
    step = dense.withColumn("__new", (F.col(order) - F.lag(order).over(w.orderBy(order)) > gap + 1).cast("int"))
    runs = step.withColumn("__run", F.sum(F.coalesce("__new", F.lit(0))).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*keys, "__run").agg(F.min(order).alias("a"), F.max(order).alias("b"))
    best = spans.groupBy(*keys).agg(F.max(F.struct((F.col("b") - F.col("a")).alias("len"), (-F.col("a")).alias("neg"), "b")).alias("s"))
    return bounds.join(best, keys, "left").select(*keys, F.coalesce(-F.col("s.neg"), "__lo").alias("first"), F.coalesce(F.col("s.b"), "__hi").alias("last"))


def bounds(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Half-open ranges from each start to the next, the last to `end`."""
    return df.withColumn("stop", F.coalesce(F.lead(start).over(Window.partitionBy(*keys).orderBy(start)), F.col(end)))


def timeline(df: DataFrame, keys: list[str], order: list[str], length: Column, lead_in: Column | float = 0.0, places: int = 2) -> DataFrame:
    """start and end of rows laid end to end."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(length).over(before), F.lit(0.0)) + lead_in
    return df.withColumn("start", F.round(begin, places)).withColumn("end", F.round(begin + length, places))


def splice_shift(df: DataFrame, at: Column, order: Column, delta: Column, places: int = 2) -> DataFrame:
    """The row `at` ends later by delta, all rows after it start and end later."""
    later, here = order > at, order == at
    return df.withColumn("end", F.round(F.col("end") + F.when(here | later, delta).otherwise(0.0), places)).withColumn("start", F.round(F.col("start") + F.when(later, delta).otherwise(0.0), places))


def neighbours(df: DataFrame, keys: list[str], order: list[str], text: str, reach: int = 2) -> DataFrame:
    """before and after: the texts of up to `reach` rows on each side, joined by a space."""
    w = Window.partitionBy(*keys).orderBy(*order)
    side = lambda a, b: F.array_join(F.collect_list(text).over(w.rowsBetween(a, b)), " ")
    return df.withColumn("before", side(-reach, -1)).withColumn("after", side(1, reach))


def even_spread(df: DataFrame, keys: list[str], order: list[str], count: int) -> DataFrame:
    """At most `count` rows of a group, evenly spread: those at floor(i * n / count)."""
    w = Window.partitionBy(*keys)
    numbered = df.withColumn("__r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    # r is floor(i * n / count) of the least i with i * n / count >= r, if of any
    i = F.ceil(F.col("__r") * count / F.col("__n"))
    hit = (F.floor(i * F.col("__n") / count) == F.col("__r")) & (i < count)
    return numbered.where((F.col("__n") <= count) | hit).drop("__r", "__n")


def fixed_batches(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))


def budget_slices(sizes: Column, budget: int) -> Column:
    """Slice number of each element: a new slice opens when the last has something and would pass the budget."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("slice"))

    def step(a, x):
        new = (a["size"] > 0) & (a["size"] + x > budget)
        slice_ = a["slice"] + new.cast("int")
        return F.struct(F.array_append(a["out"], slice_).alias("out"), (F.when(new, F.lit(0).cast("long")).otherwise(a["size"]) + x).cast("long").alias("size"), slice_.alias("slice"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])


def best_take(df: DataFrame, keys: list[str], attempt: str, clean: Column, off: Column) -> DataFrame:
    """The first clean attempt; without any, the one nearest to what was expected, the first of equals."""
    rank = F.struct((~clean).cast("int"), F.when(clean, F.lit(0.0)).otherwise(off), F.col(attempt))
    columns = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(rank.alias("r"), F.struct(*columns).alias("row"))).alias("m"))
    return best.select(*keys, "m.row.*")


def greedy_eviction(df: DataFrame, keys: list[str], size: str, tie: str, needed: Column, reserve: float, total: Column) -> DataFrame:
    """Rows to stop, the largest first, until what stays leaves room for `needed` and the reserve."""
    w = Window.partitionBy(*keys)
    gone = F.coalesce(F.sum(size).over(w.orderBy(F.desc(size), tie).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("evict", F.sum(size).over(w) - gone + needed + reserve > total)


def anchor_fill(df: DataFrame, keys: list[str], order: str, anchor: str) -> DataFrame:
    """`filled`: the last anchor up to a row; rows before the first take that one."""
    w = Window.partitionBy(*keys).orderBy(order)
    back = F.last(anchor, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(anchor, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("filled", F.coalesce(back, ahead))


def trailing_trim(df: DataFrame, keys: list[str], order: str, keep: Column) -> DataFrame:
    """Rows up to the last that `keep` holds for."""
    last = df.groupBy(*keys).agg(F.max(F.when(keep, F.col(order))).alias("__last"))
    return df.join(last, keys).where(F.col(order) <= F.col("__last")).drop("__last")


def greedy_intervals(intervals: Column) -> Column:
    """array<struct<first, last>> in the order of answers: those that overlap none accepted before."""
    kind = "array<struct<first:bigint,last:bigint>>"
    clash = lambda a, x: F.exists(a, lambda y: (y["first"] <= x["last"]) & (x["first"] <= y["last"]))
    return F.aggregate(intervals.cast(kind), F.array().cast(kind), lambda a, x: F.when(clash(a, x), a).otherwise(F.concat(a, F.array(x))))


def nearest_occurrence(wanted: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """wanted (keys, text, at) with `found`: of the rows (keys, text, pos) with that text the nearest, the smaller of two; only where there is one.

    Both sides go through one sorted window, which looks back and ahead: no pairs are made.
    """
    both = wanted.select(*keys, "text", F.col("at").alias("__p"), F.lit(None).cast("long").alias("__pos")).unionByName(
        rows.select(*keys, "text", F.col("pos").alias("__p"), F.col("pos").cast("long").alias("__pos"))
    )
    w = Window.partitionBy(*keys, "text").orderBy("__p")
    before, after = F.max("__pos").over(w.rangeBetween(Window.unboundedPreceding, 0)), F.min("__pos").over(w.rangeBetween(0, Window.unboundedFollowing))
    near = F.when(after.isNull() | (F.col("__p") - before <= after - F.col("__p")), before).otherwise(after)
    return both.withColumn("found", near).where("__pos is null and found is not null").select(*keys, "text", F.col("__p").alias("at"), "found")
