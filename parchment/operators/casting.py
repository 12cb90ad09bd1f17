"""Casts of voices, reuse of takes, currency of tracks, signatures, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_clean_takes(takes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last usable take. takes has clean, start, end."""
    usable = takes.where(F.coalesce("clean", F.lit(True)) & (F.col("end") > F.col("start")))
    rest = [c for c in usable.columns if c not in keys]
    return usable.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def reuse_plan(segments: DataFrame, takes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """segments with `action`: reuse where a usable take of the same text and voice exists, else render."""
    known = last_clean_takes(takes, keys, order).select(*keys, F.lit(True).alias("__known"))
    return segments.join(known, keys, "left").withColumn("action", F.when(F.col("__known"), "reuse").otherwise("render")).drop("__known")


def track_currency(segments: DataFrame, manifest: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """key, n_segments, n_manifest, current: whether manifest and segments say the same in the same places."""
    side = segments.select(key, order, F.col(text).alias("__a"), F.lit(1).alias("__s"))
    other = manifest.select(key, order, F.col(text).alias("__b"), F.lit(1).alias("__m"))
    both = side.join(other, [key, order], "full")
    return both.groupBy(key).agg(
        F.count("__s").alias("n_segments"), F.count("__m").alias("n_manifest"),
        F.bool_and(F.col("__s").isNotNull() & F.col("__m").isNotNull() & F.col("__a").eqNullSafe(F.col("__b"))).alias("current"),
    )


def effective_voices(cast: DataFrame, segments: DataFrame, role: str = "role") -> DataFrame:
    """Rows of the cast whose role some segment has, case aside, and whose voice isn't empty."""
    used = segments.select(F.lower(role).alias("__r")).distinct()
    return cast.where(F.coalesce(F.col("voice"), F.lit("")) != "").join(used, F.lower(F.col(role)) == F.col("__r"), "left_semi")


def cast_diagnostics(cast: DataFrame, segments: DataFrame, role: str = "role") -> DataFrame:
    """role key, issue: voices without segments, and roles without a voice."""
    a = cast.select(F.lower(role).alias("k"), F.lit(1).alias("c")).distinct()
    b = segments.select(F.lower(role).alias("k"), F.lit(1).alias("s")).distinct()
    return a.join(b, "k", "full").where("c is null or s is null").select("k", F.when(F.col("s").isNull(), "voice without segments").otherwise("role without voice").alias("issue"))


def resolve(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """wanted (w) with `found` of the catalogue (name): the exact name, else the only one equal but for case, else the only one that contains it.

    Equalities are hash joins; only names that they leave open meet the catalogue by substring, and there only names that share a run of letters.
    """
    names = catalogue.select("name").distinct()
    asked = wanted.select("w").distinct()
    exact = asked.join(names, F.col("w") == F.col("name")).select("w", "name")
    open_ = asked.join(exact, "w", "left_anti")
    only = lambda hits: hits.groupBy("w").agg(F.min("name").alias("name"), F.count("*").alias("n")).where("n = 1").select("w", "name")
    same = only(open_.join(names, F.lower("w") == F.lower("name")))
    left = open_.join(same, "w", "left_anti")
    # a name that contains w contains its first three letters, so names are keyed by all runs of up to three
    low = names.withColumn("low", F.lower("name"))
    runs = F.flatten(F.transform(F.array(*[F.lit(k) for k in (1, 2, 3)]), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("low") - k + 1)), lambda i: F.substring(F.col("low"), i, k))))
    keyed = low.select("name", "low", F.explode(F.array_distinct(runs)).alias("run"))
    part = only(left.withColumn("run", F.substring(F.lower("w"), 1, 3)).join(keyed, "run").where(F.contains("low", F.lower("w"))))
    return wanted.join(exact.unionByName(same).unionByName(part).withColumnRenamed("name", "found"), "w", "left")


def signature(backend: Column, voice: Column, roles: Column, speed: Column) -> Column:
    """backend/voice+role=voice...@speed, roles by name regardless of case."""
    parts = F.transform(F.array_sort(F.transform(F.map_entries(roles), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["key"].alias("role"), e["value"].alias("voice")))), lambda e: F.concat(F.lit("+"), e["role"], F.lit("="), e["voice"]))
    return F.concat(backend, F.lit("/"), voice, F.array_join(parts, ""), F.lit("@"), F.format_string("%.2f", speed))


def parse_signature(c: Column) -> Column:
    """struct<backend, voice, roles, speed>; a part without = is the dialogue's voice."""
    body, speed = F.regexp_extract(c, "^(.*)@([^@]*)$", 1), F.regexp_extract(c, "^(.*)@([^@]*)$", 2)
    parts = F.split(body, r"\+")
    head = parts[0]
    roles = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.when(F.contains(p, F.lit("=")), F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v"))).otherwise(F.struct(F.lit("dialogue").alias("k"), p.alias("v"))))
    return F.struct(F.substring_index(head, "/", 1).alias("backend"), F.regexp_replace(head, "^[^/]*/", "").alias("voice"), F.map_from_entries(roles).alias("roles"), speed.cast("double").alias("speed"))


def keep_first(df: DataFrame, name: str, order: str) -> DataFrame:
    """Names that differ by more than case, each as it was first written."""
    return df.groupBy(F.lower(name).alias("key")).agg(F.min_by(name, order).alias(name))


def suffix_join(names: DataFrame, hrefs: DataFrame) -> DataFrame:
    """names (name) with `title` of hrefs (href, title, pos): that of the equal href, else of the first that the name ends with.

    Both sides are keyed by their last path part, so only hrefs of one file name are compared.
    """
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    joined = names.withColumn("__k", last(F.col("name"))).join(hrefs.withColumn("__k", last(F.col("href"))), "__k").where(F.endswith("name", F.col("href")))
    best = joined.groupBy("name").agg(F.min(F.struct((F.col("name") != F.col("href")).alias("other"), "pos", "title")).alias("m"))
    return names.join(best.select("name", F.col("m.title").alias("title")), "name", "left")
