"""Connected components of an edge table, without gathering any component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minimum(both).select("m_u", F.least("m", "m_u").alias("m"))
    return both.join(least, F.col("u") == F.col("m_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _minimum(edges)
    own = least.select(F.col("m_u").alias("u"), F.col("m").alias("v"))
    others = edges.join(least, F.col("u") == F.col("m_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(others).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for every node of an edge but the roots themselves.

    edges has u and v. Large and small stars alternate until nothing changes;
    each round is a written table. Minima are pre-aggregated, so a node with
    many edges costs no more than its edges.
    """
    state = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    while True:
        sign = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = sign
        after = materialize(_small_star(_large_star(state)), "cc")
        release(state)
        state = after
