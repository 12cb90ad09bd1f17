"""Homomorphic multiset hashes of documents.

A text is a bag of paragraphs; long paragraphs are cut further behind
punctuation and after eight words. Every piece is hashed to a wide vector, and a
document's fingerprint is the sum of its pieces' vectors modulo powers of two.
So the order of pieces doesn't matter, and a piece is inserted or deleted by
adding or subtracting its vector (combine()).

The vector has two parts. Exact lanes hold 32-bit halves of 64-bit hashes,
summed modulo 2**32: they tell bags apart. Sketch lanes hold plus or minus the piece's
weight, summed modulo 2**32, which no single text reaches: the cosine of two sums estimates
the cosine of the two bags. Printed fingerprints show sketch lanes modulo 2**16.

Only DataFrame and SQL expressions; two lanes of ones are counted in one long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A piece: up to eight words of a line; a word that ends in punctuation or a symbol is its last.
PIECE = r"(?:[^\s]*[\p{L}\p{N}][ \t]+){0,7}[^\s]+"
SEEDS = (101, 102)  # 64 sketch lanes each
EXACT_SEEDS = (201, 202)  # two exact lanes each
PAIR = 0x0000000100000001
LANES = 64 * len(SEEDS)


def _sums(piece: Column) -> list[Column]:
    """Aggregates of the pieces of a group; an empty piece adds nothing.

    A piece's sketch is scaled by its length in eights, 8 at most, so that short pieces
    that repeat often don't drown the others.
    """
    weight = F.least(F.lit(8), F.expr("(length(piece) + 7) div 8"))
    hashed = lambda seed: F.xxhash64(F.lit(seed), piece)
    ones = [
        F.sum(F.shiftrightunsigned(hashed(seed), i).bitwiseAND(F.lit(PAIR)) * weight).alias(f"s{seed}_{i}")
        for seed in SEEDS
        for i in range(32)
    ]
    exact = [
        F.sum(F.when(piece != "", part).otherwise(0)).alias(f"e{seed}_{k}")
        for seed in EXACT_SEEDS
        for k, part in enumerate((hashed(seed).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(hashed(seed), 32)))
    ]
    return [F.sum(weight).alias("weight"), *ones, *exact]


def _vector() -> tuple[Column, Column]:
    """exact: array of 32-bit values; sketch: array of centred 32-bit values."""
    lanes = [
        half
        for seed in SEEDS
        for i in range(32)
        for half in (F.col(f"s{seed}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"s{seed}_{i}"), 32))
    ]
    half = 1 << 31
    centred = [F.pmod(2 * x - F.col("weight") + half, F.lit(2 * half)) - half for x in lanes]
    exact = [F.col(f"e{seed}_{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for seed in EXACT_SEEDS for k in (0, 1)]
    return F.array(*exact), F.array(*[x.cast("int") for x in centred])


def bag_hashes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, exact, sketch of every row of df; rows with equal keys are summed together."""
    pieces = df.select(*keys, F.explode_outer(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))).alias("piece")).fillna("", ["piece"])
    exact, sketch = _vector()
    return pieces.groupBy(*keys).agg(*_sums(F.col("piece"))).select(*keys, exact.alias("exact"), sketch.alias("sketch"))


def combine(a: Column, b: Column, bits: int, sign: int = 1, centred: bool = False) -> Column:
    """Lane by lane a + b (or a - b) modulo 2**bits: insertion, or deletion, of a bag.

    Exact lanes have 32 bits, sketch lanes 32 centred ones; 16 bits, always centred, are the lanes that fingerprints print.
    """
    centred = centred or bits == 16
    half = F.lit(1 << (bits - 1) if centred else 0).cast("long")
    total = F.zip_with(a, b, lambda x, y: F.pmod(x.cast("long") + sign * y.cast("long") + half, F.lit(1 << bits).cast("long")) - half)
    return F.transform(total, lambda x: x.cast("smallint" if bits == 16 else "int")) if centred else total


def as_text(exact: Column, sketch: Column) -> Column:
    """The fingerprint in hexadecimal digits: exact lanes, then sketch lanes modulo 2**16, four to a long."""
    heads = [F.lpad(F.lower(F.hex(F.element_at(exact, i + 1).cast("long"))), 8, "0") for i in range(2 * len(EXACT_SEEDS))]
    quad = lambda i: sum(
        F.shiftleft(F.element_at(sketch, 4 * i + j + 1).cast("long").bitwiseAND(F.lit(0xFFFF)), 48 - 16 * j) for j in range(4)
    )
    return F.concat(*heads, *[F.lpad(F.lower(F.hex(quad(i))), 16, "0") for i in range(LANES // 4)])


def likeness(exact_a: Column, a: Column, exact_b: Column, b: Column) -> Column:
    """1 for equal fingerprints; else the cosine of the sketches, in [0, 1). An empty bag is like nothing else."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    cosine = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1 - 1e-9), dot(a, b) / norm))).otherwise(0.0)
    return F.when((exact_a == exact_b) & (a == b), 1.0).otherwise(cosine)


NO_ID = -(1 << 63)  # stands for a null doc_id


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """k, h, copy and more columns. k is doc_id with a stand-in for null, h a hash of the text; copy numbers rows of one doc_id by h."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), *more)
    return base.withColumn("copy", F.row_number().over(Window.partitionBy("k").orderBy("h")))


def successors(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """k, copy, q, next_k, next_copy: each row and the next one by ascending doc_id, the first after the last.

    Only keys and lengths move. They are dealt by range; a range's last row
    takes the first of the next range from a table of one row per range.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = materialize(
        _keyed(docs, F.length(F.coalesce("text", F.lit(""))).alias("n")).select("k", "copy", "n").repartitionByRange(ranges, "k", "copy").withColumn("part", F.spark_partition_id()),
        "bag-ids",
    )
    firsts = ids.groupBy("part").agg(F.min(F.struct("k", "copy")).alias("first"))
    over = Window.partitionBy().orderBy("part")
    whole = Window.partitionBy()
    firsts = firsts.select(
        F.col("part").alias("f_part"),
        F.coalesce(F.lead("first").over(over), F.min("first").over(whole)).alias("follows"),
    )
    row = Window.partitionBy("part").orderBy("k", "copy")
    return (
        ids.withColumn("next", F.lead(F.struct("k", "copy")).over(row))
        .join(F.broadcast(firsts), F.col("part") == F.col("f_part"))  # a row per range
        .withColumn("next", F.coalesce("next", "follows"))
        .select("k", "copy", F.expr("n div 4").alias("q"), F.col("next.k").alias("next_k"), F.col("next.copy").alias("next_copy"))
    )


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how alike they are.

    A document's edited text has its last floor(n/4) code points replaced by
    as many from the start of the next document (all of a shorter one).

    Defined cases: a null text is empty, and an empty bag has the all-zero
    fingerprint; a null doc_id comes first; rows with one doc_id follow each
    other by hash of text; a table of one row is its own successor; an empty
    table gives no rows; columns beyond doc_id and text are not read.

    Texts cross the network once, dealt by doc_id: both joins below ask for the
    same columns of `texts`, so they read one exchange. Only the heads that
    neighbours need, and the vectors, move again.
    """
    texts = _keyed(docs, F.coalesce("text", F.lit("")).alias("text"))
    wanted = successors(docs).select(F.col("next_k").alias("w_k"), F.col("next_copy").alias("w_copy"), F.col("k").alias("to_k"), F.col("copy").alias("to_copy"), "q")
    # the difference keeps `copy` out of the join's key, so that texts stay where they are
    heads = texts.join(wanted, (F.col("k") == F.col("w_k")) & (F.col("copy") - F.col("w_copy") == 0)).select(
        "to_k", "to_copy", F.col("k").alias("next_k"), F.col("copy").alias("next_copy"),
        F.col("q").alias("h_q"), F.substring("text", F.lit(1), F.col("q").cast("int")).alias("head"),
    )
    row = ["k", "copy", "next_k", "next_copy", "n", "sha"]
    both = (
        texts.join(heads, (F.col("k") == F.col("to_k")) & (F.col("copy") - F.col("to_copy") == 0))
        .select(
            "k", "copy", "next_k", "next_copy", "text", F.length("text").alias("n"),
            F.concat(F.substring("text", F.lit(1), (F.length("text") - F.col("h_q")).cast("int")), "head").alias("edited"),
        )
        .withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256))
        .select(*row, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("v"))
        .select(*row, F.col("v.kind").alias("kind"), F.col("v.t").alias("t"))
    )
    # the two vectors of a row meet where its pieces were summed
    hashed = materialize(
        bag_hashes(both, [*row, "kind"], "t")
        .groupBy(*row)
        .agg(F.array_sort(F.collect_list(F.struct("kind", "exact", "sketch"))).alias("v"))
        .select(*row, *[F.col("v")[i][c].alias(f"{c}{i}") for i in (0, 1) for c in ("exact", "sketch")]),
        "bag-hashes",
    )
    other = hashed.select(F.col("k").alias("o_k"), F.col("copy").alias("o_copy"), F.col("exact0").alias("exact2"), F.col("sketch0").alias("sketch2"))
    return hashed.join(other, (F.col("next_k") == F.col("o_k")) & (F.col("next_copy") == F.col("o_copy"))).select(
        F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        as_text(F.col("exact0"), F.col("sketch0")).alias("fingerprint"),
        as_text(F.col("exact1"), F.col("sketch1")).alias("edited_fingerprint"),
        likeness(*[F.col(c) for c in ("exact0", "sketch0", "exact1", "sketch1")]).alias("near_edited"),
        likeness(*[F.col(c) for c in ("exact0", "sketch0", "exact2", "sketch2")]).alias("near_next"),
    )
