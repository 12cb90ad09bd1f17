"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of words. Water-filling gives every source its
target; whole passes over the source's blocks and a prefix of a permuted order
give its exact block quota. A binary tree hands these quotas down to output
shards: each inner node draws, from the multivariate hypergeometric law, how
many blocks of every source go left. A leaf then owns, for each source, a range
of the permuted order that no other leaf has, and shuffles what it owns.

Everything is DataFrame and SQL expressions. No source is gathered anywhere: a
source is dealt into hash buckets of bounded size, and only counts of buckets
are summed along a source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Positions of a source's permuted order that share one key of the range join.
CELL = 4096
#: Buckets or shards that are added up together.
STRETCH = 4096


def word_counts(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, th (hash of the text), size of every row. The table is written, so row stays as it is."""
    return materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "source",
            F.xxhash64("text").alias("th"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )


def source_targets(sizes: DataFrame, weights=(3, 1, 2), ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: idx, source, source_size, target.

    Sources go by code point, null last, and take the weights in turn. Each gets
    min(cap * size, level * weight); the level that spends ratio * all sizes is
    the largest of the levels that remain when the sources with the least
    cap/weight are full. The window runs over one row per source.
    """
    one = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("idx") % len(weights)) + 1).cast("int"))
    by_cap = Window.partitionBy().orderBy(F.col("most") / F.col("w"), "idx")
    s = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("idx", (F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
        .withColumn("w", w)
        .withColumn("most", cap * F.col("source_size"))
        .withColumn("spent", F.coalesce(F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (ratio * F.sum("source_size").over(one) - F.col("spent")) / F.col("rest"))
        .withColumn("level", F.max("level").over(one))
    )
    return s.select("idx", "source", "source_size", F.least("most", F.col("level") * F.col("w")).alias("target"))


def split_quota(quotas: str, take: str, seed: int) -> str:
    """SQL: for each source the blocks that go left when `take` of all are drawn at random.

    One univariate hypergeometric draw after the other. Each inverts the law
    within ten standard deviations of the mode; the ratio of neighbouring
    probabilities gives the weights, a hash of node and source the uniform number.
    """
    def walk(start: str, step: str) -> str:
        return f"aggregate(sequence(a.lo, a.hi), {start}, (s, k) -> {step})"

    ratio = "(double(a.kk - k) * double(a.nn - k)) / (double(k + 1) * double(a.tt - a.kk - a.nn + k + 1))"
    total = walk("named_struct('w', 1D, 'sum', 0D)", f"named_struct('w', s.w * {ratio}, 'sum', s.sum + s.w)")
    found = walk(
        "named_struct('w', 1D, 'sum', 0D, 'at', a.lo - 1)",
        f"named_struct('w', s.w * {ratio}, 'sum', s.sum + s.w, 'at', if(s.sum <= a.aim, k, s.at))",
    )
    mode = "(double(nn) + 1) * (double(kk) + 1) / (double(tt) + 2)"
    wide = "10 * sqrt(double(nn) * kk / tt * (double(tt) - kk) / tt * (double(tt) - nn) / greatest(tt - 1, 1)) + 10"
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    bounds = (
        "named_struct('tt', r.tt, 'nn', r.nn, 'kk', r.kk,"
        f" 'lo', greatest(0L, r.nn - (r.tt - r.kk), cast(floor({mode.replace('nn', 'r.nn').replace('kk', 'r.kk').replace('tt', 'r.tt')} - ({wide.replace('nn', 'r.nn').replace('kk', 'r.kk').replace('tt', 'r.tt')})) as bigint)),"
        f" 'hi', least(r.kk, r.nn, cast(ceil({mode.replace('nn', 'r.nn').replace('kk', 'r.kk').replace('tt', 'r.tt')} + ({wide.replace('nn', 'r.nn').replace('kk', 'r.kk').replace('tt', 'r.tt')})) as bigint)))"
    )
    uniform = f"(shiftrightunsigned(xxhash64({seed}, depth, node, i), 11) / {float(1 << 53)!r}D)"
    aimed = f"named_struct('tt', b.tt, 'nn', b.nn, 'kk', b.kk, 'lo', b.lo, 'hi', b.hi, 'aim', {let('a', 'b', total)}.sum * {uniform})"
    draw = let("b", bounds, let("a", aimed, found) + ".at")
    drawn = f"if(q = 0 or left.nn = 0, 0L, if(left.tt = left.nn, q, {let('r', 'named_struct(' + chr(39) + 'tt' + chr(39) + ', left.tt, ' + chr(39) + 'nn' + chr(39) + ', left.nn, ' + chr(39) + 'kk' + chr(39) + ', q)', draw)}))"
    step = (
        "transform(array(struct(element_at({q}, left.i + 1) as q, left.i as i)), e -> {inner})[0]"
    )
    inner = let("q", "e.q", let("i", "e.i", let("d", drawn, "named_struct('i', left.i + 1, 'tt', left.tt - q, 'nn', left.nn - d, 'out', array_append(left.out, d))")))
    return (
        f"aggregate({quotas}, named_struct('i', 0, 'tt', aggregate({quotas}, 0L, (x, y) -> x + y), 'nn', {take}, 'out', cast(array() as array<bigint>)),"
        f" (left, unused) -> {step.format(q=quotas, inner=inner)}, left -> left.out)"
    )


def split_tree(quotas: DataFrame, levels: int, seed: int = 11) -> DataFrame:
    """node (0 .. 2**levels - 1) and its exact quotas, from one row with the array `quotas`."""
    tree = quotas.select(F.lit(0).cast("long").alias("node"), "quotas")
    for depth in range(levels):
        if depth == 5:  # 32 nodes by now: let more tasks draw
            tree = tree.repartition(32, "node")
        left = split_quota("quotas", "(aggregate(quotas, 0L, (x, y) -> x + y) + 1) div 2", seed)
        tree = tree.withColumn("depth", F.lit(depth)).select(
            "node",
            F.explode(F.expr(f"transform(array({left}), l -> array(named_struct('side', 0, 'q', l), named_struct('side', 1, 'q', zip_with(quotas, l, (x, y) -> x - y))))[0]")).alias("half"),
        )
        tree = tree.select((F.col("node") * 2 + F.col("half.side")).alias("node"), F.col("half.q").alias("quotas"))
    return tree


def sums_before(df: DataFrame, key: str, at: str, columns: dict[str, str], width: int = STRETCH) -> DataFrame:
    """df with, for each column, the sum of it over the rows of `key` before `at` (a whole number from 0).

    In two steps: stretches of `width` places are summed, these sums are added up along a key, and rows only
    within their stretch. So no task holds more than a stretch, or a key's stretches.
    """
    cut = df.withColumn("stretch", F.expr(f"`{at}` div {width}"))
    whole = cut.groupBy(F.col(key).alias("s_key"), F.col("stretch").alias("s_stretch")).agg(*[F.sum(c).alias(f"s_{c}") for c in columns])
    along = Window.partitionBy("s_key").orderBy("s_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("s_key", "s_stretch", *[F.coalesce(F.sum(f"s_{c}").over(along), F.lit(0)).alias(f"s_{c}") for c in columns])
    inside = Window.partitionBy(key, "stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumns({f"i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
        .join(starts, (F.col(key) == F.col("s_key")) & (F.col("stretch") == F.col("s_stretch")))
        .select(*df.columns, *[(F.col(f"i_{c}") + F.col(f"s_{c}")).alias(name) for c, name in columns.items()])
    )


def mix(docs: DataFrame, *, weights=(3, 1, 2), ratio: float = 1.5, cap: float = 2.0, block_words: int = 512, shard_blocks: int = 4096, bucket_blocks: int = 2_000, seed: int = 11) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Draw the mix. Returns (draws, sizes, targets).

    draws has a row per drawn block: shard, slot (its place in the shard), row,
    doc_id, source, block, pass, words. sizes and targets are as word_counts()
    and source_targets() give them.

    Defined cases: a null or empty text has size 0 and is never drawn; a null
    source is a source of its own, the last; rows that repeat a doc_id, or a
    whole row, are separate documents; an empty table gives no draws; columns
    beyond doc_id, source and text are not read. The blocks' order comes from
    hashes of doc_id, text and block, so reruns agree, whatever the order of rows;
    rows that are equal in these take each other's place.

    Sources are few: one row holds the quotas of all of them, and each node of
    the tree draws for all. A million hosts as sources aren't meant.
    """
    sizes = word_counts(docs)
    targets = materialize(source_targets(sizes, weights, ratio, cap), "mix-targets")
    plan = targets.select(
        F.col("source").alias("of"), "idx", "source_size",
        F.round("target").cast("long").alias("aim"),
    ).withColumn("full", F.when(F.col("source_size") > 0, F.expr("aim div source_size")).otherwise(0))
    plan = plan.withColumn("extra", F.col("aim") - F.col("full") * F.col("source_size"))

    n_blocks = sizes.agg(F.sum(F.ceil(F.col("size") / block_words))).first()[0] or 0
    buckets = max(1, math.ceil(n_blocks / bucket_blocks))
    blocks = (
        sizes.where("size > 0")
        .join(plan, F.col("source").eqNullSafe(F.col("of")))
        .select(
            "row", "doc_id", "source", "th", "idx", "full", "extra", "size",
            F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / block_words) - 1)).alias("block"),
        )
        .withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words))
        .withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "th", "block"))
        .withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    )
    counted = blocks.groupBy("idx", "bucket").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    totals = counted.groupBy(F.col("idx").alias("t_idx")).agg(F.sum("n").alias("n_source"))  # a row a source
    bases = (
        sums_before(counted, "idx", "bucket", {"w": "w0", "n": "n0"})
        .join(totals, F.col("idx") == F.col("t_idx"))
        .select(F.col("idx").alias("b_idx"), F.col("bucket").alias("b_bucket"), "w0", "n0", "n_source")
    )
    inside = Window.partitionBy("idx", "bucket").orderBy("h", "doc_id", "th", "block", "row")  # rows that are equal take each other's place
    ranked = (
        blocks.withColumn("w_in", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        .withColumn("n_in", F.row_number().over(inside) - 1)
        .join(bases, (F.col("idx") == F.col("b_idx")) & (F.col("bucket") == F.col("b_bucket")))
        .withColumn("part", F.greatest(F.lit(0), F.least("words", F.col("extra") - F.col("w0") - F.col("w_in"))))
        .withColumn("times", F.col("full") + F.when(F.col("part") > 0, 1).otherwise(0))
        .where("times > 0")
    )
    drawn = materialize(
        ranked.select(
            "row", "doc_id", "source", "idx", "block", "h", "part", "full", "n_source",
            F.col("words").alias("whole"), (F.col("n0") + F.col("n_in")).alias("rank"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("pass"),
        ).select(
            "row", "doc_id", "source", "idx", "block", "pass",
            F.when(F.col("pass") <= F.col("full"), F.col("whole")).otherwise(F.col("part")).alias("words"),
            ((F.col("pass") - 1) * F.col("n_source") + F.col("rank")).alias("pos"),
            F.xxhash64(F.lit(seed + 1), "h", "pass").alias("order"),
        ),
        "mix-drawn",
    )

    counts = drawn.groupBy("idx").agg(F.count("*").alias("n"))
    n_drawn = counts.agg(F.sum("n")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(1, n_drawn / shard_blocks))))
    quotas = (
        targets.join(counts, "idx", "left")
        .agg(F.expr("transform(array_sort(collect_list(struct(idx, coalesce(n, 0L) as n))), x -> x.n)").alias("quotas"))
    )
    leaves = split_tree(quotas, levels, seed).select(F.col("node").alias("shard"), F.posexplode("quotas").alias("l_idx", "n")).where("n > 0")
    ranges = (
        sums_before(leaves, "l_idx", "shard", {"n": "lo"})
        .withColumn("hi", F.col("lo") + F.col("n") - 1)
        .withColumn("l_cell", F.explode(F.expr(f"sequence(lo div {CELL}, hi div {CELL})")))
    )
    draws = drawn.join(
        ranges,
        (F.col("idx") == F.col("l_idx")) & (F.expr(f"pos div {CELL}") == F.col("l_cell")) & F.col("pos").between(F.col("lo"), F.col("hi")),
    ).select(
        "shard",
        F.row_number().over(Window.partitionBy("shard").orderBy("order", "row", "block", "pass")).alias("slot"),
        "row", "doc_id", "source", "block", "pass", "words",
    )
    return draws, sizes, targets


def mix_by_document(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, n_shards of every row of docs."""
    draws, sizes, targets = mix(docs, **options)
    taken = draws.groupBy(F.col("row").alias("t_row")).agg(F.sum("words").alias("t"), F.count_distinct("shard").alias("s"))
    named = targets.select(F.col("source").alias("of"), "source_size", "target")
    return (
        sizes.join(taken, F.col("row") == F.col("t_row"), "left")
        .join(named, F.col("source").eqNullSafe(F.col("of")))
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("t", F.lit(0)).cast("long").alias("taken"), F.coalesce("s", F.lit(0)).alias("n_shards"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with `taken` (words of it in the mix, repeats counted), without what the mix leaves out.

    Cases are as mix() defines them; rows with one doc_id and text become one, and take what they took together; a column
    `taken` of docs gives way.
    """
    draws, sizes, _ = mix(docs, **options)
    taken = (
        draws.groupBy(F.col("row").alias("t_row")).agg(F.sum("words").alias("t"))
        .join(sizes, F.col("t_row") == F.col("row"))
        .groupBy(F.col("doc_id").alias("__t_id"), F.col("th").alias("__t_th")).agg(F.sum("t").cast("long").alias("taken"))
    )
    keyed = docs.drop("taken").withColumn("__th", F.xxhash64("text"))
    joined = keyed.join(taken, F.col("doc_id").eqNullSafe(F.col("__t_id")) & (F.col("__th") == F.col("__t_th")))
    return joined.dropDuplicates(["doc_id", "__th"]).drop("__th", "__t_id", "__t_th")
