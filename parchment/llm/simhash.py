"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into two halves and each half into 24 segments, 8 of two
bits and 16 of one; a half's vector of segment popcounts is a point of a grid. Flipping a bit moves a point
by one step, so the Manhattan distance of points is a lower bound of the
Hamming distance: fingerprints within 4 bits are within 2 steps in one half at
least. Such points have a grid cell within one step of both, so every
fingerprint goes to its own cells and their neighbours, and meets there all it
can link to. Pairs of a cell are verified exactly, and a cell reports a star of
each group it finds instead of the group's pairs.

A cell with more than CELL_MOST members isn't held. Its members go another
exact way: to all values within two bits of themselves. Two fingerprints within
4 bits share such a value, and all that share one are within 4 bits, so stars
need no verification there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_batches
from .components import components

SHINGLE = 4
RADIUS = 4
CELL_MOST = 1024

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash, as a signed number, of word shingles; no words give 0."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(size, len(words))
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    hashed = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashed), 1 << 16):  # a very long text's bits aren't unpacked at once
        bits = np.unpackbits(hashed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view(np.int64)[0])


def fingerprint(text: str = "text") -> Column:
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t) for t in texts], dtype="int64")

    return hashed(text)


def cells(fp: Column) -> Column:
    """The cells of both halves: each half's point and the points one step away; null where the grid ends.

    A cell is the half's number, 16 popcounts of one bit and 8 of two bits.
    """
    out = []
    for half in (0, 1):
        x = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        pairs = x.bitwiseAND(F.lit(0x5555)) + F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x5555))
        here = x.bitwiseAND(F.lit(0xFFFF0000)) + pairs + F.lit(half << 32)
        out.append(here)
        out += [here.bitwiseXOR(F.lit(1 << i)) for i in range(16, 32)]
        for i in range(0, 16, 2):
            count = F.shiftrightunsigned(pairs, i).bitwiseAND(F.lit(3))
            out.append(F.when(count < 2, here + F.lit(1 << i)))
            out.append(F.when(count > 0, here - F.lit(1 << i)))
    return F.array(*out)


def stars(members: np.ndarray) -> list[tuple[int, int]]:
    """(member, least of its group) of the groups that verified pairs make in one cell."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= RADIUS
    if near.sum() == len(members):
        return []
    label = np.arange(len(members))
    while True:
        new = np.where(near, label[None, :], len(members)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    ids = members.view(np.int64)
    return [(int(ids[i]), int(ids[k])) for i, k in enumerate(label) if i != k]


def edges_of(cell: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """Edges of whole cells, given in runs. Cells of one size are looked at together."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    edges: list[tuple[int, int]] = []
    for size in np.unique(sizes[sizes > 1]).tolist():
        own = starts[sizes == size]
        step = max(1, (1 << 21) // size**2)
        for at in range(0, len(own), step):
            block = fp[own[at : at + step, None] + np.arange(size)].view(np.uint64)
            near = np.bitwise_count(block[:, :, None] ^ block[:, None, :]) <= RADIUS
            for i in np.flatnonzero(near.sum(axis=(1, 2)) > size):
                edges += stars(block[i])
    return edges


def meet(most: int):
    """From rows sorted by cell: kind 0, edges (u, v) of cells with `most` members at most; kind 1, members u of larger cells.

    What is held is a batch and one unfinished cell, which is never larger than `most`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        large = None  # the cell that was given up last

        def give(final: bool) -> pd.DataFrame:
            nonlocal cell, fp, large
            crowded = [fp[cell == large]] if large is not None else []
            if crowded:
                fp, cell = fp[cell != large], cell[cell != large]
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(cell)])
            over = np.repeat(sizes > most, sizes)
            if len(over) and over[-1]:
                large = cell[-1]
            crowded.append(fp[over])
            fp, cell = fp[~over], cell[~over]
            keep = len(cell) if final or not len(cell) or cell[-1] == large else int(np.searchsorted(cell, cell[-1]))
            edges = edges_of(cell[:keep], fp[:keep]) if keep else []
            cell, fp = cell[keep:], fp[keep:]
            many = np.concatenate(crowded)
            u = np.concatenate([np.array([e[0] for e in edges], np.int64), many])
            v = np.concatenate([np.array([e[1] for e in edges], np.int64), many])
            return pd.DataFrame({"kind": np.r_[np.zeros(len(edges), np.int32), np.ones(len(many), np.int32)], "u": u, "v": v})

        for b in batches:
            cell, fp = np.r_[cell, b["cell"].to_numpy(np.int64)], np.r_[fp, b["fp"].to_numpy(np.int64)]
            yield give(False)
        yield give(True)

    return run


def ball(fp: Column) -> Column:
    """fp and all values that differ from it in one or two bits."""
    masks = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i in range(64) for j in range(i))]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: m.bitwiseXOR(fp))


def links(fps: DataFrame, most: int = CELL_MOST) -> DataFrame:
    """u, v: edges that connect all distinct fingerprints `fp` within RADIUS bits, directly or by others."""
    spark = fps.sparkSession
    keys = fps.select("fp", F.explode(cells(F.col("fp"))).alias("cell")).where("cell is not null")
    text_batches(spark)
    met = materialize(keys.repartition("cell").sortWithinPartitions("cell").mapInPandas(meet(most), "kind int, u long, v long").distinct(), "simhash-met")
    found = met.where("kind = 0").select("u", "v")
    crowded = met.where("kind = 1").select(F.col("u").alias("fp"))
    if crowded.isEmpty():
        return found
    around = crowded.repartition("fp").select("fp", F.explode(ball(F.col("fp"))).alias("value"))
    shared = around.groupBy(F.col("value").alias("s_value")).agg(F.min("fp").alias("root"), F.count("*").alias("n")).where("n > 1")
    more = around.join(shared, F.col("value") == F.col("s_value")).where("fp <> root").select(F.col("fp").alias("u"), F.col("root").alias("v")).distinct()
    return found.unionByName(more)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), fp of every row; written."""
    text_batches(docs.sparkSession)
    return materialize(docs.select("doc_id", F.xxhash64("text").alias("th"), fingerprint().alias("fp")), "simhash-fp")


def component_of(table: DataFrame, most: int = CELL_MOST) -> DataFrame:
    """fp, component_id: the least doc_id that is reachable from the fingerprint."""
    fps = materialize(table.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(fps, most))
    joined = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("group"))
    least = joined.groupBy(F.col("group").alias("g")).agg(F.min("first").alias("component_id"))
    return joined.join(least, F.col("group") == F.col("g")).select(F.col("fp").alias("c_fp"), "component_id")


def near_duplicates(docs: DataFrame, most: int = CELL_MOST) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Defined cases: null, empty and blank texts have fingerprint zero and link
    like any other; texts under four words are one shingle; repeated rows share
    fingerprint and component; a null doc_id is never a component's id unless
    the component has no other; an empty table gives no rows; columns beyond
    doc_id and text are not read. A group of equal texts is one fingerprint
    before any search begins.
    """
    table = fingerprint_table(docs)
    own = component_of(table, most)
    return table.join(own, F.col("fp") == F.col("c_fp")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each near-duplicate component: that of the least doc_id."""
    table = fingerprint_table(docs)
    own = component_of(table)
    stay = (
        table.join(own, F.col("fp") == F.col("c_fp"))
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("s"))
        .select(F.col("s.doc_id").alias("__s_id"), F.col("s.th").alias("__s_th"))
    )
    kept = docs.withColumn("__th", F.xxhash64("text")).join(stay, F.col("doc_id").eqNullSafe(F.col("__s_id")) & (F.col("__th") == F.col("__s_th")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__th"]).drop("__th")
