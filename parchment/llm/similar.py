"""Near-duplicates by similarity: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

At that similarity 64-bit fingerprints are about ten bits apart, where neither segment
popcounts nor any other cut of 64 bits tells pairs from strangers. So fingerprints are
wide here (1024 bits), candidates share a band of least shingle hashes, and they are
told by the distance of fingerprints: popcounts of their 64-bit segments are compared
first, as their Manhattan distance is a lower bound, then bits. Sets of one similarity lie
at distances that scatter by eleven bits. Pairs 4.5 times as far below the mean distance
of 0.8 are links, those 4 times as far above are none. Where pairs between these bounds
could still connect groups, the sets themselves of all that take part are compared, all
with all, in blocks of bounded size.

Equal sets of shingles are one before any search. A cell reports a star of each group it
finds instead of the group's pairs. Nothing of a cell is compared twice that is linked
already, and a cell larger than CELL_MOST is never held: all its members are compared
with one of them, and only those unlike it meet all others, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_batches
from .components import components

SIZE, SIMILARITY = 5, 0.8
WORDS = 16  # of 64 bits in a fingerprint
BANDS, ROWS = 16, 4  # pairs of similarity 0.8 share a band with a probability of 0.9998
CELL_MOST = 8192
SURE, NONE = 4.5, 4.0  # standard deviations of a distance below and above the mean: between them sets are compared
BLOCK_BYTES = 16 << 20  # of sets that meet in a task, from either side
BROADCAST = 1_000_000  # texts to be verified that may be named in a broadcast

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_CHUNK = 4096


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_LIFT, _RANK = _odd(WORDS, 7), _odd(BANDS * ROWS, 8)


def _mixed(h: np.ndarray, odd: np.ndarray) -> np.ndarray:
    x = h[:, None] * odd[None, :]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def radius(similarity: float) -> int:
    """Bits by which fingerprints of sets of that similarity differ in the mean."""
    return int(64 * WORDS * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def zone(similarity: float) -> tuple[int, int]:
    """Distances up to which a pair surely is, and from which on it surely isn't, of that similarity."""
    mean, n = radius(similarity), 64 * WORDS
    scatter = math.sqrt(mean * (n - mean) / n)
    return int(mean - SURE * scatter), int(mean + NONE * scatter)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Different hashes of the text's shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(size, len(words))
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    return np.unique(np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())], dtype=np.uint64))


def signature(h: np.ndarray) -> tuple[int, bytes, list[int]]:
    """Of a set of hashes: its own hash, the fingerprint, the bands."""
    from xxhash import xxh64_intdigest

    ones = np.zeros(64 * WORDS, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), _CHUNK):  # a very long text's bits aren't unpacked at once
        part = h[at : at + _CHUNK]
        ones += np.unpackbits(_mixed(part, _LIFT).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
        least = np.minimum(least, _mixed(part, _RANK).min(axis=0))
    bands = [xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(xxh64_intdigest(h.tobytes(), 1)), np.packbits(2 * ones > len(h), bitorder="little").tobytes(), [signed(x) for x in bands]


def unpacked(fps) -> np.ndarray:
    return np.frombuffer(b"".join(fps), np.uint64).reshape(-1, WORDS)


def distances(one: np.ndarray, many: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Bits between one and each of many (with popcounts of their segments); more than `most` where these alone say so."""
    bound = np.abs(counts - np.bitwise_count(one).astype(np.int16)).sum(axis=1)
    at = np.flatnonzero(bound <= most)
    bound[at] = np.bitwise_count(many[at] ^ one).sum(axis=1, dtype=np.int64)
    return bound


def stars(nodes: np.ndarray, fps: np.ndarray, sure: int, most: int, only: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(kind, u, v): kind 0, edges that connect what pairs within `sure` bits connect; kind 2 (u = v), members that a pair
    within `most` bits could connect with another group. `only` says which members have to be compared with all (None: any).

    A member that nothing links yet is compared with all. Then those outside the largest group are, as a pair between two
    groups has an end in the smaller one; links inside a group are never looked for. What is held grows with members, not pairs.
    """
    n = len(nodes)
    counts = np.bitwise_count(fps).astype(np.int16)
    label = np.arange(n)
    out: list[tuple[int, int, int]] = []
    done, open_, linked = (np.zeros(n, bool) for _ in range(3))

    def look(i: int) -> None:
        done[i] = True
        far = distances(fps[i], fps, counts, most)
        here = far <= sure
        roots = np.unique(label[here])
        for root in roots[roots != label[i]]:
            j = np.flatnonzero(here & (label == root))[0]
            out.append((0, int(nodes[i]), int(nodes[j])))
            label[label == root] = label[i]
        mine = label == label[i]
        if mine.sum() > 1:
            linked[mine] = True
        between = (far > sure) & (far <= most) & ~mine
        if between.any():
            open_[between] = True
            open_[i] = True

    for i in np.flatnonzero(only) if only is not None else range(n):
        if only is not None or not linked[i]:
            look(i)
    if only is None:
        found, sizes = np.unique(label, return_counts=True)
        if len(found) > 1:
            for i in np.flatnonzero((label != found[sizes.argmax()]) & ~done):
                look(i)
    return out + [(2, int(u), int(u)) for u in nodes[open_]]


EDGES = "kind int, cell long, u long, v long"


def meet(sure: int, most: int, cell_most: int):
    """From rows (cell, node, fp) sorted by cell: kinds 0 and 2, what stars() says of cells; kind 1, (cell, members) of cells that are too large to be held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, cell = 0, None
        out: list[tuple] = []

        def close() -> None:
            nonlocal held, size
            if 1 < size <= cell_most:
                whole = pd.concat(held) if len(held) > 1 else held[0]
                out.extend((kind, cell, u, v) for kind, u, v in stars(whole["node"].to_numpy(), unpacked(whole["fp"]), sure, most))
            elif size > cell_most:
                out.append((1, cell, size, 0))
            held, size = [], 0

        for b in batches:
            values = b["cell"].to_numpy()
            starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
            for a, z in zip(starts, np.r_[starts[1:], len(values)]):
                if values[a] != cell:
                    close()
                    cell = values[a]
                size += z - a
                if size <= cell_most:
                    held.append(b.iloc[a:z])
                else:
                    held = []
            yield pd.DataFrame(out, columns=["kind", "cell", "u", "v"])
            out = []
        close()
        yield pd.DataFrame(out, columns=["kind", "cell", "u", "v"])

    return run


def _large(cells: DataFrame, large: DataFrame, sure: int, most: int, cell_most: int) -> DataFrame:
    """kind, cell, u, v of cells that aren't held. large has l_cell and n."""
    members = materialize(cells.join(large, F.col("cell") == F.col("l_cell")).select("cell", "n", "node", "fp"), "similar-large")
    first = members.groupBy(F.col("cell").alias("f_cell")).agg(F.min(F.struct("node", "fp")).alias("f"))

    def compared(batches):
        for b in batches:
            x = np.bitwise_count(unpacked(b["fp"]) ^ unpacked(b["first"])).sum(axis=1, dtype=np.int64) if len(b) else np.zeros(0)
            yield b.drop(columns=["first"]).assign(near=x <= sure)

    judged = materialize(
        members.join(first, F.col("cell") == F.col("f_cell")).select("cell", "n", "node", "fp", F.col("f.node").alias("root"), F.col("f.fp").alias("first"))
        .mapInPandas(compared, "cell long, n long, node long, fp binary, root long, near boolean"),
        "similar-judged",
    )
    star = judged.where("near and node <> root").select(F.lit(0).alias("kind"), "cell", F.col("node").alias("u"), F.col("root").alias("v"))
    odd = judged.where("not near")
    sizes = odd.groupBy(F.col("cell").alias("o_cell")).agg(F.count("*").alias("odd"))
    blocks = lambda c: F.ceil(F.col(c) / cell_most).cast("int")
    block = lambda c, salt: F.pmod(F.xxhash64("node", F.lit(salt)), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    rest = judged.join(sizes, F.col("cell") == F.col("o_cell"))
    ones = rest.where("not near").withColumn("r", block("odd", 1)).select("cell", "node", "fp", F.lit(True).alias("one"), "r", every("n").alias("a"))
    all_ = rest.withColumn("a", block("n", 2)).select("cell", "node", "fp", F.lit(False).alias("one"), every("odd").alias("r"), "a")

    def met(b: pd.DataFrame) -> pd.DataFrame:
        ids = b["node"].to_numpy()
        found = pd.DataFrame(stars(ids, unpacked(b["fp"]), sure, most, b["one"].to_numpy()), columns=["kind", "u", "v"])
        return found.assign(cell=b["cell"].iloc[0])[["kind", "cell", "u", "v"]]

    crossed = ones.unionByName(all_.select("cell", "node", "fp", "one", "r", "a")).groupBy("cell", "r", "a").applyInPandas(met, EDGES)
    return star.unionByName(crossed.where("u <> v or kind = 2"))


def connected(nodes: np.ndarray, sets: list[np.ndarray], label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges that connect all sets which pairs of the similarity or more connect, beyond what `label` says is connected already.

    A set is compared with all others at once: its hashes are marked, and marks are summed over each set's hashes.
    """
    sizes = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    full = sizes > 0
    label = np.unique(label, return_inverse=True)[1]
    marked = np.zeros(len(values), bool)
    out: list[tuple[int, int]] = []
    most = np.bincount(label).argmax()  # a link between two groups has an end outside the largest of the start
    for i in np.flatnonzero(full & (label != most)):
        if (label == label[i]).all():
            break
        own = flat[starts[i] : starts[i] + sizes[i]]
        marked[own] = True
        common = np.zeros(len(sets), np.int64)
        common[full] = np.add.reduceat(marked[flat], starts[full])
        marked[own] = False
        near = (common >= similarity * (sizes + sizes[i] - common)) & full
        roots = np.unique(label[near])
        for root in roots[roots != label[i]]:
            j = np.flatnonzero(near & (label == root))[0]
            out.append((int(nodes[i]), int(nodes[j])))
            label[label == root] = label[i]
    return out


def _verified(docs: DataFrame, sets: DataFrame, open_: DataFrame, roots: DataFrame, size: int, similarity: float) -> DataFrame:
    """u, v: links between the groups of `roots` among members (cell, node) of open cells. Only their texts are read again.

    A cell's sets meet in blocks of BLOCK_BYTES, each pair of blocks in a task of its own.
    """
    grouped = open_.join(roots.select(F.col("node").alias("r_node"), "root"), F.col("node") == F.col("r_node"), "left").select("cell", "node", F.coalesce("root", "node").alias("g"))
    sized = grouped.join(sets.select(F.col("node").alias("s_node"), "n"), F.col("node") == F.col("s_node")).select("cell", "node", "g", "n")
    cells = (
        sized.groupBy(F.col("cell").alias("o_cell")).agg(F.min("g").alias("low"), F.max("g").alias("high"), F.sum(8 * F.col("n")).alias("bytes"))
        .where("low <> high").select("o_cell", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    )
    members = materialize(sized.join(cells, F.col("cell") == F.col("o_cell")).select("cell", "node", "g", "blocks"), "similar-members")
    wanted = materialize(sets.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("first.th").alias("w_th")), "similar-wanted")
    few = wanted.count() <= BROADCAST

    def hashes(batches):
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "h": [shingles(t, size).tobytes() for t in b["text"]]})

    texts = docs.select(F.xxhash64("text").alias("t_th"), "text").join(F.broadcast(wanted) if few else wanted, F.col("t_th") == F.col("w_th")).select("node", "text")
    known = materialize(texts.mapInPandas(hashes, "node long, h binary").groupBy("node").agg(F.min("h").alias("h")), "similar-hashes")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = (
        members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cell", "g", "node", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
        .join(known.select(F.col("node").alias("k_node"), "h"), F.col("node") == F.col("k_node")).select("cell", "x", "y", "node", "g", "h")
    )

    def compared(b: pd.DataFrame) -> pd.DataFrame:
        found = connected(b["node"].to_numpy(), [np.frombuffer(h, np.uint64) for h in b["h"]], b["g"].to_numpy(), similarity) if len(b) > 1 else []
        return pd.DataFrame(found, columns=["u", "v"], dtype=np.int64)

    return met.groupBy("cell", "x", "y").applyInPandas(compared, "u long, v long")


def groups(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, cell_most: int = CELL_MOST) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): doc_id, th (hash of the text), node of every row; g_node, doc_id, th: of each node's group the row that stays."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, size) for t in b["text"]]
            found = [signature(h) for h in sets]
            yield b.drop(columns=["text"]).assign(node=[f[0] for f in found], n=[len(h) for h in sets], fp=[f[1] for f in found], bands=[f[2] for f in found])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text_batches(docs.sparkSession)
    rows = materialize(
        docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInPandas(signed, f"doc_id {kind}, th long, node long, n long, fp binary, bands array<long>"), "similar-rows"
    )
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")  # a row without an id stays only where no other does
    sets = materialize(rows.groupBy("node").agg(least, F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("bands").alias("bands")), "similar-sets")
    cells = sets.select("node", "fp", F.explode("bands").alias("cell"))
    sure, most = zone(similarity)
    found = materialize(cells.repartition("cell").sortWithinPartitions("cell", "node").mapInPandas(meet(sure, most, cell_most), EDGES), "similar-met")
    links = found.where("kind <> 1")
    large = found.where("kind = 1").select(F.col("cell").alias("l_cell"), F.col("u").alias("n"))
    if not large.isEmpty():
        links = materialize(links.unionByName(_large(cells, large, sure, most, cell_most)), "similar-links")
    edges = links.where("kind = 0").select("u", "v")
    open_ = materialize(links.where("kind = 2").select("cell", F.col("u").alias("node")).distinct(), "similar-open")
    roots = components(edges)
    if not open_.isEmpty():
        more = materialize(_verified(docs, sets, open_, roots, size, similarity), "similar-more")
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    joined = sets.select("node", "first").join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("node", "first", F.coalesce("root", "node").alias("group"))
    stay = joined.groupBy(F.col("group").alias("s_group")).agg(F.min("first").alias("first"))
    member = joined.select("node", "group").join(stay, F.col("group") == F.col("s_group"))
    return rows.select("doc_id", "th", "node"), member.select(F.col("node").alias("g_node"), F.col("first.doc_id").alias("g_id"), F.col("first.th").alias("g_th"))


def deduplicated(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, cell_most: int = CELL_MOST) -> DataFrame:
    """docs, all columns, with one row of each group of near-duplicates: that of the least doc_id.

    Groups are what links of `similarity` or more connect, of sets of `size`-word shingles, A-Z lower-cased. Defined cases:
    texts of fewer words are one shingle; null, empty and blank texts are one group; rows of one doc_id and text become
    one; of rows with the least doc_id that of the least hash of text stays; a row without doc_id stays only where its group
    has no other; an empty table stays empty; columns beyond doc_id and text pass through, whatever their names.
    """
    _, found = groups(docs, size, similarity, cell_most)
    stay = found.select(F.col("g_id").alias("__s_id"), F.col("g_th").alias("__s_th")).distinct()
    kept = docs.withColumn("__th", F.xxhash64("text")).join(stay, F.col("doc_id").eqNullSafe(F.col("__s_id")) & (F.col("__th") == F.col("__s_th")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__th"]).drop("__th")
