"""Embedding whitening from a compensated covariance.

Whole-number vectors are summed per dimension; their deviations from the mean are held
as a double and its error. Outer products of the deviations are free of error: each
deviation is cut into slices of so few bits that a product of slices, summed over the
rows of a chunk, is exact in float64. Those sums are added up in double-double (a high
and a low part, by error-free sums), inside tasks and then across them, row by row of
the matrix. The covariance is brought to tridiagonal form and solved by divide and
conquer, which is what numpy's symmetric solver does, and its eigenpairs are refined
against the double-double matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_batches
from .vectors import matrix, scaled, whole

SCALE, PLUS = 64, 1_000_000
COMPONENTS = 32
CHUNK = 4096  # rows whose products are summed without error
SLICE = 20  # bits of a slice: two slices and the rows of a chunk fill 52 bits
SLICES = 4
FOLD = 32  # tasks whose sums one task adds up in a step
GROUP = 1e-6  # eigenvalues within this ratio are one magnitude
REFINED = 4
FLAT = 2.0**-66  # of the largest eigenvalue: less, for each dimension, is no variance

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
OUT_NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

PART = "i long, part long, hi array<double>, lo array<double>"


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as a double and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def dd_add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def slices(hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """hi + lo as a sum of slices: multiples of a power of two, the same for a column, of SLICE bits each."""
    top = np.abs(hi).max(axis=0, initial=0)
    unit = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1))) + 1 - SLICE)
    out = []
    for _ in range(SLICES):
        part = np.rint(hi / unit) * unit
        hi, lo = two_sum(hi - part, lo)
        out.append(part)
        unit = unit / 2 ** (SLICE - 1)
    return out


def outer(hi: np.ndarray, lo: np.ndarray, total: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """total plus the sum of outer products of the rows hi + lo; every partial product is exact."""
    parts = slices(hi, lo)
    for p in range(SLICES):
        for q in range(SLICES - p):  # further products lie below the last bit of a double-double
            product = parts[p].T @ parts[q]
            total = dd_add(total, (product, np.zeros_like(product)))
    return total


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows less the mean, as double-doubles."""
    s, e = two_sum(x.astype(np.float64), -mean[0])
    return two_sum(s, e - mean[1])


def as_dd(numerator: int, denominator: int) -> tuple[float, float]:
    """A fraction as a double and what it lacks."""
    hi = numerator / denominator
    a, b = hi.as_integer_ratio()
    return hi, (numerator * b - a * denominator) / (denominator * b)


def _gram(of, d: int):
    """Tasks' sums of outer products of what `of` makes of a batch, a row of the matrix each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, seen = (np.zeros((d, d)), np.zeros((d, d))), False
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                total, seen = outer(*of(b.slice(at, CHUNK)), total), True
        if seen:
            yield _rows(np.arange(d), np.full(d, TaskContext.get().partitionId()), *total)

    return run


def _rows(i: np.ndarray, part: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], m.ravel()) for m in (hi, lo)]
    return pa.RecordBatch.from_arrays([pa.array(i), pa.array(part), *lists], names=["i", "part", "hi", "lo"])


def _added(d: int):
    """Adds up rows of one i and part; only the sums of the keys at hand are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            hi, lo = (b.column(c).flatten().to_numpy().reshape(-1, d) for c in ("hi", "lo"))
            for k, key in enumerate(zip(b.column("i").to_pylist(), b.column("part").to_pylist())):
                sums[key] = dd_add(sums[key], (hi[k], lo[k])) if key in sums else (hi[k].copy(), lo[k].copy())
        if sums:
            keys = np.array(list(sums))
            yield _rows(keys[:, 0], keys[:, 1], *(np.stack([s[k] for s in sums.values()]) for k in (0, 1)))

    return run


def gram(df: DataFrame, of, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of outer products over all rows, as double-doubles (d, d), summed up in a tree of tasks."""
    own = materialize(df.mapInArrow(_gram(of, d), PART), "gram")
    tasks = (own.agg(F.max("part")).first()[0] or 0) + 1
    while tasks > 1:
        tasks = -(-tasks // FOLD)
        own = materialize(own.withColumn("part", F.floor(F.col("part") / FOLD)).repartition("i", "part").mapInArrow(_added(d), PART), "gram")
    found = own.orderBy("i").toArrow()
    return tuple(np.array(found[c].to_pylist(), dtype=np.float64).reshape(d, d) for c in ("hi", "lo")) if found.num_rows else (np.zeros((d, d)),) * 2


def dd_matmul(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Product of two double-double matrices, by slices."""
    total = (np.zeros((len(a[0]), b[0].shape[1])),) * 2
    left, right = slices(a[0].T, a[1].T), slices(*b)
    for p in range(SLICES):
        for q in range(SLICES - p):
            for at in range(0, len(b[0]), CHUNK):
                product = left[p].T[:, at : at + CHUNK] @ right[q][at : at + CHUNK]
                total = dd_add(total, (product, np.zeros_like(product)))
    return total


def magnitudes(e: np.ndarray) -> list[slice]:
    """Falling eigenvalues in groups of one magnitude: inside a group a double has digits enough for the least beside the largest."""
    out, start = [], 0
    for k in range(1, len(e) + 1):
        if k == len(e) or e[k] < GROUP * e[start]:
            out.append(slice(start, k))
            start = k
    return out


def eigen(v: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric double-double matrix.

    numpy's solver (tridiagonal form, divide and conquer) gives them to the precision of the largest eigenvalue. Steps of
    refinement against the double-double matrix part the groups of one magnitude, and the solver turns each group in itself,
    so that small eigenvalues beside large ones have digits of their own. The largest entry of a vector is positive.
    """
    x = np.linalg.eigh(v[0])[1][:, ::-1]
    eye, zero = np.eye(len(x)), np.zeros_like(v[0])
    e = np.zeros(len(x))
    for _ in range(REFINED):
        held = (x, zero)
        turned = dd_matmul((x.T, zero), dd_matmul(v, held))
        gram_ = dd_matmul((x.T, zero), held)
        s, r = turned[0], (eye - gram_[0]) - gram_[1]
        e = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-e, kind="stable")
        e, s, r, x = e[order], s[np.ix_(order, order)], r[np.ix_(order, order)], x[:, order]
        step, spin = np.zeros_like(s), eye.copy()
        groups = magnitudes(e)
        number = np.repeat(np.arange(len(groups)), [g.stop - g.start for g in groups])
        apart = number[:, None] != number
        gap = np.where(apart, e[None, :] - e[:, None], 1.0)
        step = np.where(apart, (s + e[None, :] * r) / np.where(gap == 0, 1.0, gap), r / 2)
        for g in groups:
            spin[g, g] = np.linalg.eigh(s[g, g] + 0.5 * (r[g, g] @ s[g, g] + s[g, g] @ r[g, g]))[1][:, ::-1]
        x = (x + x @ step) @ spin
    if len(x):
        x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1.0, 1.0)
    turned = dd_matmul((x.T, zero), dd_matmul(v, (x, zero)))
    return np.diag(turned[0]) / np.maximum((x * x).sum(axis=0), 1e-300), x


def sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for b in batches:
            x = matrix(b.column("x"), width, PLUS)
            n += len(x)
            total = total + (x >> 26).sum(axis=0).astype(object) * 2**26 + (x & (2**26 - 1)).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([n, *total.tolist()], pa.decimal128(38, 0))], names=["i", "s"])

    found = {r.i: int(r.s) for r in vectors.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2, in whole numbers; None where a long can't hold it."""
    most = max((float(np.abs(x).max(initial=0)) * n + max(map(abs, total), default=0)), 1.0)
    if most * most * max(1, x.shape[1]) < 2.0**62:
        u = x * n - np.array(total, np.int64)
        return (u * u).sum(axis=1).tolist()
    out = []
    for row in x.tolist():
        d = sum((n * c - s) ** 2 for c, s in zip(row, total))
        out.append(d if d < 2**63 else None)
    return out


def whitened(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Defined cases: rows with a null vector, or with a null or non-finite entry, take no part; shorter vectors are filled up with
    entries of 0; entries are clamped at 2^53; repeated rows count each time; a null vec_id is kept; a component without
    variance (up to the last bits of the largest) has no whitened value and no rows, so one vector, equal vectors and an
    empty table give none; a deviation that a long can't hold is null; other columns are not read.
    """
    spark = df.sparkSession
    text_batches(spark)
    vectors = whole(df, vector).select(F.col("vec_id").cast("long"), scaled(vector, SCALE, PLUS).alias("x"))
    width = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    n, total = sums(vectors, width)
    mean = tuple(np.array(c) for c in zip(*(as_dd(s, n) for s in total))) if n and width else (np.zeros(0),) * 2
    x_only = vectors.select("x")
    v = gram(x_only, lambda b: centred(matrix(b.column("x"), width, PLUS), mean), width)
    e, axes = eigen(v) if width else (np.zeros(0), np.zeros((0, 0)))
    kept = [k for k in range(min(components, width)) if e[k] > FLAT * width * e[0]]
    explained = e[kept] / e.sum() if kept else np.zeros(0)
    onto = axes[:, kept] / np.sqrt(e[kept] / max(n, 1))

    def project(column: pa.Array) -> np.ndarray:
        hi, lo = centred(matrix(column, width, PLUS), mean)
        return hi @ onto + lo @ onto

    own = gram(x_only, lambda b: ((w := project(b.column("x"))), np.zeros_like(w)), len(kept)) if kept else ()
    error = float(np.abs((own[0] / n - np.eye(len(kept))) + own[1] / n).max()) if kept else 0.0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(kept)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                b = batch.slice(at, CHUNK)
                m, w, column = b.num_rows, project(b.column("x")), b.column("vec_id")
                again = pa.array(np.repeat(np.arange(m), k))
                deviation = pa.array(deviations(matrix(b.column("x"), width, PLUS), n, total), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        column.take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                        deviation.take(again), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=OUT_NAMES,
                )

    if not kept:
        vectors = vectors.limit(0)
    return vectors.mapInArrow(rows, OUT)
