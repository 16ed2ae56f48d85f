"""Whitening of embeddings from a bit-sliced scatter matrix (operator 11).

Entries become whole numbers x = floor(64 c) + 1,000,000. The fit list holds each distinct x-vector
once. To get the sums of all products x_i x_j exactly, the entries of a dimension are shifted by
their minimum, and the bits of equal weight of all rows of a block are packed into words: a bit plane.
The product sum of two dimensions is then the number of ones in the AND of two planes, times two to the power
of both weights, over all pairs of planes. Counts of equal weight are added up by Spark; the scatter
matrix is put together, and centred as n sum(x_i x_j) - S_i S_j, in whole numbers without bound. Only
then is it divided and given to `eigh`.

What goes to the driver and back is bounded by the number of dimensions, never by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stash

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Rows whose bits are packed at a time; a multiple of 64.
BLOCK_ROWS = 1 << 15
#: Eigenvalues below this share of the largest are noise of the double precision of `eigh`.
LEAST_SHARE = 1e-13


def whole_entries(vector: Column) -> Column:
    """The vector as whole numbers x; null where an entry is null, not finite or beyond 64 bits."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    fits = F.forall(
        vector,
        lambda c: F.coalesce(
            ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < float(2**62)), F.lit(False)
        ),
    )
    return F.when(fits, F.transform(scaled, lambda x: x.cast("long") + SHIFT))


def bit_planes(shifted: np.ndarray, bits: int) -> np.ndarray:
    """Planes (dimension, weight, word) of unsigned numbers (row, dimension), 64 rows a word."""
    n, d = shifted.shape
    out = np.zeros((d, bits, -(-n // 64)), np.uint64)
    weights = np.arange(bits, dtype=np.uint64)[:, None]
    for i in range(d):
        ones = np.zeros((bits, out.shape[2] * 64), np.uint8)
        ones[:, :n] = (shifted[None, :, i] >> weights) & np.uint64(1)
        out[i] = np.packbits(ones, axis=1).view(np.uint64)
    return out


def plane_counts(planes: np.ndarray) -> np.ndarray:
    """Counts (i, j, weight): ones in the AND of the planes of i and j whose weights add up to it."""
    d, bits, words = planes.shape
    flat = planes.reshape(d * bits, words)
    out = np.zeros((d, d, 2 * bits - 1), np.int64)
    for i in range(d):
        for a in range(bits):
            both = np.bitwise_count(flat[i * bits :] & planes[i, a])
            ones = both.sum(axis=1, dtype=np.int64).reshape(d - i, bits)
            out[i, i:, a : a + bits] += ones
    return out


def _scatter(lows: np.ndarray, bits: int):
    d = len(lows)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d, 2 * bits - 1), np.int64)
        seen = False
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.column(0).slice(at, BLOCK_ROWS)
                x = block.flatten().to_numpy(zero_copy_only=False).reshape(len(block), d)
                total += plane_counts(bit_planes((x - lows).astype(np.uint64), bits))
                seen = True
        if seen:
            i, j, weight = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(v.astype(np.int32)) for v in (i, j, weight)),
                 pa.array(total[i, j, weight])],
                ["i", "j", "weight", "ones"],
            )

    return scatter


@dataclass
class Whitening:
    """A fit: `n` distinct vectors, their sums, and up to 16 components by falling eigenvalue."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n. The whole part of the mean is taken off in whole numbers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2; null where it needs more than 64 bits."""
        reach = max(abs(int(x.max())), abs(int(x.min()))) * self.n
        if max(reach, *(abs(s) for s in self.sums)) < 2**62:
            gaps = self.n * x - np.array(self.sums, np.int64)
            if int(np.abs(gaps).max()) ** 2 * x.shape[1] < 2**63:
                return (gaps * gaps).sum(axis=1).tolist()
        gaps = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 2**63 else None for v in (gaps * gaps).sum(axis=1).tolist()]


def centred_scatter(n: int, sums: list[int], products: list[list[int]]) -> list[list[int]]:
    """n^2 times the covariance, in whole numbers: n sum(x_i x_j) - S_i S_j."""
    d = len(sums)
    return [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def components_of(n: int, sums: list[int], products: list[list[int]], count: int) -> Whitening:
    centred = centred_scatter(n, sums, products)
    cov = np.array([[c / (n * n) for c in row] for row in centred])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    least = LEAST_SHARE * max(values.max(initial=0.0), 0.0) * max(1, len(sums))
    order = [k for k in order if values[k] > least][:count]
    vectors = vectors[:, order]
    # The eigenvalue as v'Vv from the exact matrix: its error is of second order in that of v.
    exact = [_quadratic(centred, vectors[:, k]) / (n * n) for k in range(len(order))]
    trace = Fraction(sum(centred[i][i] for i in range(len(sums))), n * n)
    return Whitening(
        n, sums, vectors, np.array([float(e) for e in exact]),
        np.array([float(e / trace) for e in exact]),
    )


def _quadratic(matrix: list[list[int]], v: np.ndarray) -> Fraction:
    unit = 1 << 60
    w = [int(x * unit) for x in v.tolist()]
    norm = sum(x * x for x in w)
    total = sum(wi * sum(a * wj for a, wj in zip(row, w)) for wi, row in zip(w, matrix))
    return Fraction(total, norm)


def fit(entries: DataFrame) -> Whitening | None:
    """The fit over the column `x` of `entries`, a list of distinct vectors of one length; None
    where there are no vectors, or where they do not differ."""
    at = F.posexplode("x").alias("i", "v")
    by_dim = (
        entries.select(at)
        .groupBy("i")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("v").cast("decimal(38,0)")).alias("total"),
            F.min("v").alias("low"),
            F.max("v").alias("high"),
        )
        .orderBy("i")
        .collect()
    )
    if not by_dim:
        return None
    n, d = by_dim[0].n, len(by_dim)
    sums, lows = [int(r.total) for r in by_dim], [r.low for r in by_dim]
    bits = max(r.high - r.low for r in by_dim).bit_length()
    if not bits:
        return None
    counts = (
        entries.select("x")
        .mapInArrow(_scatter(np.array(lows), bits), "i int, j int, weight int, ones long")
        .groupBy("i", "j", "weight")
        .agg(F.sum("ones").alias("ones"))
        .groupBy("i", "j")
        .agg(F.collect_list(F.struct("weight", "ones")).alias("ones"))
        .collect()
    )
    shifted = [[0] * d for _ in range(d)]
    for r in counts:
        shifted[r.i][r.j] = shifted[r.j][r.i] = sum(o.ones << o.weight for o in r.ones)
    gaps = [s - n * low for s, low in zip(sums, lows)]
    products = [
        [shifted[i][j] + lows[i] * gaps[j] + lows[j] * gaps[i] + n * lows[i] * lows[j]
         for j in range(d)]
        for i in range(d)
    ]
    return components_of(n, sums, products, COMPONENTS)


def _moments(model: Whitening):
    """Per task: the sums of w_k and of w_k w_l over its rows of the fit list."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                w = model.whitened(x.reshape(batch.num_rows, -1))
                sums += w.sum(axis=0)
                products += w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.full(k, -1), i]).astype(np.int32)),
                pa.array(np.concatenate([np.arange(k), j]).astype(np.int32)),
                pa.array(np.concatenate([sums, products.ravel()])),
            ],
            ["i", "j", "total"],
        )

    return moments


def identity_error(entries: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    rows = (
        entries.select("x")
        .mapInArrow(_moments(model), "i int, j int, total double")
        .groupBy("i", "j")
        .agg(F.sum("total").alias("total"))
        .collect()
    )
    k = len(model.values)
    means, cov = np.zeros(k), np.zeros((k, k))
    for r in rows:
        if r.i < 0:
            means[r.j] = r.total / model.n
        else:
            cov[r.i, r.j] = r.total / model.n
    return float(np.abs(cov - np.outer(means, means) - np.eye(k)).max())


def _project(model: Whitening, error: float):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                ids, block = (batch.column(c).slice(at, 4096) for c in (0, 1))
                rows = len(ids)
                x = block.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, model.n)),
                        pa.array(model.deviations(x), pa.int64()).take(
                            pa.array(np.repeat(np.arange(rows), k))
                        ),
                        pa.array(model.whitened(x).ravel()),
                        pa.array(np.tile(model.explained, rows)),
                        pa.array(np.full(rows * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained",
                     "identity_error"],
                )

    return project


def whiten(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Rows projected on the principal components of the distinct vectors, to unit variance.

    One row per row of `embeddings` and component, 16 at most: `vec_id`, `component` from 1 by falling
    eigenvalue, `n` distinct vectors, `deviation` (sum of (n x - S)^2, exact; null if it passes 64 bits),
    `whitened`, `explained` share of the variance, and one `identity_error`. Rows whose vector is null,
    empty, or holds an entry that is null, not finite or beyond 2^62 / 64 are left out; so are those of another
    length than most of the rest (the longer one on a tie). Repeated rows and ids give a row each; equal
    vectors count once in the fit. Components without variance (to double precision) are not given, so a table
    without rows, or of one vector only, gives none. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), whole_entries(F.col(vector_col)).alias("x")
    ).filter("size(x) > 0")
    lengths = (
        rows.groupBy(F.size("x").alias("d"))
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), F.desc("d"))
        .first()
    )
    out = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double"
    )
    if lengths is None:
        return spark.createDataFrame([], out)
    rows = rows.filter(F.size("x") == lengths.d)
    entries = stash(rows.select("x").distinct(), "distinct-vectors")
    model = fit(entries)
    if model is None:
        return spark.createDataFrame([], out)
    return rows.mapInArrow(_project(model, identity_error(entries, model)), out)
