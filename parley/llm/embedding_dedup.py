"""Near-duplicate vectors by binary codes of random rotations (operator 8).

Each unit vector is rotated at random several times; the signs of its coordinates are its code, and
what the signs keep of the rotated vector is stored as a correction factor. Bands of the code's bits
bring vectors of one label together: the wider the bands, and the more of them, the larger the table,
so that a pair at the cosine asked for is missed with a chance of MISS and others seldom meet. The
code of one vector with its factor gives an unbiased estimate of its inner product with another and a bound
of the error; only pairs whose bound reaches the threshold are computed exactly.

Equal vectors are one node. A crowded band is worked on in blocks, each pair of blocks as a group of
its own, and a pair of vectors counts in the first band it shares. A group gives the links of each vector as a
number, and one link to the smallest vector it hangs together with, never the pairs themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stash
from parley.llm.components import components

COSINE = 0.98
MISS = 1e-7
#: Rotations that estimates use, and standard errors of their bound.
ESTIMATES = 4
ERRORS = 6.0
#: Vectors of a block, about.
BLOCK = 256
SEED = 7


@cache
def rotation(size: int, which: int) -> np.ndarray:
    """A random rotation, the same on every machine."""
    normal = np.random.default_rng([SEED, size, which]).normal(size=(size, size))
    q, r = np.linalg.qr(normal)
    return q * np.sign(np.diag(r))


def bands_for(count: int, cosine: float) -> tuple[int, int]:
    """Bits of a band and number of bands for a table of so many vectors."""
    width = min(60, max(8, math.ceil(math.log2(max(count, 2))) + 4))
    agree = 1 - math.acos(min(1.0, cosine)) / math.pi
    if agree >= 1:
        return width, 1
    return width, max(1, math.ceil(math.log(MISS) / math.log(1 - agree**width)))


def signs(units: np.ndarray, rotations: int) -> np.ndarray:
    """The code bits of unit vectors under the first rotations."""
    return np.hstack([units @ rotation(units.shape[1], i) >= 0 for i in range(rotations)])


def factors(units: np.ndarray) -> np.ndarray:
    """Inner products of the rotated vectors with their normalised signs, for each estimate."""
    size = units.shape[1]
    return np.stack(
        [np.abs(units @ rotation(size, i)).sum(axis=1) / math.sqrt(size) for i in range(ESTIMATES)],
        axis=1,
    )


def estimate(
    bits: np.ndarray, kept: np.ndarray, others: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded vectors with others, and the bound of each one's error.

    `bits` and `kept` are the code and factors of the first, `others` whole vectors.
    """
    size = others.shape[1]
    total = np.zeros((len(bits), len(others)), np.float32)
    variance = np.zeros(len(bits))
    for i in range(ESTIMATES):
        code = np.where(bits[:, i * size : (i + 1) * size], 1, -1).astype(np.float32)
        turned = (others @ rotation(size, i)).astype(np.float32)
        total += code @ turned.T / (math.sqrt(size) * kept[:, i : i + 1])
        variance += (1 - kept[:, i] ** 2) / (kept[:, i] ** 2 * max(size - 1, 1))
    return total / ESTIMATES, ERRORS * np.sqrt(np.maximum(variance, 0)) / ESTIMATES + 1e-4


_READ = pa.schema(
    [
        ("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.string()),
        ("digest", pa.binary()), ("size", pa.int32()), ("unit", pa.binary()),
    ]
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        out = []
        ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for vec_id, label, vector in zip(ids, labels, batch.column(2), strict=True):
            digest = unit = size = None
            if vector.is_valid and label is not None and vector.values.null_count == 0:
                values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                most = np.abs(values).max(initial=0.0)
                if len(values) and np.isfinite(most) and most > 0:
                    values = values + 0.0  # no negative zeros
                    digest = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
                    # Scaled first, so that squares neither overflow nor vanish.
                    scaled = values / most
                    unit = (scaled / np.linalg.norm(scaled)).tobytes()
                    size = len(values)
            out.append((row, vec_id, label, digest, size, unit))
            row += 1
        columns = zip(*out) if out else [[]] * len(_READ)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _READ)], schema=_READ
        )


def _code(width: int, bands: int):
    """Codes, factors and band values of the nodes."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                units = np.frombuffer(b"".join(part.column("unit").to_pylist()), np.float64)
                units = units.reshape(-1, size)
                turns = max(ESTIMATES, math.ceil(width * bands / size))
                bits = signs(units, turns)
                # Each band takes its bits from all over the code.
                order = np.random.default_rng([SEED, bits.shape[1]]).permutation(bits.shape[1])
                weights = 1 << np.arange(width, dtype=np.int64)
                values = np.stack(
                    [
                        bits[:, order[b * width : (b + 1) * width]].astype(np.int64) @ weights
                        for b in range(bands)
                    ],
                    axis=1,
                )
                kept = factors(units)
                first = np.packbits(bits[:, : ESTIMATES * size], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("node", "label", "size", "copies", "unit")),
                        pa.array([x.tobytes() for x in first], pa.binary()),
                        pa.array([x.tobytes() for x in kept], pa.binary()),
                        pa.array(list(values), pa.list_(pa.int64())),
                    ],
                    ["node", "label", "size", "copies", "unit", "code", "factors", "bands"],
                )

    return code


def _smallest(linked: np.ndarray) -> np.ndarray:
    """For each place the smallest place it hangs together with, from a matrix of links."""
    label = np.arange(len(linked))
    joined = linked | np.eye(len(linked), dtype=bool)
    while True:
        near = np.where(joined, label, len(label)).min(axis=1)
        near = near[near]
        if (near == label).all():
            return label
        label = near


def _link(cosine: float):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])

    def link(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        size = group.column("size")[0].as_py()
        band = group.column("band")[0].as_py()
        node = group.column("node").to_numpy()
        side = group.column("side").to_numpy()
        copies = group.column("copies").to_numpy()
        n = len(node)
        units = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64)
        units = units.reshape(n, size)
        codes = np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint8)
        bits = np.unpackbits(codes.reshape(n, -1), axis=1, count=ESTIMATES * size)
        kept = np.frombuffer(b"".join(group.column("factors").to_pylist()), np.float64)
        guess, bound = estimate(bits, kept.reshape(n, ESTIMATES), units)
        possible = np.triu(guess + bound[:, None] >= cosine, 1)
        if group.column("block_a")[0].as_py() != group.column("block_b")[0].as_py():
            possible &= side[:, None] != side[None, :]
        a, b = np.nonzero(possible)
        exact = np.einsum("ij,ij->i", units[a], units[b]) >= cosine
        a, b = a[exact], b[exact]
        linked = np.zeros((n, n), bool)
        linked[a, b] = linked[b, a] = True
        # A pair counts in the first band it shares.
        values = np.stack(group.column("bands").to_numpy(zero_copy_only=False))
        new = ~(values[a, :band] == values[b, :band]).any(axis=1)
        count = np.bincount(a[new], copies[b[new]], n) + np.bincount(b[new], copies[a[new]], n)
        to = node[_smallest(linked)]
        told = (count > 0) | (to != node)
        return pa.table(
            [pa.array(node[told]), pa.array(count[told].astype(np.int64)), pa.array(to[told])],
            schema=schema,
        )

    return link


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Groups of vectors of one label linked by a cosine of at least `cosine`.

    One row per row of `vectors`: `vec_id`, `n_links` (other rows linked directly), `component_id` (the
    smallest id that links reach, its own included) and `kept` (`vec_id` is `component_id`). A vector that is
    null, empty or zero, or has null or non-finite components, or a null label, is linked with
    nothing, as are vectors of different lengths. Rows that are the same are linked. A null id is larger than any
    other; a group of null ids alone has a null component, and all of it is kept. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = stash(
        vectors.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(label_col).cast("string").alias("label"),
            F.col(vector_col).cast("array<double>").alias("vector"),
        ).mapInArrow(
            _read,
            "row long, vec_id long, label string, digest binary, size int, unit binary",
        ),
        "vectors",
    )
    alike = ["label", "digest"]
    nodes = rows.filter("unit is not null").groupBy(*alike, "size").agg(
        F.min("row").alias("node"), F.count("*").alias("copies"), F.min("unit").alias("unit")
    )
    nodes = stash(nodes, "nodes")
    width, bands = bands_for(nodes.count(), cosine)
    coded = stash(
        nodes.select("node", "label", "size", "copies", "unit").mapInArrow(
            _code(width, bands),
            "node long, label string, size int, copies long, unit binary, code binary, "
            "factors binary, bands array<long>",
        ),
        "codes",
    )
    keys = coded.select("label", "size", "node", F.posexplode("bands").alias("band", "value"))
    bucket = ["label", "size", "band", "value"]
    crowded = stash(
        keys.groupBy(*bucket)
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .drop("n"),
        "crowded",
    )
    member = keys.join(crowded, bucket).withColumn(
        "side", F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int")
    )
    pairs = member.withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select(
        *bucket,
        F.least("side", "other").alias("block_a"),
        F.greatest("side", "other").alias("block_b"),
        "side",
        "node",
    )
    held = coded.drop("label", "size")
    found = stash(
        pairs.join(held, "node")
        .groupBy(*bucket, "block_a", "block_b")
        .applyInArrow(_link(cosine), "node long, links long, to long"),
        "found",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    judged = stash(
        nodes.join(links, "node", "left")
        .join(labels, "node", "left")
        .select(
            *alike,
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        ),
        "judged",
    )
    grouped = stash(
        rows.filter("unit is not null")
        .join(judged, alike)
        .select("vec_id", "n_links", "component"),
        "grouped",
    )
    least = stash(grouped.groupBy("component").agg(F.min("vec_id").alias("component_id")), "least")
    linked = grouped.join(least, "component").select("vec_id", "n_links", "component_id")
    alone = rows.filter("unit is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionAll(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
