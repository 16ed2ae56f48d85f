"""Exact deduplication by naming blocks (operator 9).

Each text, without white space, is cut into blocks of a fixed size. All blocks are sorted,
and equal blocks get the same integer: their rank among the distinct ones. Pairs of adjacent
names are then named in the same way, again and again, until each document is left with one
name. Blocks are compared themselves, never by a digest, so that texts with the same name at the
same level are equal. Documents of different numbers of levels differ in length.

Sorting deals the blocks by (hash, row), so that a block that a third of all rows have is
spread over many tasks. Where a run of equal blocks goes on over the end of a task, the first and
last block of each task show it; one row per task is enough to number them throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import SPACES, stash

BLOCK_BYTES = 4096
#: Bytes of blocks that one Arrow batch holds at most, but for a single block.
BATCH_BYTES = 4 << 20

_BLOCKS = (
    "row long, pos long, n_blocks long, block binary, doc_id long, n_chars long, "
    "text_sha256 string, row_sha256 string"
)
_META = ["doc_id", "n_chars", "text_sha256", "row_sha256"]


def _cut(block_bytes: int):
    schema = pa.schema(
        [
            ("row", pa.int64()), ("pos", pa.int64()), ("n_blocks", pa.int64()),
            ("block", pa.binary()), ("doc_id", pa.int64()), ("n_chars", pa.int64()),
            ("text_sha256", pa.string()), ("row_sha256", pa.string()),
        ]
    )
    spaces = SPACES.encode()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                raw = text.encode("utf-8", "surrogatepass")
                bare = raw.translate(None, spaces)
                n = max(1, -(-len(bare) // block_bytes))
                digest = hashlib.sha256(bare).hexdigest()
                whole = hashlib.sha256(raw).hexdigest()
                for i in range(n):
                    block = bare[i * block_bytes : (i + 1) * block_bytes]
                    # What is known of the document goes with its first block.
                    meta = (doc_id, len(text), digest, whole) if i == 0 else (None,) * 4
                    out.append((row, i, n, block, *meta))
                    held += len(block) + 200
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema
                        )
                        out, held = [], 0
                row += 1
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema
            )

    return cut


def _rank(keys: list[str], keep: list[str]):
    """Number the distinct keys of a sorted task from 0; a last row tells its first and last key."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        at, first, last = -1, None, None
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            new = np.zeros(batch.num_rows, bool)
            for c in columns:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            head = [c[0].as_py() for c in columns]
            new[0] = head != last
            first = head if first is None else first
            last = [c[-1].as_py() for c in columns]
            ranks = at + np.cumsum(new)
            at = int(ranks[-1])
            kept = [batch.schema.field(k) for k in keep]
            yield _rows(kept, [batch.column(k) for k in keep], task, ranks, keys, columns)
        if first is not None:
            empty = [pa.nulls(1, f.type) for f in kept]
            yield _rows(kept, empty, task, np.array([at + 1]), keys, columns, first, last)

    return rank


def _rows(kept, values, task, ranks, keys, columns, first=None, last=None) -> pa.RecordBatch:
    n = len(ranks)
    arrays = [*values, pa.array(np.full(n, task)), pa.array(ranks.astype(np.int64))]
    names = [*(f.name for f in kept), "task", "rank"]
    for i, (k, c) in enumerate(zip(keys, columns, strict=True)):
        for end, value in (("first", first), ("last", last)):
            arrays.append(pa.nulls(n, c.type) if value is None else pa.array([value[i]], c.type))
            names.append(f"{end}_{k}")
    return pa.RecordBatch.from_arrays(arrays, names)


def name_by_rank(
    df: DataFrame, deal: list[str], keys: list[str], keep: list[str], purpose: str
) -> DataFrame:
    """`keep` and `name`: the rank of each row's `keys` among the distinct ones, from 0.

    Rows are dealt by ranges of `deal`, which has to end with a column that splits equal keys, and to
    start with one that depends on the keys alone.
    """
    types = dict(df.dtypes)
    fields = [f"{c} {types[c]}" for c in keep] + ["task long", "rank long"]
    fields += [f"{end}_{k} {types[k]}" for k in keys for end in ("first", "last")]
    order = list(dict.fromkeys([*deal[:-1], *keys, deal[-1]]))
    ranked = stash(
        df.repartitionByRange(*deal).sortWithinPartitions(*order).mapInArrow(
            _rank(keys, keep), ", ".join(fields)
        ),
        purpose,
    )
    by_task = Window.orderBy("task")
    first = F.struct(*(F.col(f"first_{k}") for k in keys))
    last = F.struct(*(F.col(f"last_{k}") for k in keys))
    # One row per task: how many names the tasks before have used.
    starts = (
        ranked.filter(F.col(f"first_{keys[0]}").isNotNull())
        .withColumn("same", F.coalesce(F.lag(last).over(by_task) == first, F.lit(False)))
        .select(
            "task",
            (
                F.sum("rank").over(by_task.rowsBetween(Window.unboundedPreceding, -1))
            ).alias("before"),
            F.sum(F.col("same").cast("long")).over(
                by_task.rowsBetween(Window.unboundedPreceding, 0)
            ).alias("joined"),
        )
        .select("task", (F.coalesce("before", F.lit(0)) - F.col("joined")).alias("start"))
    )
    return (
        ranked.filter(F.col(f"first_{keys[0]}").isNull())
        .join(F.broadcast(starts), "task")
        .select(*keep, (F.col("start") + F.col("rank")).alias("name"))
    )


def _identities(docs: DataFrame, block_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: `level` and `name`, equal just for equal texts."""
    blocks = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        _cut(block_bytes), _BLOCKS
    )
    keep = ["row", "pos", "n_blocks", *_META]
    level, done = 0, []
    names = name_by_rank(
        blocks.withColumn("hash", F.xxhash64("block")), ["hash", "row"], ["block"], keep, "blocks"
    )
    longest = names.agg(F.max("n_blocks")).first()[0] or 0
    while True:
        done.append(
            names.filter(F.col("n_blocks") <= 2**level).select(
                "row", *_META, F.lit(level).alias("level"), "name"
            )
        )
        if longest <= 2**level:
            break
        odd = F.col("pos") % 2 == 1
        pairs = (
            names.filter(F.col("n_blocks") > 2**level)
            .groupBy("row", F.floor(F.col("pos") / 2).alias("pair"))
            .agg(
                F.max("n_blocks").alias("n_blocks"),
                F.max(F.when(~odd, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("right"),
                *(F.max(c).alias(c) for c in _META),
            )
            .withColumnRenamed("pair", "pos")
        )
        level += 1
        names = name_by_rank(
            pairs, ["left", "right", "row"], ["left", "right"], keep, f"names-{level}"
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Which document stays of those that are equal apart from white space.

    One row per row of `docs`: `doc_id`, `keep_id`, `group_size`, `kept`, `text_sha256` of the text
    without white space, `row_sha256` of the text as it is. Of equal texts the longest stays, then the
    lowest id (null ids last), then any one of rows that are the same. A null text counts as empty, and empty
    texts are equal. Other columns are ignored; an empty table gives no rows. `docs` should be a stored
    table, as ids of rows are given out while it is read.
    """
    rows = stash(_identities(docs, block_bytes, id_col, text_col), "identities")
    order: list[Column] = [
        F.col("n_chars"), F.col("doc_id").isNotNull(), -F.col("doc_id"), -F.col("row")
    ]
    groups = stash(
        rows.groupBy("level", "name").agg(
            F.count("*").alias("group_size"),
            F.max(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("best"),
        ).select(
            "level", "name", "group_size",
            (-F.col("best.o2")).alias("keep_id"), (-F.col("best.o3")).alias("keep_row"),
        ),
        "groups",
    )
    return rows.join(groups, ["level", "name"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        "text_sha256",
        "row_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` that `exact_duplicates` keeps, with all their columns."""
    kept = exact_duplicates(docs, block_bytes=block_bytes).filter("kept").select(
        F.col("doc_id").alias("_kept_id"), F.col("row_sha256").alias("_kept_text")
    )
    text = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    marked = docs.withColumn("_row_text", text)
    return (
        marked.join(
            kept,
            F.col("doc_id").eqNullSafe(F.col("_kept_id"))
            & (F.col("_row_text") == F.col("_kept_text")),
            "left_semi",
        )
        # Rows that agree in id and text count as one.
        .dropDuplicates(["doc_id", "_row_text"])
        .drop("_row_text")
    )
