"""Substring dedup by seed and extend (operator 13).

Seeds are short runs of words, chosen by winnowing: of the seeds in a window of `min_words` words the one
with the least hash. Equal windows choose the same seed at the same place, so documents that share a window
share an anchor. Documents meet on their anchors; only anchors that lie in documents of
different ids go on. From an anchor the match is extended to both sides:

* as far as a window around the anchor can reach. Where all of this context agrees, every window with the
  anchor in it does, and what matters of a group of equal contexts is its smallest id;
* where the contexts of an anchor differ, those of the smallest ids are extended one side more, the other
  less, to each window that holds the anchor, and windows are matched.

So a passage that a third of all documents share costs a row for each anchor and context, never a pair of
documents. Matches that overlap or touch are joined to maximal repeats. Windows and contexts are matched by 128 bits.

Nothing depends on the order or the numbering of rows: a document is known by its id and the digest of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stash

MIN_WORDS = 13
SEED_WORDS = 5
#: Bytes of text worked on at a time, and words of one long text.
PART_BYTES = 1 << 20
BLOCK_WORDS = 1 << 18

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SPACES = b" \t\n\x0b\x0c\r"
#: A null id counts as the largest.
NO_ID = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finalizer of the public SplitMix64 generator)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _chain(columns: Iterator[np.ndarray], n: int, seed: int) -> np.ndarray:
    out = np.full(n, _U(seed))
    for c in columns:
        out = _mix(out * _BASE + c)
    return out


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in parts of limited size."""
    at = 0
    while at < len(raw):
        end = at + PART_BYTES
        while end < len(raw):
            cut = max(raw.rfind(bytes([c]), at, end) for c in _SPACES) + 1
            if cut > at:
                end = cut
                break
            end += PART_BYTES
        yield raw[at:end].split()
        at = end


def text_key(doc_id: int, raw: bytes) -> bytes:
    """What a document is known by: rows with the same id and text are alike in everything."""
    return hashlib.blake2b(doc_id.to_bytes(8, "little", signed=True) + raw, digest_size=16).digest()


class _Part:
    """The words of a few texts as two numbers each, and where the texts begin."""

    def __init__(self, texts: list[bytes]):
        digests, bounds = [], [0]
        for raw in texts:
            n = 0
            for words in words_of(raw):
                digests.append(b"".join(map(xxhash.xxh3_128_digest, words)))
                n += len(words)
            bounds.append(bounds[-1] + n)
        self.bounds = np.array(bounds)
        # Numbers of words are never 0, which stands for no word.
        self.lanes = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2) | _U(1)


def _anchors(part: _Part, min_words: int, seed_words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors in blocks: text, place, hash of the seed, hash of the context."""
    reach = min_words - seed_words
    total = len(part.lanes)
    previous = -1
    for low in range(0, total, BLOCK_WORDS):
        # Windows that begin in the block, and the words that their contexts reach.
        high = min(low + BLOCK_WORDS, total - min_words + 1)
        if high <= low:
            break
        words = part.lanes[low : high + min_words - 1, 0]
        n = len(words) - seed_words + 1
        seeds = _chain((words[i : i + n] for i in range(seed_words)), n, seed_words)
        text = np.searchsorted(part.bounds, np.arange(low, high + min_words - 1), "right") - 1
        windows = np.flatnonzero(text[: high - low] == text[min_words - 1 :])
        if not len(windows):
            continue
        seen = np.lib.stride_tricks.sliding_window_view(seeds, reach + 1)
        chosen = np.unique(windows + seen[windows].argmin(axis=1))
        # The last anchor of a block may be the first of the next.
        chosen = chosen[chosen + low > previous]
        if not len(chosen):
            continue
        place = chosen + low
        previous = int(place[-1])
        texts = text[chosen]
        first, end = part.bounds[texts], part.bounds[texts + 1]
        around = (
            np.where(
                (place + i >= first) & (place + i < end),
                part.lanes[np.clip(place + i, 0, total - 1), 1],
                _U(0),
            )
            for i in range(-reach, min_words)
        )
        yield texts, place - first, seeds[chosen], _chain(around, len(chosen), min_words)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and texts of a batch in parts of limited size."""
    ids, texts, held = [], [], 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        ids.append(doc_id)
        texts.append(raw)
        held += len(raw) + 100
        if held > PART_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _seed(min_words: int, seed_words: int):
    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _texts(batch):
                keys = pa.array([text_key(i, t) for i, t in zip(ids, texts)], pa.binary())
                ids = np.array(ids)
                part = _Part(texts)
                for text, place, anchor, context in _anchors(part, min_words, seed_words):
                    yield pa.RecordBatch.from_arrays(
                        [_signed(anchor), _signed(context), pa.array(ids[text]),
                         keys.take(pa.array(text)), pa.array(place.astype(np.int32))],
                        ["anchor", "context", "doc_id", "key", "place"],
                    )

    return seed


def _windows(min_words: int, seed_words: int):
    """The windows of a text that hold one of the anchors at `places`."""
    reach = min_words - seed_words

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in _texts(batch):
                rows = slice(at, at + len(ids))
                at += len(ids)
                part = _Part(texts)
                keys = batch.column("key")[rows]
                places = batch.column("places")[rows]
                text = np.repeat(np.arange(len(ids)), places.value_lengths().to_numpy())
                anchors = part.bounds[text] + places.flatten().to_numpy()
                starts = np.unique((anchors[:, None] - np.arange(reach + 1)[None, :]).ravel())
                # An anchor lies in its text, a window around it may not.
                text = np.searchsorted(part.bounds, np.clip(starts, 0, None), "right") - 1
                near = np.searchsorted(part.bounds, starts + min_words - 1, "right") - 1
                inside = (starts >= 0) & (text == near)
                starts, text = starts[inside], text[inside]
                for low in range(0, len(starts), BLOCK_WORDS):
                    some, of = (x[low : low + BLOCK_WORDS] for x in (starts, text))
                    one, two = (
                        _chain(
                            (part.lanes[some + i, lane] for i in range(min_words)),
                            len(some), lane + 1,
                        )
                        for lane in (0, 1)
                    )
                    yield pa.RecordBatch.from_arrays(
                        [_signed(one), _signed(two), pa.array(np.array(ids)[of]),
                         keys.take(pa.array(of)),
                         pa.array((some - part.bounds[of]).astype(np.int32))],
                        ["one", "two", "doc_id", "key", "start"],
                    )

    return windows


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in _texts(batch):
            yield pa.RecordBatch.from_arrays(
                [pa.array([text_key(i, t) for i, t in zip(ids, texts)], pa.binary()),
                 pa.array(ids, pa.int64()), pa.array(texts, pa.string())],
                ["key", "doc_id", "text"],
            )


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def _differ(df: DataFrame, keys: list[str]) -> DataFrame:
    """The `keys` that rows of different ids have, with the smallest id as `first`."""
    return (
        df.groupBy(*keys)
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last"))
        .filter("first < _last")
        .drop("_last")
    )


def matches(
    rows: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS
) -> DataFrame:
    """Runs of words (key, start, end) that also stand in a document with a smaller id.

    `rows` has `doc_id` and `text` without nulls. Runs of a document may overlap; together they cover
    just the words of the windows asked for. No run is shorter than a window.
    """
    reach = min_words - seed_words
    seeds = rows.mapInArrow(
        _seed(min_words, seed_words), "anchor long, context long, doc_id long, key binary, place int"
    )
    shared = stash(_differ(seeds, ["anchor"]).select("anchor"), "anchors")
    met = stash(seeds.join(shared, "anchor"), "met")
    groups = stash(
        met.groupBy("anchor", "context").agg(F.min("doc_id").alias("first")), "contexts"
    )
    open_ones = stash(
        groups.groupBy("anchor")
        .agg(F.min("context").alias("_low"), F.max("context").alias("_high"))
        .filter("_low <> _high")
        .select("anchor"),
        "open-anchors",
    )
    known = met.join(groups, ["anchor", "context"])
    # All of the context is there in a smaller document.
    whole = known.filter("doc_id > first").select(
        "key",
        F.greatest(F.col("place") - reach, F.lit(0)).alias("start"),
        (F.col("place") + min_words).alias("end"),
    )
    places = stash(
        known.filter("doc_id = first")
        .join(open_ones, "anchor", "left_semi")
        .select("key", "place")
        .distinct()
        .groupBy("key")
        .agg(F.collect_list("place").alias("places")),
        "places",
    )
    texts = rows.mapInArrow(_keyed, "key binary, doc_id long, text string")
    windows = stash(
        texts.join(places, "key").mapInArrow(
            _windows(min_words, seed_words), "one long, two long, doc_id long, key binary, start int"
        ),
        "windows",
    )
    seen = stash(_differ(windows, ["one", "two"]), "seen-windows")
    alone = windows.join(seen, ["one", "two"]).filter("doc_id > first").select(
        "key", "start", (F.col("start") + min_words).alias("end")
    )
    return whole.unionAll(alone)


def maximal(runs: DataFrame) -> DataFrame:
    """`key` and `spans`: the runs of a document joined where they overlap or touch, in order."""
    listed = runs.groupBy("key", "start").agg(F.max("end").alias("end")).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs")
    )
    return listed.mapInArrow(_join_runs, "key binary, spans array<struct<start:int,end:int>>")


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, spans = [], []
        for key, runs in zip(batch.column("key").to_pylist(), batch.column("runs")):
            start = np.asarray(runs.values.field("start"))
            end = np.maximum.accumulate(np.asarray(runs.values.field("end")))
            begins = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
            ends = end[np.append(begins[1:] - 1, len(end) - 1)]
            keys.append(key)
            spans.append(
                [{"start": s, "end": e} for s, e in zip(start[begins].tolist(), ends.tolist())]
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(spans, _SPANS)], ["key", "spans"]
        )


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_REDUCED = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", _SPANS),
     ("kept_text", pa.string())]
)


def without(raw: bytes, spans: list[dict]) -> tuple[int, int, bytes]:
    """How many words there are and how many go, and the others joined by one space."""
    kept, n, removed, at = [], 0, 0, 0
    for words in words_of(raw):
        low, n = n, n + len(words)
        upto = low
        while at < len(spans) and spans[at]["start"] < n:
            first, end = max(spans[at]["start"], low), min(spans[at]["end"], n)
            kept += words[upto - low : first - low]
            removed += end - first
            upto = end
            if spans[at]["end"] > n:
                break
            at += 1
        kept += words[upto - low :]
        kept = [b" ".join(kept)] if kept else kept
    return n, removed, b"".join(kept)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = 0

    def made() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _REDUCED)], schema=_REDUCED
        )

    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for doc_id, text, found in zip(ids, batch.column("text"), batch.column("spans")):
            spans = found.as_py() or []
            n, removed, kept = without(text.as_buffer().to_pybytes(), spans)
            out.append((doc_id, n, removed, spans, kept))
            held += len(kept) + 100
            if held > 4 * PART_BYTES:
                yield made()
                out, held = [], 0
    if out:
        yield made()


def drop_repeats(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    seed_words: int = SEED_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents without the runs of `min_words` words and more that a smaller id has as well.

    One row per row of `docs`: `doc_id`, `n_words`, `n_removed`, the removed `spans` of words (start,
    end; maximal) and `kept_text`, the other words joined by one space. Words are parted by ASCII white space
    and compared as they are. All windows are judged on the texts as given. A run that stands twice in one
    document, or in rows of the same id only, stays. A null id is larger than any other; null ids
    are the same id. A null or empty text has no words. Other columns are ignored; an empty table gives no
    rows.
    """
    rows = _documents(docs, id_col, text_col)
    spans = stash(maximal(matches(rows, min_words, seed_words)), "spans")
    texts = rows.mapInArrow(_keyed, "key binary, doc_id long, text string")
    out = texts.join(spans, "key", "left").mapInArrow(
        _removed,
        "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, "
        "kept_text string",
    )
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def kept_digest(kept: Column) -> Column:
    return F.sha2(kept, 256)
