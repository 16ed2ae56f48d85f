"""Packing documents into windows by multiway differencing (operator 7).

A document's tokens are cut at multiples of the window; each whole window is a sequence by itself.
What is left is cut at multiples of `cut`, and these pieces are packed by Karmarkar and Karp's
differencing: each piece starts as a partial partition of its own, and the two of the largest
imbalance are merged, the fullest parts of one with the emptiest of the other, until one is left, with
windows that are nearly equal. Where the fullest is beyond the capacity, it is done again with one
window more.

Pieces are dealt into batches of a fixed expected size by a hash, so that the work spreads at any
size of the corpus; the text is read and tokenised once.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stash

WINDOW = 4096
CUT = 1024
END_ID = 2
#: Windows that one batch of differencing is about to fill.
BATCH_WINDOWS = 128
#: Words whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 200_000
#: Characters of the texts whose words are looked up together.
TOGETHER = 1 << 17
VOCABULARY = "word_bpe_49k.json"

#: Marks the end of a word among the ranks.
END = b"\x01"
#: Among lines, those without an apostrophe, control character or special token, of ASCII and Latin-1 letters.
PLAIN = re.compile(r"^(?!.*<\|)[!-&(-~À-ÖØ-öø-ÿ]+$", re.MULTILINE)
#: What the vocabulary takes as a word in them: letters, one digit, or signs.
PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+")

_PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_known: dict[str, tuple] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of texts, as little-endian bytes.

    The vocabulary's rules never join what white space parts, so that each stretch between
    blanks or line ends is tokenised once and remembered. Stretches of plain Latin letters, digits and
    signs, whose rules are simple, go through many at a time as merge ranks; all others go to the tokenizer
    itself. The tests hold both against whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self._ranks(json.load(f)["model"])
        self.seen: dict[str, bytes] = {"": b""}

    def _ranks(self, model: dict) -> None:
        """Tokens as bytes in order of merging; a word's end is a byte that plain words lack."""
        import tiktoken

        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        # Bytes that print stand for themselves, the others for letters from 256 on.
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printed]
        letter = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(others)}
        byte = {c: b for b, c in letter.items()}

        def raw(token: str) -> bytes:
            bare = token.removesuffix(suffix)
            return bytes(byte[c] for c in bare) + END * (bare != token)

        ranks = {bytes([b]): b for b in range(256)}
        ids = [vocab[letter[b]] for b in range(256)]
        ended = [letter[b] + suffix for b in range(256) if bytes([b]) != END]
        for token in [*ended, *(a + b for a, b in map(_pair, model["merges"]))]:
            if (key := raw(token)) not in ranks:
                ranks[key] = len(ids)
                ids.append(vocab[token])
        self.id_of = np.asarray(ids, "<u4")
        self.ends = np.zeros(len(ids), bool)
        self.ends[[r for k, r in ranks.items() if len(k) > 1 and k.endswith(END)]] = True
        self.plain = tiktoken.Encoding(
            "words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={}
        )

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.seen]
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen = {"": b""}
            new = [w for w in words if w]
        plain = PLAIN.findall("\n".join(new))
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            marked = PARTS.sub(r"\g<0>" + END.decode(), "\n".join(part).lower())
            ranks = np.asarray(self.plain.encode_ordinary(marked.replace("\n", "")))
            ids = self.id_of[ranks].tobytes()
            at = np.flatnonzero(self.ends[ranks])
            # The parts there are up to the end of each word, then the ids.
            signs = np.frombuffer(marked.encode("latin-1") + b"\n", np.uint8)
            until = at[np.cumsum(signs == END[0])[signs == 10] - 1] + 1
            begin = 0
            for word, end in zip(part, (4 * until).tolist(), strict=True):
                self.seen[word] = ids[begin:end]
                begin = end
        rest = [w for w in new if w not in self.seen]
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for word, found in zip(
                part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True
            ):
                self.seen[word] = np.asarray(found.ids, "<u4").tobytes()

    def ids_of(self, texts: list[str]) -> Iterator[bytes]:
        """Of each text; words new in any of them are learnt together."""
        split = [text.replace("\n", " ").split(" ") for text in texts]
        self.learn(set().union(*split))
        for words in split:
            yield b"".join(map(self.seen.__getitem__, words))

    def ids(self, text: str) -> bytes:
        return next(self.ids_of([text]))


def _pair(merge: str | list[str]) -> list[str]:
    return merge.split(" ") if isinstance(merge, str) else merge


def _word_ids(path: str) -> WordIds:
    if path not in _known:
        _known[path] = (WordIds(path),)
    return _known[path][0]


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in order, as many at a time as TOGETHER allows, at least one."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _pieces(path: str, window: int, cut: int, end_id: int):
    schema = pa.schema([(n, pa.int64()) for n in
                        ("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens")])
    end = np.asarray([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            texts = (text.as_py() or "" for text in batch.column(1))
            all_ids = (ids for group in _groups(texts) for ids in words.ids_of(group))
            for doc_id, ids in zip(batch.column(0).to_pylist(), all_ids, strict=True):
                ids += end
                total, at = len(ids) // 4, 0
                while at < total:
                    n = window if total - at >= window else min(cut, total - at)
                    crc = zlib.crc32(ids[4 * at : 4 * (at + n)])
                    out.append((row, doc_id, at, n, crc, total))
                    at, row = at + n, row + 1
            columns = zip(*out) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )

    return pieces


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Indexes of `lengths` in so many parts with nearly equal sums."""
    parts: list[list[int]] = [[] for _ in range(windows)]
    if not lengths:
        return parts
    slot = np.min_scalar_type(windows)
    heap = [(-n, i) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    # Sums less than zero, so that they sort from the fullest; of each merge, the two parts and where
    # the sums went. Members are found from these at the end, not moved at each merge.
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []

    def sums_of(node: int) -> np.ndarray:
        if node >= len(lengths):
            return sums.pop(node)
        single = np.zeros(windows, np.int64)
        single[0] = -lengths[node]
        return single

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        total = sums_of(a) + sums_of(b)[::-1]
        order = total.argsort(kind="stable")
        total = total[order]
        made = len(lengths) + len(merges)
        sums[made] = total
        merges.append((a, b, order.astype(slot)))
        heapq.heapreplace(heap, (int(total[0] - total[-1]), made))
    # From the last merge back: the part that each sum of a node has become.
    todo = [(heap[0][1], np.arange(windows))]
    while todo:
        node, place = todo.pop()
        if node < len(lengths):
            parts[place[0]].append(node)
            continue
        a, b, order = merges[node - len(lengths)]
        before = np.empty_like(place)
        before[order] = place
        todo += [(b, before[::-1]), (a, before)]
    return parts


def fill(lengths: list[int], window: int) -> list[list[int]]:
    """As few windows as differencing fits the lengths into, at most `window` in each."""
    windows = max(1, -(-sum(lengths) // window))
    while True:
        parts = difference(lengths, windows)
        if max(sum(lengths[i] for i in p) for p in parts) <= window:
            return [p for p in parts if p]
        windows += 1


_PACKED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def _pack(window: int):
    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        sequence = np.zeros(len(batch), np.int64)
        offset = np.zeros(len(batch), np.int64)
        lengths = batch["length"].tolist()
        first = int(batch["batch"].iloc[0]) << 20
        for k, part in enumerate(fill(lengths, window)):
            at = 0
            for i in part:
                sequence[i], offset[i] = 2 * (first + k), at
                at += lengths[i]
        return batch.assign(sequence_id=sequence, offset=offset)[
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        ]

    return pack


def pack_documents(
    docs: DataFrame,
    vocabulary: str | None = None,
    window: int = WINDOW,
    cut: int = CUT,
    end_id: int = END_ID,
    batch_windows: int = BATCH_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of documents and the sequences they go to, each of at most `window` tokens.

    One row per piece: `doc_id`, `start` (ids of its document before it), `length`, `ids_crc32`
    (of the ids as little-endian unsigned 32-bit numbers), `doc_tokens` (with the end id),
    `sequence_id` and `offset` there, without gaps from 0. A null or empty text is the end id alone. Rows
    that repeat an id are documents of their own, null ids as well. Other columns are ignored; an empty
    table gives no rows. `vocabulary` is the path of a tokenizer file on every machine. Sequence ids are
    unique but not consecutive.
    """
    pieces = stash(
        docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
            _pieces(vocabulary or vocabulary_path(), window, cut, end_id), _PIECES
        ),
        "pieces",
    )
    rest = pieces.filter(F.col("length") < window)
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    batches = max(1, -(-tokens // (batch_windows * window)))
    packed = (
        rest.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)))
        .groupBy("batch")
        .applyInPandas(_pack(window), _PACKED)
    )
    whole = pieces.filter(F.col("length") == window).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (2 * F.col("row") + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return whole.unionAll(packed)
