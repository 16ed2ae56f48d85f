"""Collocations by the stripes pattern (operator 12).

Each prefix of up to four words keys an associative counter of the words that follow it: a stripe. The
empty prefix has the stripe of all words. Tasks count the stripes of their texts, and stripes of one
prefix are merged elementwise. From the merged stripes comes all that is asked for: the entries are the
phrases one word longer, an entry of the stripe before is the total of a prefix, and the largest entry of
a stripe, and of the stripes that begin one word earlier, tells what subsumes a phrase.

Stripes are made one length after the other. A phrase can only be frequent if its first and its last words
without the other end are, so the words at which a longer stripe is counted have to pass a filter of the
frequent phrases one word shorter. The filter only saves work: what it lets through by mistake is counted
right and then found rare. Words are numbered within a task and phrases named by pairs of numbers, so nothing
is counted by a hash.

A stripe is written as its words in one text, those found more than once first, and the counts of these
alone, which takes about half of what two arrays take. Stripes are shuffled whole, but for those of hot prefixes (at most 256 of a length), which come in parts
by the hash of the next word, so a prefix that a third of all rows has is spread. The stripe of all words is merged
word by word, combined before the shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count as counting

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import stash

LONGEST = 5
LEAST_COUNT = 100
SUBSUMED_PERCENT = 100
TOP = 2000
#: Words counted together in a task, and bytes of a text that are parted at a time.
BLOCK_WORDS = 1 << 20
PART_BYTES = 1 << 20
#: A prefix is hot if one word in so many follows it; so many there can be at most. Stripes of hot
#: prefixes come in parts by the hash of the next word.
HOT_SHARE, HOT_PARTS = 256, 128
#: Bits of the filter for each frequent phrase, and the most it may have (32 MB).
FILTER_BITS_EACH = 16
MOST_FILTER_BITS = 1 << 28
#: Groups that a language is dealt to before its best phrases are ranked.
RANK_GROUPS = 64

# Signs that end a piece, and the language of rows without one.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
NO_LANG = "und"

#: No byte of UTF-8, so it can stand for the end of a piece.
_END = b"\xff"
_TO_END = bytes.maketrans(PIECE_ENDS, _END * len(PIECE_ENDS))

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finalizer of the public SplitMix64 generator)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _seed(lang: str, size: int) -> np.ndarray:
    """Where the number begins by which the filter knows a phrase of `size` words."""
    return np.array([xxhash.xxh3_64_intdigest(lang.encode())], _U) * _BASE + _U(size)


def _phrase_hash(lang: str, phrase: str, size: int) -> int:
    h = _seed(lang, size)
    for w in phrase.encode().split(b" "):
        h = _mix(h * _BASE + _U(xxhash.xxh3_64_intdigest(w)))
    return int(h[0])


def _tokens(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, with marks where pieces end, in parts of limited size."""
    raw = raw.lower().translate(_TO_END)
    at = 0
    while at < len(raw):
        end = at + PART_BYTES
        if end < len(raw):
            # Cut behind a blank or a mark, so that no word is cut.
            cut = max(raw.rfind(c, at, end) for c in (b" ", b"\t", _END)) + 1
            while cut <= at and end < len(raw):
                end += PART_BYTES
                cut = max(raw.rfind(c, at, end) for c in (b" ", b"\t", _END)) + 1
            end = cut if cut > at else len(raw)
        yield raw[at:end].replace(_END, b" \xff ").split()
        at = end


class _Stripes:
    """Counts the words that follow prefixes of `size` words, in blocks of texts of one task."""

    def __init__(self, size: int, passes: np.ndarray | None, hot: list[int]):
        self.size, self.passes, self.hot = size, passes, np.array(hot, _U)
        self.reset()

    def reset(self) -> None:
        # The mark has number 0.
        self.number: defaultdict[bytes, int] = defaultdict(counting(1).__next__)
        self.number[_END] = 0
        self.parts: defaultdict[str, list[np.ndarray]] = defaultdict(list)
        self.held = 0

    def add(self, lang: str, raw: bytes) -> Iterator[pa.RecordBatch]:
        for tokens in _tokens(raw):
            self.parts[lang].append(
                np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
            )
            self.held += len(tokens)
            if self.held > BLOCK_WORDS:
                # A text goes on: its last words may begin prefixes that end in the next block.
                words = list(self.number)
                last = np.concatenate(self.parts[lang])[-self.size :] if self.size else []
                tail = [_END if i == 0 else words[i] for i in last]
                yield from self.flush()
                self.parts[lang].append(
                    np.array([self.number[w] for w in tail], np.int64)
                )
                self.held = len(tail)
        self.parts[lang].append(np.zeros(1, np.int64))
        self.held += 1

    def flush(self) -> Iterator[pa.RecordBatch]:
        # Numbers are given in order, but for the mark, which comes first.
        words = [b"", *list(self.number)[1:]]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
        for lang, parts in self.parts.items():
            ids = np.concatenate(parts)
            if len(ids):
                yield from self._stripes(lang, ids, words, hashes)
        self.reset()

    def _stripes(self, lang, ids, words, hashes) -> Iterator[pa.RecordBatch]:
        size, n = self.size, len(ids) - self.size
        if n <= 0:
            return
        whole = ids[:n] != 0
        for k in range(1, size + 1):
            whole &= ids[k : n + k] != 0
        starts = np.flatnonzero(whole)
        known = np.zeros(len(starts), _U)
        for first in (1, 0) if size else ():
            h = np.repeat(_seed(lang, size), len(starts))
            for k in range(size):
                h = _mix(h * _BASE + hashes[ids[starts + (first + k)]])
            place = h % _U(len(self.passes) * 64)
            ok = ((self.passes[place >> _U(6)] >> (place & _U(63))) & _U(1)).astype(bool)
            starts, known = starts[ok], h[ok]
        if not len(starts):
            return
        # Names of prefixes: a word's number, then pairs of a name and the next word's number.
        names = ids[starts] if size else np.zeros(len(starts), np.int64)
        for k in range(1, size):
            _, names = np.unique(names * len(words) + ids[starts + k], return_inverse=True)
        following = ids[starts + size]
        part = np.where(np.isin(known, self.hot), hashes[following] % _U(HOT_PARTS), _U(0))
        part = part.astype(np.int64)
        # The parts of a stripe one after the other.
        pairs, at, found = np.unique(
            (names * HOT_PARTS + part) * len(words) + following,
            return_index=True, return_counts=True,
        )
        heads = np.flatnonzero(np.diff(pairs // len(words), prepend=-1))
        # Of each stripe first the words found more than once, whose counts are written.
        stripe = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(pairs))))
        order = np.argsort(2 * stripe + (found == 1), kind="stable")
        at, found = at[order], found[order]
        counted = np.append(0, np.cumsum(np.bincount(stripe[found > 1], minlength=len(heads))))
        first = starts[at]
        texts = pa.array(words, pa.binary()).view(pa.string())
        prefixes = [
            b" ".join([words[i] for i in ids[s : s + size].tolist()]) for s in first[heads].tolist()
        ]
        offsets = pa.array(np.append(heads, len(pairs)).astype(np.int32))
        following = ids[first + size]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(heads), pa.string()),
                pa.array(prefixes, pa.binary()).view(pa.string()),
                pa.array(part[at[heads]].astype(np.int32)),
                pc.binary_join(
                    pa.ListArray.from_arrays(offsets, texts.take(pa.array(following))), " "
                ),
                pa.ListArray.from_arrays(
                    pa.array(counted.astype(np.int32)), pa.array(found[found > 1].astype(np.int32))
                ),
            ],
            ["lang", "prefix", "part", "next", "found"],
        )


def _count(size: int, passes: np.ndarray | None, hot: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = _Stripes(size, passes, hot)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    yield from stripes.add(lang, text.as_buffer().to_pybytes())
        yield from stripes.flush()

    return count


def _filter_words(batches: Iterator[pa.RecordBatch], size: int, bits: int):
    for batch in batches:
        out: dict[int, int] = defaultdict(int)
        for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            place = _phrase_hash(lang, phrase, size) % bits
            out[place >> 6] |= 1 << (place & 63)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(out), pa.int64()),
             pa.array([v - (v >> 63 << 64) for v in out.values()], pa.int64())],
            ["word", "bits"],
        )


def phrase_filter(phrases: DataFrame, size: int) -> np.ndarray:
    """Bits of the phrases (lang, phrase) of `size` words, in a table of MOST_FILTER_BITS at most."""
    wanted = max(1 << 16, phrases.count() * FILTER_BITS_EACH)
    bits = min(MOST_FILTER_BITS, 1 << (wanted - 1).bit_length())
    rows = (
        phrases.select("lang", "phrase")
        .mapInArrow(lambda b: _filter_words(b, size, bits), "word long, bits long")
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(_U)


def merged_stripes(
    docs: DataFrame,
    size: int,
    passes: np.ndarray | None,
    hot: list[int],
    lang_col: str,
    text_col: str,
) -> DataFrame:
    """The elements (lang, prefix, next, found) of the merged stripes of prefixes of `size` words."""
    stripes = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
        F.col(text_col).alias("text"),
    ).mapInArrow(
        _count(size, passes, hot),
        "lang string, prefix string, part int, next string, found array<int>",
    )
    if size:
        stripes = stripes.repartition("lang", "prefix", "part")
    return (
        stripes.select(
            "lang", "prefix", "part", "found", F.posexplode(F.split("next", " ")).alias("place", "next")
        )
        .withColumn("found", F.coalesce(F.get("found", "place"), F.lit(1)))
        .groupBy("lang", "prefix", "part", "next")
        .agg(F.sum("found").alias("found"))
        .drop("part")
    )


def hot_prefixes(phrases: DataFrame, size: int, n: int) -> list[int]:
    """The numbers of the phrases of `size` words that make up one in HOT_SHARE of `n` places or more."""
    rows = phrases.filter(F.col("found") * HOT_SHARE >= n).select("lang", "phrase").collect()
    return [_phrase_hash(r.lang, r.phrase, size) for r in rows]


def frequent_phrases(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST_COUNT,
    lang_col: str = "lang",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to `longest` words that occur `least` times, and the words of each language.

    The first table has `lang, size, prefix, next, phrase, found`, the second `lang, n`.
    """
    # Rare words are only counted: all those of a language in one row, without a word.
    often = F.when(F.col("found") >= least, F.col("next")).alias("next")
    words = stash(
        merged_stripes(docs, 0, None, [], lang_col, text_col)
        .groupBy("lang", often)
        .agg(F.sum("found").alias("found"))
        .withColumn("prefix", F.lit("")),
        "words",
    )
    totals = stash(words.groupBy("lang").agg(F.sum("found").alias("n")), "totals")
    n = totals.agg(F.sum("n")).first()[0] or 0
    levels, rows = [], words.filter(F.col("next").isNotNull())
    for size in range(longest):
        if size:
            passes = phrase_filter(levels[-1], size)
            if not passes.any():
                break
            hot = hot_prefixes(levels[-1], size, n)
            rows = merged_stripes(docs, size, passes, hot, lang_col, text_col)
        phrase = F.concat_ws(" ", "prefix", "next") if size else F.col("next")
        levels.append(
            stash(
                rows.filter(F.col("found") >= least).select(
                    "lang", F.lit(size + 1).alias("size"), "prefix", "next",
                    phrase.alias("phrase"), "found",
                ),
                f"frequent-{size + 1}",
            )
        )
    out = levels[0]
    for more in levels[1:]:
        out = out.unionAll(more)
    return out, totals


def _cut(words: Column, at: Column, rest: bool) -> Column:
    part = F.slice(words, at + 1, F.size(words) - at) if rest else F.slice(words, F.lit(1), at)
    return F.array_join(part, " ")


def cohesion(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """`lang, phrase, a, l, r, n, score` of the phrases of two words and more, by their weakest cut."""
    words = F.split("phrase", " ")
    cuts = phrases.filter("size > 1").select(
        "lang", "phrase", F.col("found").alias("a"), words.alias("words"),
        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"),
    )
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        _cut(F.col("words"), F.col("k"), False).alias("left"),
        _cut(F.col("words"), F.col("k"), True).alias("right"),
    )
    lefts = phrases.select("lang", F.col("phrase").alias("left"), F.col("found").alias("l"))
    rights = phrases.select("lang", F.col("phrase").alias("right"), F.col("found").alias("r"))

    def whole(c: str) -> Column:
        return F.col(c).cast("decimal(18,0)")

    # The quotient is at most 1000 n / max(l, r), so it fits a long.
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (whole("a") * whole("n")),
                            whole("l") * whole("r"))
    known = stash(
        cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(totals, "lang")
        .select("lang", "phrase", "a", "n", "k", "l", "r", score.cast("long").alias("score")),
        "cuts",
    )
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return known.groupBy("lang", "phrase", "a", "n").agg(weakest).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )


def subsumed(phrases: DataFrame, percent: int = SUBSUMED_PERCENT) -> DataFrame:
    """(lang, phrase) of those that lie in a longer frequent phrase which has `percent` of their count.

    A longer phrase has at most the count of the phrase in it that is one word longer than the one asked about,
    so the largest count of those decides: the largest element of the stripe that the phrase
    keys, or of those elements that end with the phrase.
    """
    longer = phrases.filter("size > 1")
    after = longer.select("lang", F.col("prefix").alias("phrase"), "found")
    before = longer.select(
        "lang", F.expr("substring_index(phrase, ' ', 1 - size)").alias("phrase"), "found"
    )
    most = stash(
        after.unionAll(before).groupBy("lang", "phrase").agg(F.max("found").alias("most")), "most"
    )
    held = longer.select("lang", "phrase", "found").join(most, ["lang", "phrase"])
    wide = "decimal(20,0)"
    return held.filter(
        F.col("most").cast(wide) * 100 >= F.col("found").cast(wide) * percent
    ).select("lang", "phrase")


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST_COUNT,
    percent: int = SUBSUMED_PERCENT,
    top: int = TOP,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """The phrases of each language whose words keep together most.

    `lang, rank, phrase, a, l, r, n, score`: of the phrases of two to `longest` words that occur `least`
    times, and lie in no longer one with `percent` of their count, the first `top` by score, count and
    phrase. Words are parted by spaces and tabs, pieces by signs and line ends; A-Z count as a-z. A null
    language is `und`, a null or empty text has no words; repeated rows count each time. Other columns are
    ignored; an empty table gives no rows.
    """
    phrases, totals = frequent_phrases(docs, longest, least, lang_col, text_col)
    scored = cohesion(phrases, totals)
    scored = scored.join(stash(subsumed(phrases, percent), "subsumed"), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language, so that none has to be ranked in one task.
    parts = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS)))
    first = Window.partitionBy("lang", "_part").orderBy(*order)
    best = parts.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return best.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
