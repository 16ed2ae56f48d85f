"""Toxicity by a subsequence kernel with Nystroem landmarks (operator 10).

Two strings are as alike as the subsequences of three letters they share, each weighted by how far it
is stretched, so that letters put in between or left out take away little. A word's likeness to
a landmark is that of its likest beginning, as insults are inflected; a text has that of its likest word
and the mean over its words.
Landmarks are beginnings of words that set labelled toxic texts apart; the likenesses, turned by the
inverse root of the landmarks' own kernel matrix, are the features of a linear support vector machine,
whose margins a logistic curve turns into scores.

The model is learnt from a bounded sample of labelled rows, outside a held-out fold; all texts are then
scored whole, batch by batch, with nothing shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import SPACES, stash

#: Weight of each place a subsequence is stretched over, and how many at most.
DECAY = 0.6
SPAN = 4
#: Letters of a word that are looked at together; longer words go through in overlapping windows.
LETTERS = 16
STEP = 8
#: Letters of the shortest beginning that counts, and of the longest landmark.
SHORTEST = 4
LONGEST = 9
#: Likenesses count with this power, which is a kernel again; below FLOOR they count as none.
POWER = 4
FLOOR = 0.6
LANDMARKS = 64
#: Candidates a landmark, of which those that overlap with better ones are left out.
RANKED = 40
#: Labelled rows of each class that the model is fitted on.
SAMPLE = 5_000
#: A landmark is found in so many toxic texts of the sample, and such a share of them, at least.
LEAST_TEXTS = 3
LEAST_SHARE = 0.03
RIDGE = 1.0
#: Where one word in so many is like a landmark, more of them make no difference.
OFTEN = 50
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Texts that are scored together.
TEXTS = 512
#: Words whose likenesses a worker remembers; beyond that it starts anew.
REMEMBERED = 300_000

_FIRST, _LAST, _SIGNS = 27, 28, 29
_GAPS = [(d, e) for d in range(1, SPAN) for e in range(1, SPAN) if d + e <= SPAN]
_EDGES = "0123456789.,;:!?%*#$&|\"'()[]{}<>+-=_/\\~^@`"


def _codes() -> np.ndarray:
    """a-z, with or without accents, as 1 to 26; all else, which only keeps its place, as 0."""
    out = np.zeros(0x250, np.int32)
    for point in range(0x250):
        letter = unicodedata.normalize("NFD", chr(point).lower())[0]
        if "a" <= letter <= "z":
            out[point] = ord(letter) - 96
    return out


_CODE = _codes()


def words_of(text: str) -> list[str]:
    """The words in order; a run of single letters also counts as a word, after the others."""
    for space in SPACES[1:]:
        text = text.replace(space, " ")
    words = [w for w in text.lower().split(" ") if w]
    if sum(len(w) == 1 for w in words) < 3:
        return words
    runs: list[list[str]] = [[]]
    for w in words:
        if len(w) == 1 and w.isalpha():
            runs[-1].append(w)
        elif runs[-1]:
            runs.append([])
    return words + ["".join(r) for r in runs if len(r) >= 3]


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of letter codes with marks at both ends, and the word each belongs to."""
    parts, of = [], []
    for i, word in enumerate(words):
        word = word.strip(_EDGES)
        if not word:
            continue
        for at in range(0, max(1, len(word) - LETTERS + STEP), STEP):
            parts.append(word[at : at + LETTERS])
            of.append(i)
    out = np.zeros((len(parts), LETTERS + 2 + SPAN), np.int32)
    if parts:
        lengths = np.array([len(p) for p in parts])
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.repeat(np.arange(len(parts)), lengths)
        places = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[rows, places + 1] = _CODE[np.where(points < len(_CODE), points, 0)]
        out[:, 0] = _FIRST
        out[np.arange(len(parts)), lengths + 1] = _LAST
    return out, np.array(of, np.int64)


def _triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, int, float]]:
    """For each pair of gaps the numbers of the subsequences from each place, how far they end from
    it, and their weight; number -1 stands for none."""
    width = codes.shape[1] - SPAN
    first = codes[:, :width]
    for d, e in _GAPS:
        second, third = codes[:, d : d + width], codes[:, d + e : d + e + width]
        number = (first * _SIGNS + second) * _SIGNS + third
        some = (first > 0) & (second > 0) & (third > 0)
        yield np.where(some, number, -1), d + e, DECAY ** (d + e)


class Kernel:
    """Likeness of words to the landmarks."""

    def __init__(self, landmarks: tuple[str, ...]):
        self.landmarks = landmarks
        table = np.zeros((_SIGNS**3 + 1, max(1, len(landmarks))), np.float32)
        # A landmark is a beginning: without the mark of a word's end.
        codes, _ = _matrix(list(landmarks))
        codes[codes == _LAST] = 0
        for number, _, weight in _triples(codes):
            row, place = np.nonzero(number >= 0)
            np.add.at(table, (number[row, place], row), np.float32(weight))
        self.table = table / np.maximum(np.sqrt((table**2).sum(axis=0)), 1e-12)
        self.known = table.any(axis=1)

    def likeness(self, words: list[str]) -> list[np.ndarray | None]:
        """For each word its likenesses to the power; None if none reaches the floor."""
        out: list[np.ndarray | None] = [None] * len(words)
        codes, of = _matrix(words)
        if not len(codes):
            return out
        width = codes.shape[1] - SPAN
        # By place of the last letter: sums up to it belong to the beginning that ends there.
        norm, shared = np.zeros((2, len(codes), width + SPAN), np.float32)
        for number, end, weight in _triples(codes):
            norm[:, end : end + width] += weight**2 * (number >= 0)
            shared[:, end : end + width] += weight**2 * self.known[number]
        norm, shared = norm.cumsum(axis=1)[:, SHORTEST:], shared.cumsum(axis=1)[:, SHORTEST:]
        # A word with less in common with all landmarks together cannot be like one of them.
        some = np.flatnonzero(((shared >= FLOOR**2 * norm) & (norm > 0)).any(axis=1))
        for at in range(0, len(some), 512):
            part = some[at : at + 512]
            k = np.zeros((len(part), width + SPAN, self.table.shape[1]), np.float32)
            for number, end, weight in _triples(codes[part]):
                k[:, end : end + width] += self.table[number] * np.float32(weight)
            k = k.cumsum(axis=1)[:, SHORTEST:]
            k /= np.sqrt(np.maximum(norm[part], 1e-12))[:, :, None]
            k = np.minimum(k.max(axis=1), 1.0)
            k = np.where(k >= FLOOR, k, 0.0) ** POWER
            for i in np.flatnonzero(k.any(axis=1)):
                word = of[part[i]]
                out[word] = k[i] if out[word] is None else np.maximum(out[word], k[i])
        return out


@lru_cache(maxsize=2)
def _kernel(landmarks: tuple[str, ...]) -> tuple[Kernel, dict]:
    return Kernel(landmarks), {}


def features(texts: list[str], landmarks: tuple[str, ...]) -> np.ndarray:
    """For each text the likenesses to the landmarks of the likest word, and of all words on average.

    The average is taken up to one word in `OFTEN`, and its root.
    """
    kernel, seen = _kernel(landmarks)
    words_in = [words_of(text) for text in texts]
    distinct = [set(words) for words in words_in]
    new = list({w for words in distinct for w in words if w not in seen})
    if len(seen) + len(new) > REMEMBERED:
        seen.clear()
        new = list(set().union(*distinct))
    for at in range(0, len(new), 4096):
        part = new[at : at + 4096]
        seen.update(zip(part, kernel.likeness(part), strict=True))
    size = max(1, len(landmarks))
    out = np.zeros((len(texts), 2 * size))
    for i, words in enumerate(distinct):
        found = {w: k for w in words if (k := seen[w]) is not None}
        if found:
            out[i, :size] = np.max(list(found.values()), axis=0)
            total = np.sum([found[w] for w in words_in[i] if w in found], axis=0)
            out[i, size:] = np.sqrt(np.minimum(OFTEN * total / len(words_in[i]), 1.0))
    return out


@dataclass(frozen=True)
class Model:
    landmarks: tuple[str, ...]
    weights: tuple[float, ...]
    offset: float
    slope: float
    shift: float

    def scores(self, found: np.ndarray) -> np.ndarray:
        margins = found @ np.asarray(self.weights) + self.offset
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def _machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = RIDGE * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        wrong = y * (x @ w) < 1
        a = x[wrong]
        new = np.linalg.solve(ridge + a.T @ a, a.T @ y[wrong])
        if np.allclose(new, w, atol=1e-10):
            break
        w = new
    return w[:-1], float(w[-1])


def _curve(margins: np.ndarray, toxic: np.ndarray, of_rows: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, by Newton steps.

    `of_rows` weights the rows; targets stay off 0 and 1, as one more row of each class would.
    """
    n1, n0 = of_rows[toxic].sum(), of_rows[~toxic].sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (of_rows * (p - target)) + 1e-3 * w
        curve = (x * (of_rows * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(
    landmarks: tuple[str, ...], found: np.ndarray, toxic: np.ndarray, totals: tuple[int, int]
) -> Model:
    """The model from features of a sample; `totals` are the labelled rows of class 0 and 1."""
    if not landmarks or toxic.all() or not toxic.any():
        share = (totals[1] + 0.5) / (sum(totals) + 1.0)
        zeros = (0.0,) * (2 * max(1, len(landmarks)))
        return Model(landmarks, zeros, 0.0, 0.0, float(np.log(share / (1 - share))))
    own = np.array([
        k if k is not None else np.zeros(len(landmarks))
        for k in _kernel(landmarks)[0].likeness(list(landmarks))
    ])
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    inverse_root = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    half = len(landmarks)
    turned = np.hstack([found[:, :half] @ inverse_root, found[:, half:] @ inverse_root])
    w, offset = _machine(turned, np.where(toxic, 1.0, -1.0))
    in_sample = np.array([(~toxic).sum(), toxic.sum()])
    of_rows = np.where(toxic, totals[1] / in_sample[1], totals[0] / in_sample[0])
    slope, shift = _curve(turned @ w + offset, toxic, of_rows)
    weights = np.concatenate([inverse_root @ w[:half], inverse_root @ w[half:]])
    return Model(landmarks, tuple(weights.tolist()), offset, slope, shift)


def held_out_fold(doc_id):
    """Rows that no model may learn from; null ids are in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct beginnings of words of each text that may become landmarks, with its label."""
    for batch in batches:
        found, toxic = [], []
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = {w.strip(_EDGES) for w in words_of(text.as_py() or "")}
            own = {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}
            found += own
            toxic += [label] * len(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.string()), pa.array(toxic, pa.int32())], ["start", "toxic"]
        )


def choose(ranked: list[str], number: int) -> tuple[str, ...]:
    """The first so many of a ranking, without those that begin an earlier one or begin with it."""
    out: list[str] = []
    for start in ranked:
        if not any(start.startswith(x) or x.startswith(start) for x in out):
            out.append(start)
            if len(out) == number:
                break
    return tuple(out)


def _sample_features(landmarks: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            found = features(texts, landmarks)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(list(found), pa.list_(pa.float64()))],
                ["toxic", "found"],
            )

    return run


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, TEXTS):
                texts = [t or "" for t in batch.column(1).slice(at, TEXTS).to_pylist()]
                scores.append(model.scores(features(texts, model.landmarks)))
            score = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score)],
                ["doc_id", "held_out", "score"],
            )

    return run


def learn(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS
) -> Model:
    """Fit the model on at most `sample` labelled texts of each class, taken by a hash of the id."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int"))
        .filter(F.col("toxic").isin(0, 1) & ~held_out_fold(F.col("_id")))
        .groupBy("_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    totals = (counts.get(0, 0), counts.get(1, 0))
    drawn = [
        known.filter(F.col("toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        for c in (0, 1)
    ]
    # At most two times `sample` ids; of rows that repeat an id, one text is taken.
    chosen = F.broadcast(drawn[0].unionAll(drawn[1]))
    texts = stash(
        docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
        .join(chosen, "_id")
        .groupBy("_id")
        .agg(F.max("_text").alias("text"), F.max("toxic").alias("toxic")),
        "sample",
    ).select("text", "toxic")
    one, zero = F.col("n1"), F.col("n0")
    few, many = max(1, min(totals[1], sample)), max(1, min(totals[0], sample))
    # Texts of each class that have a beginning: those whose shares differ most, longer ones first.
    ranked = (
        texts.mapInArrow(_beginnings, "start string, toxic int")
        .groupBy("start")
        .agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
        .filter((one >= max(LEAST_TEXTS, LEAST_SHARE * few)) & (one / few > 3 * zero / many))
        .orderBy((one / few - zero / many).desc(), F.length("start").desc(), "start")
        .limit(RANKED * landmarks)
    )
    words = choose([r["start"] for r in ranked.collect()], landmarks)
    rows = texts.mapInArrow(_sample_features(words), "toxic int, found array<double>").collect()
    found = np.array([r["found"] for r in rows]) if rows else np.zeros((0, 2))
    toxic = np.array([r["toxic"] == 1 for r in rows], bool)
    return fit(words, found, toxic, totals)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id`, `held_out`, `score` and `predicted` for each row of `docs`."""
    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("text"),
            held_out_fold(F.col("doc_id").cast("long")).alias("held_out"),
        )
        .mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )


def toxicity(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS
) -> DataFrame:
    """A toxicity score for each row of `docs`, from the labels outside the held-out fold.

    Gives `doc_id`, `held_out` (crc32 of the id as text leaves 2 by 4; null ids are not), `score` from 0 to 1 and
    `predicted` (1 from 0.3 on). Only the text goes into a score. A null or empty text has no likeness to any
    landmark and gets a low score, the same for all. Labels other than 0 and 1, null labels and labels of
    missing documents are ignored; of labels that repeat an id the higher counts. With labels of one class only,
    or none, all scores are the share of that class. Repeated rows are scored each by itself; other columns
    are ignored; an empty table gives no rows.
    """
    return score_texts(docs, learn(docs, labels, sample, landmarks))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not predicted toxic."""
    model = learn(docs, labels, **options)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                scores = model.scores(features(texts, model.landmarks))
                yield batch.filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
