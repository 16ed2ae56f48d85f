"""Near duplicates where many texts are just too far from each other."""

import random

import numpy as np
from brute import near
from pyspark.sql import functions as F

from parley.llm import minhash


def misses(n, seed, words=120, edits=(3, 8)):
    """Texts made of one by changed, left out and doubled words, some of them twice changed alike."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(*edits)):
            at = rng.randrange(len(w))
            kind = rng.randrange(4)
            if kind == 0:
                w[at] = f"c{rng.randrange(10**6)}"
            elif kind == 1:
                w[at] = f"c{rng.randrange(3)}"
            elif kind == 2:
                del w[at]
            else:
                w.insert(at, w[at])
        if rng.random() < 0.15:
            low = rng.randrange(60)
            del w[low : low + rng.randrange(40)]
        rows.append((i, " ".join(w)))
    return rows


def groups(frame, size, percent):
    found = minhash.near_duplicates(frame, size, percent).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found}


def test_near_misses_are_grouped_as_by_all_pairs(spark):
    rows = misses(250, 1) + [(1000 + i, t + " " + " ".join(f"z{i}" for i in range(400))) for i, t in misses(30, 2)]
    rows += [(2000, " ".join(f"b{i}" for i in range(120)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((3, 85), (5, 80), (2, 60)):
        assert groups(frame, size, percent) == near(rows, size, percent)


def test_near_misses_are_not_paired(spark, monkeypatch):
    """Of 3,000 near misses of one text, few pairs are looked at, of 4.5 million."""
    looked_at = []
    confirmed = minhash._Job.confirmed

    def counting(self, pairs, sets):
        looked_at.append(pairs.count())
        return confirmed(self, pairs, sets)

    monkeypatch.setattr(minhash._Job, "confirmed", counting)
    rows = misses(3000, 3, 150, (5, 12))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = minhash.near_duplicates(frame, 3, 85)
    assert found.count() == 3000
    assert sum(looked_at) < 60_000, looked_at


def test_long_texts_are_hashed_in_stretches(monkeypatch):
    rng = np.random.default_rng(0)
    text = " ".join(f"W{i}" for i in rng.integers(0, 500, 3000)).encode() + b" \n " + b"x" * 900
    whole = minhash.word_hashes([b"a b", text, b""])
    sets = minhash.shingles(whole[1], 3)
    monkeypatch.setattr(minhash, "PART_BYTES", 100)
    parts = minhash.word_hashes([b"a b", text, b""])
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    assert np.array_equal(minhash.shingles(parts[1], 3), sets)
