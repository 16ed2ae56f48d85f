"""Whitening, collocations and substring dedup against plain forms, and their edge cases."""

import math
import random

import numpy as np
import pytest
from brute import phrases, repeats, sha, whitening
from tests.conftest import SF_DIR

from parley.llm import collocations, substrings, whitening as whitening_of
from parley.llm.common import read_table
from parley.llm.queries import QUERIES


def check_whitening(got, rows):
    kept, n, sums, scatter = whitening(rows)
    d = len(sums)
    cov = np.array([[v / n**3 for v in row] for row in scatter])
    trace = np.trace(cov)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    by_component = {}
    for r in got:
        by_component.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(by_component) == list(range(1, len(by_component) + 1))
    for k, found in by_component.items():
        assert sum(map(len, found.values())) == len(kept)
        e = values[k - 1]
        fit = {}
        for vec_id, x in kept:
            r = found[vec_id][0]
            gap = [n * v - s for v, s in zip(x, sums)]
            assert r.n == n and r.deviation == sum(g * g for g in gap)
            assert math.isclose(r.explained, e / trace, rel_tol=1e-6)
            fit[x] = r.whitened
        w = np.array(list(fit.values()))
        # Unit variance, and projected on an eigenvector: V maps the sums of w (x - mean) to e times them.
        centred = np.array([[v - s / n for v, s in zip(x, sums)] for x in fit])
        assert abs(w.mean()) < 1e-6 and abs((w * w).mean() - 1) < 1e-6
        direction = centred.T @ w / n / np.sqrt(e)
        assert np.allclose(cov @ direction, e * direction, atol=1e-6 * values[0])
        assert abs(np.linalg.norm(direction) - 1) < 1e-6
    assert {r.identity_error for r in got} == {got[0].identity_error}
    assert got[0].identity_error <= 1e-6


def test_whitening_of_the_given_table(spark):
    rows = [tuple(r) for r in read_table(spark, SF_DIR, "embeddings").select("vec_id", "embedding").collect()]
    got = QUERIES["op11_whitening"](spark, SF_DIR).collect()
    assert {r.component for r in got} == set(range(1, 17))
    check_whitening(got, rows)


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) * [1, 50, 1e4]).tolist()) for i in range(300)]
    rows += [(3, rows[3][1])] * 100 + [(None, rows[5][1])]
    odd = [(900, None), (901, [1.0, None, 2.0]), (902, [math.nan, 0.0, 0.0]), (903, [0.0, -math.inf, 1.0]),
           (904, []), (905, [1.0, 2.0]), (906, [1e300, 0.0, 0.0])]
    frame = spark.createDataFrame(
        [(i, v, "x", 1) for i, v in rows + odd],
        "vec_id long, embedding array<double>, n string, component int",
    )
    got = whitening_of.whiten(frame).collect()
    assert {r.component for r in got} == {1, 2, 3}
    check_whitening(got, rows)


def test_whitening_keeps_whole_numbers_beyond_64_bits(spark):
    rows = [(0, [0.0, 1.0]), (1, [1e15, 2.0]), (2, [-3e15, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening_of.whiten(frame).collect()
    kept, n, sums, scatter = whitening(rows)
    assert {r.deviation for r in got} == {None}
    trace = scatter[0][0] + scatter[1][1]
    assert math.isclose(sum({r.component: r.explained for r in got}.values()), 1, rel_tol=1e-9)
    assert trace > 2**63


def test_no_variance_no_components(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening_of.whiten(spark.createDataFrame([], schema)).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)
    assert whitening_of.whiten(same).collect() == []


def test_planes_give_exact_products():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1000, (131, 5)).astype(np.uint64)
    ones = whitening_of.plane_counts(whitening_of.bit_planes(x, 10))
    products = (ones * (1 << np.arange(19))).sum(axis=2)
    assert np.array_equal(np.triu(products), np.triu(x.T @ x))


COLUMNS = "lang rank phrase a l r n score".split()


def found_phrases(frame, *args):
    return sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(frame, *args).collect())


def test_collocations_of_the_given_table(spark):
    docs = read_table(spark, SF_DIR, "documents")
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    want = phrases(rows, 5, 100, 100, 2000)
    assert len(want) > 20
    got = QUERIES["op12_collocations"](spark, SF_DIR).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == want


@pytest.mark.parametrize("block,part,bits", [(1 << 20, 1 << 20, 16), (50, 40, 16), (7, 3, 0)])
def test_collocations_of_made_texts(spark, monkeypatch, block, part, bits):
    """The same whatever the size of the blocks, and if the filter lets nearly all through."""
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    monkeypatch.setattr(collocations, "PART_BYTES", part)
    monkeypatch.setattr(collocations, "FILTER_BITS_EACH", bits)
    rng = random.Random(4)
    words = ["a", "B", "b", "új", "ÚJ", "x y", "-", "…", "a\x00"]
    rows = []
    for i in range(150):
        text = "".join(
            rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r"])
            for _ in range(rng.randrange(60))
        )
        rows.append((rng.choice(["en", "en", "en", None, "und", "de"]), text))
    rows += [(None, None), ("en", ""), (None, " . ,"), ("fr", "one two one two one two")] + [("en", "tie one")] * 6
    frame = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "lang string, text string, n int, phrase int")
    assert found_phrases(frame, 5, 4, 100, 2000) == phrases(rows, 5, 4, 100, 2000)
    assert found_phrases(frame, 4, 2, 60, 7) == phrases(rows, 4, 2, 60, 7)


def test_collocations_without_words(spark):
    schema = "lang string, text string"
    assert found_phrases(spark.createDataFrame([], schema)) == []
    assert found_phrases(spark.createDataFrame([(None, None)], schema)) == []


def test_scores_beyond_64_bits(spark):
    phrases_of = spark.createDataFrame(
        [("en", 1, "", "a", "a", 3 * 10**12), ("en", 1, "", "b", "b", 10**12 + 1),
         ("en", 2, "a", "b", "a b", 10**12 - 1)],
        "lang string, size int, prefix string, next string, phrase string, found long",
    )
    totals = spark.createDataFrame([("en", 10**13 + 7)], "lang string, n long")
    row = collocations.cohesion(phrases_of, totals).first()
    assert row.score == 1000 * (10**12 - 1) * (10**13 + 7) // (3 * 10**12 * (10**12 + 1))


def reduced(frame, *args):
    found = substrings.drop_repeats(frame, *args).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found), key=repr)


def test_repeats_of_the_given_table(spark):
    docs = read_table(spark, SF_DIR, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = repeats(rows, 13)
    assert sum(r[2] for r in want) > 1000
    got = QUERIES["op13_substring_dedup"](spark, SF_DIR).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == [
        (a, b, c, sha(d)) for a, b, c, d in want
    ]


@pytest.mark.parametrize("block,part", [(1 << 18, 1 << 20), (17, 30)])
def test_repeats_of_made_texts(spark, monkeypatch, block, part):
    monkeypatch.setattr(substrings, "BLOCK_WORDS", block)
    monkeypatch.setattr(substrings, "PART_BYTES", part)
    rng = random.Random(5)
    passages = [[rng.choice("abcdeÉé") for _ in range(rng.randrange(3, 40))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passages)[rng.randrange(4):] if rng.random() < 0.6 else [
                f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(9))
            ]
        rows.append((rng.choice([None, i, i, i, 3]), rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(500, None), (501, ""), (502, " \n "), (503, "same " * 40), (504, "same " * 13), (2, "same " * 12)]
    rows += [rows[0]] * 30 + [(10**6, rows[7][1])] * 3
    frame = spark.createDataFrame(
        [(a, b, "k", "s") for a, b in rows], "doc_id long, text string, key string, spans string"
    )
    for min_words, seed_words in ((13, 5), (7, 2), (6, 6), (4, 1)):
        assert reduced(frame, min_words, seed_words) == repeats(rows, min_words)


def test_spans_are_maximal(spark):
    run = [f"r{i}" for i in range(30)]
    frame = spark.createDataFrame(
        [(1, " ".join(run)), (2, "x y " + " ".join(run[:20]) + " z " + " ".join(run[15:]))],
        "doc_id long, text string",
    )
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in substrings.drop_repeats(frame).collect()}
    assert spans == {1: [], 2: [(2, 22), (23, 38)]}


def test_no_documents(spark):
    assert substrings.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_passage_in_all_texts_makes_no_pairs(spark):
    """A third of the words the same everywhere: what is gathered grows with the documents."""
    passage = " ".join(f"p{i}" for i in range(25))
    frame = spark.createDataFrame(
        [(i, f"s{i} {passage} e{i}") for i in range(2000)], "doc_id long, text string"
    )
    got = {r.doc_id: r.n_removed for r in substrings.drop_repeats(frame).collect()}
    assert got == {i: 0 if i == 0 else 25 for i in range(2000)}
    found = substrings.matches(substrings._documents(frame, "doc_id", "text"))
    assert found.count() < 2000 * 25
