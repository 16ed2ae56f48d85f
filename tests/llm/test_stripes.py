"""Stripes as they are shuffled."""

import numpy as np

from parley.llm import collocations


def test_stripes_are_texts_with_counts_of_repeated_words():
    stripes = collocations._Stripes(1, np.array([2**64 - 1], np.uint64), [])
    assert list(stripes.add("en", b"b c b a b a. b A")) == []
    (batch,) = stripes.flush()
    got = {r["prefix"]: (r["next"], r["found"]) for r in batch.to_pylist()}
    assert got == {"a": ("b", []), "b": ("a c", [3]), "c": ("b", [])}
