"""Many small pieces in few windows, and words of several texts."""

import tracemalloc

from parley.llm import packing


def test_differencing_keeps_members_until_the_end():
    tracemalloc.start()
    parts = packing.difference([1] * 2000, 128)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sorted(i for p in parts for i in p) == list(range(2000))
    assert {len(p) for p in parts} <= {15, 16}
    # A list for each of 128 windows and each piece took 20 MB.
    assert most < 5_000_000


def test_words_of_texts_are_learnt_together():
    known = packing.WordIds(packing.vocabulary_path())
    texts = ["ab cd", "", "cd é1\n<|x it's", "ab", "new\rwords 12 ÀB"]
    one = packing.WordIds(packing.vocabulary_path())
    assert list(known.ids_of(texts)) == [one.ids(t) for t in texts]
    groups = list(packing._groups(["a" * packing.TOGETHER, "", "b", "c" * packing.TOGETHER]))
    assert [len(g) for g in groups] == [1, 2, 1] or [len(g) for g in groups] == [2, 1, 1]
