"""Near-duplicates among rows that share an id."""

import random

from parley.llm import minhash


def words(seed, n=120):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def near(text, n):
    """The text with another last word."""
    return [*text[:-1], f"end{n}"]


def test_texts_that_share_an_id_are_judged_each(spark):
    a, b, c, unique = (words(n) for n in range(4))
    rows = [
        (1, a), (5, near(a, 1)), (5, unique),  # a near copy of a smaller id, and a text of its own
        (2, b), (2, near(b, 1)), (2, near(b, 2)), (7, near(b, 3)),  # a repeated smallest id
        (3, c), (3, c), (None, near(c, 1)),
    ]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in rows] + [(9, None), (9, "")], "doc_id long, text string")
    kept = minhash.drop_near_duplicates(table)
    assert kept.columns == table.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(i for i, _ in got if i is not None) == [1, 2, 3, 3, 5, 9, 9]
    assert (1, " ".join(a)) in got and (5, " ".join(unique)) in got
    assert [t for i, t in got if i is None] == [" ".join(near(c, 1))]
    again = minhash.drop_near_duplicates(table.repartition(3))
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))
