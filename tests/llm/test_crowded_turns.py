"""Conversations whose turn numbers do not part their rows."""

import pytest
from pyspark.sql import functions as F

from parley.llm import chat

MANY = 3000
FORM = "<|{}|>\n{}\n<|end|>\n".format


@pytest.mark.parametrize("conv_id, turn", [(None, None), (None, 3), (5, None), (5, 7)])
def test_blocks_are_cut_by_number_of_turns(spark, conv_id, turn):
    table = spark.range(MANY).select(
        F.lit(conv_id).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("u").alias("role"),
        F.format_string("t%d", "id").alias("text"),
    )
    other = spark.createDataFrame([(9, 0, "u", "x"), (9, 1, "a", "y")], table.schema)
    got = sorted(chat.chat_texts(table.unionByName(table).unionByName(other)).collect(), key=lambda r: (r.conv_id == 9, r.part))
    assert (got[-1].conv_id, got[-1].text) == (9, FORM("u", "x") + FORM("a", "y"))
    got = got[:-1]
    assert [r.part for r in got] == list(range(-(-MANY // 256)))
    assert all(r.conv_id == conv_id and r.n_turns == MANY and r.text.count("<|end|>") <= 256 for r in got)
    want = sorted(("u" if n % 2 else "a", f"t{n}") for n in range(MANY))
    assert "".join(r.text for r in got) == "".join(FORM(*t) for t in want)


def test_equal_turn_numbers_go_by_text(spark):
    """Of rows that share a turn and role the lower text is the prefix, as in the SQL."""
    rows = [(c, 0, "u", t) for c in range(40) for t in (f"a{c}", f"b{c}")]
    rows += [(100 + c, 0, "u", f"a{c}") for c in range(40)] + [(200 + c, 0, "u", f"b{c}") for c in range(40)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(r.conv_id for r in chat.chat_texts(table).collect())
    assert got == [*range(40), *range(200, 240)]
