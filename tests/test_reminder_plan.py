"""The names of a reminder are not put in one place to be numbered."""

import re

from pyspark.sql import functions as F

from parley.operators import members
from tests.test_plans import plan_of


def test_names_do_not_pass_through_one_task(spark):
    people = spark.range(45).select(
        F.when(F.col("id") > 0, F.col("id")).alias("id"), F.format_string("n%d", "id").alias("nickname"),
        F.lit("").alias("remark"),
    )
    pieces = members.reminder_pieces(members.member_reminder(people, 10))
    nodes = re.findall(r"\(\d+\) (?:Window|Exchange)\n.*?(?=\n\n)", plan_of(pieces), re.S)
    single = [n for n in nodes if n.split(" ", 1)[1].startswith("Window") or "SinglePartition" in n]
    assert single and not any(c in n for n in single for c in ("names", "listed", "nickname"))
    got = sorted(pieces.collect())
    assert [(r.piece, r.member_count) for r in got] == [(0, 1), (1, 9), (2, 10), (3, 10), (4, 10), (5, 5)]
    whole = members.reminder_text(F.lit(",".join(f"n{n}" for n in range(45))))
    assert "".join(r.content for r in got) == spark.range(1).select(whole).first()[0]
