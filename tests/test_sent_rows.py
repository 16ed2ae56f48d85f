"""Rows of messages that were sent."""

from parley.operators import replies

NOW = "2024-01-30 12:30:00"
EPOCH = 1706617800


def test_replies_that_are_sent_become_rows(spark):
    said = spark.createDataFrame(
        [("c1", "acc", 10, 0, "one"), ("c1", "acc", 10, 1, "two"), ("c2", "acc", 10, 0, "gate shut"),
         ("c3", "acc", 10, 0, "inactive"), ("c1", "nokey", 10, 0, "x"), ("c1", "gone", 10, 0, "x"), ("c1", None, 10, 0, "x")],
        "from_user string, to_user string, burst_start long, position int, content string",
    )
    friends = spark.createDataFrame(
        [(1, "c1", 1, 1, 1), (2, "c1", 1, 1, 0), (3, "c2", 1, 1, 0), (4, "c2", 1, 1, 1), (5, "c3", 0, 1, 1), (6, "c1", 0, 1, 0)],
        "id int, wxid string, is_active int, ai_active int, ai_reply int",
    )
    accounts = spark.createDataFrame(
        [(1, "acc", "k"), (2, "acc", "later"), (3, "nokey", "")], "id int, wx_id string, auth_key string"
    )
    got = sorted(replies.sent_message_rows(said, friends, accounts, NOW).collect())
    assert [(r.from_user, r.to_user, r.position, r.content) for r in got] == [
        ("acc", "c1", 0, "one"), ("acc", "c1", 1, "two")
    ]
    assert {(r.is_ai, r.type, r.msg_type, r.create_time, r.status) for r in got} == {(1, 1, 1, EPOCH, "queued")}


def test_task_messages_that_are_sent_become_rows(spark):
    copies = spark.createDataFrame([(1, "hi"), (2, ""), (3, "no key"), (4, None)], "request_id int, content string")
    targets = spark.createDataFrame(
        [(n, 9, "c1", 5, 1, None if n == 3 else "k", "acc") for n in range(1, 5)],
        "request_id int, task_id int, wxid string, friend_id int, account_id int, auth_key string, sender_wxid string",
    )
    (row,) = replies.sent_task_rows(copies, targets, NOW).collect()
    assert (row.request_id, row.from_user, row.to_user, row.content, row.is_ai, row.type, row.msg_type, row.create_time) == (
        1, "acc", "c1", "hi", 1, 1, 1, EPOCH
    )
