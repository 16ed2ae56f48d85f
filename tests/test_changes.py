from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parley.operators import changes, members
from parley.schemas import SCHEMAS, conform, corrected_names, with_defaults
from parley.sources import documents

NOW = "2024-01-30 12:30:00"
THEN = datetime(2024, 1, 30, 12, 30)
OLD = datetime(2020, 1, 1)


def by_id(df, *cols):
    return {r.id: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.fixture
def tasks(spark):
    data = [
        {"id": 1, "friend_id": 1, "task_name": "a", "is_active": 1, "execution_count": None, "update_time": OLD},
        {"id": 2, "friend_id": 2, "task_name": "b", "is_active": 0, "execution_count": 4, "update_time": OLD},
        {"id": 3, "friend_id": 1, "task_name": "c", "is_active": 1, "execution_count": 0, "update_time": OLD},
    ]
    names = SCHEMAS["friends_task"].names
    return spark.createDataFrame(
        [tuple(d.get(n) for n in names) for d in data], SCHEMAS["friends_task"]
    ).withColumns({"end_date": F.lit(""), "cron_expression": F.lit("0 0 8 * * *")})


def test_patch_sets_nulls_and_the_last_one_wins(rows):
    df = rows("id int, a string, b int, update_time timestamp_ntz", (1, "x", 1, OLD), (2, "y", 2, OLD))
    patches = rows("id int, a string, seq int", (1, "first", 1), (1, None, 2), (9, "z", 1))
    got = changes.apply_patch(df, patches, "id", ["a"], NOW, "seq")
    assert by_id(got, "a", "b", "update_time") == {1: (None, 1, THEN), 2: ("y", 2, OLD)}
    assert got.columns == df.columns
    unchanged = changes.apply_patch(df, patches.limit(0), "id", ["a"], NOW, "seq")
    assert sorted(unchanged.collect()) == sorted(df.collect())


def test_empty_times_become_null(rows):
    df = changes.empty_to_null(rows("id int, start_time string", (1, ""), (2, "x")), "start_time")
    assert by_id(df, "start_time") == {1: (None,), 2: ("x",)}


def test_members_at_the_boundaries(rows):
    friends = rows(
        "id int, is_active int, ai_active int, end_time timestamp_ntz, remark string, nickname string",
        (1, 1, 1, datetime(2024, 1, 30, 12, 29, 59), "", "n1"),
        (2, 1, 1, THEN, "r2", "n2"),
        (3, 1, 1, datetime(2024, 1, 31, 12, 30), None, "n3"),
        (4, 1, 1, datetime(2024, 1, 31, 12, 30, 1), "r4", "n4"),
        (5, 0, 1, OLD, "r5", "n5"),
        (6, 1, 0, None, "r6", None),
        (7, 1, 1, OLD, None, None),
        (8, None, 1, OLD, "r8", "n8"),
    )
    assert sorted(r.id for r in members.expired_members(friends, NOW).collect()) == [1, 7]
    assert sorted(r.id for r in members.expiring_members(friends, NOW).collect()) == [2, 3]
    expired = by_id(members.expire_members(friends, NOW), "is_active", "ai_active")
    assert expired[1] == expired[7] == (0, 0)
    assert expired[5] == (0, 1) and expired[6] == (1, 0) and expired[8] == (None, 1)
    (row,) = members.member_reminder(members.expired_members(friends, NOW)).collect()
    assert (row.member_count, row.names) == (2, "n1,")
    text = members.reminder_text(F.col("names"), members.EXPIRING_END)
    (row,) = members.member_reminder(friends.where("id IN (2, 3)")).select(text.alias("t")).collect()
    assert row.t == "注意：r2,n3 会员将在24小时内到期"
    pieces = members.reminder_pieces(members.member_reminder(friends.where("id IN (2, 3)"), 3))
    assert [(r.piece, r.member_count, r.content) for r in pieces.orderBy("piece").collect()] == [
        (0, 1, "注意：r2"), (1, 1, ",n3 会员已到期")
    ]


CONTACT = "account_id int, position int, wxid string, nickname string, avatar string, remark string, signature string, province string, city string, country string"


def contact(account, position, wxid, nickname):
    return (account, position, wxid, nickname, "", "", "", "", "", "")


@pytest.fixture
def friends(spark):
    df = spark.createDataFrame([(5, 1, "a", 1, "keep"), (3, 1, "a", 0, "keep"), (7, 2, "a", 1, "keep")],
                               "id int, account_id int, wxid string, is_active int, remark string")
    return conform(df, "friends").withColumn("update_time", F.lit("2020-01-01").cast("timestamp_ntz"))


def test_contacts_are_added_once_and_update_profiles_only(friends, rows):
    incoming = rows(
        CONTACT, contact(1, 0, "a", "early"), contact(1, 1, "b", "new"), contact(1, 2, "a", "late"),
        contact(1, 3, "b", "newer"), contact(2, 0, "c", "other"),
    )
    merged = changes.upsert_contacts(friends, incoming, NOW)
    got = by_id(merged, "account_id", "wxid", "nickname", "remark", "is_active", "role_id", "update_time")
    assert got[3] == (1, "a", "late", "", 0, 1009, THEN)
    assert got[5] == (1, "a", None, "keep", 1, 1009, OLD)
    assert got[7] == (2, "a", None, "keep", 1, 1009, OLD)
    added = {v[:3] for k, v in got.items() if k > 7}
    assert added == {(1, "b", "newer"), (2, "c", "other")} and set(got) == {3, 5, 7, 8, 9}
    again = changes.upsert_contacts(merged, incoming, NOW)
    assert sorted(again.collect()) == sorted(merged.collect())


def test_accounts_are_added_or_updated(spark, rows):
    accounts = conform(rows("id int, wx_id string, nickname string, alias string", (1, "x", "old", "al")), "accounts")
    patches = rows(
        "wx_id string, auth_key string, nickname string, seq int",
        ("x", "k1", "one", 1), ("x", "k2", None, 2), ("y", "k3", "new", 1),
    )
    got = by_id(changes.upsert_accounts(accounts, patches, NOW), "wx_id", "auth_key", "nickname", "alias", "ws_status")
    assert got == {1: ("x", "k2", None, "al", "0"), 2: ("y", "k3", "new", None, "0")}


OPS = (
    "op_seq long, id long, operate string, friend_id int, task_name string, cron_expression string, "
    "start_date string, end_date string, is_active int, given array<string>"
)


def test_task_operations(tasks, rows):
    ops = rows(
        OPS,
        (0, 1, "update", None, "n1", "? ? ? ? ? ?", None, None, None, ["task_name", "cron_expression"]),
        (1, 1, "update", None, None, None, None, "2030-01-01", None, ["task_name", "end_date"]),
        (2, 2, "update", None, "gone", None, None, None, None, ["task_name"]),
        (3, 2, "delete", None, None, None, None, None, None, []),
        (4, -1, "add", 9, "new", "0 0 8 ? * *", None, None, 0, ["friend_id", "task_name", "is_active"]),
        (5, 3, "add", 9, "ignored", None, None, None, None, ["task_name"]),
        (6, 3, "rename", None, "ignored", None, None, None, None, ["task_name"]),
        (7, 77, "update", None, "nobody", None, None, None, None, ["task_name"]),
        (8, -1, "add", 9, "second", None, None, None, None, []),
    )
    result = changes.apply_task_ops(tasks, ops, NOW)
    got = by_id(result, "task_name", "cron_expression", "end_date", "is_active", "friend_id", "execution_count", "update_time")
    added = [got.pop(4), got.pop(5)]
    assert sorted(added, key=lambda r: r[0]) == [
        ("new", "0 0 8 * * *", None, 0, 9, 0, THEN), ("second", None, None, 1, 9, 0, THEN),
    ]
    assert got == {
        1: (None, "* 1 * * * *", "2030-01-01", 1, 1, None, THEN),
        3: ("c", "0 0 8 * * *", "", 1, 1, 0, OLD),
    }


def test_executions_and_errors(tasks, rows):
    runs = rows("task_id int, run_time timestamp_ntz, error_message string",
                (1, THEN, "late"), (1, OLD, "early"), (9, THEN, "nobody"), (2, OLD, None))
    got = by_id(changes.record_executions(tasks, runs), "execution_count", "last_execution_time")
    assert got == {1: (2, THEN), 2: (5, OLD), 3: (0, None)}
    got = by_id(changes.record_errors(tasks, runs), "error_message", "last_execution_time")
    assert got == {1: ("late", THEN), 2: (None, OLD), 3: (None, None)}


def test_closing_and_retiring(tasks, rows):
    closed = changes.close_tasks(tasks, rows("friend_id int", (1,), (1,), (8,)), NOW)
    assert by_id(closed, "is_active", "update_time") == {1: (0, THEN), 2: (0, OLD), 3: (0, THEN)}
    ends = F.when(F.col("id") == 1, "2024-01-29").when(F.col("id") == 2, "2024-01-01").otherwise("2024-01-30")
    retired = changes.retire_tasks(tasks.withColumn("end_date", ends), NOW)
    assert by_id(retired, "is_active", "update_time") == {1: (0, THEN), 2: (0, OLD), 3: (1, OLD)}


def test_delete_keeps_what_is_guarded(rows):
    roles = rows("id int, is_system int", (1, 1), (2, 0), (3, None), (4, 1))
    kept, refused = changes.delete_rows(roles, rows("id int", (1,), (2,), (2,), (3,), (9,)), "id", F.col("is_system") == 1)
    assert sorted(r.id for r in kept.collect()) == [1, 4]
    assert [r.id for r in refused.collect()] == [1]
    kept, refused = changes.delete_rows(roles, rows("id int", (1,)))
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4] and refused.count() == 0


def test_status_online_and_set_all(rows):
    messages = rows("id int, msg_id string, status string", (1, "m", "queued"), (2, "n", "queued"), (3, None, "queued"))
    patches = rows("msg_id string, status string", ("m", "processed"), ("m", "failed"), (None, "failed"))
    assert by_id(changes.set_message_status(messages, patches), "status") == {1: ("failed",), 2: ("queued",), 3: ("queued",)}
    accounts = conform(rows("id int, auth_key string, onlineTime string, alias string", (1, "k", "t", "a"), (2, "l", "t", "a")), "accounts")
    got = by_id(changes.reset_online(accounts, rows("auth_key string", ("k",), ("k",))), "onlineTime", "alias")
    assert got == {1: (None, "a"), 2: ("t", "a")}
    assert by_id(changes.set_all(accounts, ws_status=0), "ws_status") == {1: ("0",), 2: ("0",)}


def test_schedule_diff_covers_every_id_once(rows):
    active = rows("id int, cron_expression string", (1, "a"), (2, "b"), (3, None), (5, None))
    scheduled = rows("id int, cron string", (2, "x"), (3, None), (4, "d"), (1, "a"))
    got = by_id(changes.schedule_diff(active, scheduled), "action")
    assert got == {1: ("unchanged",), 2: ("changed",), 3: ("unchanged",), 4: ("removed",), 5: ("new",)}


def test_rows_with_and_without_id(tasks, rows):
    incoming = rows("id int, seq int, friend_id int, task_name string", (1, 1, 9, "p"), (1, 2, 9, "q"), (None, 3, 4, "r"), (99, 4, 4, "lost"))
    got = by_id(changes.upsert_by_id(tasks, incoming, "friends_task", "seq", NOW), "friend_id", "task_name", "is_active", "create_time")
    assert got == {1: (9, "q", 1, None), 2: (2, "b", 0, None), 3: (1, "c", 1, None), 4: (4, "r", 1, THEN)}


def test_run_log_labels(rows):
    runs = rows("task_id int, task_name string, outcome string", (1, "a", "ok"), (2, "b", "failed"))
    logged = changes.task_log_rows(runs, NOW)
    assert sorted(logged.collect()) == [(1, "a", "执行完成", THEN), (2, "b", "执行失败", THEN)]


def test_defaults_and_names(rows):
    df = with_defaults(rows("id int, is_active int, role_id int", (1, None, None), (2, 1, 5)), "friends")
    assert by_id(df, "is_active", "role_id") == {1: (0, 1009), 2: (1, 5)}
    shaped = conform(rows("id int, text string", (1, "t")), "logs", NOW)
    assert shaped.schema.names == SCHEMAS["logs"].names
    assert shaped.first().create_time == THEN
    assert corrected_names(shaped).columns == ["id", "create_time", "text", "reasoning", "msg", "reply"]


def test_documents(rows):
    accounts = rows("id int, auth_key string", (2, "k"), (1, "k"))
    snapshot = (
        '{"Code":200,"Data":{"count":7,"IsInitFinished":true,"friendList":[{"userName":{"str":"w"},'
        '"nickName":{},"remark":{"str":"r"},"city":"c"},{"userName":{"str":null},"nickName":{"str":"n"}}]}}'
    )
    docs = rows("auth_key string, value string", ("k", snapshot), ("k", '{"Code":500}'), ("z", snapshot), ("k", "broken"))
    got = sorted(documents.contacts_from_snapshot(docs, accounts).collect())
    assert got == [(1, 0, "w", "", "", "r", "", "", "c", ""), (1, 1, "", "n", "", "", "", "", "", "")]
    assert sorted(documents.snapshot_counts(docs).collect()) == [("k", 7), ("z", 7)]
    status = rows("auth_key string, value string", ("k", '{"Code":"200","Data":{"onlineTime":"1h","loginTime":"x"}}'), ("l", '{"Code":-2,"Data":{"onlineTime":"1h"}}'), ("m", None))
    got = {r.auth_key: r.onlineTime for r in documents.account_patch_from_status(status).collect()}
    assert got == {"k": "1h", "l": None, "m": None}
    profile = '{"Code":200,"Data":{"userInfo":{"userName":{"str":"w"},"nickName":{"str":"n"},"alias":"al"},"userInfoExt":{"smallHeadImgUrl":"i"}}}'
    (row,) = documents.account_patch_from_profile(rows("auth_key string, value string", ("k", profile), ("l", '{"Code":1}'))).collect()
    assert row == ("k", "w", "n", "i", "al")
    login = '{"Code":200,"Data":{"wxid":"w","nick_name":"n","effective_time":198}}'
    (row,) = documents.account_patch_from_login(rows("auth_key string, value string", ("k", login), ("l", '{"Code":1}'))).collect()
    assert row.asDict() == {"auth_key": "k", "wx_id": "w", "nickname": "n", "avatar": None, "auth_key_remaining_time": "198"}
