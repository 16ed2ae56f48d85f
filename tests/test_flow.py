"""The operators one after the other, as an account's day runs through them."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parley.operators import calendar, changes, ingest, prompts, replies, tasks
from parley.schemas import conform
from parley.sources import documents

NOW = "2024-01-30 12:30:00"
SECOND = 1706617000


@pytest.fixture
def world(rows):
    friends = conform(
        rows("id int, account_id int, wxid string, is_active int, ai_active int, my_remark string, remark string, role_id int",
             (1, 5, "u1", 1, 1, "Ann", "Annie", 999), (2, 5, "u2", 1, 0, "Bob", "", 999)), "friends")
    accounts = conform(rows("id int, wx_id string, auth_key string", (5, "acc", "k")), "accounts")
    roles = rows("id int, prompt string", (999, "You help {{name}}. {{task_list}}"))
    table = conform(
        rows("id int, friend_id int, task_name string, cron_expression string, start_date string, end_date string",
             (3, 1, "walk", "0 0 8 * * *", "", ""), (4, 1, "old", "0 0 9 * * *", "", "")), "friends_task", "2024-01-01 00:00:00")
    return friends, accounts, roles, table


def frame(n, sender, text, time):
    doc = {"msg_id": n, "from_user_name": {"str": sender}, "to_user_name": {"str": "acc"}, "msg_type": 1,
           "content": {"str": text}, "create_time": time}
    return (json.dumps(doc), "k", n)


def test_from_frames_to_sent_messages_and_new_tasks(rows, world):
    friends, accounts, roles, table = world
    raw = rows(documents.RAW_SCHEMA, frame(1, "u1", "hi", SECOND), frame(2, "u1", "remind me", SECOND + 4),
               frame(2, "u1", "remind me", SECOND + 4), frame(3, "u2", "hello", SECOND), frame(4, "zz", "spam", SECOND))
    good, _ = documents.parse_frames(raw)
    routed = ingest.route_messages(ingest.dedup_messages(good, ["arrival"]), accounts, friends)
    stored = ingest.to_message_rows(routed, NOW).withColumn("id", F.col("msg_id").cast("long"))
    assert sorted(r.msg_id for r in stored.collect()) == ["1", "2", "3"]

    bursts = ingest.assign_bursts(routed.where("route = 3").withColumn("id", F.col("arrival")))
    requests = prompts.burst_requests(ingest.merge_assigned(bursts), friends)
    turns = prompts.build_prompts(requests, friends, accounts, roles, table, stored, NOW, hours=1)
    listed = sorted(turns.collect(), key=lambda r: (r.section, r.create_time or 0))
    assert [r.role for r in listed] == ["user", "user", "system", "user"]
    assert listed[0].content == "2024-01-30 12:30:00:hi" and listed[-1].content == "hi\nremind me"
    assert '"task_name":"walk"' in listed[2].content and listed[2].content.startswith("You help Ann. [{")

    answer = ('```json\n{"message":["ok","done"],"cron":['
              '{"id":-1,"operate":"add","friend_id":1,"task_name":"swim","cron_expression":"0 30 7 ? * *","is_active":1},'
              '{"id":4,"operate":"delete","cron_expression":""},'
              '{"id":3,"operate":"update","cron_expression":"? ? ? ? ? ?"},]}\n```')
    exchanges = requests.select("request_id", "friend_id", F.lit(answer).alias("text"))
    parsed = replies.parse_replies(exchanges, "text")
    sent = replies.reply_messages(parsed, ["request_id"]).orderBy("position")
    assert [r.content for r in sent.collect()] == ["ok", "done"]
    (notice,) = replies.task_change_notices(parsed, friends).collect()
    assert notice.content.startswith('当前Annie的cron任务列表已更新：[{"id":-1,')

    changed = changes.apply_task_ops(table, replies.reply_task_ops(parsed, ["request_id"]), NOW)
    got = {r.id: (r.task_name, r.cron_expression, r.is_active) for r in changed.collect()}
    assert got == {3: ("walk", "* 1 * * * *", 1), 5: ("swim", "0 30 7 * * *", 1)}

    handled = bursts.select("from_user", "to_user", "burst_start").distinct().withColumn("failed", F.lit(False))
    status = changes.set_message_status(stored, ingest.burst_status(bursts, friends, handled), NOW)
    assert {r.msg_id: r.status for r in status.collect()} == {"1": "processed", "2": "processed", "3": "queued"}

    # The next morning the new task is due.
    due = calendar.cron_fires(changed, "2024-01-31 07:00:00", "2024-01-31 08:00:00").where("friend_id = 1")
    due = due.groupBy(F.col("id").alias("task_id")).agg(F.min("fire_time").alias("run_time"))
    judged = tasks.task_eligibility(changed, friends, "2024-01-31 07:30:00", due)
    to_send = {r.task_id: r.content for r in tasks.task_messages(judged).collect()}
    assert to_send[5] == "Ann，swim"
    runs = tasks.run_outcomes(judged).join(due, "task_id")
    after = {r.id: (r.execution_count, r.last_execution_time) for r in changes.record_executions(changed, runs).collect()}
    assert after[5] == (1, datetime(2024, 1, 31, 7, 30))
    logged = changes.task_log_rows(runs, "2024-01-31 07:30:00").where("task_id = 5").first()
    assert (logged.task_name, logged.status) == ("swim", "执行完成")

    # What is scheduled follows the changed tasks.
    scheduled = table.select("id", F.col("cron_expression").alias("cron"))
    diff = {r.id: r.action for r in changes.schedule_diff(changed.where("is_active = 1"), scheduled).collect()}
    assert diff == {3: "changed", 4: "removed", 5: "new"}
