import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from parley.functions.replies import cleaned_text, strict_json
from parley.functions.values import raw_json
from parley.operators import listings, prompts, replies, tasks

GOOD = '{"message":["a"],"cron":[]}'

# Text, what it is cleaned to, and the status.
CASES = {
    "plain": (GOOD, GOOD, "ok"),
    "blanks": ("﻿ \n　" + GOOD + "  ", GOOD, "ok"),
    "fenced": ("```json\n" + GOOD + "\n```", GOOD, "ok"),
    "other fence": ("```\n" + GOOD + "\n```", "```\n" + GOOD, "JSON_PARSE_FAILED"),
    "two fences": ("```json " + GOOD + "\n```\n```", GOOD, "ok"),
    "blank before fence": (GOOD + " \u3000\n```", GOOD, "ok"),
    "four ticks": (GOOD + "````", GOOD + "`", "JSON_PARSE_FAILED"),
    "commas": ('{"message":["a" , ],"cron":[],\n}', '{"message":["a"  ],"cron":[]\n}', "ok"),
    "two commas": ('{"cron":[1,,]}', '{"cron":[1,]}', "JSON_PARSE_FAILED"),
    "curly quotes": ("{“message”:[“a”]}", '{"message":["a"]}', "ok"),
    "curly single": ("{‘message’:1}", "{'message':1}", "JSON_PARSE_FAILED"),
    "colons": ('{"message":::["a"]}', '{"message":["a"]}', "ok"),
    "colons in text": ('{"message":["12:30::05"]}', '{"message":["12:30:05"]}', "ok"),
    "numerals": ('{"message":[二十,十六]}', '{"message":[20,16]}', "ok"),
    "no end": ('{"a":{"b":[1]', '{"a":{"b":[1]', "balanced"),
    "no start": ('"a":{"b":1}}', '"a":{"b":1}}', "balanced"),
    "no bracket": ('{"a":[1}', '{"a":[1}', "JSON_PARSE_FAILED"),
    "brace in text": ('{"a":"}"}', '{"a":"}"}', "ok"),
    "brace in text, open": ('{"a":"}","b":{"c":1}', '{"a":"}","b":{"c":1}', "JSON_PARSE_FAILED"),
    "text behind": (GOOD + " xx", GOOD + " xx", "JSON_PARSE_FAILED"),
    "single quotes": ("{'a':1}", "{'a':1}", "JSON_PARSE_FAILED"),
    "nan": ('{"a":NaN}', '{"a":NaN}', "JSON_PARSE_FAILED"),
    "long number": ('{"a":' + "9" * 5000 + "}", '{"a":' + "9" * 5000 + "}", "ok"),
    "list": ("[1,2]", "[1,2]", "ok"),
    "empty": ("", "", "JSON_PARSE_FAILED"),
    "null": (None, None, "JSON_PARSE_FAILED"),
}


def test_repair(rows):
    df = rows("name string, text string", *[(n, c[0]) for n, c in CASES.items()])
    got = {r.name: r for r in replies.repair_json(df, "text").collect()}
    assert {n: (r.cleaned, r.status) for n, r in got.items()} == {n: c[1:] for n, c in CASES.items()}
    assert json.loads(got["no end"].parsed) == {"a": {"b": [1]}}
    assert json.loads(got["no start"].parsed) == {"a": {"b": 1}}
    assert all((r.parsed is None) == (r.status == "JSON_PARSE_FAILED") for r in got.values())


def test_cleanups_as_one_expression(rows):
    df = rows("name string, text string", *[(n, c[0]) for n, c in CASES.items()])
    got = {r.name: r.c for r in df.select("name", cleaned_text(F.col("text")).alias("c")).collect()}
    assert got == {n: c[1] for n, c in CASES.items()}


def test_valid_text_is_kept(rows):
    texts = ['{"a": [1, {"b": null}], "c": "x\\ny é 漢"}', '"text"', "12.5e3", "true", '{"t":"8:05"}']
    df = rows("text string", *[(t,) for t in texts])
    assert {r.parsed for r in replies.repair_json(df, "text").collect()} == set(texts)


def random_json(rng, depth=3):
    kind = rng.randrange(8 if depth else 5)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.choice([0, -3, 1.5e-7, 10**18, 0.25])
    if kind < 5:
        return "".join(rng.choice('aé漢😀 "\\/{}[],\n\t\x01') for _ in range(rng.randrange(8)))
    if kind == 5:
        return [random_json(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {f"k{n}": random_json(rng, depth - 1) for n in range(rng.randrange(4))}


def test_random_json_is_valid_and_a_cut_one_is_not(rows):
    rng = random.Random(2)
    texts = [json.dumps(random_json(rng), ensure_ascii=rng.random() < 0.5, separators=rng.choice([(",", ":"), (", ", ": ")])) for _ in range(400)]
    # A comma before a closing bracket is edited even inside of a text.
    texts = [t for t in texts if not re.search(r",\s*[}\]]", t)]
    got = replies.repair_json(rows("text string", *[(t,) for t in texts]), "text").collect()
    assert len(got) > 300 and all((r.status, r.parsed) == ("ok", r.text) for r in got)
    cut = [(t[:-1],) for t in texts if t.startswith("[") and len(t) > 2]
    assert {r.status for r in replies.repair_json(rows("text string", *cut), "text").collect()} == {"JSON_PARSE_FAILED"}


@pytest.fixture
def parsed(rows):
    text = json.dumps(
        {
            "continue": True,
            "message": ["one", "", None, "two"],
            "cron": [
                {"id": -1, "operate": "add", "friend_id": 5, "task_name": "t", "cron_expression": "0 0 8 ? * *", "is_active": 1},
                {"id": 7, "operate": "update", "task_name": None},
            ],
            "summarize": [{"friend_id": 5, "task_name": "t", "score": 3, "date": "2024-01-01"}],
        }
    )
    df = rows("reply_id int, friend_id int, text string", (1, 5, text), (2, 5, "{"), (3, 5, "[]"), (4, 6, '{"cron":[]}'), (5, 9, text), (6, 5, "broken"))
    return replies.parse_replies(df, "text")


def test_unpacking(parsed):
    first = parsed.where("reply_id <> 5")
    said = replies.reply_messages(first, ["reply_id"]).collect()
    assert sorted(said) == [(1, 0, "one"), (1, 3, "two")]
    ops = sorted(replies.reply_task_ops(first, ["reply_id"]).collect())
    assert [(o.position, o.id, o.operate, o.friend_id, o.is_active) for o in ops] == [(0, -1, "add", 5, 1), (1, 7, "update", None, None)]
    assert ops[1].given == ["id", "operate", "task_name"] and ops[0].cron_expression == "0 0 8 ? * *"
    (record,) = replies.reply_summaries(first, ["reply_id"]).collect()
    assert (record.friend_id, record.task_name, record.score, record.result) == (5, "t", 3, None)


def test_change_notices(parsed, rows):
    friends = rows("id int, remark string", (5, "Ann"), (6, "Bob"), (9, None))
    got = {r.reply_id: r.content for r in replies.task_change_notices(parsed, friends).collect()}
    assert set(got) == {1, 5}
    assert got[1].startswith('当前Ann的cron任务列表已更新：[{"id":-1,"operate":"add","friend_id":5,')
    assert got[5].startswith("当前null的cron")


def test_exchange_logs_and_raw_json(rows):
    turns = "id int, turns array<struct<role: string, content: string>>, reasoning string, reply string"
    df = rows(turns, (1, [("user", "a"), ("user", None)], None, "r"), (2, [("user", "b")], "why", None), (3, None, None, None))
    got = {r.id: (r.msg, r.text, r.reson, r.reply) for r in listings.exchange_log_rows(df).collect()}
    assert got == {
        1: ('[{"role":"user","content":"a"},{"role":"user","content":null}]', "", "", "r"),
        2: ('[{"role":"user","content":"b"}]', "b", "why", ""),
        3: ("[]", "", "", ""),
    }
    assert df.select(raw_json(F.struct("reasoning", "id")).alias("j")).first().j == '{"reasoning":null,"id":1}'


TASKS = "id int, friend_id int, task_name string, start_date string, end_date string, is_active int"
NOW = "2024-01-30 12:30:00"


def test_validity_at_the_bounds(rows):
    cases = {
        ("", ""): 1, (None, None): 1, ("2024-01-30 12:30:00", ""): 1, ("2024-01-30 12:30:01", ""): 0,
        ("", "2024-01-30 12:30:00"): 1, ("", "2024-01-30 12:29:59"): 2, ("", "2024-01-30"): 1, ("", "2024-01-29"): 2,
        ("2024-02-01", "2024-01-01"): 2, ("soon", ""): 0, ("", "later"): 0, ("2024-01-30", "2024-01-31"): 1,
    }
    df = rows(TASKS, *[(n, 1, "t", s, e, 1) for n, (s, e) in enumerate(cases)])
    got = {r.id: r.validity for r in tasks.with_validity(df, NOW).collect()}
    assert list(cases.values()) == [got[n] for n in range(len(cases))]


def test_eligibility_reasons_in_order(rows):
    df = rows(
        TASKS, (1, 1, "t1", "", "", 1), (2, 1, "t2", "", "2020-01-01", 0), (3, 9, "t3", "", "2020-01-01", 1), (4, 9, "t4", "", "", 1),
        (5, 2, "t5", "", "", 1), (6, 3, "t6", "", "", 1), (7, None, "t7", "", "", 1), (8, 4, None, "", "", None),
    )
    friends = rows(
        "id int, is_active int, ai_active int, wxid string, account_id int, my_remark string",
        (1, 1, 1, "w1", 5, "Ann"), (2, 0, 0, "w2", 5, ""), (3, 1, 0, "w3", 5, None), (4, 1, 1, "w4", 5, None),
    )
    due = rows("task_id int", *[(n,) for n in range(1, 10)])
    judged = tasks.task_eligibility(df, friends, NOW, due)
    assert {r.task_id: r.verdict for r in judged.collect()} == {
        1: "ok", 2: "task_inactive", 3: "out_of_range", 4: "friend_missing", 5: "friend_inactive", 6: "friend_ai_off",
        7: "friend_missing", 8: "task_inactive", 9: "task_missing",
    }
    outcomes = {r.task_id: r.outcome for r in tasks.run_outcomes(judged).collect()}
    assert outcomes == {1: "ok", 4: "failed", 5: "failed", 6: "failed", 7: "failed"}
    (message,) = tasks.task_messages(judged).collect()
    assert (message.wxid, message.account_id, message.content) == ("w1", 5, "Ann，t1")
    assert 0 <= message.delay_ms < 60000
    assert tasks.task_messages(judged).first().delay_ms == message.delay_ms


def test_targets(rows):
    requests = rows(
        "request_id int, task_id int, account_id int, wxid string",
        (1, 1, None, "w"), (2, 1, 5, "w1"), (3, 9, None, "w"), (4, 1, 5, "zz"), (5, None, 8, "w1"),
    )
    task_table = rows("id int, friend_id int", (1, 2))
    friends = rows("id int, account_id int, wxid string", (4, 5, "w1"), (3, 5, "w1"), (2, 6, "w2"), (7, None, "w"))
    accounts = rows("id int, auth_key string, wx_id string", (5, "k5", "a5"), (6, "k6", "a6"))
    got = {r.request_id: (r.friend_id, r.account_id, r.auth_key, r.sender_wxid) for r in tasks.resolve_targets(requests, task_table, friends, accounts).collect()}
    assert got == {1: (2, 6, "k6", "a6"), 2: (3, 5, "k5", "a5"), 3: (None, None, None, None), 4: (None, 5, "k5", "a5"), 5: (None, 8, None, None)}


def test_history_and_turns(rows):
    messages = rows(
        "id long, from_user string, to_user string, content string, msg_type int, create_time long, at string",
        (1, "u", "a", "one", 1, 10, "2024-01-30 12:00:00"), (2, "a", "u", "two", 1, None, "2024-01-30 11:30:00"),
        (3, "u", "a", "pic", 3, 12, "2024-01-30 12:00:00"), (4, "u", "a", "old", 1, 1, "2024-01-30 11:29:59"),
        (5, "u", "b", "other", 1, 11, "2024-01-30 12:00:00"), (6, None, "a", "x", 1, 11, "2024-01-30 12:00:00"),
    ).withColumn("create_at", F.col("at").cast("timestamp_ntz"))
    pairs = rows("request int, party_a string, party_b string", (7, "u", "a"), (8, "u", "a"), (9, "a", None))
    history = prompts.chat_history(messages, pairs, NOW, 1)
    turns = prompts.chat_turns(history).orderBy("request", *prompts.history_order()).collect()
    lines = [("assistant", "2024-01-30 11:30:00:two"), ("user", "2024-01-30 12:00:00:one")]
    assert [(r.request, r.role, r.turn_content) for r in turns] == [(n, *line) for n in (7, 8) for line in lines]
    system = rows("id int, key string, value string", (3, "hisMsgDay", "99"), (2, "hisMsgDay", "1"), (1, "other", "5"))
    configured = prompts.chat_history(messages, pairs, NOW, system=system)
    assert sorted(configured.collect()) == sorted(history.collect())
    assert prompts.config_row(system, ["hisMsgDay", "none"]).first() == ("1", None)
    with_values = prompts.with_config(pairs, system, ["other"]).collect()
    assert {r.other for r in with_values} == {"5"} and len(with_values) == 3


def test_owner_and_adhoc_prompts(rows):
    messages = rows(
        "id long, from_user string, to_user string, raw_data string, msg_type int, create_time long",
        (1, "a", "x", "r1", 1, 5), (2, "y", "a", "r2", 1, 4), (3, "a", "a", "r3", 1, 6), (4, "x", "y", "r4", 1, 6), (5, "a", "x", "r5", 3, 6),
    ).withColumn("create_at", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    accounts = rows("id int, wx_id string", (1, "a"), (2, None), (3, "b"))
    roles = rows("id int, prompt string", (1000, "Owner"), (5, "Five"))
    requests = rows("request_id int, account_id int, text string", (10, 1, "q"), (20, 2, "q"), (30, 3, ""))
    turns = prompts.owner_prompts(requests, accounts, roles, messages, NOW)
    listed = sorted(turns.collect(), key=lambda r: (r.section, r.create_time or 0, r.message_id or 0))
    assert [(r.request_id, r.role, r.content) for r in listed] == [
        (10, "user", "r2"), (10, "user", "r1"), (10, "user", "r3"), (10, "system", "Owner 我的账号是a"), (10, "user", "q"),
    ]
    asked = rows("request_id int, role_id int, text string", (1, 5, "x"), (2, 6, "y"), (3, 5, ""))
    got = sorted((r.request_id, r.section, r.content or "") for r in prompts.adhoc_prompts(asked, roles).collect())
    assert got == [(1, 1, "Five"), (1, 2, "x"), (2, 1, ""), (2, 2, "y")]


def test_spoken_time_and_passwords(rows):
    from parley.functions.clock import epoch_of, from_epoch, moment, spoken_now
    from parley.functions.values import salted_md5

    row = rows("p string", ("secret",)).select(
        spoken_now("2024-01-28 09:05:07").alias("t"), salted_md5(F.col("p"), F.lit("s")).alias("h"),
        from_epoch(F.lit(-1)).cast("string").alias("before"), epoch_of(moment("2024-03-10 02:30:00")).alias("e"),
    ).first()
    assert row.t == "2024/1/28 09:05:07 星期日"
    assert row.h == hashlib.md5(b"secrets").hexdigest()
    assert row.before == "1969-12-31 23:59:59"
    assert row.e == 1710037800


def test_strict_json_agrees_with_a_strict_reader(rows):
    """Texts of all kinds and small damages, against the standard library with constants refused."""

    def refuse(name):
        raise ValueError(name)

    def valid(text):
        try:
            json.loads(text, parse_constant=refuse)
        except ValueError:
            return False
        return True

    texts = [
        "", " ", "{}", "[]", "1", "-0", "01", "1.", ".5", "1E+", '"a"', "'a'", '{"a":1}x', '{"a":1}{"b":2}',
        "[1,]", "{a:1}", "NaN", "[Infinity]", "true", "nul", '"\t"', '"\\x"', '1,"y":2', "1}",
        '1},{"x":2', ' {"a":1} \n', "\xa0{}", '{"a":1,"a":2}', "/*c*/1", '{"x":1,"e":2}', "\x00",
    ]
    rnd, signs = random.Random(1), '{}[]",:\\ 01-.eEtruefalsn\'\n ab'
    for _ in range(1500):
        text = list('{"a":[1,2.5e3,true,null,"x\\"y"],"b":{"c":"d"}}')
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(text))
            text[i : i + rnd.randint(0, 1)] = [rnd.choice(signs)] * rnd.randint(0, 1)
        texts.append("".join(text))
    df = rows("i int, text string", *enumerate(texts), (-1, None))
    got = {r.i: r.ok for r in df.select("i", strict_json(F.col("text")).alias("ok")).collect()}
    assert got.pop(-1) is False
    assert [texts[i] for i, ok in got.items() if ok != valid(texts[i])] == []


def test_summary_numbers_may_be_text(rows):
    text = json.dumps({"summarize": [
        {"friend_id": "3", "score": "8"}, {"friend_id": 4, "score": 7.5}, {"friend_id": "x", "score": None},
        None, {"friend_id": [1]},
    ]})
    parsed = replies.parse_replies(rows("reply_id int, text string", (1, text)), "text")
    got = sorted(replies.reply_summaries(parsed, ["reply_id"]).collect(), key=lambda r: r.position)
    assert [(r.position, r.friend_id, r.score) for r in got] == [
        (0, 3, 8), (1, 4, 8), (2, None, None), (4, None, None)
    ]
