"""Large groups are split, and what is put together again is the whole."""

import random

import pytest
from pyspark.sql import functions as F

from parley.functions import ordered
from parley.operators import ingest, listings, members, prompts, tasks
from parley.operators.filters import involving

ROWS = "who string, create_time long, id long, v string"


@pytest.fixture
def hot(spark):
    """One key holds most rows, many of them in one hour, and many in one second."""
    rng = random.Random(3)
    data, n = [], 0
    for who, count in (("hot", 300), ("warm", 25), ("cold", 4), (None, 40)):
        for _ in range(count):
            kind = rng.random()
            time = 7200 if kind < 0.4 else 7200 + rng.randrange(3600) if kind < 0.7 else rng.randrange(50_000)
            data.append((who, None if kind < 0.05 else time, n, f"v{n}"))
            n += 1
    rng.shuffle(data)
    return spark.createDataFrame(data, ROWS).repartition(5)


def in_order(df, who):
    key = lambda r: (-1 if r.create_time is None else r.create_time, r.id)
    return sorted((r for r in df.collect() if r.who == who), key=key)


def test_parts_are_bounded_and_keep_the_order(hot):
    levels = ordered.time_levels("create_time", "id", 10)
    parts = ordered.split_large_groups(hot, ["who"], levels, 10)
    assert parts.groupBy("who", "part").count().agg(F.max("count")).first()[0] <= 10
    assert parts.count() == hot.count()
    for who in ("hot", "warm", None):
        listed = in_order(parts, who)
        assert len({tuple(r.part) for r in listed}) > 1
        assert [list(r.part) for r in listed] == sorted(list(r.part) for r in listed)
    assert {tuple(r.part) for r in in_order(parts, "cold")} == {()}


def test_packed_parts_make_up_the_whole(hot):
    levels = ordered.time_levels("create_time", "id", 10)
    packed = ordered.pack_ordered(hot, ["who"], ["create_time", "id"], F.col("v"), levels, 10)
    got = {}
    for row in sorted(packed.collect(), key=lambda r: list(r.part)):
        assert len(row["items"]) <= 10
        got.setdefault(row.who, []).extend(row["items"])
    assert got == {w: [r.v for r in in_order(hot, w)] for w in ("hot", "warm", "cold", None)}


@pytest.mark.parametrize("size", [10, 10_000])
def test_values_are_carried_over_parts(hot, size):
    order = ["create_time", "id"]
    rows = hot.withColumn("odd", F.when(F.col("id") % 7 == 0, F.col("id")))
    parts, split = ordered.split_groups(rows, ["who"], ordered.time_levels(*order, size), size)
    assert split == (size == 10)
    before = ordered.with_previous(parts, ["who"], order, "v", split, "before", "n")
    both = ordered.latest_value(before, ["who"], order, "odd", "last_odd", split)
    for who in ("hot", "warm", "cold", None):
        previous = last = None
        for n, row in enumerate(in_order(both, who), 1):
            last = row.odd if row.odd is not None else last
            assert (row.before, row.last_odd, row.n) == (previous, last, n)
            previous = row.v


def test_bursts_do_not_depend_on_the_split(hot):
    messages = hot.where("create_time IS NOT NULL").select(
        F.col("who").alias("from_user"), F.when(F.col("who") != "hot", "x").alias("to_user"),
        "create_time", "id", F.col("v").alias("content"),
    )
    keys = ["from_user", "to_user", "burst_start", "burst_position", "id"]
    plain = ingest.assign_bursts(messages, 60).select(*keys)
    split = ingest.assign_bursts(messages, 60, window_rows=10).select(*keys)
    assert sorted(plain.collect(), key=repr) == sorted(split.collect(), key=repr)
    whole = ingest.merge_bursts(messages, 60)
    pieces = ingest.merge_bursts(messages, 60, size=10)
    texts = {}
    for r in sorted(pieces.collect(), key=lambda r: r.part):
        assert r.message_count <= 10
        texts.setdefault((r.from_user, r.burst_start), []).append(r.content)
    assert {(r.from_user, r.burst_start): r.content for r in whole.collect()} == {
        k: "\n".join(v) for k, v in texts.items()
    }
    assert max(len(v) for v in texts.values()) > 1


def test_state_changes_do_not_depend_on_the_split(spark):
    rng = random.Random(5)
    events = spark.createDataFrame(
        [(n, "u", rng.choice(["OPEN", "CLOSED"]), f"2024-01-01 0{rng.randrange(3)}:00:0{rng.randrange(2)}") for n in range(200)],
        "event_id long, url string, state string, t string",
    ).withColumn("timestamp", F.col("t").cast("timestamp_ntz"))
    plain = ingest.state_changes(events).collect()
    assert sorted(plain) == sorted(ingest.state_changes(events, window_rows=10).collect())
    listed = sorted(events.collect(), key=lambda r: (r.timestamp, r.event_id))
    want = [r.event_id for i, r in enumerate(listed) if i == 0 or listed[i - 1].state != r.state]
    assert sorted(want) == sorted(r.event_id for r in plain)


TASKS = (
    "id int, friend_id int, cron_expression string, task_name string, is_active int, "
    "end_date string, start_date string"
)


@pytest.fixture
def many_tasks(spark):
    data = [(n, 1 if n % 3 else 2, "0 0 8 * * *", f"t{n}", 1, "", None) for n in range(1, 60)]
    return spark.createDataFrame([*data, (99, 1, "x", "off", 0, "", "")], TASKS)


def test_nested_tasks_come_in_parts(many_tasks, spark):
    friends = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, nickname string")
    nested = listings.friends_with_tasks(friends, many_tasks, size=7).collect()
    got = {}
    for r in sorted(nested, key=lambda r: list(r.part)):
        assert len(r.tasks) <= 7
        got.setdefault(r.id, []).extend(t.id for t in r.tasks)
    assert got == {
        1: [n for n in range(1, 60) if n % 3], 2: [n for n in range(1, 60) if not n % 3], 3: [],
    }


def test_task_json_parts_join_to_the_list(many_tasks):
    whole = {r.friend_id: r["items"] for r in tasks.active_task_json(many_tasks).collect()}
    parts = {}
    for r in sorted(tasks.active_task_json(many_tasks, 7).collect(), key=lambda r: list(r.part)):
        parts.setdefault(r.friend_id, []).append(r["items"])
    assert {k: ",".join(v) for k, v in parts.items()} == whole


def test_reminder_blocks_join_to_the_list(spark):
    people = spark.createDataFrame(
        [(n, f"n{n}", "" if n % 2 else f"r{n}") for n in range(25)], "id int, nickname string, remark string"
    )
    blocks = sorted(members.member_reminder(people, 10).collect(), key=lambda r: r.block)
    assert [r.member_count for r in blocks] == [10, 10, 5]
    assert ",".join(r.names for r in blocks) == ",".join(f"n{n}" if n % 2 else f"r{n}" for n in range(25))


def prompt_texts(turns):
    """Contents per request and turn, pieces joined."""
    texts = {}
    key = lambda r: (r.section, -1 if r.create_time is None else r.create_time, r.message_id or -1, list(r.piece))
    for r in sorted(turns.collect(), key=key):
        texts.setdefault((r.request_id, r.section, r.create_time, r.message_id, r.role), []).append(r.content)
    return {k: "".join(v) for k, v in texts.items()}, max(len(v) for v in texts.values())


@pytest.mark.parametrize("variant", ["reply", "summary"])
def test_prompts_in_pieces_have_the_same_texts(spark, many_tasks, variant):
    friends = spark.createDataFrame(
        [(1, 1, "u1", None, "", "Ann"), (2, 1, "u2", 7, "story", None), (4, 1, "u4", 8, "s", "x")],
        "id int, account_id int, wxid string, role_id int, user_story string, my_remark string",
    )
    accounts = spark.createDataFrame([(1, "acc")], "id int, wx_id string")
    text = "{{task_list}} A {{name}} {{task_list}} B {{chatHistory}}{{user_story}}"
    roles = spark.createDataFrame([(999, text), (7, "no list"), (1010, text)], "id int, prompt string")
    messages = spark.createDataFrame(
        [(n, "u1" if n % 2 else "acc", "acc" if n % 2 else "u1", f"c{n}", 1, 1000 + n // 5) for n in range(40)],
        "id long, from_user string, to_user string, content string, msg_type int, create_time long",
    ).withColumn("create_at", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    requests = spark.createDataFrame(
        [(10, 1, "hello"), (20, 2, "hi"), (30, 1, ""), (40, 4, "no role")], "request_id int, friend_id int, text string"
    )
    build = lambda size: prompts.build_prompts(
        requests, friends, accounts, roles, many_tasks, messages, "2024-01-30 12:30:00", variant, 24,
        size=size,
    )
    whole, one = prompt_texts(build(10_000))
    pieces, many = prompt_texts(build(7))
    assert one == 1 and many > 5
    assert pieces == whole
    packed = {}
    for r in sorted(prompts.packed_prompts(build(10_000), 7).collect(), key=lambda r: list(r.part)):
        assert len(r.turns) <= 7
        packed.setdefault(r.request_id, []).extend((t.role, t.content) for t in r.turns)
    in_turn = sorted(whole, key=lambda k: (k[1], -1 if k[2] is None else k[2], k[3] or -1))
    assert packed == {n: [(k[4], whole[k]) for k in in_turn if k[0] == n] for n in {k[0] for k in whole}}
    asked = {k[0] for k in whole}
    assert asked == ({10, 20} if variant == "reply" else {10, 20, 40})
    system = whole[(10, 1, None, None, "system")]
    assert system.count('"friend_id":1') == 80 and "{{task_list}}" not in system
    assert "Ann" in system and system.endswith("无")
    if variant == "summary":
        assert system.count('{"role":') == 40
    else:
        assert "{{chatHistory}}" in system
        assert whole[(20, 1, None, None, "system")] == "no list"
        assert sum(k[1] == 0 for k in whole) == 40


def test_ids_of_new_rows_are_consecutive_and_new(spark):
    new = spark.createDataFrame([(f"k{n}", n % 3) for n in range(500)], "k string, g int")
    ids = sorted(r.id for r in ordered.numbered_ids(new, ["k", "g"], F.lit(41), 16).collect())
    assert ids == list(range(42, 542))


def test_ids_of_new_rows_follow_their_order(spark):
    new = spark.createDataFrame([(n % 7, f"k{n:03}") for n in range(500)] + [(None, "z")], "g int, k string")
    rows = sorted(ordered.numbered_ids(new.repartition(5), ["g", "k"], F.lit(9), 6).collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == list(range(10, 511))
    assert [(r.g, r.k) for r in rows] == [(None, "z")] + sorted((n % 7, f"k{n:03}") for n in range(500))


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, o int, v string")
    assert sorted(ordered.first_per_key(df, ["k"], ["o"]).collect()) == [("a", 1, "y"), ("b", 5, None)]
    assert sorted(ordered.last_per_key(df, ["k"], ["o"]).collect()) == [("a", 2, "x"), ("b", 5, None)]
    assert involving(spark.createDataFrame([("a", "b")], "from_user string, to_user string"), "b").count() == 1


def test_a_request_in_parts_has_one_system_turn(spark, many_tasks):
    friends = spark.createDataFrame(
        [(1, 1, "u1", None, "", "Ann")],
        "id int, account_id int, wxid string, role_id int, user_story string, my_remark string",
    )
    accounts = spark.createDataFrame([(1, "acc")], "id int, wx_id string")
    roles = spark.createDataFrame([(999, "Hello {{name}}")], "id int, prompt string")
    messages = spark.createDataFrame(
        [], "id long, from_user string, to_user string, content string, msg_type int, create_time long, create_at timestamp_ntz"
    )
    requests = spark.createDataFrame(
        [("r", 1, 0, "a"), ("r", 1, 1, "\nb"), ("r", 1, 2, "\n"), ("r", 1, 10, "\nc")],
        "request_id string, friend_id int, part long, text string",
    )
    turns = prompts.build_prompts(requests, friends, accounts, roles, many_tasks, messages, "2024-01-30", hours=1)
    texts, _ = prompt_texts(turns)
    assert texts == {("r", 1, None, None, "system"): "Hello Ann", ("r", 2, None, None, "user"): "a\nb\n\nc"}


@pytest.mark.parametrize("broadcast_rows, heavy_rows", [(100, 5), (2, 10), (2, 1000), (0, 10)])
def test_join_to_a_unique_table_does_not_depend_on_the_way(hot, spark, broadcast_rows, heavy_rows):
    side = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3), (None, 4)], "who string, n int")
    got = ordered.left_join_unique(hot, side, ["who"], broadcast_rows, heavy_rows)
    assert got.columns == [*hot.columns, "n"]
    assert sorted(got.collect(), key=repr) == sorted(hot.join(side, "who", "left").select(got.columns).collect(), key=repr)
