import json
import os
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from parley.operators import changes, ingest, prompts
from parley.sources import documents
from parley.sources.tables import append, load_table, shared_dir, write_version
from parley.streaming import frames as streams

NOW = "2024-01-30 12:30:00"
RAW = documents.RAW_SCHEMA


def frame(msg_id, sender="u1", content="hi", kind=1, time=1000, to="acc", **more):
    doc = {"msg_id": msg_id, "from_user_name": {"str": sender}, "to_user_name": {"str": to},
           "msg_type": kind, "content": {"str": content}, "create_time": time, **more}
    return json.dumps(doc, ensure_ascii=False)


@pytest.fixture
def accounts(rows):
    return rows("id int, wx_id string, auth_key string", (1, "acc", "k"), (2, "acc2", "k2"))


@pytest.fixture
def friends(rows):
    return rows(
        "id int, wxid string, is_active int, ai_active int",
        (1, "u1", 1, 1), (2, "u2", 1, 0), (3, "u3", 0, 1), (4, "u4", 1, 2), (6, "u5", 1, 1), (5, "u5", 1, 0),
        (7, "u6", 0, 1), (8, "u6", 1, 1),
    )


def test_good_and_bad_frames(rows):
    big = 9007199254740993
    texts = [
        frame(big, new_msg_id=big, push_content="p"), frame(2, time=1_700_000_000_123), '{"msg_id":3}', "[]", "not json", "",
        None, frame(4) + " xx", frame(5).replace('"', "'"), frame(6)[:-1], '{"msg_id":7,"create_time":NaN}', "null",
        '{"msg_id":8,"unknown":{"deep":[1,2]}}',
    ]
    raw = rows(RAW, *[(t, "k", n) for n, t in enumerate(texts)])
    good, bad = documents.parse_frames(raw)
    got = {r.arrival: r for r in good.collect()}
    assert sorted(got) == [0, 1, 2, 12]
    assert (got[0].msg_id, got[0].new_msg_id, got[0].from_user) == (str(big), big, "u1")
    assert got[1].create_time == 1_700_000_000
    assert got[12].raw_data == texts[12] and got[2].from_user is None
    assert sorted(r.arrival for r in bad.collect()) == [3, 4, 5, 6, 7, 8, 9, 10, 11]
    lenient, _ = documents.parse_frames(raw, strict=False)
    assert {0, 1, 2, 7, 12} <= {r.arrival for r in lenient.collect()}


def test_routes(rows, accounts, friends):
    messages = rows(
        "id int, from_user string, auth_key string",
        (1, "acc", "k"), (2, "acc", "k2"), (3, "u1", "k"), (4, "u2", "k"), (5, "u3", "k"), (6, "u4", "k"),
        (7, "u5", "k"), (8, "u6", "k"), (9, "zz", "k"), (10, None, "k"),
    )
    got = {r.id: r.route for r in ingest.route_messages(messages, accounts, friends).collect()}
    assert got == {1: 1, 2: 0, 3: 3, 4: 2, 5: 0, 6: 0, 7: 2, 8: 3, 9: 0, 10: 0}


def test_stored_rows(rows):
    schema = "msg_id string, from_user string, to_user string, content string, msg_type int, create_time long, raw_data string, route int"
    routed = rows(
        schema, ("1", "a", "b", "x", 1, 5, "r", 1), ("2", "u", None, "x", None, 0, "r", 3), ("3", "u", "b", "", 1, 5, "r", 3),
        ("4", "u", "b", "x", 51, 5, "r", 2), ("5", "u", "b", "x", 1, 5, "r", 0), ("6", "u", "b", None, 1, 5, "r", 2),
        ("7", "u", "b", "x", 34, None, "r", 2),
    )
    got = {r.msg_id: (r.status, r.type, r.to_user, r.create_time, r.is_ai) for r in ingest.to_message_rows(routed, NOW).collect()}
    now = 1706617800
    assert got == {"1": ("done", 1, "b", 5, 0), "2": ("queued", 0, "", now, 0), "7": ("queued", 0, "b", now, 0)}


def test_dedup_and_store_check(rows):
    batch = rows("msg_id string, create_time long, v string", ("1", 5, "late"), ("1", 4, "first"), ("2", 1, "x"), ("3", 1, "y"))
    once = ingest.dedup_messages(batch)
    assert sorted(once.collect()) == [("1", 4, "first"), ("2", 1, "x"), ("3", 1, "y")]
    stored = rows("id int, msg_id string", (1, "2"), (2, "2"), (3, None), (4, "9"))
    assert sorted(r.msg_id for r in ingest.new_messages(once, stored).collect()) == ["1", "3"]


def test_bursts_at_the_gap(rows):
    schema = "from_user string, to_user string, create_time long, id long, content string"
    messages = rows(
        schema, ("a", "x", 100, 2, "b"), ("a", "x", 100, 1, "a"), ("a", "x", 110, 3, None), ("a", "x", 121, 4, "d"),
        ("a", "y", 112, 5, "e"), ("b", "x", 105, 6, "f"),
    )
    got = sorted((r.from_user, r.to_user, r.burst_start, r.message_count, r.last_received, r.content) for r in ingest.merge_bursts(messages).collect())
    assert got == [("a", "x", 100, 3, 110, "a\nb\n"), ("a", "x", 121, 1, 121, "d"), ("a", "y", 112, 1, 112, "e"), ("b", "x", 105, 1, 105, "f")]
    by_sender = sorted((r.from_user, r.burst_start, r.message_count) for r in ingest.merge_bursts(messages, keys=["from_user"]).collect())
    assert by_sender == [("a", 100, 5), ("b", 105, 1)]


def test_burst_status_and_requests(rows, friends):
    bursts = rows(
        "from_user string, to_user string, burst_start long, msg_id string",
        ("u1", "x", 1, "m1"), ("u1", "x", 1, "m2"), ("u1", "x", 9, "m3"), ("u2", "x", 1, "m4"), ("u6", "x", 1, "m5"), ("u6", "x", 5, "m6"),
    )
    replies = rows(
        "from_user string, to_user string, burst_start long, failed boolean",
        ("u1", "x", 1, False), ("u2", "x", 1, False), ("u6", "x", 1, True), ("u1", "x", 9, None),
    )
    got = sorted(ingest.burst_status(bursts, friends, replies).collect())
    assert got == [("m1", "processed"), ("m2", "processed"), ("m3", "processed"), ("m5", "failed")]
    merged = rows(
        "from_user string, to_user string, burst_start long, part long, content string",
        ("u1", "x", 1, 0, "text"), ("u1", "x", 2, 0, ""), ("u2", "x", 1, 0, "no ai"), ("u5", "x", 1, 1, "b"),
        ("u5", "x", 1, 0, "a"), ("u5", "x", 1, 2, ""),
    )
    requests = sorted(prompts.burst_requests(merged, friends).collect(), key=lambda r: (r.friend_id, r.part))
    assert [(r.friend_id, r.text) for r in requests] == [(1, "text"), (6, "a"), (6, "\nb"), (6, "\n")]


def test_connections(rows):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    events = rows(
        "event_id long, url string, state string, timestamp timestamp_ntz",
        (1, "k", "CONNECTING", t(0)), (2, "k", "OPEN", t(1)), (3, "k", "OPEN", t(2)), (4, "k2", "ERROR", t(3)),
        (6, "k", "CLOSED", t(4)), (5, "k", "OPEN", t(4)), (7, "k3", "ODD", t(0)),
    )
    status = ingest.connection_status(events)
    assert sorted(status.collect()) == [("k", "CLOSED", t(0), t(4), 3), ("k2", "ERROR", t(3), t(3), 4), ("k3", "ODD", t(0), t(0), -1)]
    assert sorted(r.event_id for r in ingest.state_changes(events).collect()) == [1, 2, 4, 6, 7]
    accounts = rows("id int, auth_key string, ws_status string", (1, "k", "3"), (2, "k2", "1"), (3, "k3", None), (4, "none", "3"), (5, "gone", "1"))
    patches = ingest.ws_status_patches(accounts, status)
    assert sorted(patches.collect()) == [(2, "1", "4", "ERROR"), (3, None, "3", "ODD"), (5, "1", "3", "NOT_FOUND")]
    patched = changes.apply_patch(accounts, patches.select("id", F.col("new_status").alias("ws_status")), "id", ["ws_status"])
    assert ingest.ws_status_patches(patched, status).count() == 0
    names = rows("c int", (0,), (1,), (2,), (3,), (4,)).select(ingest.state_name(F.col("c")).alias("n"))
    assert [r.n for r in names.collect()] == ["CONNECTING", "OPEN", "CLOSING", "CLOSED", "UNKNOWN"]


def write_frames(path, name, texts):
    path.mkdir(exist_ok=True)
    lines = [json.dumps({"value": t, "auth_key": "k", "arrival": n}) for n, t in texts]
    (path / name).write_text("\n".join(lines) + "\n")


def run(df, tmp_path, name):
    streams.run_stream(df, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")).awaitTermination()
    return df.sparkSession.read.parquet(str(tmp_path / name))


@pytest.fixture
def frame_files(tmp_path):
    """Two files: repeated ids within and across them, bad and senderless frames, a late end."""
    first = [frame(n, time=1000 + 4 * n, content=f"c{n}") for n in range(5)]
    first += [frame(1, time=1004, content="again"), "broken", frame(90, sender="", time=1001), frame(91, sender="zz", time=1001)]
    first += [frame(50, sender="acc", to="u1", time=1003), frame(51, kind=51, time=1018, content="status"), frame(52, time=1019, content="")]
    second = [frame(20, time=1045, content="d"), frame(2, time=1008, content="again"), frame(60, sender="u2", time=1046)]
    second += [frame(99, sender="nobody", time=9000)]
    numbered = list(enumerate(first + second))
    write_frames(tmp_path / "in", "a.json", numbered[: len(first)])
    write_frames(tmp_path / "in", "b.json", numbered[len(first) :])
    return str(tmp_path / "in")


def test_stream_equals_batch(spark, accounts, friends, frame_files, tmp_path):
    raw = documents.read_frames_stream(spark, frame_files)
    routed_stream = streams.process_stream(raw, accounts, friends, watermark="10 minutes")
    routed = run(routed_stream, tmp_path, "routed")
    good, bad = documents.parse_frames(spark.read.schema(RAW).json(frame_files))
    once = ingest.dedup_messages(ingest.drop_senderless(good), ["arrival"])
    batch = ingest.route_messages(once, accounts, friends).where("route <> 0")
    key = ["msg_id", "route", "create_time"]
    assert bad.count() == 1
    assert sorted(routed.select(*key).collect()) == sorted(batch.select(*key).collect())
    # Which of the copies of a repeated frame stays is not fixed in one batch of a stream.
    ranges = run(streams.burst_ranges_stream(routed_stream), tmp_path, "ranges")
    merged = streams.merge_closed_bursts(ranges, routed)
    wanted = ingest.merge_bursts(routed.where("route = 3").withColumn("id", F.col("arrival")))
    columns = ["from_user", "to_user", "burst_start", "message_count", "last_received", "content"]
    got = sorted(merged.select(*columns).collect())
    assert got == sorted(wanted.select(*columns).collect())
    assert [(r.burst_start, r.message_count) for r in got] == [(1000, 7), (1045, 1)]
    assert sorted((r.burst_start, r.message_count) for r in ranges.collect()) == [(1000, 7), (1045, 1)]


def test_stored_stream_adds_each_message_once(spark, accounts, friends, frame_files, tmp_path):
    table = str(tmp_path / "messages")
    late = [(100, frame(70, time=5, content="late")), (101, frame(3, time=1012, content="again")), (102, frame(70, time=5))]
    write_frames(tmp_path / "in", "c.json", late)
    os.utime(tmp_path / "in" / "c.json", (4e9, 4e9))
    for attempt, look_back in (("one", None), ("two", None), ("three", 24)):
        raw = documents.read_frames_stream(spark, frame_files, files_per_trigger=1)
        routed = streams.route_stream(raw, accounts, friends)
        streams.store_stream(routed, table, str(tmp_path / attempt), NOW, look_back).awaitTermination()
        stored = spark.read.parquet(table)
        ids = sorted(int(r.msg_id) for r in stored.collect())
        assert ids == [0, 1, 2, 3, 4, 20, 50, 60, 70]
    texts = {r.msg_id: (r.status, r.content) for r in stored.collect()}
    assert texts["50"] == ("done", "hi") and texts["1"] == ("queued", "c1") and texts["70"][1] == "late"


def test_late_frames_are_left_out_of_bursts(spark, accounts, friends, frame_files, tmp_path):
    write_frames(tmp_path / "in", "c.json", [(100, frame(70, time=900, content="late"))])
    os.utime(tmp_path / "in" / "c.json", (4e9, 4e9))
    raw = documents.read_frames_stream(spark, frame_files, files_per_trigger=1)
    routed = run(streams.process_stream(raw, accounts, friends), tmp_path, "routed")
    assert "70" not in {r.msg_id for r in routed.collect()}


def test_frames_without_a_time_take_that_of_recording(spark, accounts, friends, tmp_path):
    frames = [(0, frame(1, time=1000)), (1, frame(2, time=None)), (2, frame(3, time=0)), (3, frame(4, sender="zz", time=9000))]
    write_frames(tmp_path / "in", "a.json", frames)
    raw = documents.read_frames_stream(spark, str(tmp_path / "in"))
    routed = streams.process_stream(raw, accounts, friends, received=F.col("arrival") + 1004)
    ranges = run(streams.burst_ranges_stream(routed), tmp_path, "ranges")
    assert [(r.burst_start, r.last_received, r.message_count) for r in ranges.collect()] == [(1000, 1006, 3)]


def test_tables_round_trip(spark, rows, tmp_path):
    append(rows("id int, text string", (1, "t")), str(tmp_path / "logs"), "logs", NOW)
    append(rows("id int, text string, day int", (2, "u", 5)), str(tmp_path / "logs"), "logs", NOW)
    logs = load_table(spark, "logs", str(tmp_path / "logs"))
    assert sorted((r.id, r.text, r.create_time) for r in logs.collect()) == [(1, "t", datetime(2024, 1, 30, 12, 30)), (2, "u", datetime(2024, 1, 30, 12, 30))]
    path = write_version(logs, str(tmp_path / "versions"), 1)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        write_version(logs, str(tmp_path / "versions"), 1)


def test_shared_folder_is_the_one_the_session_names():
    settings = {"spark.checkpoint.dir": "/shared/place/"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: settings.get(key, default)))
    assert shared_dir(session, "x").startswith("/shared/place/x-")
    assert shared_dir(session, "x") != shared_dir(session, "x")


def test_messages_without_a_time_are_bursts_of_their_own(spark, rows):
    messages = rows(
        "id int, from_user string, to_user string, create_time bigint, content string",
        *[(i, "a", "b", None, f"t{i}") for i in range(25)],
        (100, "a", "b", 50, "x"), (101, "a", "b", 55, "y"), (102, "a", "b", 90, "z"),
    )
    got = ingest.merge_bursts(messages, 10, size=10).collect()
    assert sorted(r.content for r in got) == sorted([*(f"t{i}" for i in range(25)), "x\ny", "z"])
    assert all(r.part == 0 for r in got)
    # The same where the sender is worked on in parts.
    parts = ingest.merge_assigned(ingest.assign_bursts(messages, 10, window_rows=4)).collect()
    assert sorted(r.content for r in parts) == sorted(r.content for r in got)


def test_messages_without_an_id_are_all_kept(rows):
    batch = rows(
        "msg_id string, create_time bigint, content string",
        (None, 1, "a"), (None, 1, "a"), ("m", 2, "late"), ("m", 1, "first"),
    )
    got = ingest.dedup_messages(batch)
    assert got.columns == ["msg_id", "create_time", "content"]
    assert sorted((str(r.msg_id), r.content) for r in got.collect()) == [
        ("None", "a"), ("None", "a"), ("m", "first")
    ]


def test_frames_with_fields_of_another_kind_are_good(rows):
    texts = [
        '{"msg_id":"m1","from_user_name":{"str":"u"},"create_time":"1000","msg_type":"1"}',
        '{"msg_id":2,"from_user_name":{"str":"u"},"create_time":1000.5,"img_buf":"odd","msg_type":[]}',
        '{"msg_id":3,"from_user_name":"u"}', "[1]", "3", '{"msg_id":4}x',
    ]
    raw = rows(RAW, *[(t, "k", i) for i, t in enumerate(texts)])
    good, bad = documents.parse_frames(raw)
    got = {r.arrival: (r.msg_id, r.from_user, r.create_time, r.msg_type) for r in good.collect()}
    assert got == {
        0: ("m1", "u", 1000, 1), 1: ("2", "u", 1000, None), 2: ("3", None, None, None)
    }
    assert sorted(r.arrival for r in bad.collect()) == [3, 4, 5]
