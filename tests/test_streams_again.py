"""Streams whose batches run again, whose tables change, and states that go on from batch to batch."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tests.test_ingest import NOW, RAW, frame, write_frames

from parley.operators import ingest, prompts
from parley.sources import documents, store
from parley.sources.tables import newest_version, shared_dir, write_version
from parley.streaming import frames as streams
from parley.streaming import states

MESSAGE = "msg_id string, from_user string, to_user string, msg_type int, content string, create_time long, route int, arrival long, raw_data string"


def batch_of(rows, *data):
    return rows(MESSAGE, *[(m, "u", "a", 1, c, t, 3, n, c) for n, (m, t, c) in enumerate(data)])


def contents(spark, path):
    return sorted(r.content for r in spark.read.parquet(path).collect())


def test_a_batch_that_runs_again_adds_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    first = batch_of(rows, ("1", 1000, "a"), (None, 1001, "b"), (None, 1001, "b"), ("2", None, "c"))
    second = batch_of(rows, ("1", 99_000, "a again"), ("3", 90_000, "d"), (None, 5, "e"))
    for _ in range(2):
        streams.store_batch(first, path, NOW, writer="w", batch_id=0)
        assert contents(spark, path) == ["a", "b", "b", "c"]
    for as_of in (NOW, "2024-02-02 00:00:00"):
        streams.store_batch(second, path, as_of, writer="w", batch_id=1)
        assert contents(spark, path) == ["a", "b", "b", "c", "d", "e"]
    # The first again, at another time: its message without a time moves to another day.
    streams.store_batch(first, path, "2024-02-02 00:00:00", writer="w", batch_id=0)
    assert contents(spark, path) == ["a", "b", "b", "c", "d", "e"]
    # Another stream adds what is new alone.
    streams.store_batch(first.limit(1).unionByName(batch_of(rows, ("9", 1, "z"))), path, NOW, writer="x")
    assert contents(spark, path) == ["a", "b", "b", "c", "d", "e", "z"]


def test_filters_prune_what_is_read(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    data = [(str(n), 86_400 * (n % 7), f"t{n}") for n in range(400)]
    streams.store_batch(batch_of(rows, *data), path, NOW, writer="w", batch_id=0)
    asked = ingest.to_message_rows(batch_of(rows, ("17", 3, "x"), ("none", 4, "y")), NOW)
    assert asked.count() == 2
    names = store.partitions_holding(asked.select("msg_id"), path, "w", 1)
    days = spark.range(1).select(F.date_add(F.lit("1970-01-01").cast("date"), 17 % 7).cast("string")).first()[0]
    bucket = spark.range(1).select(store.bucket_of(F.lit("17"))).first()[0]
    assert f"w/0/{days}/{bucket}" in names and len(names) <= 4
    stored = store.stored_copies(asked, path, "w", 1)
    scan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "PartitionFilters: []" not in scan
    assert stored.where("msg_id = '17'").count() == 1
    # What the batch itself wrote does not count.
    assert store.stored_copies(asked, path, "w", 0) is None


def test_every_id_passes_its_filter(spark, tmp_path):
    ids = spark.range(3000).select(F.concat(F.lit("m"), "id").alias("msg_id"))
    rows = ids.select(
        "msg_id", F.lit("u").alias("from_user"), F.lit("a").alias("to_user"), F.lit("c").alias("content"),
        F.lit(5).cast("long").alias("create_time"),
    )
    store.write_batch(rows, str(tmp_path / "s"), "w", 0)
    names = store.partitions_holding(ids, str(tmp_path / "s"), "w", 1)
    assert len(names) == len(set(names)) == spark.read.parquet(str(tmp_path / "s")).select("bucket").distinct().count()
    others = spark.range(3000).select(F.concat(F.lit("x"), "id").alias("msg_id"))
    one = [len(store.partitions_holding(others.where(f"msg_id = 'x{n}'"), str(tmp_path / "s"), "w", 1)) for n in range(12)]
    assert sum(one) <= 1


def test_frames_without_an_id_all_come_through(spark, rows, tmp_path):
    accounts = rows("id int, wx_id string, auth_key string", (1, "acc", "k"))
    friends = rows("id int, wxid string, is_active int, ai_active int", (1, "u1", 1, 1))
    texts = [frame(None, time=1000, content="a"), frame(None, time=1000, content="a"), frame(7, time=1001), frame(7, time=1001)]
    write_frames(tmp_path / "in", "a.json", list(enumerate(texts)) + [(9, frame(None, time=1002, content="c"))])
    raw = documents.read_frames_stream(spark, str(tmp_path / "in"))
    routed = streams.process_stream(raw, accounts, friends)
    streams.run_stream(routed, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.arrival for r in spark.read.parquet(str(tmp_path / "out")).where("msg_id is null").collect()) == [0, 1, 9]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_bursts_over_all_receivers(spark, rows, tmp_path):
    accounts = rows("id int, wx_id string, auth_key string", (1, "acc", "k"))
    friends = rows("id int, wxid string, is_active int, ai_active int", (1, "u1", 1, 1))
    texts = [frame(1, to="x", time=1000, content="a"), frame(2, to="y", time=1005, content="b"), frame(3, to="x", time=1012, content="c"), frame(4, to="x", time=1100, content="d"), frame(5, sender="zz", time=9000)]
    write_frames(tmp_path / "in", "a.json", list(enumerate(texts)))
    raw = documents.read_frames_stream(spark, str(tmp_path / "in"))
    routed = streams.process_stream(raw, accounts, friends, ignored=True)
    path = str(tmp_path / "routed")
    streams.run_stream(routed, path, str(tmp_path / "cp")).awaitTermination()
    table = spark.read.parquet(path)
    again = streams.read_routed(spark, path, table.schema)
    ranges = streams.burst_ranges_stream(again, 10, keys=["from_user"])
    streams.run_stream(ranges, str(tmp_path / "ranges"), str(tmp_path / "cp2")).awaitTermination()
    merged = streams.merge_closed_bursts(spark.read.parquet(str(tmp_path / "ranges")), table, keys=["from_user"])
    assert sorted((r.burst_start, r.message_count, r.content) for r in merged.collect()) == [(1000, 3, "a\nb\nc"), (1100, 1, "d")]


def test_contacts_that_change_between_batches(spark, rows, tmp_path):
    tables = {name: str(tmp_path / name) for name in ("accounts", "friends")}
    write_version(rows("id int, wx_id string, auth_key string", (1, "acc", "k")), tables["accounts"], 1)
    contacts = "id int, wxid string, is_active int, ai_active int"
    write_version(rows(contacts, (1, "u1", 1, 1)), tables["friends"], 9)
    write_frames(tmp_path / "in", "a.json", [(0, frame(1, time=1000, content="a"))])
    path, checkpoint = str(tmp_path / "messages"), str(tmp_path / "cp")

    def go_on():
        raw = documents.read_frames_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
        streams.store_frames(raw, tables, path, checkpoint, NOW).awaitTermination()
        return contents(spark, path)

    assert go_on() == ["a"]
    os.makedirs(tmp_path / "friends" / "version=11")  # being written
    write_version(rows(contacts, (1, "u1", 0, 1), (2, "u2", 1, 0)), tables["friends"], 10)
    assert newest_version(spark, tables["friends"]).endswith("version=10")
    write_frames(tmp_path / "in", "b.json", [(1, frame(2, time=1001, content="b")), (2, frame(3, sender="u2", time=1002, content="c"))])
    assert go_on() == ["a", "c"]
    # A batch that runs again is routed by the versions of its first run.
    writer = spark.read.parquet(path).first().writer
    assert store.version_for(spark, path, writer, 0, {"friends": "x"})["friends"].endswith("version=9")


def test_bursts_without_a_time_have_ids_and_a_status(rows):
    messages = rows(
        "id int, msg_id string, from_user string, to_user string, create_time bigint, content string",
        (1, "m1", "u1", "a1", None, "x"), (2, "m2", "u1", "a1", None, "y"), (3, "m3", "u1", "a1", 50, "z"),
        (4, "m4", "u1", None, None, "n"),
    )
    friends = rows("id int, wxid string, is_active int, ai_active int", (5, "u1", 1, 1))
    bursts = ingest.assign_bursts(messages)
    asked = prompts.burst_requests(ingest.merge_assigned(bursts), friends).collect()
    assert sorted((r.request_id, r.text) for r in asked) == [
        ("u1//n1", "n"), ("u1/a1/50", "z"), ("u1/a1/n1", "x"), ("u1/a1/n2", "y")
    ]
    heads = bursts.select("from_user", "to_user", "burst_start", "burst_number").distinct()
    handled = heads.withColumn("failed", F.col("burst_number") == 2)
    assert sorted(ingest.burst_status(bursts, friends, handled).collect()) == [
        ("m1", "processed"), ("m2", "failed"), ("m3", "processed"), ("m4", "processed")
    ]


EVENTS = "event_id long, url string, state string, timestamp timestamp_ntz"


def test_state_changes_over_several_batches(spark, rows, tmp_path):
    at = lambda s: datetime(2024, 3, 10, 2, 0, 0) + timedelta(seconds=s)
    parts = [
        [(1, "k", "CONNECTING", 0), (2, "k", "OPEN", 1), (3, "k2", "ERROR", 1), (4, "k", "OPEN", 2)],
        [(6, "k", "OPEN", 4), (5, "k", "CLOSED", 4), (7, "k3", "ODD", 0), (8, "k2", "ERROR", 9), (90, None, "OPEN", 1)],
        [(9, "k", "OPEN", 5), (10, "k2", "CLOSED", 10), (2, "k", "OPEN", 1), (11, "k3", "OPEN", 7)],
    ]
    folder = tmp_path / "events"
    folder.mkdir()
    accounts = rows("id int, auth_key string, ws_status string", (1, "k", "0"), (2, "k2", "4"), (3, "k3", None), (4, "none", "3"))
    out, patched = str(tmp_path / "changes"), []
    for n, part in enumerate(parts):
        lines = [json.dumps({"event_id": i, "url": u, "state": s, "timestamp": at(t).isoformat()}) for i, u, s, t in part]
        (folder / f"{n}.json").write_text("\n".join(lines))
        events = spark.readStream.schema(EVENTS).json(str(folder))
        changes = states.state_changes_stream(events)
        streams.run_stream(changes, out, str(tmp_path / "cp")).awaitTermination()
        states.write_status_patches(
            states.state_changes_stream(events), lambda: accounts, str(tmp_path / "patches"), str(tmp_path / "cp2")
        ).awaitTermination()
        found = spark.read.parquet(str(tmp_path / "patches")).where(f"batch = {n}").collect()
        patched.append(sorted((r.id, r.new_status) for r in found))
    whole = rows(EVENTS, *[(i, u, s, at(t)) for part in parts for i, u, s, t in part if u and i != 2], (2, "k", "OPEN", at(1)))
    wanted = ingest.state_changes(whole).select("url", "event_id", "state", "previous_state", "timestamp")
    got = spark.read.parquet(out)
    assert sorted(got.select(*wanted.columns).collect(), key=repr) == sorted(wanted.collect(), key=repr)
    status = {r.url: r for r in ingest.connection_status(whole).collect()}
    last = {r.url: r for r in sorted(got.collect(), key=lambda r: (r.timestamp, r.event_id))}
    assert {u: (r.state, r.state_code, r.since) for u, r in last.items()} == {
        u: (r.state, r.state_code, r.since) for u, r in status.items()
    }
    assert patched == [[(1, "1")], [(1, "1"), (3, "3")], [(2, "3"), (3, "1")]]


def test_on_a_cluster_the_shared_folder_has_to_be_named():
    from types import SimpleNamespace

    def session(master):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: default),
            sparkContext=SimpleNamespace(master=master),
        )

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"), "x")
    assert "/x-" in shared_dir(session("local[4]"), "x")
