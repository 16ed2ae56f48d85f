"""Registered queries: one per operator, over the stand-in tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.clock import epoch_of, moment, time_text
from parley.functions.ordered import first_per_key, pack_ordered, part_text
from parley.functions.values import raw_json, salted_md5
from parley.operators import (
    calendar,
    changes,
    filters,
    ingest,
    listings,
    members,
    prompts,
    replies,
    stats,
    tasks,
)
from parley.sources import documents
from parley.sources.standins import CRONS, Standins, every, pick, prefixed
from parley.sources import store
from parley.sources.tables import shared_dir
from parley.streaming import frames as streams
from parley.streaming import states

EVENTS_NOW = "2024-01-30 12:30:00"
ORDERS_NOW = "2001-07-31 12:00:00"
FIRES_START, FIRES_END = "2024-03-01 00:00:00", "2024-03-08 00:00:00"
BURST_GAP = 1800
LOOK_BACK = 24 * 30

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Standins], DataFrame]) -> Callable[[Standins], DataFrame]:
    """Register a query under its function's name."""
    QUERIES[build.__name__] = lambda spark, folder: build(Standins(spark, folder))
    return build


# --- statistics -------------------------------------------------------------


@query
def daily_messages(s):
    return stats.daily_messages(s.messages(), EVENTS_NOW)


@query
def daily_tasks(s):
    return stats.daily_tasks(s.tasks(), ORDERS_NOW)


@query
def hourly_messages(s):
    return stats.hourly_messages(s.messages(), EVENTS_NOW)


@query
def message_summary(s):
    return stats.message_summary(stats.hourly_messages(s.messages(), EVENTS_NOW))


@query
def hourly_tasks(s):
    return stats.hourly_tasks(s.tasks_hourly(), EVENTS_NOW)


@query
def overview_counts(s):
    return stats.overview_counts(s.friends(), s.accounts(), s.messages())


@query
def message_kinds(s):
    return stats.message_kind_distribution(s.messages(), EVENTS_NOW)


@query
def task_status(s):
    return stats.task_status_distribution(s.tasks())


@query
def conversation_volume(s):
    return stats.conversation_volume(s.messages())


# --- filters, lookups, listings ---------------------------------------------

LISTED = ["id", "account_id", "nickname", "remark", "is_active", "ai_active", "ai_reply", "ow_nickname", "ow_avatar"]


@query
def friend_listing(s):
    params = {"nickname": "cUSTOMER#00", "remark": "u", "is_active": "1", "wxid": ""}
    return listings.friend_listing(s.friends(), s.accounts(), params, page=None).select(*LISTED)


@query
def friend_page(s):
    page = listings.friend_listing(s.friends(), s.accounts(), {"is_active": "0"}, 2, 15)
    return page.select(*LISTED, "total_rows", "total_pages")


@query
def friend_ranks(s):
    """Every contact with its place and page in the listing, from a listing written by ranges."""
    path = shared_dir(s.spark, "ranked")
    filters.write_ranked(s.friends(), listings.friend_order(), path)
    return filters.ranked_rows(s.spark, path, 15).select("id", "rank", "page", "page_row")


@query
def friend_page_by_rank(s):
    """The page of `friend_page`, read by rank."""
    wanted = filters.apply_filters(s.friends(), {"is_active": "0"})
    page = filters.paginate(wanted, listings.friend_order(), 2, 15, shallow_rows=0)
    named = listings.flags_as_text(listings.with_owner(page, s.accounts()))
    # The join to owners keeps the columns of contacts; the counts are of the page.
    return named.select(*LISTED, "total_rows", "total_pages")


@query
def friends_with_tasks(s):
    nested = listings.friends_with_tasks(s.friends(), s.tasks())
    line = lambda t: F.concat_ws("|", t["id"], t["task_name"], t["cron_expression_chinese"])
    return nested.select(
        "id",
        "nickname",
        part_text(F.col("part")).alias("part"),
        F.size("tasks").cast("long").alias("task_count"),
        F.array_join(F.transform("tasks", line), ";").alias("task_lines"),
    )


@query
def account_friend_counts(s):
    counted = listings.account_friend_counts(s.accounts(), s.friends())
    return counted.select("id", "nickname", "friend_count")


@query
def search_logs(s):
    return listings.search_logs(s.logs(), {"text": "THE", "reson": "en", "reply": ""}, 2, 10).select(
        "id", "reson", "msg", "total_rows", "total_pages"
    )


@query
def search_all_logs(s):
    """All finds, with wildcards taken from the text as they stand."""
    found = filters.search_contains(s.logs(), {"text": "T_E", "msg": "SRC"}, escape=False)
    return found.select("id", "reson", "msg", F.length("text").alias("text_length"))


@query
def name_conflicts(s):
    admins = s.admins()
    return filters.name_conflicts(admins.select("id", "username"), admins)


@query
def admin_listing(s):
    return listings.admin_listing(s.admins()).select("id", "username", "password", "last_login_time")


@query
def password_hashes(s):
    hashed = salted_md5(F.col("password"), F.col("password_salt"))
    return s.admins().select("id", hashed.alias("hash"))


@query
def validate_rows(s):
    rows = s.tasks().select(
        "id",
        F.nullif("end_date", F.lit("2000")).alias("start_time"),
        F.when(every("id", 4), "").otherwise(F.col("task_name")).alias("name"),
    )
    checked = filters.validate_rows(rows, required=["name"])
    return checked.select("id", F.array_join("errors", ";").alias("errors"))


@query
def pair_messages(s):
    return filters.between_parties(s.messages(), "u7", "a7").select("id", "from_user", "to_user")


@query
def party_messages(s):
    """Messages of every account, whichever side it is on."""
    own = s.accounts().select(F.col("wx_id").alias("party"), F.col("id").alias("account_id"))
    mine = filters.by_party(s.messages()).join(own, "party")
    return mine.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.max("create_at").alias("last_at")
    )


@query
def recent_sent(s):
    recent = filters.since(s.messages(), "create_at", EVENTS_NOW, 48)
    sent = filters.filter_eq(recent, {"type": 1, "is_ai": 0})
    return filters.filter_in(sent, "to_user", s.friends().where("ai_active = 1").select("wxid")).select(
        "id", "to_user"
    )


@query
def first_contact(s):
    """The first message of every sender."""
    return first_per_key(
        s.messages().select("from_user", "create_time", "id", "content"),
        ["from_user"],
        ["create_time", "id"],
    )


@query
def active_tasks(s):
    return listings.active_tasks(s.tasks()).select("id", "friend_id", "cron_expression_chinese")


@query
def tasks_of_friend(s):
    return listings.tasks_of_friend(s.tasks(), 7).select("id", "task_name", "create_time")


# --- members ----------------------------------------------------------------


@query
def expired_members(s):
    return members.expired_members(s.friends(), EVENTS_NOW).select("id", "nickname", "end_time")


@query
def expiring_members(s):
    return members.expiring_members(s.friends(), EVENTS_NOW).select("id", "nickname", "end_time")


@query
def member_reminder(s):
    lapsed = members.expired_members(s.friends(), EVENTS_NOW)
    return members.reminder_pieces(members.member_reminder(lapsed))


@query
def expire_members(s):
    return members.expire_members(s.friends(), EVENTS_NOW).select(
        "id", "is_active", "ai_active", "update_time"
    )


# --- changes ----------------------------------------------------------------


@query
def patch_members(s):
    """Two patches for every contact without a story; the later one counts."""
    asked = s.friends().where("user_story = ''")
    patch = asked.select(
        "id",
        F.concat("nickname", F.lit("!")).alias("remark"),
        F.when(every("id", 2), 1009).alias("role_id"),
        F.lit(1).alias("seq"),
    )
    early = patch.withColumn("remark", F.lit("early")).withColumn("seq", F.lit(0))
    changed = changes.apply_patch(
        s.friends(), patch.unionByName(early), "id", ["remark", "role_id"], EVENTS_NOW, "seq"
    )
    return changed.select("id", "nickname", "remark", "role_id", "update_time")


@query
def close_tasks(s):
    closing = s.friends().where("is_active = 0").select(F.col("id").alias("friend_id"))
    return changes.close_tasks(s.tasks(), closing, ORDERS_NOW).select(
        "id", "friend_id", "is_active", "update_time"
    )


@query
def delete_rows(s):
    asked = s.roles().where("name LIKE 'red%'").select("id")
    kept, refused = changes.delete_rows(s.roles(), asked, "id", F.col("is_system") == 1)
    return kept.select("id", "name", F.lit("kept").alias("outcome")).unionByName(
        refused.select("id", "name", F.lit("refused").alias("outcome"))
    )


def _snapshots(s):
    """A contact snapshot per customer: stored contacts, and new ones for every third."""
    key = F.col("c_custkey")
    name = F.when(every("c_custkey", 3), prefixed("n", key)).otherwise(prefixed("u", key))
    item = F.struct(
        F.struct(name.alias("str")).alias("userName"),
        F.struct(F.concat("c_name", F.lit("*")).alias("str")).alias("nickName"),
        F.struct(F.lit("").alias("str")).alias("remark"),
        F.col("c_mktsegment").alias("province"),
    )
    data = F.struct(F.lit(2).alias("count"), F.array(item, item).alias("friendList"))
    code = F.when(every("c_custkey", 5), 500).otherwise(200)
    return s.raw("customer").select(
        prefixed("k", F.col("c_nationkey")).alias("auth_key"),
        F.to_json(F.struct(code.alias("Code"), data.alias("Data"))).alias("value"),
    )


@query
def upsert_contacts(s):
    contacts = documents.contacts_from_snapshot(_snapshots(s), s.accounts())
    stored = s.friends().withColumn("province", F.lit("old"))
    merged = changes.upsert_contacts(stored, contacts, EVENTS_NOW)
    return merged.select(
        "id", "account_id", "wxid", "nickname", "remark", "province", "is_active", "role_id",
        "update_time",
    )


@query
def snapshot_counts(s):
    counts = documents.snapshot_counts(_snapshots(s)).groupBy("auth_key").agg(
        F.sum("friend_count").alias("friend_count")
    )
    accounts = s.accounts().withColumn("friend_count", F.lit(0).cast("long"))
    return changes.set_friend_count(accounts, counts).select("id", "friend_count")


@query
def upsert_accounts(s):
    """Login documents by supplier: for stored and for new accounts, the last one counts."""
    key = F.col("s_suppkey")
    data = F.struct(
        prefixed("a", key % 40).alias("wxid"),
        F.col("s_name").alias("nick_name"),
        F.col("s_nationkey").alias("effective_time"),
    )
    code = F.when(every("s_suppkey", 7), 300).otherwise(200)
    docs = s.raw("supplier").select(
        F.to_json(F.struct(code.alias("Code"), data.alias("Data"))).alias("value"),
        key.alias("seq"),
        prefixed("d", key).alias("auth_key"),
    )
    merged = changes.upsert_accounts(s.accounts(), documents.account_patch_from_login(docs))
    return merged.select(
        "id", "wx_id", "auth_key", "nickname", "auth_key_remaining_time", "totalOnline", "ws_status"
    )


@query
def account_profiles(s):
    """Profile documents by supplier, the last one per connection key applied."""
    key = F.col("s_suppkey")
    user = F.struct(
        F.struct(prefixed("w", key).alias("str")).alias("userName"),
        F.struct(F.col("s_name").alias("str")).alias("nickName"),
        prefixed("alias", key).alias("alias"),
    )
    ext = F.struct(prefixed("img", key).alias("smallHeadImgUrl"))
    data = F.struct(user.alias("userInfo"), ext.alias("userInfoExt"))
    docs = s.raw("supplier").select(
        prefixed("k", key % 30).alias("auth_key"),
        F.to_json(F.struct(F.lit(200).alias("Code"), data.alias("Data"))).alias("value"),
    )
    patches = documents.account_patch_from_profile(docs).withColumn(
        "seq", F.substring("wx_id", 2, 20).cast("long")
    )
    changed = changes.apply_patch(
        s.accounts(), patches, "auth_key", ["wx_id", "nickname", "avatar", "alias"], seq="seq"
    )
    return changed.select("id", "wx_id", "nickname", "avatar", "alias", "onlineTime")


@query
def account_online(s):
    """Status documents by supplier: failed ones clear the online columns."""
    key = F.col("s_suppkey")
    data = F.struct(
        prefixed("on", key).alias("onlineTime"), prefixed("total", key).alias("totalOnline")
    )
    docs = s.raw("supplier").select(
        prefixed("k", key).alias("auth_key"),
        F.to_json(
            F.struct(F.when(every("s_suppkey", 3), 400).otherwise(200).alias("Code"), data.alias("Data"))
        ).alias("value"),
    )
    patches = documents.account_patch_from_status(docs)
    changed = changes.apply_patch(s.accounts(), patches, "auth_key", changes.ONLINE_COLUMNS)
    return changed.select("id", *changes.ONLINE_COLUMNS)


@query
def reset_online(s):
    leaving = s.raw("supplier").where("s_acctbal < 3000").select(
        prefixed("k", F.col("s_suppkey")).alias("auth_key")
    )
    return changes.reset_online(s.accounts(), leaving).select(
        "id", "nickname", *changes.ONLINE_COLUMNS
    )


@query
def upsert_by_id(s):
    rows = s.friends().select(
        F.when(every("id", 3), F.col("id")).alias("id"),
        F.col("id").alias("seq"),
        F.col("id").alias("friend_id"),
        F.col("nickname").alias("task_name"),
        F.lit("0 0 8 * * *").alias("cron_expression"),
    )
    merged = changes.upsert_by_id(s.tasks(), rows, "friends_task", "seq", ORDERS_NOW)
    return merged.select(
        "id", "friend_id", "task_name", "cron_expression", "is_active", "execution_count", "update_time",
    )


@query
def set_all(s):
    return changes.set_all(s.friends(), ai_reply=0).select("id", "ai_reply")


# --- tasks ------------------------------------------------------------------


@query
def validity_state(s):
    return tasks.with_validity(s.tasks(), ORDERS_NOW).select("id", "end_date", "validity")


@query
def retire_tasks(s):
    return changes.retire_tasks(s.tasks(), ORDERS_NOW).select("id", "is_active", "update_time")


def _shifted_friends(s):
    """All contacts under ids further on, so that some tasks have none."""
    return s.friends().withColumn("id", (F.col("id") + 20).cast(s.friends().schema["id"].dataType))


def _eligible(s):
    return tasks.task_eligibility(s.tasks(), _shifted_friends(s), ORDERS_NOW)


@query
def task_eligibility(s):
    due = s.tasks().select((F.col("id") * 2).alias("task_id"))
    judged = tasks.task_eligibility(s.tasks(), _shifted_friends(s), ORDERS_NOW, due)
    return judged.select("task_id", "friend_id", "wxid", "verdict")


@query
def task_messages(s):
    return tasks.task_messages(_eligible(s)).select("task_id", "account_id", "wxid", "content")


@query
def task_log_rows(s):
    runs = tasks.run_outcomes(_eligible(s))
    return changes.task_log_rows(runs, ORDERS_NOW)


@query
def resolve_targets(s):
    key = F.col("id")
    requests = s.tasks().select(
        key.alias("request_id"),
        key.alias("task_id"),
        F.when(every("id", 2), (F.col("friend_id") % 25).cast("int")).alias("account_id"),
        prefixed("u", F.col("friend_id")).alias("wxid"),
    )
    return tasks.resolve_targets(requests, s.tasks(), s.friends(), s.accounts())


@query
def schedule_diff(s):
    present = s.tasks().select(
        (F.col("id") + 10).alias("id"),
        F.when(every("id", 3), pick(("0 0 1 * * *", None), F.col("id") % 2))
        .otherwise(pick(CRONS, F.col("id") % len(CRONS)))
        .alias("cron"),
    )
    return changes.schedule_diff(s.tasks().where("is_active = 1"), present)


@query
def active_task_json(s):
    listed = tasks.active_task_json(s.tasks())
    return listed.select("friend_id", part_text(F.col("part")).alias("part"), "task_count", "items")


def _ops(s):
    key = F.col("event_id")
    return s.raw("events").select(
        key.alias("op_seq"),
        F.when(every("event_id", 4), F.lit(-1)).otherwise(key % 3000).cast("long").alias("id"),
        pick(("add", "update", "update", "update", "delete", "keep", "update"), key % 7).alias("operate"),
        F.col("user_id").cast("int").alias("friend_id"),
        prefixed("t", key).alias("task_name"),
        pick(("? ? ? ? ? ?", "0 0 8 ? * *", None), key % 3).alias("cron_expression"),
        F.lit(None).cast("string").alias("start_date"),
        F.lit("2030-01-01").alias("end_date"),
        F.lit(1).alias("is_active"),
        F.when(every("event_id", 2), F.array(F.lit("cron_expression"), F.lit("start_date")))
        .otherwise(F.array(F.lit("task_name"), F.lit("end_date")))
        .alias("given"),
    )


@query
def apply_task_ops(s):
    changed = changes.apply_task_ops(s.tasks(), _ops(s), ORDERS_NOW)
    return changed.select(
        "id", "friend_id", "task_name", "cron_expression",
        "start_date", "end_date", "is_active", "execution_count", "update_time",
    )


def _runs(s):
    return s.raw("events").select(
        (F.col("event_id") % 3000).alias("task_id"),
        F.col("ts").alias("run_time"),
        F.concat(F.lit("failed at "), time_text(F.col("ts"))).alias("error_message"),
    )


@query
def record_executions(s):
    return changes.record_executions(s.tasks(), _runs(s)).select(
        "id", "execution_count", "last_execution_time"
    )


@query
def record_errors(s):
    return changes.record_errors(s.tasks(), _runs(s)).select(
        "id", "error_message", "last_execution_time"
    )


# --- cron -------------------------------------------------------------------


@query
def describe_cron(s):
    return calendar.describe_cron(s.tasks()).select(
        "id", "cron_expression", "cron_expression_chinese"
    )


@query
def cron_valid(s):
    return calendar.with_cron_validity(s.tasks()).select("id", "cron_valid")


@query
def cron_fires(s):
    return calendar.cron_fires(s.tasks(), FIRES_START, FIRES_END).select("id", "fire_time")


ZONES = ("America/Havana", "Asia/Shanghai", "UTC")


def _zoned_fires(s, start, end):
    names = F.array(*[F.lit(z) for z in ZONES])
    tasks = s.tasks().withColumn("zone", F.get(names, (F.col("id") % len(ZONES)).cast("int")))
    fires = calendar.zoned_fires(tasks, start, end, F.col("zone"))
    return fires.select("id", "zone", "fire_time", "fire_epoch")


@query
def zoned_fires_forward(s):
    """Clocks of one of the zones are set forward at midnight of the second day."""
    return _zoned_fires(s, "2024-03-09 00:00:00", "2024-03-12 00:00:00")


@query
def zoned_fires_back(s):
    """Clocks of one of the zones are set back at one o'clock of the second day."""
    return _zoned_fires(s, "2024-11-02 00:00:00", "2024-11-05 00:00:00")


@query
def next_fire(s):
    return calendar.next_fire(s.tasks(), ORDERS_NOW).select("id", "next_fire")


@query
def set_next_execution(s):
    return calendar.set_next_execution(s.tasks(), ORDERS_NOW).select("id", "next_execution_time")


# --- ingest -----------------------------------------------------------------


@query
def parse_frames(s):
    good, _ = documents.parse_frames(s.frames())
    return good.select(
        "arrival", "auth_key", "msg_id", "from_user", "to_user", "msg_type", "content", "create_time"
    )


@query
def bad_frames(s):
    _, bad = documents.parse_frames(s.frames())
    return bad.select("arrival", "value")


@query
def route_messages(s):
    return ingest.route_messages(s.messages(), s.accounts(), s.friends()).select(
        "id", "from_user", "route"
    )


@query
def message_rows(s):
    good, _ = documents.parse_frames(s.frames())
    routed = ingest.route_messages(ingest.drop_senderless(good), s.accounts(), s.friends())
    return ingest.to_message_rows(routed, EVENTS_NOW).drop("raw_data")


@query
def dedup_messages(s):
    """Every message arrives, and again five seconds later; those sent are stored already."""
    first = s.messages().select("msg_id", "create_time", "content")
    again = first.withColumn("create_time", F.col("create_time") + 5)
    stored = s.messages().where("type = 1")
    once = ingest.dedup_messages(first.unionByName(again))
    return ingest.new_messages(once, stored)


@query
def merge_bursts(s):
    return ingest.merge_bursts(s.odd_messages(), BURST_GAP)


@query
def stream_bursts(s):
    """The bursts of `merge_bursts`, by a stream over files of frames.

    Only messages of active contacts with AI take part. A last frame of nobody,
    two hours later, closes the bursts before it.
    """
    spark = s.spark
    root = shared_dir(spark, "stream-bursts")
    last = s.messages().agg(
        (F.max("create_time") + 7200).alias("create_time"), (F.max("id") + 1).alias("arrival")
    )
    frame = F.struct(
        F.lit(-1).alias("msg_id"),
        F.struct(F.lit("nobody").alias("str")).alias("from_user_name"),
        F.col("create_time"),
    )
    closing = last.select(F.to_json(frame).alias("value"), F.lit("none").alias("auth_key"), "arrival")
    s.stream_frames().unionByName(closing).write.json(f"{root}/frames")
    raw = documents.read_frames_stream(spark, f"{root}/frames")
    routed = streams.process_stream(raw, s.accounts(), s.friends(), ignored=True)
    streams.run_stream(routed, f"{root}/routed", f"{root}/routed-checkpoint").awaitTermination()
    stored = streams.read_routed(spark, f"{root}/routed", spark.read.parquet(f"{root}/routed").schema)
    ranges = streams.burst_ranges_stream(stored, BURST_GAP)
    streams.run_stream(ranges, f"{root}/ranges", f"{root}/ranges-checkpoint").awaitTermination()
    return streams.merge_closed_bursts(
        spark.read.parquet(f"{root}/ranges"), spark.read.parquet(f"{root}/routed")
    )


@query
def stream_messages(s):
    """The rows of `message_rows`, stored by a stream over frames that come twice, but for
    those without an id, which are no copies of each other."""
    spark = s.spark
    root = shared_dir(spark, "stream-messages")
    frames = s.frames(odd=True)
    frames.unionByName(frames.where("arrival % 29 <> 0")).write.json(f"{root}/frames")
    raw = documents.read_frames_stream(spark, f"{root}/frames", files_per_trigger=2)
    routed = streams.route_stream(raw, s.accounts(), s.friends())
    streams.store_stream(
        routed, f"{root}/messages", f"{root}/checkpoint", EVENTS_NOW
    ).awaitTermination()
    return spark.read.parquet(f"{root}/messages").drop("raw_data", *store.LAYOUT)


def _bursts(s):
    return ingest.assign_bursts(s.messages(both_ways=False), BURST_GAP)


def _handled(s):
    """Replies for the bursts that began by now; those to every seventh sender failed."""
    sender = F.substring("from_user", 2, 20).cast("long")
    heads = _bursts(s).select("from_user", "to_user", "burst_start").distinct()
    begun = heads.where(F.col("burst_start") < epoch_of(moment(EVENTS_NOW)))
    return begun.withColumn("failed", sender % 7 == 0)


@query
def burst_status(s):
    """With bursts that have no time, all of which are handled."""
    bursts = ingest.assign_bursts(s.odd_messages(), BURST_GAP)
    heads = bursts.select("from_user", "to_user", "burst_start", "burst_number").distinct()
    begun = F.coalesce("burst_start", F.lit(0)) < epoch_of(moment(EVENTS_NOW))
    sender = F.substring("from_user", 2, 20).cast("long")
    return ingest.burst_status(
        bursts, s.friends(), heads.where(begun).withColumn("failed", sender % 7 == 0)
    )


@query
def set_message_status(s):
    patches = ingest.burst_status(_bursts(s), s.friends(), _handled(s))
    return changes.set_message_status(s.messages(), patches, EVENTS_NOW).select(
        "id", "status", "update_at"
    )


@query
def connection_status(s):
    return ingest.connection_status(s.state_events())


@query
def state_changes(s):
    return ingest.state_changes(s.state_events())


@query
def stream_state_changes(s):
    """The rows of `state_changes`, by a stream that goes on three times as events come in."""
    spark = s.spark
    root = shared_dir(spark, "stream-states")
    events, day = s.state_events(), F.dayofmonth("timestamp")
    for part in (day <= 10, (day > 10) & (day <= 20), day > 20):
        events.where(part).write.mode("append").parquet(f"{root}/events")
        source = spark.readStream.schema(events.schema).parquet(f"{root}/events")
        changes = states.state_changes_stream(source)
        streams.run_stream(changes, f"{root}/changes", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/changes").select(*events.columns, "previous_state")


@query
def ws_status_patches(s):
    # Events of one connection come under a name no account has.
    renamed = F.when(F.col("url") == "a3", "gone").otherwise(F.col("url"))
    tracked = ingest.connection_status(s.state_events().withColumn("url", renamed))
    return ingest.ws_status_patches(s.accounts(), tracked, "wx_id")


# --- conversations and prompts ----------------------------------------------


@query
def config_row(s):
    return prompts.config_row(s.system(), ["hisMsgDay", "to_noti_wxid", "from_noti_key"])


@query
def members_with_config(s):
    noted = prompts.with_config(s.friends(), s.system(), ["to_noti_wxid", "from_noti_key"])
    return noted.select("id", "to_noti_wxid", "from_noti_key")


def _pairs(s):
    return prompts.friend_pairs(s.friends(own_account=True), s.accounts()).drop("friend_id")


@query
def chat_history(s):
    """Histories over the configured look-back."""
    history = prompts.chat_history(s.messages(), _pairs(s), EVENTS_NOW, system=s.system())
    return history.select("party_a", "party_b", "id", "create_time", "content")


@query
def chat_turns(s):
    turns = prompts.chat_turns(prompts.chat_history(s.messages(), _pairs(s), EVENTS_NOW, LOOK_BACK))
    return turns.select("party_a", "party_b", "id", "create_time", "role", "turn_content")


def _requests(s):
    """A request per contact; every sixth has no text."""
    return s.friends().select(
        (F.col("id") + 100).alias("request_id"),
        F.col("id").alias("friend_id"),
        F.when(every("id", 6), "").otherwise(F.col("nickname")).alias("text"),
    )


def _prompts(s, variant):
    turns = prompts.build_prompts(
        _requests(s), s.friends(own_account=True), s.accounts(), s.roles(), s.tasks(),
        s.messages(), EVENTS_NOW, variant, LOOK_BACK,
    )
    return prompts.turns_text(turns)


@query
def build_prompts(s):
    return _prompts(s, "reply")


@query
def prompt_arrays(s):
    turns = prompts.build_prompts(
        _requests(s), s.friends(own_account=True), s.accounts(), s.roles(), s.tasks(),
        s.messages(), EVENTS_NOW, "reply", LOOK_BACK,
    )
    packed = prompts.packed_prompts(turns)
    return packed.select(
        "request_id",
        part_text(F.col("part")).alias("part"),
        F.size("turns").cast("long").alias("turn_count"),
        raw_json(F.col("turns")).alias("turns"),
    )


@query
def copy_edit_prompts(s):
    return _prompts(s, "copy_edit")


@query
def summary_prompts(s):
    return _prompts(s, "summary")


@query
def adhoc_prompts(s):
    requests = s.logs().select(
        F.col("id").alias("request_id"),
        (F.col("id") % 300 + 990).cast("int").alias("role_id"),
        "text",
    )
    return prompts.turns_text(prompts.adhoc_prompts(requests, s.roles()))


@query
def owner_prompts(s):
    requests = s.accounts().select(
        (F.col("id") + 500).alias("request_id"), F.col("id").alias("account_id"),
        F.col("nickname").alias("text"),
    )
    turns = prompts.owner_prompts(
        requests, s.accounts(), s.roles(), s.messages(), EVENTS_NOW, LOOK_BACK
    )
    return prompts.turns_text(turns)


@query
def burst_requests(s):
    bursts = ingest.merge_bursts(s.odd_messages(), BURST_GAP)
    return prompts.burst_requests(bursts, s.friends())


@query
def exchange_log_rows(s):
    turns = pack_ordered(
        s.raw("conversations").select("conv_id", "turn", "role", F.col("text").alias("content")),
        ["conv_id"],
        ["turn"],
        F.struct("role", "content"),
    )
    exchanges = turns.select(
        "conv_id",
        F.col("items").alias("turns"),
        F.lit(None).cast("string").alias("reasoning"),
        F.concat(F.lit("re: "), F.element_at("items", 1)["role"]).alias("reply"),
    )
    return listings.exchange_log_rows(exchanges)


# --- replies ----------------------------------------------------------------


@query
def repair_json(s):
    return replies.repair_json(s.replies(), "text").select("reply_id", "status", "parsed")


@query
def reply_messages(s):
    return replies.reply_messages(replies.parse_replies(s.replies(), "text"), ["reply_id"])


@query
def sent_messages(s):
    """Rows of the replies to the bursts; the reply to a burst is that to its first message."""
    heads = _bursts(s).where("burst_position = 0").select(
        F.col("id").alias("reply_id"), "from_user", "to_user", "burst_start"
    )
    answers = s.replies().select("reply_id", "text").join(heads, "reply_id")
    said = replies.reply_messages(
        replies.parse_replies(answers, "text"), ["from_user", "to_user", "burst_start"]
    )
    return replies.sent_message_rows(said, s.friends(), s.accounts(), EVENTS_NOW)


@query
def sent_tasks(s):
    """Rows of the task messages sent to their targets; every sixth text is empty."""
    text = F.when(~every("id", 6), F.concat(F.lit("hi "), "task_name")).otherwise("")
    copies = s.tasks().select(F.col("id").alias("request_id"), text.alias("content"))
    return replies.sent_task_rows(copies, resolve_targets(s), ORDERS_NOW)


@query
def reply_task_ops(s):
    ops = replies.reply_task_ops(replies.parse_replies(s.replies(), "text"), ["reply_id"])
    return ops.select(
        "reply_id", "position", "id", "operate", "friend_id", "task_name", "cron_expression",
        F.array_join("given", ",").alias("given"),
    )


@query
def reply_summaries(s):
    return replies.reply_summaries(replies.parse_replies(s.replies(), "text"), ["reply_id"])


@query
def task_change_notices(s):
    parsed = replies.parse_replies(s.replies(), "text")
    return replies.task_change_notices(parsed, s.friends()).select("reply_id", "friend_id", "content")
