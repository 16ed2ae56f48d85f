"""Conversation histories and prompts.

A prompt is an ordered list of turns. It is kept in long form, one row per
turn, because a history has no bound: `request_id`, then the columns that order
the turns (`section`, `create_time`, `message_id`, `piece`), `role`, `content`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.clock import hours_before, spoken_now, time_text
from parley.functions.ordered import (
    broadcast_if_small,
    first_per_key,
    no_part,
    pack_ordered,
    part_text,
    split_large_groups,
    time_levels,
)
from parley.functions.values import blank, fill_template, or_else, pair_key, raw_json
from parley.operators.filters import by_party, with_pair_key
from parley.operators.tasks import active_task_json, display_remark

# Fixed value: kind of a text message.
TEXT_KIND = 1

# Roles used when a request does not name one, and the wording.
REPLY_ROLE = 999
OWNER_ROLE = 1000
COPY_EDIT_ROLE = 1001
SUMMARY_ROLE = 1010
FIXED_ROLES = {"copy_edit": COPY_EDIT_ROLE, "summary": SUMMARY_ROLE}
NO_STORY = "无"
OWNER_ACCOUNT = " 我的账号是"
HISTORY_HOURS_KEY = "hisMsgDay"
SUMMARY_HOURS = 1
OWNER_HOURS = 24

# The turns of a prompt come in this order.
HISTORY, SYSTEM, USER = 0, 1, 2


def config_row(system: DataFrame, keys: list[str]) -> DataFrame:
    """Configuration values as one row with a column per key.

    A key stored twice takes the value with the lowest id.
    """
    values = [
        F.min_by("value", F.when(F.col("key") == k, F.col("id"))).alias(k) for k in keys
    ]
    return system.where(F.col("key").isin(keys)).agg(*values)


def with_config(df: DataFrame, system: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with the configuration values attached."""
    row = config_row(system, keys)
    return df.withColumns({k: row.select(k).scalar() for k in keys})


def friend_pairs(friends: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each contact with the account it belongs to, as `friend_id, party_a, party_b`."""
    account = accounts.select(F.col("id").alias("account_id"), F.col("wx_id").alias("party_b"))
    contact = friends.select(F.col("id").alias("friend_id"), "account_id", F.col("wxid").alias("party_a"))
    return contact.join(account, "account_id").select("friend_id", "party_a", "party_b")


def chat_history(
    messages: DataFrame,
    pairs: DataFrame,
    as_of,
    hours: int | None = None,
    system: DataFrame | None = None,
) -> DataFrame:
    """Text messages of the conversations asked for, in the look-back (K1).

    `pairs` has `party_a, party_b` and any columns that name the request; its
    rows are kept. Without `hours` the look-back is the configured one. The
    order of a history is `create_time`, then `id`.
    """
    if hours is None:
        # A scalar subquery of the time itself still reaches the scan as a filter.
        configured = config_row(system, [HISTORY_HOURS_KEY])
        look_back = F.col(HISTORY_HOURS_KEY).try_cast("int")
        start = configured.select(hours_before(as_of, look_back)).scalar()
    else:
        start = hours_before(as_of, hours)
    recent = with_pair_key(
        messages.where((F.col("msg_type") == TEXT_KIND) & (F.col("create_at") >= start))
    )
    asked = pairs.where(F.col("party_a").isNotNull() & F.col("party_b").isNotNull()).select(
        "*", *pair_key(F.col("party_a"), F.col("party_b"))
    )
    return recent.join(broadcast_if_small(asked), ["party_low", "party_high"]).drop(
        "party_low", "party_high"
    )


def history_order() -> list[str]:
    return ["create_time", "id"]


def chat_turns(history: DataFrame, account: str = "party_b") -> DataFrame:
    """Messages of a history as turns: `role`, and `content` with its time (K2).

    `account` is the column with the account's own name: what it sent is the
    assistant's.
    """
    role = F.when(F.col("from_user") == F.col(account), F.lit("assistant")).otherwise(F.lit("user"))
    null = F.lit("null")
    said = F.concat(
        F.coalesce(time_text(F.col("create_at")), null), F.lit(":"), F.coalesce("content", null)
    )
    return history.withColumn("role", role).withColumn("turn_content", said)


def _friend_requests(
    requests: DataFrame, friends: DataFrame, accounts: DataFrame
) -> DataFrame:
    """Requests that have a text, once each, with their contact and its account."""
    contact = friends.select(
        F.col("id").alias("friend_id"), "wxid", "account_id", "role_id", "user_story",
        display_remark().alias("name"),
    )
    account = accounts.select(
        F.col("id").alias("account_id"), F.col("wx_id").alias("account_wxid")
    )
    asked = requests.where(~blank(F.col("text")))
    if "part" in requests.columns:
        # Only short texts can be blank, and those have part 0 alone.
        asked = asked.where(F.col("part") == 0)
    return (
        asked.select("request_id", "friend_id")
        .join(contact, "friend_id")
        .join(account, "account_id", "left")
    )


def _history_turns(asked: DataFrame, messages: DataFrame, as_of, hours, system) -> DataFrame:
    pairs = asked.select(
        "request_id", F.col("wxid").alias("party_a"), F.col("account_wxid").alias("party_b")
    )
    turns = chat_turns(chat_history(messages, pairs, as_of, hours, system))
    return turns.select(
        "request_id", "create_time", F.col("id").alias("message_id"), "role",
        F.col("turn_content").alias("content"),
    )


def _turns(
    rows: DataFrame, section: int, role: Column, content: Column, piece: Column | None = None
) -> DataFrame:
    null = F.lit(None).cast("long")
    is_history = section == HISTORY
    return rows.select(
        "request_id",
        F.lit(section).alias("section"),
        (F.col("create_time") if is_history else null).alias("create_time"),
        (F.col("message_id") if is_history else null).alias("message_id"),
        (piece if piece is not None else no_part()).alias("piece"),
        role.alias("role"),
        content.alias("content"),
    )


def _insert_lists(filled: DataFrame, lists: DataFrame, key: str, placeholder: str) -> DataFrame:
    """Put JSON lists in place of a placeholder in `prompt`; long ones piece by piece.

    `filled` has one row per request and piece so far, `lists` has
    `key, part, items`. A list in one part is put into the text. For a list in
    several parts the text around it and the parts become pieces of their own,
    which in order make up the whole text.
    """
    mark = "{{" + placeholder + "}}"
    whole = lists.where(F.size("part") == 0).select(key, "items")
    long_keys = lists.where(F.size("part") > 0).groupBy(key).agg(F.min("part").alias("_first"))
    marked = filled.join(whole, key, "left").join(long_keys, key, "left")
    text = F.concat(F.lit("["), F.coalesce("items", F.lit("")), F.lit("]"))
    short = marked.where(F.col("_first").isNull()).withColumn(
        "prompt", F.replace("prompt", F.lit(mark), text)
    )
    # The text around the long lists: between two stretches of text there is one list.
    stretches = F.split(F.col("prompt"), r"\Q" + mark + r"\E", -1)
    around = marked.where(F.col("_first").isNotNull()).select(
        *filled.columns, "_first", F.size(stretches).alias("_stretches"),
        F.posexplode(stretches).alias("_at", "_stretch"),
    )
    has_list = F.col("_at") < F.col("_stretches") - 1
    opening = F.when(F.col("_at") > 0, F.lit("]")).otherwise(F.lit(""))
    closing = F.when(has_list, F.lit("[")).otherwise(F.lit(""))
    position = F.col("_at").cast("long")
    static = around.withColumn(
        "prompt", F.concat(opening, F.col("_stretch"), closing)
    ).withColumn("piece", F.concat("piece", F.array(position, F.lit(0).cast("long"))))
    comma = F.when(F.col("part") > F.col("_first"), F.lit(",")).otherwise(F.lit(""))
    listed = (
        around.where(has_list)
        .join(lists.where(F.size("part") > 0).select(key, "part", F.col("items").alias("_items")), key)
        .withColumn("prompt", F.concat(comma, F.col("_items")))
        .withColumn("piece", F.concat("piece", F.array(position, F.lit(1).cast("long")), "part"))
    )
    columns = filled.columns
    return (
        short.select(*columns).unionByName(static.select(*columns)).unionByName(listed.select(*columns))
    )


def _history_json(turns: DataFrame, size: int | None) -> DataFrame:
    """Histories as the inside of a JSON list, in parts: `request_id, part, items`."""
    levels = time_levels("create_time", "message_id", size)
    parts = split_large_groups(turns, ["request_id"], levels, size)
    item = F.struct("create_time", "message_id", raw_json(F.struct("role", "content")).alias("item"))
    return parts.groupBy("request_id", "part").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]), ","
        ).alias("items")
    )


def _templates(roles: DataFrame) -> DataFrame:
    named = roles.select(F.col("id").alias("role_id"), F.col("prompt").alias("template"))
    return first_per_key(named, ["role_id"], ["template"])


def _role_prompt(roles: DataFrame, role_id: int) -> Column:
    """The prompt of one role, null if there is none."""
    return roles.where(F.col("id") == role_id).agg(F.min("prompt")).scalar()


def build_prompts(
    requests: DataFrame,
    friends: DataFrame,
    accounts: DataFrame,
    roles: DataFrame,
    tasks: DataFrame,
    messages: DataFrame,
    as_of,
    variant: str = "reply",
    hours: int | None = None,
    system: DataFrame | None = None,
    with_history: bool = True,
    size: int | None = None,
) -> DataFrame:
    """Prompts of requests (`request_id, friend_id, text`), one row per turn.

    `reply` uses the contact's role, `copy_edit` and `summary` fixed ones. The
    turns are history, then system, then user; in a summary the history is part
    of the system text and looks back a fixed time. The look-back of the other
    variants is `hours`, or the configured one in `system`.

    The system text lists all active tasks of the contact, in one row. If a `size` is
    asked for and there are more tasks (or turns, in a summary), the system turn comes
    in several rows, in order of `piece`, whose contents joined make up its text.
    So does a user turn whose request has its text in several rows by `part`.
    """
    asked = _friend_requests(requests, friends, accounts)
    # A request whose role is not known gives no prompt.
    if variant in FIXED_ROLES:
        template = _role_prompt(roles, FIXED_ROLES[variant])
        asked = asked.withColumn("template", template).where(F.col("template").isNotNull())
    else:
        role_id = F.coalesce(F.nullif("role_id", F.lit(0)), F.lit(REPLY_ROLE))
        asked = asked.withColumn("role_id", role_id.cast(roles.schema["id"].dataType))
        asked = asked.join(_templates(roles), "role_id")
    filled = asked.select(
        "request_id",
        "friend_id",
        no_part().alias("piece"),
        fill_template(
            F.col("template"),
            {
                "friend_id": F.col("friend_id").cast("string"),
                "name": F.col("name"),
                "user_story": or_else(F.col("user_story"), F.lit(NO_STORY)),
                "current_time": spoken_now(as_of),
            },
        ).alias("prompt"),
    )
    # Only tasks of contacts asked for are shuffled and listed.
    people = broadcast_if_small(asked.select("friend_id").distinct())
    theirs = tasks.join(people, "friend_id", "left_semi")
    task_lists = active_task_json(theirs, size).select("friend_id", "part", "items")
    prompted = _insert_lists(filled, task_lists, "friend_id", "task_list")
    texts = requests.join(asked.select("request_id"), "request_id", "left_semi")
    piece = None
    if "part" in requests.columns:
        piece = F.when(F.col("part") > 0, F.array("part")).otherwise(no_part())
    user = _turns(texts, USER, F.lit("user"), F.col("text"), piece)
    summary = variant == "summary"
    if summary:
        history = _history_turns(asked, messages, as_of, SUMMARY_HOURS if hours is None else hours, None)
        lists = _history_json(history, size)
        prompted = _insert_lists(prompted, lists, "request_id", "chatHistory")
    system_turn = _turns(prompted, SYSTEM, F.lit("system"), F.col("prompt"), F.col("piece"))
    turns = system_turn.unionByName(user)
    if summary or not with_history:
        return turns
    history = _history_turns(asked, messages, as_of, hours, system)
    return _turns(history, HISTORY, F.col("role"), F.col("content")).unionByName(turns)


def adhoc_prompts(requests: DataFrame, roles: DataFrame) -> DataFrame:
    """Prompts of a role and a text alone (`request_id, role_id, text`): system, user (K3)."""
    asked = requests.where(~blank(F.col("text"))).join(_templates(roles), "role_id", "left")
    return _turns(asked, SYSTEM, F.lit("system"), F.col("template")).unionByName(
        _turns(asked, USER, F.lit("user"), F.col("text"))
    )


def owner_prompts(
    requests: DataFrame, accounts: DataFrame, roles: DataFrame, messages: DataFrame, as_of,
    hours: int = OWNER_HOURS,
) -> DataFrame:
    """Prompts of account owners (`request_id, account_id, text`), one row per turn (K4).

    All text messages of the account in the look-back, as raw user turns, then
    the owner role with the account's name, then the question.
    """
    owner = accounts.select(F.col("id").alias("account_id"), "wx_id").where(~blank(F.col("wx_id")))
    asked = requests.where(~blank(F.col("text"))).join(owner, "account_id")
    recent = messages.where(
        (F.col("msg_type") == TEXT_KIND) & (F.col("create_at") >= hours_before(as_of, hours))
    )
    parties = broadcast_if_small(asked.select("request_id", F.col("wx_id").alias("party")))
    mine = by_party(recent).join(parties, "party").withColumnRenamed("id", "message_id")
    history = _turns(mine, HISTORY, F.lit("user"), F.col("raw_data"))
    introduced = asked.withColumn("template", _role_prompt(roles, OWNER_ROLE))
    told = F.concat("template", F.lit(OWNER_ACCOUNT), F.col("wx_id"))
    return (
        history.unionByName(_turns(introduced, SYSTEM, F.lit("system"), told))
        .unionByName(_turns(asked, USER, F.lit("user"), F.col("text")))
    )


def burst_requests(bursts: DataFrame, friends: DataFrame) -> DataFrame:
    """Merged bursts as prompt requests of active AI contacts.

    Of several contacts of one name the lowest id counts. A very long burst
    keeps its parts: joined in order of `part` they are its text. The id of a burst without a
    time ends with its number instead.
    """
    began = F.col("burst_start").cast("string")
    if "burst_number" in bursts.columns:
        began = F.coalesce(began, F.concat(F.lit("n"), F.col("burst_number").cast("string")))
    members = friends.where((F.col("is_active") == 1) & (F.col("ai_active") == 1)).select(
        F.col("wxid").alias("from_user"), F.col("id").alias("friend_id")
    )
    members = members.groupBy("from_user").agg(F.min("friend_id").alias("friend_id"))
    later = F.col("part") > 0
    text = F.when(later, F.concat(F.lit("\n"), F.col("content"))).otherwise(F.col("content"))
    asked = bursts.where(later | ~blank(F.col("content")))
    return asked.join(members, "from_user").select(
        # A missing receiver keeps its place, so that ids of other bursts are not met.
        F.concat_ws(
            "/", "from_user", F.coalesce("to_user", F.lit("")), began
        ).alias("request_id"),
        "friend_id",
        "part",
        text.alias("text"),
    )


def packed_prompts(turns: DataFrame, size: int | None = None) -> DataFrame:
    """Prompts with their turns in one ordered array: `request_id, part, turns`.

    With `size`, a prompt of more turns comes in several rows by `part`. The turns
    are then looked at twice, for their number and for the arrays: prompts that take
    long to build should be written or persisted first.
    """
    levels = [F.col("section"), *time_levels("create_time", "message_id", size)]
    order = ["section", "create_time", "message_id", "piece"]
    packed = pack_ordered(
        turns, ["request_id"], order, F.struct("role", "content"), levels, size
    )
    return packed.withColumnRenamed("items", "turns")


def turns_text(turns: DataFrame) -> DataFrame:
    """Turns with `piece` as text, for output."""
    return turns.withColumn("piece", part_text(F.col("piece")))
