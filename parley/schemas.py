"""The ten tables: column types and column defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _struct(**columns: str) -> StructType:
    schema = StructType()
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return schema


# Column names, order and types of the stored tables.
SCHEMAS: dict[str, StructType] = {
    "admin": _struct(
        id="integer", username="string", password="string", password_salt="string",
        last_login_ip="string", last_login_time="integer", is_delete="integer", type="integer",
    ),
    "friends": _struct(
        id="integer", account_id="integer", avatar="string", nickname="string", wxid="string",
        creaate_time="timestamp_ntz", update_time="timestamp_ntz", prompt="string",
        start_time="timestamp_ntz", end_time="timestamp_ntz", my_remark="string", remark="string",
        signature="string", province="string", city="string", country="string",
        is_active="integer", ai_active="integer", user_story="string", role_id="integer",
        mark="string", ai_reply="integer",
    ),
    "friends_task": _struct(
        id="integer", friend_id="integer", task_name="string", cron_expression="string",
        execution_count="integer", start_date="string", end_date="string", is_active="integer",
        next_execution_time="timestamp_ntz", last_execution_time="timestamp_ntz",
        create_time="timestamp_ntz", update_time="timestamp_ntz", require_content="string",
        message_content="string", error_message="string", task_content="string",
        cron_text="string",
    ),
    "friends_task_record": _struct(
        id="integer", friend_id="integer", task_name="string", result="string",
        summarize="string", suggestion="string", date="string", create_at="timestamp_ntz",
        score="integer",
    ),
    "logs": _struct(
        id="integer", create_time="timestamp_ntz", text="string", reson="string", msg="string",
        reply="string",
    ),
    "messages": _struct(
        id="long", from_user="string", to_user="string", content="string", msg_id="string",
        status="string", create_at="timestamp_ntz", update_at="timestamp_ntz", is_ai="integer",
        type="integer", msg_type="integer", create_time="long", raw_data="string",
    ),
    "roles": _struct(
        id="integer", name="string", prompt="string", create_time="timestamp_ntz",
        update_time="timestamp_ntz", is_system="integer",
    ),
    "system": _struct(id="integer", key="string", value="string", desc="string"),
    "task_logs": _struct(
        id="integer", task_id="integer", task_name="string", status="string",
        create_at="timestamp_ntz",
    ),
    "accounts": _struct(
        id="integer", auth_key="string", wx_id="string", create_time="timestamp_ntz",
        update_time="timestamp_ntz", auth_key_remaining_time="string", avatar="string",
        nickname="string", friend_count="long", onlineTime="string", totalOnline="string",
        onlineDays="string", expiryTime="string", loginErrMsg="string", alias="string",
        ws_status="string",
    ),
}

# Column defaults of the stored tables.
DEFAULTS: dict[str, dict[str, object]] = {
    "admin": {
        "username": "", "password": "", "password_salt": "", "last_login_ip": "",
        "last_login_time": 0, "is_delete": 0, "type": 0,
    },
    "friends": {"is_active": 0, "ai_active": 0, "role_id": 1009, "ai_reply": 0},
    "friends_task": {"execution_count": 0, "is_active": 1},
    "messages": {"status": "queued", "is_ai": 0, "type": 0},
    "roles": {"is_system": 0},
    "accounts": {"ws_status": "0"},
}

# Lengths of the text columns that have a limit.
LENGTHS: dict[str, dict[str, int]] = {
    "admin": {
        "username": 25, "password": 255, "password_salt": 255, "last_login_ip": 60,
    },
    "friends": {
        "avatar": 255, "nickname": 255, "wxid": 255, "my_remark": 255, "remark": 255,
        "province": 255, "city": 255, "country": 255, "user_story": 255, "mark": 2000,
    },
    "friends_task": {
        "task_name": 255, "cron_expression": 100, "start_date": 255, "end_date": 255,
        "require_content": 255, "message_content": 255, "task_content": 255, "cron_text": 255,
    },
    "friends_task_record": {
        "task_name": 1000, "result": 1000, "summarize": 1000, "suggestion": 1000, "date": 255,
    },
    "messages": {"from_user": 255, "to_user": 255, "msg_id": 255, "status": 255},
    "roles": {"name": 255},
    "system": {"key": 255, "value": 255, "desc": 255},
    "task_logs": {"task_name": 1000, "status": 255},
    "accounts": {
        "auth_key": 255, "wx_id": 255, "auth_key_remaining_time": 255, "avatar": 255,
        "nickname": 255, "onlineTime": 255, "totalOnline": 255, "onlineDays": 255,
        "expiryTime": 255, "loginErrMsg": 255, "alias": 255, "ws_status": 255,
    },
}

# Columns filled with the time of the write when a row is added without them.
CREATED_AT: dict[str, tuple[str, ...]] = {
    "friends": ("creaate_time", "update_time"),
    "friends_task": ("create_time", "update_time"),
    "friends_task_record": ("create_at",),
    "logs": ("create_time",),
    "messages": ("create_at", "update_at"),
    "roles": ("create_time", "update_time"),
    "task_logs": ("create_at",),
    "accounts": ("create_time",),
}

# Two stored column names are misspelt; readers see the right spelling.
SPELLINGS = {"creaate_time": "create_time", "reson": "reasoning"}


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """Fill the column defaults of `table` where a value is missing."""
    fill = {
        name: F.coalesce(F.col(name), F.lit(value))
        for name, value in DEFAULTS.get(table, {}).items()
        if name in df.columns
    }
    return df.withColumns(fill) if fill else df


def conform(df: DataFrame, table: str, as_of=None) -> DataFrame:
    """Shape rows as stored in `table`: all columns, in order, with defaults.

    Columns the rows lack are null, or the default, or `as_of` for the columns
    that record when a row was added.
    """
    from parley.functions.clock import moment

    schema = SCHEMAS[table]
    shaped = df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
    if as_of is not None:
        stamp = {c: F.coalesce(F.col(c), moment(as_of)) for c in CREATED_AT.get(table, ())}
        shaped = shaped.withColumns(stamp) if stamp else shaped
    return with_defaults(shaped, table)


def corrected_names(df: DataFrame) -> DataFrame:
    """Expose misspelt stored columns under their right names (Q18)."""
    return df.withColumnsRenamed({k: v for k, v in SPELLINGS.items() if k in df.columns})
