"""The tables of the data model, derived by Spark from the generic test tables.

Every column is computed from the row it belongs to, so a table grows with the
data it stands on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.clock import epoch_of

ACCOUNTS = 25

# Ten cron samples; the sixth has too few fields.
CRONS = (
    "0 0 20 * * 1-4",
    "0 0 10 * * 0,6",
    "50 19 15 8 7 2",
    "0 32 0 * * *",
    "0 0 0/24 * * *",
    "30 8 * * *",
    "0 30 9 ? * 1",
    "0 */15 8-9 1,15 * ?",
    "* 0 6 1 3 ?",
    "0 * 3 ? 3 5,6",
)
KINDS = {"view": 1, "click": 1, "signup": 3, "purchase": 34, "error": 49}
STATES = {
    "view": "OPEN", "click": "CONNECTING", "signup": "CLOSING", "purchase": "CLOSED",
    "error": "ERROR",
}
CONFIG_KEYS = ("hisMsgDay", "to_noti_wxid", "from_noti_key", "aiHost", "aiChatModel")
TEMPLATE = (
    " for {{name}} ({{friend_id}}): {{user_story}}. Now {{current_time}}. "
    "Tasks {{task_list}}. Said {{chatHistory}}."
)


def pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def every(column: str, n: int) -> Column:
    return F.col(column) % n == 0


def by_type(values: dict) -> Column:
    mapped = F.lit(None)
    for name, value in values.items():
        mapped = F.when(F.col("event_type") == name, F.lit(value)).otherwise(mapped)
    return mapped


def prefixed(prefix: str, column: Column) -> Column:
    return F.concat(F.lit(prefix), column.cast("string"))


class Standins:
    """Stand-in tables over one folder of test data."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def messages(self, both_ways: bool = True) -> DataFrame:
        """Messages of contacts to accounts; with `both_ways`, every third goes back."""
        person = prefixed("u", F.col("user_id"))
        account = prefixed("a", F.col("user_id") % ACCOUNTS)
        back = every("event_id", 3) if both_ways else F.lit(False)
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.when(back, account).otherwise(person).alias("from_user"),
            F.when(back, person).otherwise(account).alias("to_user"),
            F.col("props").alias("content"),
            F.col("event_id").cast("string").alias("msg_id"),
            F.lit("queued").alias("status"),
            F.col("ts").alias("create_at"),
            F.col("ts").alias("update_at"),
            flag(every("event_id", 5)).alias("is_ai"),
            flag(every("event_id", 3)).alias("type"),
            by_type(KINDS).alias("msg_type"),
            epoch_of(F.col("ts")).alias("create_time"),
            F.col("props").alias("raw_data"),
            prefixed("k", F.col("user_id") % ACCOUNTS).alias("auth_key"),
        )

    def odd_messages(self) -> DataFrame:
        """Received messages; every 23rd has no time, every 29th no `msg_id`."""
        return self.messages(both_ways=False).withColumns(
            {
                "create_time": F.when(~every("id", 23), F.col("create_time")),
                "msg_id": F.when(~every("id", 29), F.col("msg_id")),
            }
        )

    def friends(self, own_account: bool = False) -> DataFrame:
        """Contacts; with `own_account`, under the account their messages go to."""
        key = F.col("c_custkey")
        start = F.lit("2024-01-30").cast("timestamp_ntz")
        account = (key % ACCOUNTS).cast("int") if own_account else F.col("c_nationkey")
        return self.raw("customer").select(
            key.alias("id"),
            account.alias("account_id"),
            prefixed("av", key).alias("avatar"),
            F.col("c_name").alias("nickname"),
            prefixed("u", key).alias("wxid"),
            start.alias("update_time"),
            (start + F.make_dt_interval(hours=(key % 97 - 48).cast("int"))).alias("end_time"),
            F.when(every("c_custkey", 5), "").otherwise(F.col("c_name")).alias("my_remark"),
            F.when(every("c_custkey", 4), "").otherwise(F.col("c_mktsegment")).alias("remark"),
            flag(F.col("c_acctbal") > 0).alias("is_active"),
            (key % 2).cast("int").alias("ai_active"),
            F.when(every("c_custkey", 3), "").otherwise(F.col("c_mktsegment")).alias("user_story"),
            F.when(~every("c_custkey", 7), (key % 3 * 5 + 999).cast("int")).alias("role_id"),
            flag(every("c_custkey", 3)).alias("ai_reply"),
        )

    def accounts(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.raw("nation").select(
            key.alias("id"),
            prefixed("k", key).alias("auth_key"),
            prefixed("a", key).alias("wx_id"),
            F.col("n_name").alias("nickname"),
            prefixed("av", key).alias("avatar"),
            F.when(F.col("n_regionkey") != 0, F.col("n_name")).alias("onlineTime"),
            F.col("n_name").alias("totalOnline"),
            F.col("n_name").alias("onlineDays"),
            F.col("n_name").alias("expiryTime"),
            F.col("n_name").alias("loginErrMsg"),
            F.lit(None).cast("string").alias("alias"),
            F.lit(None).cast("string").alias("auth_key_remaining_time"),
            (key % 5).cast("string").alias("ws_status"),
        )

    def tasks(self) -> DataFrame:
        key, date = F.col("o_orderkey"), F.col("o_orderdate")
        day = F.expr("INTERVAL '1' DAY")
        end = date + F.make_dt_interval(days=(key % 60).cast("int"))
        return self.raw("orders").select(
            key.alias("id"),
            F.col("o_custkey").alias("friend_id"),
            F.col("o_orderpriority").alias("task_name"),
            pick(CRONS, key % len(CRONS)).alias("cron_expression"),
            (key % 7).cast("int").alias("execution_count"),
            F.date_format(date, "yyyy-MM-dd").alias("start_date"),
            F.when(every("o_orderkey", 5), "")
            .when(every("o_orderkey", 2), F.date_format(end, "yyyy-MM-dd"))
            .otherwise(F.date_format(end, "yyyy-MM-dd HH:mm:ss"))
            .alias("end_date"),
            flag(F.col("o_orderstatus") != "F").alias("is_active"),
            F.when(F.col("o_orderstatus") != "P", date + day).alias("last_execution_time"),
            date.alias("create_time"),
            date.alias("update_time"),
            F.lit(None).cast("string").alias("error_message"),
            F.lit(None).cast("timestamp_ntz").alias("next_execution_time"),
        )

    def tasks_hourly(self) -> DataFrame:
        """Tasks with times within the day."""
        key = F.col("event_id")
        return self.raw("events").select(
            key.alias("id"),
            F.col("ts").alias("create_time"),
            (F.col("ts") + F.make_dt_interval(hours=(key % 3).cast("int"))).alias(
                "last_execution_time"
            ),
            (key % 7).cast("int").alias("execution_count"),
        )

    def logs(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("doc_id").alias("id"),
            "text",
            F.col("lang").alias("reson"),
            F.col("source").alias("msg"),
            F.col("text").alias("reply"),
        )

    def roles(self) -> DataFrame:
        return self.raw("part").select(
            (F.col("p_partkey") + 990).cast("int").alias("id"),
            F.col("p_name").alias("name"),
            F.concat("p_name", F.lit(TEMPLATE)).alias("prompt"),
            flag(F.col("p_size") % 5 == 0).alias("is_system"),
        )

    def system(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            key.alias("id"),
            pick(CONFIG_KEYS, key % len(CONFIG_KEYS)).alias("key"),
            (key + 480).cast("string").alias("value"),
        )

    def admins(self) -> DataFrame:
        key = F.col("s_suppkey")
        named = F.when(key % 10 == 1, key - 1).otherwise(key)
        return self.raw("supplier").select(
            key.alias("id"),
            prefixed("admin", named).alias("username"),
            prefixed("secret", key).alias("password"),
            F.lit("salt").alias("password_salt"),
            F.when(every("s_suppkey", 3), 0).otherwise(key * 3600 + 1_700_000_000).alias(
                "last_login_time"
            ),
            flag(every("s_suppkey", 11)).alias("is_delete"),
        )

    def state_events(self) -> DataFrame:
        return self.raw("events").select(
            "event_id",
            prefixed("a", F.col("user_id") % ACCOUNTS).alias("url"),
            by_type(STATES).alias("state"),
            F.col("ts").alias("timestamp"),
        )

    def frames(self, odd: bool = False) -> DataFrame:
        """Frames as JSON text; every tenth is cut off, every eleventh has text behind it. With
        `odd`, every 29th has no `msg_id`."""
        named_by = F.when(~every("id", 29), F.col("id")) if odd else F.col("id")
        m = self.messages(both_ways=False)
        named = F.when(F.col("id") % 13 != 0, F.struct(F.col("from_user").alias("str")))
        frame = F.struct(
            named_by.alias("msg_id"),
            named.alias("from_user_name"),
            F.struct(F.col("to_user").alias("str")).alias("to_user_name"),
            F.when(F.col("id") % 17 == 0, 51).otherwise(F.col("msg_type")).alias("msg_type"),
            F.struct(F.when(F.col("id") % 19 != 0, F.col("content")).alias("str")).alias("content"),
            F.when(F.col("id") % 2 == 0, F.col("create_time"))
            .otherwise(F.col("create_time") * 1000)
            .alias("create_time"),
        )
        text = F.to_json(frame)
        value = (
            F.when(F.col("id") % 10 == 0, F.expr("left(_text, length(_text) - 3)"))
            .when(F.col("id") % 11 == 0, F.concat("_text", F.lit(" xx")))
            .otherwise(F.col("_text"))
        )
        return m.withColumn("_text", text).select(
            value.alias("value"), "auth_key", F.col("id").alias("arrival")
        )

    def stream_frames(self) -> DataFrame:
        """Frames as JSON text, all well formed."""
        frame = F.struct(
            F.col("id").alias("msg_id"),
            F.struct(F.col("from_user").alias("str")).alias("from_user_name"),
            F.struct(F.col("to_user").alias("str")).alias("to_user_name"),
            "msg_type",
            F.struct(F.col("content").alias("str")).alias("content"),
            "create_time",
        )
        return self.messages(both_ways=False).select(
            F.to_json(frame).alias("value"), "auth_key", F.col("id").alias("arrival")
        )

    def replies(self) -> DataFrame:
        """Model replies built from events, damaged in nine ways by `event_id`."""
        key = F.col("event_id")
        k = F.get_json_object("props", "$.k")
        target = F.when(key % 4 == 0, F.lit(-1)).otherwise(key % 3000).cast("string")
        operate = pick(("add", "update", "delete", "keep"), key % 4)
        person = F.col("user_id").cast("string")
        base = F.concat(
            F.lit('{"continue":false,"message":["m'), k, F.lit('","",null,"n'),
            key.cast("string"), F.lit('"],"cron":[{"id":'), target, F.lit(',"operate":"'),
            operate, F.lit('","should_update":true,"friend_id":'), person,
            F.lit(',"task_name":"t'), k,
            F.lit('","cron_expression":"0 0 8 ? * *"}],"summarize":[{"friend_id":'), person,
            F.lit(',"task_name":"t'), k,
            F.lit('","result":"ok","summarize":"s","suggestion":null,"date":"2024-01-30","score":'),
            k, F.lit("}]}"),
        )
        body = F.col("base")
        damage = key % 9
        damaged = (
            F.when(damage == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(damage == 2, F.replace(body, F.lit("}]}"), F.lit("},]}")))
            .when(damage == 3, F.replace(body, F.lit('"continue"'), F.lit("“continue”")))
            .when(damage == 4, F.replace(body, F.lit('"message":'), F.lit('"message"::')))
            .when(damage == 5, F.expr("left(base, length(base) - 1)"))
            .when(damage == 6, F.expr("substring(base, 2)"))
            .when(damage == 7, F.concat(body, F.lit(" xx")))
            .when(damage == 8, F.replace(body, F.lit('"'), F.lit("'")))
            .otherwise(F.concat(F.lit("  \n"), body, F.lit(" ")))
        )
        return (
            self.raw("events")
            .withColumn("base", base)
            .select(key.alias("reply_id"), F.col("user_id").alias("friend_id"), damaged.alias("text"))
        )
