"""Frames and documents in JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.clock import epoch_seconds
from parley.functions.replies import strict_json

# Shapes of the documents.
# Scalars are read as text, so that a number sent as text, or an odd field, spoils no frame.
FRAME_SCHEMA = (
    "msg_id string, from_user_name struct<str: string>, to_user_name struct<str: string>, "
    "msg_type string, content struct<str: string>, create_time string, push_content string, "
    "new_msg_id string"
)
CONTACTS_SCHEMA = (
    "Code string, Data struct<count: long, IsInitFinished: boolean, friendList: array<struct<"
    "userName: struct<str: string>, nickName: struct<str: string>, remark: struct<str: string>, "
    "smallHeadImgUrl: string, signature: string, province: string, city: string, "
    "country: string>>>"
)
PROFILE_SCHEMA = (
    "Code string, Data struct<userInfo: struct<userName: struct<str: string>, "
    "nickName: struct<str: string>, alias: string>, userInfoExt: struct<smallHeadImgUrl: string>>"
)
LOGIN_SCHEMA = (
    "Code string, Data struct<wxid: string, nick_name: string, head_img_url: string, "
    "effective_time: string, state: int>"
)
STATUS_SCHEMA = (
    "Code string, Data struct<onlineTime: string, expiryTime: string, loginErrMsg: string, "
    "onlineDays: string, loginTime: string, totalOnline: string>"
)
# Fixed value: the code of a successful answer.
OK_CODE = "200"

RAW_SCHEMA = "value string, auth_key string, arrival long"


def _whole(text: Column) -> Column:
    """A whole number in text; fractions are cut."""
    return F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"))


def parse_frames(raw: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Frames of JSON text in `value`: the good ones flattened, and the bad ones (S3).

    A frame is good if it is one JSON object; fields that are not of their kind are null. Spark's
    reader takes some text that is not JSON, such as text after the closing brace; `strict`
    refuses that too. Other columns of `raw` are kept. `raw_data` is the text as it came.
    """
    carried = [c for c in raw.columns if c != "value"]
    schema = FRAME_SCHEMA + ", _corrupt string"
    options = {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}
    read = raw.withColumn("_frame", F.from_json("value", schema, options))
    whole = F.startswith(F.ltrim("value", F.lit(" \t\r\n")), F.lit("{"))
    fine = whole & (strict_json(F.col("value")) if strict else F.col("_frame._corrupt").isNull())
    read = read.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    frame = F.col("_frame")
    good = read.where("_fine").select(
        *carried,
        frame["msg_id"].alias("msg_id"),
        frame["from_user_name"]["str"].alias("from_user"),
        frame["to_user_name"]["str"].alias("to_user"),
        _whole(frame["msg_type"]).try_cast("int").alias("msg_type"),
        frame["content"]["str"].alias("content"),
        epoch_seconds(_whole(frame["create_time"])).alias("create_time"),
        frame["push_content"].alias("push_content"),
        _whole(frame["new_msg_id"]).alias("new_msg_id"),
        F.col("value").alias("raw_data"),
    )
    bad = read.where(~F.col("_fine")).select(*carried, "value")
    return good, bad


def read_frames_stream(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """An unbounded source of frames: JSON lines of `value, auth_key, arrival`."""
    reader = spark.readStream.schema(RAW_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def contacts_from_snapshot(documents: DataFrame, accounts: DataFrame) -> DataFrame:
    """Contacts of the snapshot documents (`auth_key, value`), one row each.

    Only successful documents of known accounts give rows. `position` is the
    place in the document's list.
    """
    read = documents.select("auth_key", F.from_json("value", CONTACTS_SCHEMA).alias("_doc"))
    owner = accounts.groupBy("auth_key").agg(F.min("id").alias("account_id"))
    item = F.col("_item")
    return (
        read.where(F.col("_doc.Code") == OK_CODE)
        .join(owner, "auth_key")
        .select("account_id", F.posexplode("_doc.Data.friendList").alias("position", "_item"))
        .select(
            "account_id",
            "position",
            _text(item["userName"]["str"]).alias("wxid"),
            _text(item["nickName"]["str"]).alias("nickname"),
            _text(item["smallHeadImgUrl"]).alias("avatar"),
            _text(item["remark"]["str"]).alias("remark"),
            _text(item["signature"]).alias("signature"),
            _text(item["province"]).alias("province"),
            _text(item["city"]).alias("city"),
            _text(item["country"]).alias("country"),
        )
    )


def snapshot_counts(documents: DataFrame) -> DataFrame:
    """The contact count each successful snapshot states: `auth_key, friend_count` (M3)."""
    read = documents.select("auth_key", F.from_json("value", CONTACTS_SCHEMA).alias("_doc"))
    return read.where(F.col("_doc.Code") == OK_CODE).select(
        "auth_key", F.col("_doc.Data.count").alias("friend_count")
    )


def account_patch_from_profile(documents: DataFrame) -> DataFrame:
    """Account patches of successful profile documents, by `auth_key`."""
    read = documents.select("auth_key", F.from_json("value", PROFILE_SCHEMA).alias("_doc"))
    data = F.col("_doc.Data")
    return read.where(F.col("_doc.Code") == OK_CODE).select(
        "auth_key",
        data["userInfo"]["userName"]["str"].alias("wx_id"),
        data["userInfo"]["nickName"]["str"].alias("nickname"),
        data["userInfoExt"]["smallHeadImgUrl"].alias("avatar"),
        data["userInfo"]["alias"].alias("alias"),
    )


def account_patch_from_login(documents: DataFrame) -> DataFrame:
    """Account rows of successful login documents, by `wx_id`, for `upsert_accounts`."""
    kept = [c for c in documents.columns if c != "value"]
    read = documents.select(*kept, F.from_json("value", LOGIN_SCHEMA).alias("_doc"))
    data = F.col("_doc.Data")
    return read.where(F.col("_doc.Code") == OK_CODE).select(
        *kept,
        data["wxid"].alias("wx_id"),
        data["nick_name"].alias("nickname"),
        data["head_img_url"].alias("avatar"),
        data["effective_time"].alias("auth_key_remaining_time"),
    )


def account_patch_from_status(documents: DataFrame) -> DataFrame:
    """Online columns of status documents by `auth_key`; all null if not successful."""
    read = documents.select("auth_key", F.from_json("value", STATUS_SCHEMA).alias("_doc"))
    ok = F.coalesce(F.col("_doc.Code") == OK_CODE, F.lit(False))
    columns = ("onlineTime", "expiryTime", "loginErrMsg", "onlineDays", "totalOnline")
    return read.select(
        "auth_key", *[F.when(ok, F.col(f"_doc.Data.{c}")).alias(c) for c in columns]
    )
