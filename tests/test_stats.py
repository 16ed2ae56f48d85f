from datetime import date, datetime

from pyspark.sql import functions as F

from parley.operators import stats

NOW = "2024-01-30 12:30:00"
MESSAGE = "create_at timestamp_ntz, is_ai int, type int, msg_type int"


def at(text):
    return datetime.fromisoformat(text)


def test_daily_messages_fill_days_and_leave_out_later_ones(rows):
    messages = rows(
        MESSAGE,
        (at("2024-01-30 00:00:00"), 1, 1, 1),
        (at("2024-01-30 23:59:59"), 0, 1, 1),
        (at("2024-01-11 00:00:00"), 1, 0, 1),
        (at("2024-01-10 23:59:59"), 1, 1, 1),
        (at("2024-01-31 00:00:00"), 1, 1, 1),
    )
    days = stats.daily_messages(messages, NOW).collect()
    assert [d.stat_date for d in days] == [date(2024, 1, 30 - n) for n in range(20)]
    assert (days[0].ai_msg_count, days[0].total_msg_count) == (1, 2)
    assert (days[19].ai_msg_count, days[19].total_msg_count) == (1, 0)
    assert sum(d.ai_msg_count for d in days) == 2


def test_hourly_messages_cut_off_is_not_aligned(rows):
    messages = rows(
        MESSAGE,
        (at("2024-01-29 12:29:59"), 0, 0, 1),
        (at("2024-01-29 12:30:00"), 0, 0, 1),
        (at("2024-01-30 11:59:59"), 1, 0, 1),
        (at("2024-01-30 12:00:00"), 1, 0, 1),
    )
    hours = stats.hourly_messages(messages, NOW).collect()
    assert len(hours) == 24
    assert (hours[0].label, hours[0].message_count) == ("01-29 12:00", 1)
    assert (hours[-1].label, hours[-1].message_count, hours[-1].ai_count) == ("01-30 11:00", 1, 1)


def test_summary_without_messages_has_ratio_zero(rows, spark):
    hours = stats.hourly_messages(spark.createDataFrame([], MESSAGE), NOW)
    total = stats.message_summary(hours).first()
    assert (total.total_messages, total.ai_messages, total.ai_message_ratio) == (0, 0, 0.0)


def test_hourly_tasks_include_the_current_hour(rows):
    tasks = rows(
        "create_time timestamp_ntz, last_execution_time timestamp_ntz, execution_count int",
        (at("2024-01-30 12:10:00"), at("2024-01-30 09:30:00"), 3),
        (at("2024-01-30 09:29:59"), at("2024-01-30 12:59:00"), 4),
        (None, None, None),
    )
    got = [(r.label, r.created, r.executions) for r in stats.hourly_tasks(tasks, NOW).collect()]
    assert got == [("09:00", 0, 3), ("10:00", 0, 0), ("11:00", 0, 0), ("12:00", 1, 4)]


def test_kinds_and_states_with_nulls(rows):
    messages = rows(MESSAGE, *[(at(NOW), 0, 0, k) for k in (1, 3, 34, 49, None, 1)])
    labels = stats.with_labels(stats.message_kind_distribution(messages, NOW), "kind", stats.KIND_LABELS)
    assert {r.kind: r.label for r in labels.collect()}["voice"] == "语音"
    kinds = {r.kind: r.message_count for r in stats.message_kind_distribution(messages, NOW).collect()}
    assert kinds == {"text": 2, "image": 1, "voice": 1, "other": 2}
    tasks = rows(
        "is_active int, last_execution_time timestamp_ntz, execution_count int",
        (1, at(NOW), 0), (1, None, 5), (0, None, 5), (0, at(NOW), 0), (None, at(NOW), 5), (0, None, None),
    )
    states = {r.task_status: r.task_count for r in stats.task_status_distribution(tasks).collect()}
    assert states == {"running": 1, "pending": 1, "finished": 1, "inactive": 3}


def test_volume_drops_messages_without_both_parties(rows):
    messages = rows(
        "from_user string, to_user string, create_at timestamp_ntz",
        ("b", "a", at("2024-01-02 00:00:00")),
        ("a", "b", at("2024-01-01 00:00:00")),
        (None, "b", at("2024-01-01 00:00:00")),
        ("a", None, at("2024-01-01 00:00:00")),
    )
    (row,) = stats.conversation_volume(messages).collect()
    assert (row.party_low, row.party_high, row.message_count) == ("a", "b", 2)
    assert (row.first_at, row.last_at) == (at("2024-01-01"), at("2024-01-02"))


def test_online_counts_set_values_only(rows):
    one = rows("id int", (1,), (2,))
    accounts = rows("onlineTime string", ("x",), (None,))
    messages = rows(MESSAGE, (at(NOW), 0, 1, 1), (at(NOW), 0, 0, 1), (at(NOW), 0, None, 1))
    row = stats.overview_counts(one, accounts, messages).first()
    assert row.asDict() == {"friends": 2, "online": 1, "messages_all": 3, "messages_sent": 1}


def test_daily_sums_equal_the_filtered_count(spark):
    from parley.sources.standins import Standins
    from tests.conftest import SF_DIR

    messages = Standins(spark, SF_DIR).messages()
    total = stats.daily_messages(messages, NOW).agg(F.sum("total_msg_count")).first()[0]
    assert total == messages.where("type = 1 AND create_at >= '2024-01-11'").count()
