"""Cron rows against a plain scan over every second or minute of some days."""

import random
from datetime import datetime, timedelta

import pytest

from parley.operators import calendar

SPANS = {"second": (0, 59), "minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 7)}


def numbers(text, low, high):
    found = set()
    for term in text.split(","):
        base, _, step = term.partition("/")
        if base in ("*", "?"):
            first, last = low, high
        elif "-" in base:
            first, last = map(int, base.split("-"))
        else:
            first = int(base)
            last = high if step else first
        found.update(range(first, last + 1, int(step or 1)))
    return found


def plan(cron):
    sets = [numbers(t, *span) for t, span in zip(cron.split(), SPANS.values())]
    sets[5] = {d % 7 for d in sets[5]}
    return sets


def fires_at(sets, t):
    seconds, minutes, hours, days, months, weekdays = sets
    if t.second not in seconds or t.minute not in minutes or t.hour not in hours or t.month not in months:
        return False
    on_day, on_weekday = t.day in days, t.isoweekday() % 7 in weekdays
    if len(days) == 31:
        return on_weekday
    if len(weekdays) == 7:
        return on_day
    return on_day or on_weekday


MINUTE_CRONS = [
    "0 0 20 * * 1-4", "0 0 10 * * 0,6", "0 32 0 * * *", "0 0 0/24 * * *", "0 30 9 ? * 1",
    "0 */15 8-9 1,15 * ?", "0 5/20 22-23 * 2,3 7", "0 59 23 31 * *", "0 0 0 29 2 *",
    "0 10-50/20 6,18 10-12 * 5-7", "0 0 12 1 * 3", "0 0 1 */10 * ?", "0 * 4 13 */3 ?", "  0 0\t8 * * *  ",
]


@pytest.fixture
def tasks(rows):
    def make(crons):
        return rows("id int, cron_expression string, is_active int", *[(i, c, 1 - i % 2) for i, c in enumerate(crons)])

    return make


def test_fires_equal_a_scan_of_minutes(tasks):
    start, end = datetime(2024, 2, 26, 7, 45), datetime(2024, 3, 17, 4, 30)
    got = calendar.cron_fires(tasks(MINUTE_CRONS), start, end).collect()
    want, t = [], start
    plans = [plan(c) for c in MINUTE_CRONS]
    while t < end:
        want += [(i, t) for i, p in enumerate(plans) if fires_at(p, t)]
        t += timedelta(minutes=1)
    assert sorted((r.id, r.fire_time) for r in got) == sorted(want)
    assert len({i for i, _ in want}) > 9


def test_fires_equal_a_scan_of_seconds(tasks):
    crons = ["*/7 59 23 * * *", "50 * 0 * * 1", "5-9,59 0,30 */12 * * ?", "* * 1 4 3 ?"]
    start, end = datetime(2024, 3, 3, 23, 58, 10), datetime(2024, 3, 4, 13, 0, 0)
    got = calendar.cron_fires(tasks(crons), start, end).collect()
    want, t = [], start
    plans = [plan(c) for c in crons]
    while t < end:
        want += [(i, t) for i, p in enumerate(plans) if fires_at(p, t)]
        t += timedelta(seconds=1)
    assert sorted((r.id, r.fire_time) for r in got) == sorted(want)


def random_field(rng, low, high):
    def term():
        a, b = sorted((rng.randint(low, high), rng.randint(low, high)))
        return rng.choice(["*", "?", f"{a}", f"{a}-{b}", f"{a}/{rng.randint(1, 9)}", f"*/{rng.randint(1, high)}",
                           f"{a}-{b}/{rng.randint(1, 5)}"])

    return ",".join(term() for _ in range(rng.choice([1, 1, 1, 2, 3])))


def test_random_crons_equal_a_scan(tasks):
    rng = random.Random(11)
    crons = ["0 " + " ".join(random_field(rng, *SPANS[f]) for f in list(SPANS)[1:]) for _ in range(120)]
    start, end = datetime(2024, 2, 28, 22, 0), datetime(2024, 3, 3, 2, 0)
    table = tasks(crons)
    got = sorted((r.id, r.fire_time) for r in calendar.cron_fires(table, start, end).collect())
    want, plans, t = [], [plan(c) for c in crons], start
    while t < end:
        want += [(i, t) for i, p in enumerate(plans) if fires_at(p, t)]
        t += timedelta(minutes=1)
    assert got == sorted(want) and len({i for i, _ in want}) > 40
    following = {r.id: r.next_fire for r in calendar.next_fire(table, start - timedelta(seconds=1), 5).collect()}
    firsts = {}
    for i, t in got:
        firsts.setdefault(i, t)
    assert all(following[i] == t for i, t in firsts.items())
    assert all(following[i] is None or following[i] >= end for i in set(following) - set(firsts))


@pytest.mark.parametrize(
    "now",
    ["2024-02-28 23:59:30", "2024-02-29 00:00:00", "2024-03-01 08:15:00", "2024-12-31 23:59:59", "2024-06-15 22:05:00.5"],
)
def test_next_fire_equals_a_scan(tasks, now):
    got = {r.id: r.next_fire for r in calendar.next_fire(tasks(MINUTE_CRONS), now, 60).collect()}
    moment = datetime.fromisoformat(now)
    first = moment.replace(second=0, microsecond=0)
    last_day = (moment + timedelta(days=60)).date()
    for i, cron in enumerate(MINUTE_CRONS):
        p, t = plan(cron), first
        while t <= moment or (not fires_at(p, t) and t.date() <= last_day):
            t += timedelta(minutes=1)
        assert got[i] == (t if t.date() <= last_day else None), cron


def test_next_fire_looks_at_seconds_and_beyond_a_month(tasks):
    crons = ["10,40 19 15 8 7 2", "0 0 0 29 2 ?", "30 30 12 * * *"]
    got = {r.id: r.next_fire for r in calendar.next_fire(tasks(crons), "2025-07-08 15:19:10", 1200).collect()}
    assert got == {
        0: datetime(2025, 7, 8, 15, 19, 40), 1: datetime(2028, 2, 29), 2: datetime(2025, 7, 9, 12, 30, 30),
    }


BAD = [
    "30 8 * * *", "", "0 60 * * * *", "60 0 0 * * *", "0 0 24 * * *", "0 0 0 0 * *", "0 0 0 32 * *",
    "0 0 0 * 13 *", "0 0 0 * 0 *", "0 0 0 * * 8", "0 0 0 * * a", "0 0 5-3 * * *", "0 0 */0 * * *",
    "0 0 1,,2 * * *", "0 0 -1 * * *", "0 0 1/ * * *", "0 0 99999999999 * * *", "0 0 * * * * *", None,
]


def test_validity(tasks):
    valid, rejected = calendar.validate_cron(tasks([*MINUTE_CRONS, *BAD]))
    assert sorted(r.id for r in valid.collect()) == list(range(len(MINUTE_CRONS)))
    assert rejected.count() == len(BAD)
    assert calendar.next_fire(tasks(BAD), "2024-01-01").where("next_fire IS NOT NULL").count() == 0
    assert calendar.cron_fires(tasks(BAD), "2024-01-01", "2024-01-02").count() == 0


WORDS = {
    "0 0 11 16 7 3": "7月16日周三 11:00执行",
    "50 19 15 8 7 2": "7月8日周二 15:19:50执行",
    "5 9 1 1,2 1-3 0,7": "1月到3月1、2日周日、周日 01:09:05执行",
    "0 0 8 * * *": "每天08:00执行",
    "00 5 8 * * ?": "每天08:05执行",
    "7 5 8 * * ?": "每天08:05:07执行",
    "0 0 20 * * 1-4": "每天20:00，每周周一到周四执行",
    "0 0 9,18 15 * 0": "每天9,18:00，每月15日且每周周日执行",
    "0 30 9 ? 6 ?": "每天09:30，每年6月执行",
    "0 30 9 1-5 6,12 1": "6月、12月1到5日周一 09:30执行",
    "0 30 9 1 * 9": "每天09:30，每月1日且每周9执行",
    "* * * * * *": "每分钟每小时执行",
    "0 * 8 * * *": "每分钟8点执行",
    "15 * */2 1 * 1,7": "15秒每分钟每2点1日、一、日周执行",
    "* 0-30 8,9 1-5 3/2 2-4": "0到30分8、9点1到5日、每2月、二到四周执行",
    "* 0 1-5/2 ? * ?": "0分1到5/2点?、?执行",
    "  0 0 8 * * *　": "每天08:00执行",
    "30 8 * * *": "无效的Cron表达式: 30 8 * * *",
    "": "无效的Cron表达式: ",
}


def test_words(tasks):
    got = calendar.describe_cron(tasks(list(WORDS))).collect()
    assert {r.cron_expression: r.cron_expression_chinese for r in got} == WORDS


def test_next_execution_is_cleared_for_inactive_tasks(rows):
    tasks = rows(
        "id int, cron_expression string, is_active int, next_execution_time timestamp_ntz",
        (1, "0 0 8 * * *", 1, None), (2, "0 0 8 * * *", 0, datetime(2024, 1, 1)),
    )
    got = {r.id: r.next_execution_time for r in calendar.set_next_execution(tasks, "2024-01-01 08:00:00").collect()}
    assert got == {1: datetime(2024, 1, 2, 8), 2: None}
