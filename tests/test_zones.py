"""Named zones against Python's own zone rules."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from parley.functions.clock import instant_of, local_time
from parley.operators import calendar, listings

ZONES = ["America/Havana", "Europe/Berlin", "Australia/Lord_Howe", "Asia/Shanghai", "UTC"]
CHANGES = [datetime(2024, 3, 9), datetime(2024, 3, 30), datetime(2024, 4, 6), datetime(2024, 10, 5),
           datetime(2024, 10, 26), datetime(2024, 11, 2)]


@pytest.mark.parametrize("zone", ZONES)
def test_instants_equal_the_rules_of_the_zone(rows, zone):
    times = [start + timedelta(minutes=15 * i, seconds=7) for start in CHANGES for i in range(4 * 60)]
    table = rows("t timestamp_ntz, zone string", *[(t, zone) for t in times], (None, zone), (times[0], None))
    got = table.select("t", instant_of(F.col("t"), F.col("zone")).alias("s"), "zone").collect()
    for r in got:
        if r.t is None or r.zone is None:
            assert r.s is None
            continue
        instant = r.t.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc)
        exists = instant.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == r.t
        assert r.s == (int(instant.timestamp()) if exists else None), r


@pytest.mark.parametrize("zone", ZONES)
def test_local_times_equal_the_rules_of_the_zone(rows, zone):
    first = [int(c.replace(tzinfo=timezone.utc).timestamp()) for c in CHANGES]
    seconds = [s + 900 * i for s in first for i in range(240)] + [0, -1]
    got = rows("s long", *[(s,) for s in seconds]).select("s", local_time(F.col("s"), zone).alias("t")).collect()
    for r in got:
        there = datetime.fromtimestamp(0, ZoneInfo("UTC")) + timedelta(seconds=r.s)
        assert r.t == there.astimezone(ZoneInfo(zone)).replace(tzinfo=None)


def test_fires_in_the_hour_left_out_and_in_the_one_shown_twice(rows):
    tasks = rows("id long, cron_expression string", (1, "0 30 0 * * *"), (2, "0 0 12 * * *"), (3, "bad"))
    spring = calendar.zoned_fires(tasks, "2024-03-09", "2024-03-12", "America/Havana").collect()
    assert sorted((r.id, r.fire_time.day) for r in spring) == [(1, 9), (1, 11), (2, 9), (2, 10), (2, 11)]
    autumn = calendar.zoned_fires(tasks, "2024-11-02", "2024-11-05", "America/Havana").where("id = 1")
    epochs = sorted(r.fire_epoch for r in autumn.collect())
    assert [b - a for a, b in zip(epochs, epochs[1:])] == [86400, 90000]


def test_logins_by_the_clocks_of_a_zone(rows):
    summer = int(datetime(1987, 7, 1, tzinfo=timezone.utc).timestamp())
    admins = rows("id long, is_delete int, last_login_time long, password string",
                  (1, 0, summer, "p"), (2, 0, 0, "p"))
    fixed = {r.id: r.last_login_time for r in listings.admin_listing(admins).collect()}
    named = {r.id: r.last_login_time for r in listings.admin_listing(admins, zone="Asia/Shanghai").collect()}
    assert fixed[1] == "1987-07-01 08:00:00" and named[1] == "1987-07-01 09:00:00" and fixed[2] == named[2]
