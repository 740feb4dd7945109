import datetime
import random
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from recordmill.operators import timing


def test_slots_equal_minute_by_minute(spark):
    """Schedules of several zones, on a day on which clocks change, against a look at every minute; unknown zones and missing values too."""
    draw, now, rows = random.Random(3), datetime.datetime(2024, 3, 31, 2, 40, tzinfo=datetime.UTC), []
    names = {"CET": "Europe/Warsaw", "IST (India)": "Asia/Kolkata", "America/New_York": "America/New_York", "Mars/Base": "UTC", None: "UTC"}
    for i in range(600):
        kind = draw.choice(["hourly", "daily", "weekdays", "weekly", "never", None])
        rows.append((i, kind, draw.choice([None, *range(9)]), draw.choice([None, 0, 5, 30, 59]), draw.choice([*timing.DAYS, None]), draw.choice(list(names))))
    expected = {}
    for i, kind, hour, minute, day, zone in rows:
        for back in range(241):
            at = now - datetime.timedelta(minutes=back)
            local = at.astimezone(ZoneInfo(names[zone]))
            known = {"daily": True, "weekdays": local.isoweekday() <= 5, "weekly": timing.DAYS[local.isoweekday() % 7] == day}.get(kind, False)
            if local.minute == minute and (kind == "hourly" or (local.hour == hour and known)):
                expected[i] = (local.strftime("%Y-%m-%dT%H:%M"), at.replace(tzinfo=None), back)
                break
    schedules = spark.createDataFrame(rows, "id int, kind string, hour int, minute int, day string, zone string")
    found = timing.due_slots(schedules, F.expr("timestamp'2024-03-31 02:40:30'"))
    got = {r["id"]: (r["slot"], r["due_at"], r["minutes_late"]) for r in found.collect()}
    assert {i: (got.get(i), expected.get(i)) for i in {*got, *expected} if got.get(i) != expected.get(i)} == {} and len(expected) > 30


def test_no_minutes_are_judged_in_the_rows(spark):
    """The minutes of the window are unfolded for zones only: nothing is filtered in the schedules' rows."""
    schedules = spark.range(10).selectExpr("id", "'daily' kind", "1 hour", "2 minute", "'Monday' day", "'CET' zone")
    plan = timing.due_slots(schedules, F.expr("timestamp'2024-03-31 02:40:30'"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Generate explode" in plan
