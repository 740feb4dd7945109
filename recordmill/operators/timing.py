"""Schedules and progress: due slots with catch-up, zones, weighted completion, remaining time, stalls."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
TERMINAL = ("completed", "failed", "cancelled", "interrupted")


# Short names of zones.
ZONES = {
    "UTC": "UTC", "CET": "Europe/Warsaw", "CEST": "Europe/Warsaw", "EET": "Europe/Helsinki", "ET": "America/New_York", "CT": "America/Chicago",
    "MT": "America/Denver", "PT": "America/Los_Angeles", "GMT": "Europe/London", "BST": "Europe/London", "IST": "Asia/Kolkata", "JST": "Asia/Tokyo",
    "SGT": "Asia/Singapore", "AEST": "Australia/Sydney", "SAST": "Africa/Johannesburg",
}


def zone(label: Column, aliases: dict[str, str] | None = None) -> Column:
    """A zone's name without the `` (label)`` behind it; names with a slash pass, aliases are looked up in any case, the rest is UTC."""
    bare = F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s*\(.*\)\s*$", ""))
    known = F.create_map(*[F.lit(x) for pair in (ZONES | (aliases or {})).items() for x in pair])
    return F.when(bare.contains("/"), bare).otherwise(F.coalesce(F.element_at(known, F.upper(bare)), F.lit("UTC")))


@lru_cache(1)
def _zones() -> tuple[str, ...]:
    """The zones that this Spark knows; some six hundred."""
    jvm = SparkSession.active()._jvm
    return tuple(sorted(jvm.java.time.ZoneId.getAvailableZoneIds().toArray()))


def usable(name: Column) -> Column:
    """The zone, or UTC where there is none of that name."""
    return F.when(name.isin(*_zones()), name).otherwise("UTC")


def local_time(utc: Column, name: Column) -> Column:
    """The wall clock of a zone at a moment; UTC's in an unknown zone."""
    return F.from_utc_timestamp(utc, usable(name))


def local_to_utc(local: Column, name: Column) -> Column:
    """The moment at which a zone's wall clock shows ``local``, by the zone's offset when UTC's clock shows it."""
    offset = F.unix_timestamp(local_time(local, name)) - F.unix_timestamp(local)
    return F.timestamp_seconds(F.unix_timestamp(local) - offset)


def utc_schedule(schedules: DataFrame, now: Column) -> DataFrame:
    """``schedules`` (kind, hour, minute, day, zone and more) with zone normalised, and utc_hour (null if hourly), utc_minute, utc_day.

    The day that is converted is today in the zone, the next named day of a weekly schedule, or Monday for weekdays on a
    weekend.
    """
    tz = zone(F.col("zone"))
    today = F.date_trunc("day", local_time(now, tz))
    dow = F.dayofweek(today) - 1
    wanted = F.array_position(F.array(*map(F.lit, DAYS)), F.col("day")).cast("int") - 1
    ahead = F.when((F.col("kind") == "weekly") & (wanted >= 0), F.pmod(wanted - dow, F.lit(7))).when((F.col("kind") == "weekdays") & ~dow.between(1, 5), F.pmod(F.lit(1) - dow, F.lit(7))).otherwise(0)
    clock = F.coalesce(F.col("hour"), F.lit(0)) * 3600 + F.coalesce(F.col("minute"), F.lit(0)) * 60
    local = F.timestamp_seconds(F.unix_timestamp(today) + F.coalesce(ahead, F.lit(0)) * 86400 + clock)
    at = local_to_utc(local, tz)
    hour = F.when(F.col("kind") != "hourly", F.hour(at))
    day = F.element_at(F.array(*map(F.lit, DAYS)), F.dayofweek(at))
    kept = [F.col(c) for c in schedules.columns if c != "zone"]
    return schedules.select(*kept, tz.alias("zone"), hour.alias("utc_hour"), F.minute(at).alias("utc_minute"), day.alias("utc_day"))


def fill_utc(schedules: DataFrame, now: Column) -> DataFrame:
    """``schedules`` with missing utc_hour, utc_minute and utc_day filled in; stored values stay. This is also the backfill of old tables."""
    stored = [F.col(c).alias(f"__{c}") for c in ("utc_hour", "utc_minute", "utc_day")]
    made = utc_schedule(schedules.select(*[c for c in schedules.columns if not c.startswith("utc_")], *stored), now)
    return made.select(*[F.coalesce(f"__{c}", c).alias(c) if c.startswith("utc_") else F.col(c) for c in schedules.columns])


def schedule_label() -> Column:
    """Text of a schedule (kind, utc_hour, utc_minute, utc_day); null where it isn't known."""
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    clock = F.concat(two("utc_hour"), F.lit(":"), two("utc_minute"), F.lit(" UTC"))
    day = F.nullif(F.col("utc_day"), F.lit(""))
    return F.when(F.col("kind") == "hourly", F.concat(F.lit("hourly at minute "), two("utc_minute"), F.lit(" UTC"))).otherwise(F.coalesce(F.concat(clock, F.lit(" ("), day, F.lit(")")), clock))


def schedules_of(schedules: DataFrame, capacities: DataFrame) -> DataFrame:
    """Schedules (capacity_name) with the id of the capacity of that name in any case."""
    return schedules.join(capacities.select(F.col("id").alias("capacity_id"), F.lower("name").alias("__name")), F.lower("capacity_name") == F.col("__name")).drop("__name")


def history(executions: DataFrame, name: str, now: Column, days: int = 30, most: int = 50) -> DataFrame:
    """The newest executions of a capacity in the last ``days`` days."""
    since = F.timestamp_seconds(F.unix_timestamp(now) - days * 86400)
    return executions.where((F.col("name") == name) & (F.col("executed_at") >= since)).orderBy(F.desc("executed_at"), "id").limit(most)


def last_executions(executions: DataFrame) -> DataFrame:
    """(id, succeeded_at, skipped_at) of each schedule."""
    return executions.groupBy("id").agg(*[F.max(F.when(F.col("status") == s, F.col("executed_at"))).alias(n) for s, n in (("success", "succeeded_at"), ("skipped", "skipped_at"))])


def due_clock(zones: DataFrame, now: Column, window: int) -> DataFrame:
    """(zone, kind, minute, hour, day, due_at, slot): when a schedule of these values is due last in the ``window`` minutes up to ``now``.

    ``hour`` is -1 for hourly ones, and ``day`` is empty unless weekly. A zone has under ``window`` * 4 rows.
    """
    last = F.date_trunc("minute", now)
    at = F.timestamp_seconds(F.unix_timestamp(last) - F.col("back") * 60)
    times = zones.select("zone", F.explode(F.sequence(F.lit(0), F.lit(window))).alias("back")).select("zone", at.alias("due_at")).withColumn("local", F.from_utc_timestamp("due_at", F.col("zone")))
    weekday, hour = F.dayofweek("local"), F.hour("local")  # Sunday is 1
    kind = lambda name, h, day="": F.struct(F.lit(name).alias("kind"), h.alias("hour"), (F.lit(day) if isinstance(day, str) else day).alias("day"))
    of_kind = F.array(
        kind("hourly", F.lit(-1)),
        kind("daily", hour),
        F.when(weekday.between(2, 6), kind("weekdays", hour)),
        kind("weekly", hour, F.element_at(F.array(*map(F.lit, DAYS)), weekday)),
    )
    slot = F.date_format("local", "yyyy-MM-dd'T'HH:mm")
    each = times.select("zone", "due_at", slot.alias("slot"), F.minute("local").alias("minute"), F.explode(of_kind).alias("x")).where("x is not null").select("zone", "due_at", "slot", "minute", "x.*")
    return each.groupBy("zone", "kind", "minute", "hour", "day").agg(F.max_by(F.struct("due_at", "slot"), "due_at").alias("x")).select("zone", "kind", "minute", "hour", "day", "x.*")


def due_slots(schedules: DataFrame, now: Column, window: int = 240) -> DataFrame:
    """``schedules`` (id, kind, hour, minute, day, zone) due in the last ``window`` minutes: slot, due_at and minutes_late.

    Each minute is judged once in each zone, so changes of its clock are met, and schedules look themselves up. The
    zones are at most those that Spark knows, whatever the schedules, so the lookup is broadcast. ``now`` is the same
    for all rows.
    """
    key = {"zone": usable(zone(F.col("zone"))), "kind": F.col("kind"), "minute": F.col("minute")}
    key["hour"] = F.when(F.col("kind") == "hourly", F.lit(-1)).otherwise(F.col("hour"))
    key["day"] = F.when(F.col("kind") == "weekly", F.col("day")).otherwise("")
    asked = schedules.select("id", *[c.alias(n) for n, c in key.items()])
    clock = due_clock(schedules.select(key["zone"].alias("zone")).distinct(), now, window)
    late = (F.unix_timestamp(F.date_trunc("minute", now)) - F.unix_timestamp("due_at")) / 60
    return asked.join(F.broadcast(clock), list(key)).select("id", "slot", "due_at", late.cast("long").alias("minutes_late"))


def pending_slots(slots: DataFrame, executions: DataFrame) -> DataFrame:
    """Slots that no completed execution (id, executed_at) has met at or after the time they were due."""
    last = executions.groupBy("id").agg(F.max("executed_at").alias("last"))
    return slots.join(last, "id", "left").where("last is null or last < due_at").drop("last")


def fraction() -> Column:
    """Of a phase (state, done, total): 1 done, skipped or empty, 0 pending, a half where the size isn't known."""
    return F.when(F.col("state").isin("done", "skipped"), 1.0).when(F.col("state") == "pending", 0.0).when(F.col("total").isNull(), 0.5).when(F.col("total") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("done") / F.col("total")))


def progress(phases: DataFrame) -> DataFrame:
    """Per run (run, status): percent, work done, work in all and what remains. A live run stays below 100."""
    closed = F.col("state").isin("done", "skipped")
    done = F.when(closed, F.col("total")).otherwise(F.least("done", "total"))
    rows = phases.select("run", "status", "weight", fraction().alias("f"), "total", F.when(F.col("total").isNotNull(), done).alias("units"))
    out = rows.groupBy("run", "status").agg((F.sum(F.col("weight") * F.col("f")) / F.sum("weight")).alias("share"), F.coalesce(F.sum("units"), F.lit(0)).alias("done"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    percent = F.floor(F.coalesce("share", F.lit(0.0)) * 100 + 0.5).cast("long")
    percent = F.when(F.col("status").isin("running", "cancelling"), F.least(F.lit(99), percent)).when(F.col("status") == "completed", 100).otherwise(percent)
    return out.select("run", "status", percent.alias("percent"), "done", "total", F.greatest(F.lit(0), F.col("total") - F.col("done")).alias("remaining"))


def remaining_seconds(percent: Column, elapsed: Column) -> Column:
    """Extrapolated; null in the first 20 seconds and below 5 percent."""
    return F.when((elapsed >= 20) & (percent >= 5), F.floor(F.greatest(F.lit(0.0), elapsed * 100 / percent - elapsed) + 0.5).cast("long"))


def liveness(runs: DataFrame, now: Column, stall: int = 90, stale: int = 900) -> DataFrame:
    """Runs (run, status, started, updated, throttled_until) as terminal, interrupted, throttled, stalled or live."""
    quiet = F.unix_timestamp(now) - F.unix_timestamp(F.coalesce("updated", "started"))
    said = F.when(F.col("status").isin(*TERMINAL), "terminal").when(quiet >= max(60, stale), "interrupted").when(F.coalesce(F.col("throttled_until") > now, F.lit(False)), "throttled").when(quiet >= stall, "stalled")
    return runs.select("run", quiet.alias("quiet_seconds"), said.otherwise("live").alias("state"))


def interrupted(runs: DataFrame, beats: DataFrame, now: Column, stale: int = 900) -> DataFrame:
    """(run, quiet_seconds) of running or cancelling ``runs`` (run, status, started) whose last progress (run, updated), else start, is too long ago."""
    both = runs.where(F.col("status").isin("running", "cancelling")).join(beats.select("run", "updated"), "run", "left")
    quiet = F.unix_timestamp(now) - F.unix_timestamp(F.coalesce("updated", "started"))
    return both.select("run", quiet.alias("quiet_seconds")).where(F.col("quiet_seconds") >= max(60, stale))
