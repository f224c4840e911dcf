"""Time functions. All of them work on zone-free timestamps, so results do not depend
on the session time zone; where a zone is meant it is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "America/New_York"


def calendar_parts(ts: Column) -> dict[str, Column]:
    """Hour, day of week (Monday = 0), month and weekend flag."""
    return {
        "hour_of_day": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
        "is_weekend": F.when(F.weekday(ts) >= 5, 1).otherwise(0),
    }


def rush_hour(hour: Column, evening_end: int = 19, weekday_only: Column | None = None) -> Column:
    """Morning 7-9 or evening 16 to ``evening_end``; a missing hour is no rush hour.

    The first feature set ends the evening at 18. ``weekday_only`` takes the day of
    week and switches the flag off at weekends, as live features do.
    """
    busy = hour.between(7, 9) | hour.between(16, evening_end)
    if weekday_only is not None:
        busy = busy & (weekday_only < 5)
    return F.when(busy, 1).otherwise(0)


def light_phase(hour: Column, live: bool = False) -> Column:
    """Dark, Dawn_Dusk or Daylight; training and live use different borders."""
    if live:
        return (F.when(hour.between(7, 18), "Daylight").when(hour.isin(5, 6, 19, 20), "Dawn_Dusk")
                .otherwise("Dark"))
    return (F.when((hour < 6) | (hour >= 20), "Dark").when(hour.isin(6, 19), "Dawn_Dusk").otherwise("Daylight"))


def epoch_ms_to_timestamp(ms: Column) -> Column:
    """Zone-free UTC time of epoch milliseconds, to the second; unreadable -> null."""
    number = ms.try_cast("bigint")
    seconds = (number - F.pmod(number, F.lit(1000))) / 1000
    # nanosecond clocks reach this far; anything beyond is not a time
    readable = F.abs(seconds) <= 9_223_372_036
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.when(readable, seconds).cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + step


def epoch_ms_to_text(ms: Column) -> Column:
    return F.concat(epoch_ms_to_timestamp(ms).cast("string"), F.lit("+00:00"))


# Fixed pattern: a zone at the end of a time text.
_ZONE = r"(?:Z|([+-])(\d{2}):?(\d{2}))$"


def _split_zone(text: Column) -> tuple[Column, Column, Column]:
    """Has a zone, the zone-free time, the zone's offset in minutes."""
    has_time = text.rlike(r"\d[T ]\d")
    zoned = has_time & text.rlike(_ZONE)
    bare = F.regexp_replace(text, F.when(zoned, F.lit(_ZONE)).otherwise(F.lit("^$")), F.lit("")).try_cast("timestamp_ntz")
    amount = F.coalesce(
        F.regexp_extract(text, _ZONE, 2).try_cast("int") * 60 + F.regexp_extract(text, _ZONE, 3).try_cast("int"), F.lit(0))
    offset = F.when(zoned, F.when(F.regexp_extract(text, _ZONE, 1) == "-", -amount).otherwise(amount)).otherwise(F.lit(0))
    return zoned, bare, offset


def utc_timestamp(text: Column) -> Column:
    """Zone-free UTC time of a time text; text without a zone is UTC; unreadable -> null."""
    _, bare, offset = _split_zone(text)
    return bare - F.make_dt_interval(F.lit(0), F.lit(0), offset, F.lit(0))


def local_timestamp(text: Column, zone: str = LOCAL_ZONE) -> Column:
    """Zone-free local time of a time text; text without a zone is local already."""
    zoned, bare, _ = _split_zone(text)
    return F.when(zoned, F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_timestamp(text))).otherwise(bare)


def year_of(text: Column) -> Column:
    return F.year(utc_timestamp(text))


def run_stamp_to_iso(run_ts: Column) -> Column:
    """``2026-04-21_06-00-00`` -> ISO text in UTC; anything else unchanged."""
    pattern = r"^(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})-(\d{2})$"
    iso = F.regexp_replace(run_ts, pattern, "$1T$2:$3:$4")
    valid = run_ts.rlike(pattern) & iso.try_cast("timestamp_ntz").isNotNull()
    return F.when(valid, F.concat(iso, F.lit("+00:00"))).otherwise(run_ts)


def date_to_iso(value: Column) -> Column:
    """Bare date -> midnight UTC as ISO text; a value with a time, or no date, unchanged."""
    bare = value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & value.try_cast("date").isNotNull()
    return F.when(bare, F.concat(value.try_cast("date").cast("string"), F.lit("T00:00:00+00:00"))).otherwise(value)


def iso_week_key(ts: Column) -> Column:
    """ISO year and week, e.g. ``2026-W53`` for 2027-01-01."""
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def duration_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def duration_minutes(start: Column, end: Column) -> Column:
    return duration_seconds(start, end) / 60.0


def quarter_hour_bin(ts: Column) -> Column:
    return F.hour(ts) * 4 + F.floor(F.minute(ts) / 15).cast("int")


def three_hour_bin(hour: Column) -> Column:
    return F.floor(hour / 3).cast("int")
