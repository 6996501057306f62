"""Wall-clock parsing, local-time tests and day boundaries.

Everything here works on epoch arithmetic or names its zone, so results do not depend on the
session time zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from townbill import fixed
from townbill.functions.text import EDGE_BEFORE, SPACE, let, trim

# ---- fixed values: wall-clock shapes ----
ISO = r"^(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2})(?::(\d{2}))?"
DATE_ONLY = r"^(\d{4})-(\d{2})-(\d{2})$"
DAY_FIRST = (
    rf"{EDGE_BEFORE}(\d{{1,2}}){SPACE}+([A-Za-z]{{3,}}){SPACE}+(\d{{4}})"
    rf"(?:{SPACE}+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?)?"
)
MONTH_FIRST = (
    rf"{EDGE_BEFORE}([A-Za-z]{{3,}}){SPACE}+(\d{{1,2}}),?{SPACE}+(\d{{4}})"
    rf"(?:{SPACE}+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?{SPACE}*([AaPp]\.?[Mm]\.?)?)?"
)
SEPARATOR = "\u0001"


def as_utc(moment) -> dt.datetime:
    """Accept a datetime, date or ISO string; a value without an offset is UTC."""
    if isinstance(moment, str):
        moment = dt.datetime.fromisoformat(moment.replace("Z", "+00:00"))
    if not isinstance(moment, dt.datetime):
        moment = dt.datetime(moment.year, moment.month, moment.day)
    return moment.replace(tzinfo=dt.timezone.utc) if moment.tzinfo is None else moment.astimezone(dt.timezone.utc)


def instant(moment) -> Column:
    """A literal timestamp; folds to a constant, so scans can use it."""
    delta = as_utc(moment) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return F.timestamp_micros(F.lit(delta // dt.timedelta(microseconds=1)))


def day_start(day, offset_hours: int = fixed.DAY_OFFSET_HOURS, plus_days: int = 0) -> dt.datetime:
    """First instant of a local calendar day under the fixed offset."""
    day = as_utc(day).replace(hour=0, minute=0, second=0, microsecond=0)
    return day + dt.timedelta(days=plus_days, hours=offset_hours)


def today_cutoff(now, offset_hours: int = fixed.DAY_OFFSET_HOURS) -> dt.datetime:
    """Latest local midnight at or before now, under the fixed offset."""
    return day_start(as_utc(now) - dt.timedelta(hours=offset_hours), offset_hours)


def wall_to_utc(year, month, day, hour, minute, second, zone: str = fixed.LOCAL_ZONE, exact: bool = False) -> Column:
    """Wall-clock fields to an instant; fields past their range roll over.

    The default corrects the wall time once by the zone's offset at that reading of UTC, which
    is an hour off for a few hours around each clock change; exact=True uses the zone rules.
    """
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)
    days = F.unix_date(first) + day - 1
    guess = ((days.cast("bigint") * 24 + hour) * 60 + minute) * 60 + second
    as_if_utc = F.timestamp_seconds(guess)
    if exact:
        return F.to_utc_timestamp(as_if_utc, zone)
    return F.timestamp_micros(2 * F.unix_micros(as_if_utc) - F.unix_micros(F.from_utc_timestamp(as_if_utc, zone)))


def _groups(c: Column, pattern: str, order: str) -> Column:
    """The pattern's groups in the given order, from one match; null when it does not occur."""
    wanted = SEPARATOR.join(f"${g}" for g in order)
    parts = F.split(F.regexp_replace(c, f"(?s)^.*?(?:{pattern}).*$", wanted), SEPARATOR)
    return let(parts, lambda p: F.when(F.size(p) == len(order), p))


def _fields_to_utc(fields: Column, zone: str, exact: bool) -> Column:
    """An array of year, month, day and optionally hour, minute, second as text to an instant."""
    number = lambda i: F.coalesce(F.get(fields, F.lit(i)).try_cast("int"), F.lit(0))
    return F.when(fields.isNotNull(), wall_to_utc(*[number(i) for i in range(6)], zone=zone, exact=exact))


def iso_wall_time(c: Column, zone: str = fixed.LOCAL_ZONE, exact: bool = False) -> Column:
    """'2026-08-15T08:00[:00]' read as local wall time; anything else is null."""
    return let(_groups(c, ISO, "123456"), lambda f: _fields_to_utc(f, zone, exact))


def _named_month(fields: Column) -> Column:
    """Replace the month name by its number and the hour by its 24-hour reading; null for no month."""
    months = F.array(*[F.lit(m) for m in fixed.MONTHS])
    number = F.array_position(months, F.lower(F.substring(fields[1], 1, 3)))
    hour = F.coalesce(fields[3].try_cast("int"), F.lit(0))
    half = F.lower(F.substring(F.coalesce(F.get(fields, F.lit(6)), F.lit("")), 1, 1))
    hour24 = (
        F.when((half == "p") & (hour != 12), hour + 12).when((half == "a") & (hour == 12), F.lit(0)).otherwise(hour)
    )
    text_of = lambda c: c.cast("string")
    return F.when(
        number > 0, F.array(fields[0], text_of(number), fields[2], text_of(hour24), fields[4], fields[5])
    )


def parse_wall_time(c: Column, zone: str = fixed.LOCAL_ZONE, exact: bool = False) -> Column:
    """The three shapes sources publish, as local wall time; a stated offset is ignored."""

    def fields(s: Column) -> Column:
        return F.coalesce(
            _groups(s, ISO, "123456"),
            _groups(s, DATE_ONLY, "123"),
            let(_groups(s, DAY_FIRST, "321456"), _named_month),
            let(_groups(s, MONTH_FIRST, "3124567"), _named_month),
        )

    return let(let(trim(c), fields), lambda f: _fields_to_utc(f, zone, exact))


def local_second_of_day(ts: Column, zone: str = fixed.LOCAL_ZONE) -> Column:
    return F.pmod(F.unix_seconds(F.from_utc_timestamp(ts, zone)), F.lit(86400))


def implausible_start(
    ts: Column, unknown_is_bad: bool, zone: str = fixed.LOCAL_ZONE, earliest_hour: int = fixed.EARLIEST_HOUR
) -> Column:
    """Starts in the small hours; 00:00 exactly is the all-day marker and fine."""
    second = local_second_of_day(ts, zone)
    return F.coalesce((second >= 60) & (second < earliest_hour * 3600), F.lit(unknown_is_bad))


def utc_date(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))


def utc_text(ts: Column, pattern: str) -> Column:
    """Format an instant as UTC: it is moved to the session's reading of the same wall time first."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), pattern)


def local_date(ts: Column, zone: str = fixed.LOCAL_ZONE) -> Column:
    return utc_date(F.from_utc_timestamp(ts, zone))


def spans_days(start: Column, end: Column, zone: str = fixed.LOCAL_ZONE) -> Column:
    return F.coalesce(local_date(start, zone) != local_date(end, zone), F.lit(False))


def local_text(ts: Column, pattern: str, zone: str = fixed.LOCAL_ZONE) -> Column:
    return utc_text(F.from_utc_timestamp(ts, zone), pattern)


def short_when(start: Column, zone: str = fixed.LOCAL_ZONE) -> Column:
    return local_text(start, "EEE, MMM d '·' h:mm a", zone)


def long_when(start: Column, end: Column, zone: str = fixed.LOCAL_ZONE) -> Column:
    days = F.concat(
        local_text(start, "MMMM d, yyyy", zone), F.lit(" – "), local_text(end, "MMMM d, yyyy", zone), F.lit(" · All day")
    )
    until = F.coalesce(F.concat(F.lit(" – "), local_text(end, "h:mm a", zone)), F.lit(""))
    one_day = F.concat(
        local_text(start, "EEEE, MMMM d, yyyy", zone), F.lit(" at "), local_text(start, "h:mm a", zone), until
    )
    return F.when(spans_days(start, end, zone), days).otherwise(one_day)


def week_of(ts: Column) -> Column:
    """Monday of the UTC week, as a date."""
    days = F.floor(F.unix_seconds(ts) / 86400)
    return F.date_from_unix_date((days - F.pmod(days + 3, F.lit(7))).cast("int"))
