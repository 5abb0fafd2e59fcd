"""Date and time functions as Column expressions; the session's time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
_RFC = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2}) ([A-Za-z]{3}) (\d{2}|\d{4}) (\d{2}:\d{2})(:\d{2})? (GMT|UTC|UT|[+-]\d{4})$"


def parse_instant(text: Column) -> Column:
    """An ISO instant with a zone or an RFC 2822 one; two-digit years to 49 are of this century. Else null."""
    iso = F.try_to_timestamp(F.when(text.rlike(_ISO), text))
    part = lambda i: F.regexp_extract(text, _RFC, i)
    year = F.when(F.length(part(3)) == 4, part(3)).when(part(3) < "50", F.concat(F.lit("20"), part(3))).otherwise(F.concat(F.lit("19"), part(3)))
    zone = F.when(part(6).isin("GMT", "UTC", "UT"), "+0000").otherwise(part(6))
    seconds = F.when(part(5) == "", ":00").otherwise(part(5))
    whole = F.concat_ws(" ", F.lpad(part(1), 2, "0"), F.initcap(part(2)), year, F.concat(part(4), seconds), zone)
    rfc = F.try_to_timestamp(F.when(text.rlike(_RFC), whole), F.lit("dd MMM yyyy HH:mm:ss xx"))
    return F.coalesce(iso, rfc)


def strict_instant(text: Column) -> Column:
    """An ISO instant whose fields are all real and whose offset is at most 14 hours; else null."""
    offset = F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})$", 2).try_cast("int") * 60 + F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})$", 3).try_cast("int")
    return F.when(text.rlike(_ISO) & (F.coalesce(offset, F.lit(0)) <= 840), F.try_to_timestamp(text))


def real_date(text: Column) -> Column:
    """A calendar date written as YYYY-MM-DD; else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def local_clock(instant: Column, zone: str = ZONE) -> Column:
    """Wall-clock time in a zone, as YYYY-MM-DD HH:MM."""
    return F.date_format(F.from_utc_timestamp(instant, zone), "yyyy-MM-dd HH:mm")


def local_instant(date: Column, clock: str, zone: str = ZONE) -> Column:
    """The instant of a wall-clock time on a date in a zone, daylight saving minded."""
    return F.to_utc_timestamp(F.concat_ws(" ", date.cast("string"), F.lit(clock)), zone)


def route(instant: Column, zone: str = ZONE) -> Column:
    """D05: 'personal' at 05:05 on any day, 'delivery' at 06:00 from Monday to Friday, else null."""
    local = F.from_utc_timestamp(instant, zone)
    clock = F.date_format(local, "HH:mm")
    return F.when(clock == "05:05", "personal").when((clock == "06:00") & F.dayofweek(local).between(2, 6), "delivery")


def retained(date: Column, as_of: Column, days: int = 30) -> Column:
    """Whether a date is on or after as_of less so many days."""
    return date >= F.date_sub(as_of, days)


def window_start(end: Column, hours: int = 24, zone: str = ZONE) -> Column:
    """A window's start: for 24 hours the same wall-clock time of the day before (23 or 25 hours when clocks change)."""
    if hours != 24:
        return end - F.make_interval(hours=F.lit(hours))
    local = F.from_utc_timestamp(end, zone)
    return F.to_utc_timestamp(local - F.expr("INTERVAL 1 DAY"), zone)


def freshness(first: Column, end: Column) -> Column:
    """Points by the age of the earliest publication at the window's end, never below age 0."""
    hours = F.greatest(F.lit(0.0), (F.unix_micros(end) - F.unix_micros(first)) / 3.6e9)
    out = F.lit(2)
    for limit, points in ((168, 5), (72, 8), (48, 10), (24, 13), (6, 15)):
        out = F.when(hours <= limit, points).otherwise(out)
    return out
