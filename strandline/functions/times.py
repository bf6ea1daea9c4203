"""Publish times from text, as times without a zone in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months by their first three letters, hours of zones from UTC, and hours of dates that name no zone.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {"UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
LOCAL = 8

_ISO = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)(?:Z|([+-])(\d{2}):?(\d{2}))?$"
_RELATIVE = ((r"(\d+)\s*分钟前", 1), (r"(\d+)\s*小时前", 60), (r"(\d+)\s*天前", 1440))
_HAN = r"(\d{4})年(\d{1,2})月(\d{1,2})日(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?"
_COMPACT = (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?: (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?$", r"^(\d{4})/(\d{1,2})/(\d{1,2})(?: (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?$")
_ENGLISH = r"(?i)([a-z]{3})[a-z]*\s+(\d{1,2}),\s*(\d{4})\s+(\d{1,2}):(\d{2})\s*(AM|PM)(?:\s+([A-Z]{2,4}))?"
_MONTH = r"(?i)^([a-z]{3})[a-z]*\s+(\d{4})$"


def _minutes(n: Column) -> Column:
    return F.make_dt_interval(mins=n.cast("int"))


def _time(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A time from texts of its parts, missing ones 0; null if there is no such time."""
    two = lambda x: F.lpad(F.when(x == "", "0").otherwise(x), 2, "0")
    return F.concat(year, F.lit("-"), two(month), F.lit("-"), two(day), F.lit(" "), two(hour), F.lit(":"), two(minute), F.lit(":"), two(second)).try_cast("timestamp_ntz")


def publish_time(text: Column, now: Column) -> Column:
    """ISO times, `n` minutes, hours or days ago, Chinese, numeric and English dates, and months; null for all else.

    Chinese and numeric dates without a zone are local, English ones UTC.
    """
    c = F.trim(F.regexp_replace(text, r"\s+", " "))
    part = lambda p, k: F.regexp_extract(c, p, k)
    shift = F.coalesce(part(_ISO, 3).try_cast("int") * 60 + part(_ISO, 4).try_cast("int"), F.lit(0)) * F.when(part(_ISO, 2) == "-", -1).otherwise(1)
    tries = [F.when(c.rlike(_ISO), F.replace(part(_ISO, 1), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz") - _minutes(shift))]
    tries += [F.when(c.rlike(p), now - _minutes(part(p, 1).try_cast("int") * size)) for p, size in _RELATIVE]
    tries += [F.when(c.rlike(p), _time(*[part(p, k) for k in range(1, 7)]) - _minutes(F.lit(LOCAL * 60))) for p in (_HAN, *_COMPACT)]

    def month(p: str) -> Column:
        return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(p, 1))).cast("string")

    hour = (F.coalesce(part(_ENGLISH, 4).try_cast("int"), F.lit(0)) % 12 + F.when(F.upper(part(_ENGLISH, 6)) == "PM", 12).otherwise(0)).cast("string")
    zone = F.lit(0)
    for name, hours in ZONES.items():
        zone = F.when(F.upper(part(_ENGLISH, 7)) == name, hours * 60).otherwise(zone)
    tries.append(F.when(c.rlike(_ENGLISH), _time(part(_ENGLISH, 3), month(_ENGLISH), part(_ENGLISH, 2), hour, part(_ENGLISH, 5), F.lit("0")) - _minutes(zone)))
    tries.append(F.when(c.rlike(_MONTH), _time(part(_MONTH, 2), month(_MONTH), F.lit("1"), F.lit("0"), F.lit("0"), F.lit("0"))))
    return F.coalesce(*tries)
