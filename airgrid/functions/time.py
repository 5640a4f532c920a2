"""Column expressions for timestamps and day slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_compact(text: Column) -> Column:
    """yyyyMMddHHmmss text, left-padded with zeros; anything unreadable is null."""
    padded = F.when(F.length(text) <= 14, F.lpad(text, 14, "0"))
    return F.try_to_timestamp(padded, F.lit("yyyyMMddHHmmss"))


def strip_fraction(text: Column) -> Column:
    return F.split(F.trim(text), r"\.").getItem(0)


def window_start(ts: Column, seconds: int) -> Column:
    epoch = F.unix_timestamp(ts)
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(seconds)))


def day_slot(ts: Column, minutes: int) -> Column:
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / F.lit(minutes)).cast("int")


def slot_label(slot: Column, minutes: int) -> Column:
    first = slot * F.lit(minutes)
    last = first + F.lit(minutes - 1)
    hours = lambda m: F.floor(m / 60).cast("int")
    return F.format_string("%02d:%02d-%02d:%02d", hours(first), (first % 60).cast("int"),
                           hours(last), (last % 60).cast("int"))


def calendar_features(ts: Column) -> dict[str, Column]:
    weekday = F.weekday(ts)
    return {
        "date": F.to_date(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "second": F.second(ts),
        "day_of_week": weekday,
        "is_weekend": weekday >= 5,
    }


def date_hour(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd-HH")
