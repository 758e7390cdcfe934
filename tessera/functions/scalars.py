"""Scalars of the runs: seeds from digests, durations from texts, rounding, finiteness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seed_of(text: Column, digits: int = 8) -> Column:
    """The first hex digits of a text's SHA-256 digest as a whole number; up to 15 digits fit a long, 16 need a decimal."""
    head = F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10)
    return head.cast("decimal(20,0)") if digits > 15 else head.cast("long")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds between two texts in ISO form; null if one is no time or the difference isn't positive."""
    micros = F.unix_micros(F.try_to_timestamp(end)) - F.unix_micros(F.try_to_timestamp(start))
    return F.when(micros > 0, micros / 1e6)


def finite(value: Column) -> Column:
    """Neither null, nor infinite, nor no number."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def half_even(value: Column, places: int = 0) -> Column:
    """Rounded, ties to the even neighbour."""
    return F.bround(value, places)


def utc_text(time: Column) -> Column:
    """A time as text in ISO form, in UTC to the second."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def shortened(text: Column, most: int) -> Column:
    """A text of at most so many characters; what is cut off ends with an ellipsis."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def merged_maps(low: Column, high: Column) -> Column:
    """Both maps' members, those of `high` where both have one; null counts as empty. Whatever the session does about
    repeated keys."""
    low, high = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (low, high))
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)
