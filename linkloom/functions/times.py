"""Parsing of the time formats the feeds use. A bad value becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_x_time(c: Column) -> Column:
    """``Wed Oct 10 20:19:24 +0000 2018``; the week day carries no information."""
    return F.try_to_timestamp(F.substring(c, 5, 64), F.lit("MMM dd HH:mm:ss Z yyyy"))


def parse_rfc3339(c: Column) -> Column:
    """RFC 3339 with zero to nine fraction digits and any offset."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX"))


def to_second(c: Column) -> Column:
    """Times are compared in whole seconds."""
    return F.date_trunc("second", c)


def format_rfc3339(c: Column) -> Column:
    """UTC text form used for saved marks."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
