"""Local dates and dates named in text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions import text as tx
from sigtide.rules import RulePack


def local_ts(ts: Column, offset_hours: int = K.UTC_OFFSET_HOURS) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(offset_hours))


def local_date(ts: Column, offset_hours: int = K.UTC_OFFSET_HOURS) -> Column:
    return local_ts(ts, offset_hours).cast("date")


def utc_bounds(first: dt.date, last: dt.date, offset_hours: int = K.UTC_OFFSET_HOURS) -> tuple[dt.datetime, dt.datetime]:
    """Half-open UTC bounds of the local days first..last."""
    shift = dt.timedelta(hours=offset_hours)
    start = dt.datetime.combine(first, dt.time()) - shift
    end = dt.datetime.combine(last + dt.timedelta(days=1), dt.time()) - shift
    return start, end


def incident_date(msg_date: Column, low: Column, pack: RulePack) -> Column:
    """Date named in a text: the night-of form, then "<day> <month>", then yesterday, else the message date.

    An impossible day falls through to the next form. The year is the message's year.
    """
    named_day = F.lit(None).cast("date")
    if pack.months:
        forms = []
        names = "|".join(pack.months)
        day_month = f"([0-9]{{1,2}}) +({names})"
        for prefix in [*pack.group("night_of"), ""]:
            day = F.regexp_extract(low, prefix + day_month, 1)
            month = F.regexp_extract(low, prefix + day_month, 2)
            number = None
            for name, n in pack.months.items():
                number = F.when(month == name, n) if number is None else number.when(month == name, n)
            named = F.try_to_date(
                F.format_string("%04d-%02d-%02d", F.year(msg_date), number, day.try_cast("int")), "yyyy-MM-dd")
            forms.append(F.when(low.rlike(prefix + day_month), named) if prefix else named)
        named_day = F.when(low.rlike(day_month), F.coalesce(*forms))
    yesterday = F.when(tx.any_of(low, pack.group("yesterday")), F.date_sub(msg_date, 1))
    return F.coalesce(named_day, yesterday, msg_date)
