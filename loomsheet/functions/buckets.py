"""Date bucket labels: sortable strings; a null date has a null label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.requests import Bucket
from .predicates import family

#: Fixed formats of the labels.
FORMATS = {
    "minute": "yyyy-MM-dd'T'HH:mm",
    "hour": "yyyy-MM-dd'T'HH':00'",
    "day": "yyyy-MM-dd",
    "month": "yyyy-MM",
    "quarter": "yyyy-'Q'q",
    "year": "yyyy",
}
SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}
#: The end of a text with a time and an offset from UTC.
OFFSET = r"\d:\d{2}.*(?:[zZ]|[+-]\d{2}:?\d{2})\s*$"
#: Monday of the first week bin, in seconds from the epoch.
MONDAY = 4 * 86400


def moment(c: Column, kind: T.DataType) -> Column:
    """ISO text, epoch milliseconds, dates and timestamps as a UTC wall time; text without an offset is UTC."""
    own = family(kind)
    if own == "number":
        c = F.timestamp_millis(c.cast("long"))
    elif own == "string":
        zoned = F.convert_timezone(None, F.lit("UTC"), F.try_to_timestamp(c).cast("timestamp_ntz"))
        return F.when(c.rlike(OFFSET), zoned).otherwise(c.try_cast("timestamp_ntz"))
    if isinstance(kind, T.TimestampNTZType):
        return c
    if isinstance(kind, T.DateType):
        return c.cast("timestamp_ntz")
    return F.convert_timezone(None, F.lit("UTC"), c.cast("timestamp").cast("timestamp_ntz"))


def label(t: Column, unit: str) -> Column:
    if unit == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))
    return F.date_format(t, FORMATS[unit])


def bucket(c: Column, kind: T.DataType, b: Bucket) -> Column:
    t = moment(c, kind)
    if b.timezone:
        t = F.convert_timezone(F.lit("UTC"), F.lit(b.timezone), t)
    if b.every is None:
        return label(t, b.interval)
    if b.interval == "month":
        months = (F.year(t) - 1970) * 12 + F.month(t) - 1
        first = (F.floor(months / b.every) * b.every).cast("int")
        return label(F.make_timestamp_ntz(F.floor(first / 12).cast("int") + 1970, F.pmod(first, F.lit(12)) + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0)), "month")
    size, origin = SECONDS[b.interval] * b.every, MONDAY if b.interval == "week" else 0
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    since = days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    start = F.floor((since - origin) / size) * size + origin
    return label(epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), start.cast("decimal(18,6)")), b.interval)
