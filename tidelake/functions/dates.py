"""Dates and timestamps as the lake and its interfaces write them. Timestamps are wall-clock time without a zone."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layouts of datetime parameters (fixed values).
DATETIME_LAYOUTS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y%m%d %H:%M:%S", "%Y%m%d %H:%M", "%Y%m%d%H%M%S", "%Y-%m-%d", "%Y%m%d")
DATE_LAYOUTS = ("%Y%m%d", "%Y-%m-%d", "%Y/%m/%d")


def _first(text: str, layouts: tuple[str, ...]) -> datetime:
    for layout in layouts:
        try:
            found = datetime.strptime(text.strip(), layout)
        except ValueError:
            continue
        # strptime takes short numbers too: what it read must be what was written
        if found.strftime(layout) == text.strip():
            return found
    raise ValueError(f"no date or time: {text!r}")


def date_parameter(text: str) -> date:
    """YYYYMMDD, YYYY-MM-DD or YYYY/MM/DD; anything else is an error."""
    return _first(text, DATE_LAYOUTS).date()


def datetime_parameter(text: str) -> datetime:
    """One of seven layouts, slashes not among them."""
    return _first(text, DATETIME_LAYOUTS)


def parse_date(text: Column) -> Column:
    """The date in any of three layouts, else null."""
    s = F.trim(text)
    return F.coalesce(
        F.when(F.regexp_like(s, F.lit(r"^\d{8}$")), F.try_to_date(s, "yyyyMMdd")),
        F.when(F.regexp_like(s, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(s, "yyyy-MM-dd")),
        F.when(F.regexp_like(s, F.lit(r"^\d{4}/\d{2}/\d{2}$")), F.try_to_date(s, "yyyy/MM/dd")),
    )


def parse_date_value(raw: Column) -> Column:
    """A date from text or a number, such as 19991110.0; zero, blank and null are null."""
    s = F.regexp_replace(F.trim(raw.cast("string")), r"\.0+$", "")
    s = F.coalesce(F.when(F.regexp_like(s, F.lit(r"^\d(\.\d+)?E\d+$")), raw.try_cast("double").cast("long").cast("string")), s)
    return parse_date(F.when(~s.isin("", "0"), s))


def parse_timestamp_value(raw: Column) -> Column:
    """A timestamp from text, from a number of 8, 12 or 14 digits, or from seconds since 1970; zero and blank are null."""
    s = F.trim(raw.cast("string"))
    n = raw.try_cast("decimal(20,3)").cast("long")
    digits = n.cast("string")
    ntz = lambda x, layout: F.try_to_timestamp(x, F.lit(layout)).cast("timestamp_ntz")
    number = (
        F.when(n == 0, None)
        .when(F.length(digits) == 8, ntz(digits, "yyyyMMdd"))
        .when(F.length(digits) == 12, ntz(digits, "yyyyMMddHHmm"))
        .when(F.length(digits) == 14, ntz(digits, "yyyyMMddHHmmss"))
        .otherwise(F.timestamp_seconds(n).cast("timestamp_ntz"))
    )
    text = F.coalesce(*[ntz(s, layout) for layout in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])
    return F.when(n.isNotNull(), number).otherwise(F.when(s != "", text))


def format_date(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd")


def format_date_iso(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def format_timestamp(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss")


def date_number(d: Column) -> Column:
    """YYYYMMDD as an integer."""
    return F.date_format(d, "yyyyMMdd").cast("int")


def is_time(t: Column, hour: int, minute: int) -> Column:
    return (F.hour(t) == hour) & (F.minute(t) == minute)


def converted(column: Column, source_type: str, logical: str) -> Column:
    """A DATE or TIMESTAMP column as either logical kind, ``date`` or ``timestamp``."""
    if source_type not in ("date", "timestamp", "timestamp_ntz"):
        raise TypeError(f"{source_type} is neither a date nor a timestamp")
    return column.cast("date" if logical == "date" else "timestamp_ntz")
