"""Time and calendar columns on naive local timestamps (TIMESTAMP_NTZ).

Nothing here depends on the session time zone except ``strip_tz``, which says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import TARGET_CALENDAR


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hour_of(t) -> Column:
    return F.hour(_c(t))


def day_of_week(t) -> Column:
    """Monday is 0."""
    return F.weekday(_c(t))


def month_of(t) -> Column:
    return F.month(_c(t))


def is_weekend(t) -> Column:
    return (F.weekday(_c(t)) >= 5).cast("int")


def calendar_columns(t, names=("hour", "day_of_week", "month", "is_weekend")) -> dict[str, Column]:
    parts = (hour_of(t), day_of_week(t), month_of(t), is_weekend(t))
    return dict(zip(names, parts))


def add_hours(t, hours) -> Column:
    h = hours if isinstance(hours, Column) else F.lit(hours)
    return _c(t) + F.make_dt_interval(F.lit(0), h.cast("int"))


def add_seconds(t, seconds: Column | int) -> Column:
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    days = F.floor(s / 86400).cast("int")
    rest = (s - days.cast("long") * 86400).cast("decimal(18,6)")
    return _c(t) + F.make_dt_interval(days, F.lit(0), F.lit(0), rest)


def target_calendar(t, hours) -> dict[str, Column]:
    return calendar_columns(add_hours(t, hours), TARGET_CALENDAR)


def wind_sin_cos(degrees, prefix: str = "wind_direction") -> dict[str, Column]:
    r = F.radians(_c(degrees))
    return {f"{prefix}_sin": F.sin(r), f"{prefix}_cos": F.cos(r)}


def cyclical(x, period: float, prefix: str, origin: int = 0, suffix: str = "") -> dict[str, Column]:
    """Position on a circle of ``period`` units; ``origin`` is the value at angle zero."""
    angle = F.lit(2.0) * F.pi() * (_c(x) - F.lit(origin)) / F.lit(float(period))
    return {f"{prefix}_sin{suffix}": F.sin(angle), f"{prefix}_cos{suffix}": F.cos(angle)}


def floor_hour(t) -> Column:
    return _midnight(t) + F.make_dt_interval(F.lit(0), F.hour(_c(t)))


def _midnight(t) -> Column:
    return F.to_date(_c(t)).cast("timestamp_ntz")


def strip_tz(ts) -> Column:
    """Drop the zone tag and keep the clock as shown in the session time zone."""
    return _c(ts).cast("timestamp_ntz")


def convert_tz(t, source: str, target: str) -> Column:
    """Move a naive clock from one zone to another."""
    return F.convert_timezone(F.lit(source), F.lit(target), _c(t))


def earlier(a, b) -> Column:
    return F.least(_c(a), _c(b))


def date_of(t) -> Column:
    return F.to_date(_c(t))


def iso_date(d) -> Column:
    return F.date_format(_c(d), "yyyy-MM-dd")


def epoch_seconds(t) -> Column:
    """Whole seconds since 1970-01-01 on the naive clock; integer arithmetic only."""
    c = _c(t)
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def from_epoch_seconds(seconds) -> Column:
    return add_seconds(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(seconds))


def latest_completed(now) -> Column:
    """Newest hour that has fully passed at ``now``."""
    return add_hours(floor_hour(now), -1)
