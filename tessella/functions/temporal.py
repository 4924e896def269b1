"""Date functions and date parts. Dates are timestamps without zone, read as UTC; units count boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import PlanError

#: Fixed values of the plan language: the parts of Date_Extract.
PARTS = ("year", "month", "day", "quarter", "quarter_start", "month_start", "year_num", "month_num", "day_num", "fiscal_year", "fiscal_quarter")
_SECONDS = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}


def unit(name: str, allowed: tuple[str, ...]) -> str:
    name = str(name).lower().rstrip("s")
    if name not in allowed:
        raise PlanError(f"unsupported date unit: {name}")
    return name


def epoch(t: Column) -> Column:
    """Seconds since 1970 as a double, microseconds kept."""
    return F.unix_micros(t.cast("timestamp")) / F.lit(1e6)


def difference(name: str, start: Column, end: Column) -> Column:
    """Boundaries crossed from start to end."""
    name = unit(name, ("second", "minute", "hour", "day", "month", "quarter", "year"))
    if name in _SECONDS:
        n = _SECONDS[name]
        floor = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / F.lit(n * 1_000_000))
        return (floor(end) - floor(start)).cast("long")
    per_year = {"year": 1, "quarter": 4, "month": 12}[name]
    index = lambda t: F.year(t) * per_year + {"year": F.lit(0), "quarter": F.quarter(t), "month": F.month(t)}[name]
    return (index(end) - index(start)).cast("long")


def add(name: str, n: int, t: Column) -> Column:
    name = unit(name, ("second", "minute", "hour", "day", "month", "quarter", "year"))
    return F.timestamp_add(name.upper(), F.lit(n), t)


def truncate(name: str, t: Column) -> Column:
    return F.date_trunc(unit(name, ("day", "month", "quarter", "year")), t).cast("timestamp_ntz")


def part(name: str, t: Column, fiscal_start: int = 1) -> Column:
    """A Date_Extract part: year, month, day, quarter and the starts are text, the others integers; a fiscal year has the name of the year it starts in."""
    if name in ("year", "month", "day"):
        return F.date_format(t, {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}[name])
    if name in ("year_num", "month_num", "day_num"):
        return {"year_num": F.year(t), "month_num": F.month(t), "day_num": F.dayofmonth(t)}[name].cast("long")
    if name == "quarter":
        return F.concat(F.date_format(t, "yyyy"), F.lit("-Q"), F.quarter(t).cast("string"))
    if name in ("quarter_start", "month_start"):
        return F.date_format(F.date_trunc(name.removesuffix("_start"), t), "yyyy-MM-dd")
    if isinstance(fiscal_start, bool) or not isinstance(fiscal_start, int) or not 1 <= fiscal_start <= 12:
        raise PlanError("fiscal_start_month must be an integer from 1 to 12")
    if name == "fiscal_year":
        return (F.year(t) - F.when(F.month(t) < fiscal_start, 1).otherwise(0)).cast("long")
    if name == "fiscal_quarter":
        return (F.floor(F.pmod(F.month(t) - fiscal_start, F.lit(12)) / 3) + 1).cast("long")
    raise PlanError(f"unsupported date part: {name}")
