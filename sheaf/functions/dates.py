"""Column functions over dates written in text (day first), quarters, windows and bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_FIRST = "([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"


def date_of(day: Column, month: Column, year: Column) -> Column:
    """The date, or null where there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd")


def first_date(text: Column) -> Column:
    """The first d/m/yyyy with an optional hh:mm, as a timestamp; invalid: null."""
    part = lambda i: F.regexp_extract(text, DAY_FIRST + "(?:[^0-9]{0,3}([0-9]{1,2}):([0-9]{2}))?", i)
    at = F.format_string("%04d-%02d-%02d %02d:%02d:00", *(F.coalesce(F.nullif(part(i), F.lit("")), F.lit("0")).cast("int") for i in (3, 2, 1, 4, 5)))
    return F.when(part(3) != "", F.try_to_timestamp(at, F.lit("yyyy-MM-dd HH:mm:ss")))


def loose_date(text: Column, default_year: int) -> tuple[Column, Column]:
    """(label, date): the first d/m, d/m/yy or d/m/yyyy; the label stays where the date is invalid."""
    pattern = "([0-9]{1,2})/([0-9]{1,2})(?:/([0-9]{2,4}))?"
    label = F.regexp_extract(text, pattern, 0)
    year = F.regexp_extract(text, pattern, 3)
    y = F.when(year == "", F.lit(default_year)).when(F.length(year) <= 2, F.concat(F.lit("20"), year).cast("int")).otherwise(F.nullif(year, F.lit("")).cast("int"))
    date = F.when(label != "", date_of(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")), y))
    return F.when(label == "", F.trim(text)).otherwise(label), date


def all_dates(text: Column) -> Column:
    """Every valid d/m/yyyy, first kept, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(DAY_FIRST), F.lit(0)), lambda x: date_of(F.split(x, "/")[0], F.split(x, "/")[1], F.split(x, "/")[2]))
    return F.array_distinct(F.array_compact(found))


def quarter_of(text: Column, default: int = 3) -> Column:
    """The latest quarter named, else the latest quarter of a date, else the default."""
    named = F.transform(F.regexp_extract_all(F.lower(text), F.lit("(?:^|[^a-z0-9])q([1-4])(?![a-z0-9])"), F.lit(1)), lambda x: x.cast("int"))
    dated = F.transform(all_dates(text), lambda d: F.quarter(d))
    return F.coalesce(F.array_max(named), F.array_max(dated), F.lit(default))


def quarter_bounds(year: Column, quarter: Column) -> tuple[Column, Column]:
    start = F.make_date(year, (quarter - 1) * 3 + 1, F.lit(1))
    return start, F.date_sub(F.add_months(start, 3), 1)


def deadline_window(text: Column) -> tuple[Column, Column]:
    """(start, end): an exact day is its own window, Qn/yyyy a quarter, anything else none."""
    part = lambda i: F.nullif(F.regexp_extract(text, DAY_FIRST, i), F.lit(""))
    day = date_of(part(1), part(2), part(3))
    q = F.nullif(F.regexp_extract(text, "(?i)Q(?:u[yý]?)?\\.? *([1-4]) *[/-] *([0-9]{4})", 1), F.lit("")).cast("int")
    y = F.nullif(F.regexp_extract(text, "(?i)Q(?:u[yý]?)?\\.? *([1-4]) *[/-] *([0-9]{4})", 2), F.lit("")).cast("int")
    start, end = quarter_bounds(y, q)
    exact = part(1).isNotNull()
    return F.when(exact, day).otherwise(start), F.when(exact, day).otherwise(end)


def percent(start: Column, end: Column, at: Column) -> Column:
    """Where a date lies on an axis, 0 to 100; an axis has one day at least."""
    total = F.greatest(F.datediff(end, start), F.lit(1))
    return F.least(F.greatest(F.datediff(at, start) / total, F.lit(0.0)), F.lit(1.0)) * 100


def bar(start: Column, end: Column, low: Column, high: Column, least: float = 1.2) -> tuple[Column, Column]:
    left = percent(start, end, low)
    return left, F.greatest(percent(start, end, high) - left, F.lit(least))
