"""Numbers, places, times, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded_ratio(part: Column, whole: Column) -> Column:
    """``part`` against ``whole``, or against 1 where that is smaller."""
    return part / F.greatest(F.lit(1), whole)


def clamp(c: Column, low: float, high: Column | float) -> Column:
    return F.greatest(F.lit(low), F.least(c, high if isinstance(high, Column) else F.lit(high)))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up; 0 where there is nothing to do."""
    return F.when(whole > 0, F.floor(part / whole * 100 + 0.5)).otherwise(0).cast("int")


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def flipped(low: Column, high: Column, size: Column | float) -> tuple[Column, Column]:
    """An interval after half a turn of the page."""
    s = size if isinstance(size, Column) else F.lit(size)
    return s - high, s - low


def turned(text: Column) -> Column:
    """The letters of a line after half a turn of the page, read from left to right."""
    return F.reverse(text)


def padded(start: Column, end: Column, before: float, after: float, duration: Column | None = None) -> tuple[Column, Column]:
    """An interval with some more on either side, within the recording."""
    last = end + after
    return F.greatest(F.lit(0.0), start - before), last if duration is None else F.least(duration, last)


def taken_out(c: Column, key: Column) -> Column:
    """A map without one key."""
    return F.map_filter(c, lambda k, _: k != key)


def distinct_in_order(array: Column) -> Column:
    """The elements of an array, each at its first place."""
    return F.array_distinct(array)


def within(text: Column, least: int, most: int) -> Column:
    """Whether a text has a length between two bounds; null has none."""
    return F.coalesce(F.length(text).between(least, most), F.lit(False))


def quadrant(x0: Column, y0: Column, x1: Column, y1: Column, half: float = 500) -> Column:
    """0 to 3, row by row, by the middle of a box."""
    return F.when((y0 + y1) / 2 < half, 0).otherwise(2) + F.when((x0 + x1) / 2 < half, 0).otherwise(1)


def subdivided(start: Column, end: Column, n: Column, i: Column) -> tuple[Column, Column]:
    """Part ``i`` (from 0) of an interval in ``n`` equal parts."""
    step = (end - start) / n
    return start + step * i, start + step * (i + 1)


def duration_seconds(c: Column) -> Column:
    """``HH:MM:SS.s`` in seconds; null if it doesn't read so."""
    part = lambda i: F.regexp_extract(c, r"(\d+):(\d+):(\d+(?:\.\d+)?)", i).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def day_key(ts: Column) -> Column:
    """Year, month and day without leading zeros, as learner states keep it."""
    return F.date_format(ts, "y-M-d")


def day_of(key: Column) -> Column:
    return F.try_to_timestamp(key, F.lit("y-M-d")).cast("date")


def sorted_map(c: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(c)))


def merged_map(old: Column, new: Column) -> Column:
    """Entries of both; those of ``new`` win."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), new)


def updated_where(array: Column, test, change) -> Column:
    """Elements for which ``test`` holds, changed."""
    return F.transform(array, lambda x: F.when(test(x), change(x)).otherwise(x))


def added_once(array: Column, element: Column, same) -> Column:
    """``array`` with ``element`` at its end, unless one for which ``same`` holds is there."""
    return F.when(F.exists(array, same), array).otherwise(F.concat(array, F.array(element)))


def spliced(array: Column, position: Column, instead: Column) -> Column:
    """The element at ``position`` (from 1) replaced by the elements of ``instead``."""
    return F.flatten(F.transform(array, lambda x, i: F.when(i + 1 == position, instead).otherwise(F.array(x))))


def reasons(*conditions: tuple[Column, str | Column]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, n if isinstance(n, Column) else F.lit(n)) for c, n in conditions]))
