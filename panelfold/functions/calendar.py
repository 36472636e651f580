"""Frequency codes as Spark date arithmetic."""

import re

from pyspark.sql import Column, functions as F

# Months, days or seconds between neighbouring points per code.
MONTH_STEPS = {"Y": 12, "Q": 3, "M": 1, "MS": 1, "ME": 1}
DAY_STEPS = {"W": 7, "D": 1}
SECOND_STEPS = {"H": 3600, "T": 60, "S": 1}

# Codes whose points are at least a day apart. The timestamp domain of the data
# (years 1677-2262) then holds at most 213,700 points per series, so one series
# always fits one window task; finer codes have no such bound.
DAILY_OR_COARSER = frozenset(MONTH_STEPS) | frozenset(DAY_STEPS)


def parse_freq(freq: str) -> tuple[str, int]:
    """Split a code such as ``15T`` into its unit and multiple."""
    found = re.fullmatch(r"(\d*)([A-Z]+)", freq)
    if not found or found[2] not in {**MONTH_STEPS, **DAY_STEPS, **SECOND_STEPS}:
        raise ValueError(f"unknown frequency {freq!r}")
    return found[2], int(found[1] or 1)


def is_bounded(freq: str | None) -> bool:
    """Whether the calendar bounds the rows of one series (see above)."""
    return freq is not None and parse_freq(freq)[0] in DAILY_OR_COARSER


def next_time(time: Column, freq: str) -> Column:
    """The time one step after ``time``, keeping its type."""
    unit, times = parse_freq(freq)
    if unit in MONTH_STEPS:
        later = time + F.expr(f"INTERVAL '{MONTH_STEPS[unit] * times}' MONTH")
        if unit == "MS":
            return later
        return F.when(time.cast("date") == F.last_day(time), F.last_day(later)).otherwise(later)
    if unit in DAY_STEPS:
        return time + F.expr(f"INTERVAL '{DAY_STEPS[unit] * times}' DAY")
    return time + F.expr(f"INTERVAL '{SECOND_STEPS[unit] * times}' SECOND")


def truncate_hour(time: Column) -> Column:
    """Start of the hour without a detour over the session time zone."""
    return time - F.make_dt_interval(
        mins=F.minute(time), secs=F.extract(F.lit("SECOND"), time))


def time_chunk(time: Column, freq: str | None, points: int) -> Column:
    """Number of the stretch of ``points`` steps that holds ``time``.

    Without a frequency one step counts as a second.
    """
    if freq is None:
        step = 1
    else:
        unit, times = parse_freq(freq)
        step = times * (SECOND_STEPS.get(unit)
                        or DAY_STEPS.get(unit, 0) * 86400
                        or MONTH_STEPS[unit] * 28 * 86400)
    seconds = F.timestamp_diff(
        "SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time.cast("timestamp_ntz"))
    return F.floor(seconds / F.lit(step * points)).cast("long")
