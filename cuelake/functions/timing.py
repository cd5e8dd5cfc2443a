"""Times of cues: parsing and formatting of timing lines, and durations as people write them."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Anywhere in the line; what follows is ignored.
TIMING = r"([0-9]+):([0-9]+):([0-9]+),([0-9]+) --> ([0-9]+):([0-9]+):([0-9]+),([0-9]+)"
_UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
_PART = re.compile(r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h)")


def time_parts(c: Column) -> Column:
    """The numbers of a line's timing as strings: eight, or an empty one where there is none."""
    return F.split(F.regexp_extract(c, TIMING, 0), "[^0-9]+")


def from_parts(parts: Column) -> tuple[Column, Column]:
    """(from, to) in milliseconds of time_parts()."""

    def total(first: int) -> Column:
        h, m, s, ms = (F.get(parts, F.lit(first + k)).try_cast("bigint") for k in range(4))
        return F.try_add(F.try_multiply(h, F.lit(3_600_000)), F.try_add(F.try_multiply(m, F.lit(60_000)), F.try_add(F.try_multiply(s, F.lit(1000)), ms)))

    return total(0), total(4)


def parse_timing(c: Column) -> tuple[Column, Column]:
    """(from, to) in milliseconds, null where the line has no timing or a number is out of range. ',5' is 5 ms."""
    return from_parts(time_parts(c))


def format_time(ms: Column) -> Column:
    """HH:MM:SS,mmm; hours may have more than two digits."""
    whole = lambda x: F.floor(x).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", whole(ms / 3_600_000), whole(ms / 60_000) % 60, whole(ms / 1000) % 60, ms % 1000)


def format_timing(start: Column, stop: Column) -> Column:
    return F.concat(format_time(start), F.lit(" --> "), format_time(stop))


def parse_duration(text: str) -> int:
    """Nanoseconds of "500ms", "-2s", "1s250ms"; "0" needs no unit."""
    body = text.removeprefix("-").removeprefix("+") if text[:1] in "+-" else text
    if body == "0":
        return 0
    total, at = Decimal(0), 0
    while at < len(body) and (m := _PART.match(body, at)):
        total += Decimal(m[1]) * _UNITS[m[2]]
        at = m.end()
    if not body or at < len(body):
        raise ValueError(f"not a duration: {text!r}")
    return int(total) * (-1 if text.startswith("-") else 1)
