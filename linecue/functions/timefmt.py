"""Seconds as text and back: clock, subtitle, timecode and chapter formats as column expressions.

Everything rounds halves up, as `floor(x + 0.5)` of whole units. A null time
gives null; a negative one gives null too, as no format can show it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from linecue.errors import Unusable
from linecue.functions.unicode import bound

# Frames a second of the timelines that marker files are made for.
RATES = (23.976, 24, 25, 29.97, 30, 50, 59.94, 60)


def _whole(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")


def format_time(seconds: Column) -> Column:
    """`MM:SS.s`, from an hour on `H:MM:SS.s`."""
    tenths = _whole(seconds * 10)
    low = lambda unit, of: (F.floor(tenths / unit) % of).cast("long")
    hours = F.floor(tenths / 36000).cast("long")
    long_form = F.format_string("%d:%02d:%02d.%d", hours, low(600, 60), low(10, 60), tenths % 10)
    short_form = F.format_string("%02d:%02d.%d", low(600, 60), low(10, 60), tenths % 10)
    return F.when(seconds >= 0, F.when(hours > 0, long_form).otherwise(short_form))


def parse_time(text: Column) -> Column:
    """Seconds of `MM:SS`, `MM:SS.s`, `H:MM:SS` or `H:MM:SS.s`; null where minutes or seconds reach 60 or the text is no time."""
    fields = F.split(F.trim(text), ":")
    n = F.size(fields)
    second, minute, hour = F.get(fields, n - 1), F.get(fields, n - 2), F.get(fields, n - 3)
    good = n.between(2, 3) & second.rlike(r"^\d\d(\.\d+)?$") & minute.rlike(r"^\d\d?$") & F.coalesce(hour.rlike(r"^\d+$"), F.lit(True))
    good = good & (minute.try_cast("int") < 60) & (second.try_cast("double") < 60)
    return F.when(good, F.coalesce(hour.try_cast("int"), F.lit(0)) * 3600 + minute.try_cast("int") * 60 + second.try_cast("double"))


def format_srt_time(seconds: Column) -> Column:
    """`HH:MM:SS,mmm`."""
    millis = _whole(seconds * 1000)
    low = lambda unit, of: (F.floor(millis / unit) % of).cast("long")
    text = F.format_string("%02d:%02d:%02d,%03d", F.floor(millis / 3_600_000).cast("long"), low(60_000, 60), low(1000, 60), millis % 1000)
    return F.when(seconds >= 0, text)


class Timebase(NamedTuple):
    """Frames a second of a timeline, how many of them its timecodes count to a second, and its first frame's number."""

    rate: float
    counted: int
    first: int


def timebase(rate: float = 30.0, first: str = "01:00:00:00") -> Timebase:
    """A timeline that begins at the timecode `first`."""
    wrong = [] if rate in RATES else [f"{rate:g} is no frame rate of a timeline, which are {RATES}"]
    units = first.strip().split(":")
    below = [100, 60, 60, round(rate)]  # 29.97 frames a second are counted as 30
    if len(units) != 4 or not all(len(u) == 2 and u.isascii() and u.isdigit() and int(u) < most for u, most in zip(units, below, strict=False)):
        wrong.append(f"{first} is no timecode at {rate:g} frames a second")
    if wrong:
        raise Unusable(wrong)
    number = 0
    for unit, most in zip(units, below, strict=True):
        number = number * most + int(unit)
    return Timebase(rate, round(rate), number)


def frame_of(seconds: Column, base: Timebase) -> Column:
    """Number of the nearest frame."""
    return _whole(seconds * base.rate) + base.first


def timecode(frame: Column, base: Timebase) -> Column:
    """`HH:MM:SS:FF` of a frame number."""
    whole = F.floor(frame / base.counted).cast("long")
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(whole / 3600).cast("long"), (F.floor(whole / 60) % 60).cast("long"), whole % 60, frame % base.counted)


def chapter_clock(seconds: Column, hours: Column) -> Column:
    """Whole seconds, rounded down: `H:MM:SS` where `hours` is true, else `MM:SS` with all minutes."""
    whole = F.floor(seconds).cast("long")
    minutes = F.floor(whole / 60).cast("long")
    return F.when(hours, F.format_string("%d:%02d:%02d", F.floor(minutes / 60).cast("long"), minutes % 60, whole % 60)).otherwise(F.format_string("%02d:%02d", minutes, whole % 60))


def short_number(value: Column) -> Column:
    """Three decimals at most and one at least: 3 is `3.0`."""
    text = F.regexp_replace(F.format_string("%.3f", value), "0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def to_millis(seconds: Column) -> Column:
    """Seconds at three decimals, halves to even on the decimal value."""
    return F.bround(seconds, 3)


def fixed(value: Column, places: int) -> Column:
    """Text with so many decimals, as C and Python write it: rounded on the exact binary value, which format_string doesn't, halves to even."""
    low, ten = (1 << 30) - 1, 10**places

    def text(bits: Column) -> Column:
        # bits: what is behind the point in units of 2^-60; times ten^places, in two halves of 30 bits.
        small = bits.bitwiseAND(F.lit(low)) * ten
        great = F.shiftright(bits, 30) * ten + F.shiftright(small, 30)
        digits, rest = F.shiftright(great, 30), F.shiftleft(great.bitwiseAND(F.lit(low)), 30).bitwiseOR(small.bitwiseAND(F.lit(low)))
        half = F.lit(1 << 59)
        up = F.when((rest > half) | ((rest == half) & (digits % 2 == 1)), 1).otherwise(0)
        whole = F.floor(F.abs(value)).cast("long")
        return bound(whole * ten + digits + up, lambda n: F.concat(F.when(value < 0, "-").otherwise(""), F.floor(n / ten).cast("long").cast("string"), F.lit("."), F.lpad((n % ten).cast("string"), places, "0")))

    return bound(((F.abs(value) - F.floor(F.abs(value))) * float(1 << 60)).cast("long"), text)
