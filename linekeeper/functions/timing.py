"""Time and number functions: tags, clock texts, clamps, falsy defaults."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# Fixed value: one time tag: minutes, seconds, fraction.
TAG = r"\[([0-9]{1,3}):([0-9]{2})(?:\.([0-9]{1,3}))?\]"


def tag_cs(text: Column) -> Column:
    """Centiseconds of the first tag, its fraction cut off after two digits; null without a tag."""
    minutes, seconds, fraction = (F.regexp_extract(text, TAG, k) for k in (1, 2, 3))
    cs = (minutes.cast("int") * 60 + seconds.cast("int")) * 100 + F.rpad(fraction, 2, "0").cast("int")
    return F.when(text.rlike(TAG), cs)


def clock(seconds: Column) -> Column:
    """mm:ss.cc, negative times as zero, carries into seconds and minutes."""
    cs = F.bround(F.greatest(F.lit(0.0), seconds) * 100, 0).cast("long")
    return F.format_string("%02d:%02d.%02d", (cs / 6000).cast("long"), (F.pmod(cs, F.lit(6000)) / 100).cast("long"), F.pmod(cs, F.lit(100)))


def audit_clock(seconds: Column) -> Column:
    """mm:ss.ss of audits: rounded seconds don't carry into minutes (59.996 is 00:60.00); null is ''."""
    minutes = F.floor(seconds / 60)
    return F.when(seconds.isNull(), "").otherwise(F.format_string("%02d:%05.2f", minutes, seconds - minutes * 60))


def millis(seconds: Column) -> Column:
    """Seconds rounded to three digits by their product with 1000, half away from zero: as ``round`` of DuckDB does, where Spark's goes by the shortest decimal text."""
    return F.round(seconds * 1000) / 1000


def percent(part: Column, total: Column) -> Column:
    """100 * part / total, two digits; a total of 0 counts as 1."""
    return F.round(part * 100.0 / F.greatest(F.lit(1), total), 2)


def truthy(value: Column, default: object) -> Column:
    """Value, or the default (a constant or a column) where it is null or 0."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)


def monotone(time: Column, position: Column, gap: float, ordered: WindowSpec) -> Column:
    """t[i] = max(t[i], t[i-1] + gap) in order, as a running maximum of t - gap * i."""
    return F.max(time - position * gap).over(ordered) + position * gap
