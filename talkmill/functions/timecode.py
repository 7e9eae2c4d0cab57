"""Time expressions in milliseconds of the video; null where a value can't be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkmill.functions.text import strip


def ms_to_timecode(ms: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on; fractions of a second are cut off."""
    s = F.floor(ms / 1000)
    h, m, sec = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(sec))).when(s.isNotNull(), F.concat_ws(":", m.cast("string"), two(sec)))


def timecode_to_ms(tc: Column) -> Column:
    """Of M:SS or H:MM:SS in whole numbers; 0 for another number of parts, null if a part is no whole number."""
    parts = F.split(strip(tc), ":")
    number = lambda i: F.when(F.get(parts, i).rlike(r"^[ ]*[+-]?[0-9]{1,15}[ ]*\z"), F.get(parts, i).try_cast("bigint"))
    two, three = number(0) * 60 + number(1), number(0) * 3600 + number(1) * 60 + number(2)
    return F.when(F.size(parts) == 2, two * 1000).when(F.size(parts) == 3, three * 1000).when(tc.isNotNull(), F.lit(0))


def both_or_zero(a: Column, b: Column) -> tuple[Column, Column]:
    """Two times that are both 0 if either is null."""
    bad = a.isNull() | b.isNull()
    return F.when(bad, F.lit(0)).otherwise(a).cast("bigint"), F.when(bad, F.lit(0)).otherwise(b).cast("bigint")


def safe_seconds(value: Column) -> Column:
    """A duration as a double; null and blank give 0, what can't be read null."""
    v = strip(value)
    return F.when(F.coalesce(v == "", F.lit(True)), F.lit(0.0)).when(v.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"), v.try_cast("double"))
