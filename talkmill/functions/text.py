"""Text expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and \s see it: Unicode, with the separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"

#: Lengths in code points of what goes into prompts and into previews.
PROMPT_CHARS, PREVIEW_CHARS = 700, 300
#: Fixed value: a transcript with this phrase is a page that has no captions.
NO_CAPTIONS = "About Press Copyright Contact us Creators Advertise"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return strip(F.regexp_replace(c, SPACE, " "))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only; never null."""
    return F.coalesce(strip(c) == "", F.lit(True))


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), r"^_+|_+\z", "")


def preview(c: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(c, 1, chars)


def sentences(c: Column) -> Column:
    """Array of what stands between sentence ends followed by white space, trimmed, without empty ones."""
    parts = F.split(F.regexp_replace(c, r"([.!?])[ \t\n\f\r]+", "$1\u0001"), "\u0001")
    trimmed = F.transform(parts, lambda x: F.regexp_replace(x, r"^[ \t\n\f\r]+|[ \t\n\f\r]+\z", ""))
    return F.filter(trimmed, lambda x: x != "")


def first_colon(c: Column) -> tuple[Column, Column]:
    """What stands before and after the first colon, stripped; the second is null where there is none."""
    parts = F.split(c, ":", 2)
    return strip(F.get(parts, 0)), strip(F.get(parts, 1))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)
