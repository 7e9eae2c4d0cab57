"""Writers of the result files and of the run directory."""

from __future__ import annotations

import uuid
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import preview

# The columns of the review file, in order.
REVIEW = ("video_url", "segment_id", "title", "creator_label", "upload_date", "timecode_in", "timecode_out", "segment_duration_seconds", "topic", "segment_transcript_preview", "segment_transcript")


def run_directory(output: str, source: str, now: datetime | None = None) -> str:
    """A folder of its own for each run: time and name of the input."""
    return f"{output.rstrip('/')}/{(now or datetime.now()):%Y-%m-%d_%H%M%S}_{Path(source).stem}"


def write_csv(df: DataFrame, path: str, single: bool = False, mode: str = "errorifexists") -> None:
    """CSV with a header, every value quoted, quotes doubled, spaces at the ends kept, nulls and empties as empty quotes. ``single``: one file, for summaries."""
    options = {"header": True, "quoteAll": True, "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    (df.coalesce(1) if single else df).write.options(**options).mode(mode).csv(path)


def review_rows(segments: DataFrame) -> DataFrame:
    """The review columns of ``segments``; those that are missing are empty, others are dropped."""
    df = segments.withColumn("segment_transcript_preview", preview(F.col("segment_transcript")))
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in REVIEW])


def write_json_array(df: DataFrame, path: str, *order: str) -> None:
    """One JSON array in one file, with characters as they are and nulls written out, in the order of the rows or by ``order``.

    The tasks write the rows; the driver puts their files together byte by byte, so nothing of a result has to fit in
    memory. The file appears when it is whole; one that is there is replaced.
    """
    spark = df.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    rows = df.orderBy(*order) if order else df
    rows.select(F.concat(F.lit(","), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))).write.text(parts)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = place(f"{parts}/whole")
    out, empty = fs.create(whole, True), True
    out.write(bytearray(b"["))
    for name in sorted(s.getPath().getName() for s in fs.listStatus(place(parts)) if s.getPath().getName().startswith("part-") and s.getLen()):
        part = fs.open(place(f"{parts}/{name}"))
        if empty:
            part.read()  # the comma before the first row
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
        part.close()
        empty = False
    out.write(bytearray(b"]\n"))
    out.close()
    fs.delete(place(path), True)
    fs.rename(whole, place(path))
    fs.delete(place(parts), True)


def label_first(df: DataFrame, last: list[str]) -> DataFrame:
    """``df`` with the columns ``last`` at its end."""
    return df.select(*[c for c in df.columns if c not in last], *last)
