"""Readers of the input files: videos, segments cut before, codebooks, definitions, subtopics and earlier results."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.text import NO_CAPTIONS, first_colon, is_blank, slug, strip
from talkmill.functions.timecode import both_or_zero, safe_seconds, timecode_to_ms
from talkmill.operators.vocabulary import with_position
from talkmill.session import path_exists

# Fixed value: the longest field a CSV file may have.
LONGEST_FIELD = 10_000_000


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; quoted line breaks and doubled quotes are read, a byte order mark is dropped."""
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=LONGEST_FIELD, encoding="UTF-8").csv(path)


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def valid_videos(videos: DataFrame) -> DataFrame:
    """Videos with an address and a transcript that isn't that of a page without captions."""
    t = strip(F.col("transcript"))
    return require(videos, "source_url", "transcript").filter(~is_blank(F.col("source_url")) & ~is_blank(F.col("transcript")) & ~t.contains(NO_CAPTIONS))


def metadata_columns(videos: DataFrame, position: str | None = None) -> dict[str, Column]:
    """What goes with each segment of a video: all columns but the transcript as stripped strings, nulls empty, its 1-based position in the input if it is given, and the duration to three places, empty if it is 0."""
    out = {c: F.coalesce(strip(F.col(c).cast("string")), F.lit("")) for c in videos.columns if c not in ("transcript", position)}
    if position:
        out["input_row_index"] = F.col(position).cast("string")
    seconds = F.coalesce(safe_seconds(F.col("duration_seconds").cast("string")), F.lit(0.0)) if "duration_seconds" in videos.columns else F.lit(0.0)
    out["video_duration_seconds"] = F.when(seconds > 0, F.round(seconds, 3).cast("string")).otherwise("")
    return out


def metadata(videos: DataFrame, position: str | None = None) -> Column:
    """:func:`metadata_columns` as a map."""
    return F.create_map(*[x for name, c in metadata_columns(videos, position).items() for x in (F.lit(name), c)])


def valid_segments(segments: DataFrame, keep_bad_seconds_null: bool = False) -> DataFrame:
    """Segments with an address and text, with their times in milliseconds and their seconds.

    Missing timecodes are 0:00; if either can't be read both are 0. A missing duration is 0; one that can't be read
    is the difference of the times.
    """
    df = require(segments, "video_url", "segment_transcript").filter(~is_blank(F.col("video_url")) & ~is_blank(F.col("segment_transcript")))
    for c in ("timecode_in", "timecode_out"):
        df = df.withColumn(c, F.coalesce(F.nullif(strip(F.col(c)), F.lit("")), F.lit("0:00")) if c in df.columns else F.lit("0:00"))
    a, b = both_or_zero(timecode_to_ms(F.col("timecode_in")), timecode_to_ms(F.col("timecode_out")))
    df = df.withColumns({"timecode_in_ms": a, "timecode_out_ms": b})
    if "segment_duration_seconds" not in df.columns:
        return df.withColumn("segment_duration_seconds", F.lit(0.0))
    if dict(df.dtypes)["segment_duration_seconds"] == "string":
        seconds = F.coalesce(safe_seconds(F.col("segment_duration_seconds")), (F.col("timecode_out_ms") - F.col("timecode_in_ms")) / 1000)
    else:
        seconds = F.coalesce(F.col("segment_duration_seconds").cast("double"), F.lit(0.0))
    return df.withColumn("segment_duration_seconds", seconds)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A text file of ``label: definition`` lines, split at the first colon, in order."""
    lines = with_position(spark.read.text(path))
    label, definition = first_colon(F.col("value"))
    return lines.select("pos", label.alias("label"), definition.alias("definition")).filter("label <> ''")


def read_labels(spark: SparkSession, path: str, definitions_column: str = "definition") -> DataFrame:
    """(pos, label, definition) of a codebook or a list of subtopics, as CSV or as lines."""
    if not path.lower().endswith(".csv"):
        return read_lines(spark, path)
    df = require(with_position(read_csv(spark, path)), "label")
    definition = strip(F.col(definitions_column)) if definitions_column in df.columns else F.lit(None).cast("string")
    return df.select("pos", strip(F.col("label")).alias("label"), definition.alias("definition")).filter(~is_blank(F.col("label")))


def read_definitions(spark: SparkSession, path: str, column: str = "definition") -> DataFrame:
    """(key, definition): by label without case, the last of several."""
    df = require(with_position(read_csv(spark, path)), "label", column)
    return df.filter(~is_blank(F.col("label"))).groupBy(F.lower(strip(F.col("label"))).alias("key")).agg(F.max_by(F.coalesce(strip(F.col(column)), F.lit("")), "pos").alias("definition"))


def read_subtopics(spark: SparkSession, path: str) -> DataFrame:
    df = read_labels(spark, path)
    return df.withColumn("slug", slug(F.col("label")))


def _is_array(spark: SparkSession, path: str) -> bool:
    """Whether a file begins as a JSON array; a folder has records in lines."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        return False
    f = fs.open(p)
    try:
        c = f.read()
        while c != -1 and c in b" \t\r\n\xef\xbb\xbf":
            c = f.read()
        return c == ord("[")
    finally:
        f.close()


def processed_urls(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(video_url) of the segments of earlier runs, once each: arrays as this engine and others write them, or records in lines.

    A file that isn't there is warned of and left out.
    """
    out = spark.createDataFrame([], "video_url string")
    for path in paths:
        if not path_exists(spark, path):
            warnings.warn(f"no segments at {path}; nothing is skipped for it", stacklevel=2)
            continue
        out = out.unionByName(spark.read.schema("video_url string").option("multiLine", _is_array(spark, path)).json(path))
    return out.filter("video_url is not null").distinct()
