"""Joins of utterances with segments and of videos with what was processed before, on exploded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Time is cut into buckets of this length for the overlap join, so that one long video is joined by many tasks.
BUCKET_MS = 300_000
#: Addresses are sent to every task up to so many bytes of them; beyond that the table is shuffled.
MOST_BYTES = 128 << 20


def overlap_join(utterances: DataFrame, spans: DataFrame, key: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Every utterance with every span of its video that it overlaps by more than a border.

    Both sides stand in each bucket of time that they touch and meet on (key, bucket); a pair counts in the bucket where
    the later of the two starts, so it comes out once. Null keys match nothing. Both sides keep their columns;
    ``spans`` has a and b.
    """
    at = lambda c: F.floor(c / bucket_ms)
    touched = lambda a, b: F.explode(F.sequence(at(a), F.greatest(at(a), at(b)))).alias("_bucket")
    u = utterances.select("*", touched(F.col("start_ms"), F.col("end_ms"))).alias("u")
    s = spans.select("*", touched(F.col("a"), F.col("b"))).alias("s")
    on = (F.col(f"u.{key}") == F.col(f"s.{key}")) & (F.col("u._bucket") == F.col("s._bucket")) & (F.col("u.end_ms") > F.col("s.a")) & (F.col("u.start_ms") < F.col("s.b"))
    pairs = u.join(s, on).filter(F.col("u._bucket") == at(F.greatest("u.start_ms", "s.a")))
    return pairs.select(*[F.col(f"s.{c}") for c in spans.columns], *[F.col(f"u.{c}") for c in utterances.columns if c != key])


def _fits(keys: DataFrame, most: int) -> bool:
    return keys.agg(F.coalesce(F.sum(F.octet_length(keys.columns[0]) + 16), F.lit(0))).first()[0] <= most


def unprocessed(videos: DataFrame, earlier: DataFrame, url: str = "source_url", address: Column | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Videos whose address is not among ``earlier`` (video_url); null addresses stay. ``address`` is the form to compare, the column itself if it isn't given.

    Addresses are joined without the transcripts. The earlier ones, or of them those that are here, or the new ones, are sent to
    every task where their size allows, so that no transcript shuffles; only where all three are too large does the table.
    """
    address = F.col(url) if address is None else address
    known = earlier.select(F.col("video_url").alias("_a")).filter(F.col("_a").isNotNull()).distinct()
    rows = videos.withColumn("_a", address)
    nulls, given = rows.filter(F.col("_a").isNull()), rows.filter(F.col("_a").isNotNull())
    if _fits(known, most_bytes):
        return rows.join(F.broadcast(known), "_a", "left_anti").select(*videos.columns)
    own = given.select("_a").distinct()
    hits, new = own.join(known, "_a", "left_semi"), own.join(known, "_a", "left_anti")
    if _fits(hits, most_bytes):
        return rows.join(F.broadcast(hits), "_a", "left_anti").select(*videos.columns)
    left = given.join(F.broadcast(new), "_a", "left_semi") if _fits(new, most_bytes) else given.join(known, "_a", "left_anti")
    return left.unionByName(nulls).select(*videos.columns)
