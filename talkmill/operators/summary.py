"""The two summaries: segments by label and by subtopic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkmill.functions.text import PREVIEW_CHARS, preview, strip

SAMPLES = 3
SENTIMENTS = ("positive", "negative", "neutral")
NOT_DISCUSSED = "not_discussed"


def first_samples(df: DataFrame, key: str, pos: str, text: str, n: int = SAMPLES) -> DataFrame:
    """(key, samples): ``text`` of the first ``n`` rows of each key by ``pos``.

    The limit on the rank is applied in each task before the shuffle (a partial window group limit), so a key with
    most of the rows sends ``n`` rows a task like any other.
    """
    ranked = df.select(key, pos, text).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(pos))).filter(F.col("_r") <= n)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", text))), lambda x: x[text]).alias("samples"))


def label_summary(segments: DataFrame, codebook: DataFrame, fallback: str, pos: str = "pos") -> DataFrame:
    """A row for each label of ``codebook`` (pos, label): n_segments, runtime, three samples; labels without segments have zeros.

    ``segments`` has codebook_label, segment_duration_seconds, segment_transcript and ``pos``; a null label counts as ``fallback``.
    """
    s = segments.select(F.coalesce("codebook_label", F.lit(fallback)).alias("label"), "segment_duration_seconds", preview(strip(F.col("segment_transcript"))).alias("sample"), pos)
    agg = s.groupBy("label").agg(F.count(F.lit(1)).alias("n_segments"), F.round(F.sum(F.col("segment_duration_seconds").cast("decimal(18,3)")), 1).cast("double").alias("total_runtime_seconds"))
    agg = agg.join(first_samples(s, "label", pos, "sample"), "label", "left")
    out = codebook.select(F.col("pos").alias("_order"), "label").join(agg, "label", "left")
    samples = [F.coalesce(F.get("samples", F.lit(i)), F.lit("")).alias(f"sample_{i + 1}") for i in range(SAMPLES)]
    return out.select("_order", "label", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("total_runtime_seconds", F.lit(0.0)).alias("total_runtime_seconds"), *samples).orderBy("_order").drop("_order")


def subtopic_summary(segments: DataFrame, subtopics: DataFrame, pos: str = "pos", sentiments: str = "sentiments") -> DataFrame:
    """A row for each subtopic (pos, slug), most discussed first: counts by sentiment, share of all segments, runtime, samples.

    ``segments`` has a map ``sentiments`` from slug to sentiment; what isn't one of SENTIMENTS counts as not discussed.
    """
    entries = segments.select(pos, F.coalesce("segment_duration_seconds", F.lit(0.0)).alias("seconds"), preview(strip(F.col("segment_transcript"))).alias("sample"), F.explode(sentiments).alias("slug", "sentiment")).filter(F.col("sentiment").isin(*SENTIMENTS))
    counts = [F.count_if(F.col("sentiment") == s).alias(f"n_{s}") for s in SENTIMENTS]
    agg = entries.groupBy("slug").agg(F.count(F.lit(1)).alias("n_segments_discussed"), *counts, F.round(F.sum(F.col("seconds").cast("decimal(18,3)")), 1).cast("double").alias("total_runtime_seconds_discussed"))
    agg = agg.join(first_samples(entries, "slug", pos, "sample"), "slug", "left")
    n_total = segments.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = subtopics.select(F.col("pos").alias("_order"), "slug").join(agg, "slug", "left")
    number = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    pct = F.when(n_total > 0, F.round(100 * F.coalesce("n_segments_discussed", F.lit(0)) / n_total, 2)).otherwise(0.0).alias("pct_of_filtered")
    samples = [F.coalesce(F.get("samples", F.lit(i)), F.lit("")).alias(f"sample_{i + 1}") for i in range(SAMPLES)]
    out = out.select("_order", F.col("slug").alias("subtopic"), number("n_segments_discussed", 0), pct, *[number(f"n_{s}", 0) for s in SENTIMENTS], number("total_runtime_seconds_discussed", 0.0), *samples)
    return out.orderBy(F.desc("n_segments_discussed"), "_order").drop("_order")
