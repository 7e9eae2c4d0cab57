"""Videos that arrive in batches, as streams. An extension: the three stages by themselves work on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from talkmill.models import ModelClient
from talkmill.plans.pipelines import segment_videos


def arriving(spark: SparkSession, path: str, schema: StructType, files_a_trigger: int = 16) -> DataFrame:
    """Parquet files as they appear under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def new_videos(stream: DataFrame, time: str = "arrived_at", key: str = "source_url", delay: str = "7 days") -> DataFrame:
    """Each address once within ``delay`` of event time; later rows are dropped with their state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def arrivals_by_creator(stream: DataFrame, time: str = "arrived_at", window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """(window, creator, n_videos) in tumbling windows of event time; rows later than ``delay`` don't count."""
    creator = F.lower(F.trim("creator_label"))
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("window"), creator.alias("creator")).agg(F.count(F.lit(1)).alias("n_videos"))


def segment_stream(stream: DataFrame, client: ModelClient, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Segments of each micro-batch, a folder a batch under ``out``; a batch that is run again replaces its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        segment_videos(batch, client).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
