"""Closed-vocabulary classification of segments in batches, with a cache of answers and fallbacks.

Batches are numbered from the position of the rows, their keys hash the model, the prompt, the segment keys and the
texts, and one model call answers a batch. Answers go to a Parquet cache, one folder a run; what failed isn't cached.
"""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from talkmill.functions.text import PROMPT_CHARS, preview
from talkmill.models import CLASS_RETRY, ModelClient, Retry
from talkmill.operators.summary import NOT_DISCUSSED, SENTIMENTS
from talkmill.session import cut, path_exists

BATCH = 20


def batch_columns(df: DataFrame, pos: str = "pos", size: int = BATCH) -> DataFrame:
    """``df`` with batch_id and idx, the place in the batch, from the 0-based position."""
    if size < 1:
        raise ValueError("a batch has at least one row")
    return df.withColumns({"batch_id": F.expr(f"{pos} div {size}"), "idx": (F.col(pos) % size).cast("int")})


def batch_keys(df: DataFrame, model: str, system: str) -> DataFrame:
    """(batch_id, key) over rows with batch_id, idx, video_url, segment_id and segment_transcript.

    The key covers the texts as well as the segment keys, so an edited text is asked again.
    """
    part = F.concat_ws("::", F.coalesce("video_url", F.lit("")), F.coalesce(F.col("segment_id").cast("string"), F.lit("")), F.sha2(F.coalesce("segment_transcript", F.lit("")), 256))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", part.alias("p")))), lambda x: x["p"]), "|")
    return df.groupBy("batch_id").agg(F.sha2(F.concat_ws("|", F.lit(model), F.lit(system), parts), 256).alias("key"))


def label_prompt(labels: list[tuple[str, str | None]], fallback: str) -> str:
    lines = "\n".join(f"- {name}: {text}" if text else f"- {name}" for name, text in labels)
    return f"Each numbered text is one segment of a long recording. Give every segment exactly one category from the list, the one that fits its main subject best. Use no other wording. Where the subject is unclear or there is only filler, answer {fallback}.\n\nCategories:\n{lines}"


def label_schema(labels: list[str]) -> dict:
    item = {"type": "object", "properties": {"index": {"type": "integer"}, "label": {"type": "string", "enum": labels}}, "required": ["index", "label"], "additionalProperties": False}
    return {"type": "object", "properties": {"classifications": {"type": "array", "items": item}}, "required": ["classifications"], "additionalProperties": False}


def subtopic_prompt(subtopics: list[tuple[str, str | None]]) -> str:
    lines = "\n".join(f"- {name}: {text}" if text else f"- {name}" for name, text in subtopics)
    return f"Each numbered text is one segment of a long recording. Judge every subtopic of the list on its own: {NOT_DISCUSSED} unless the segment treats it in substance, else the stance taken towards the subtopic itself, whatever the tone of the segment. Use only the text given.\n\nSubtopics:\n{lines}"


def subtopic_schema(slugs: list[str]) -> dict:
    props = {"index": {"type": "integer"}} | {s: {"type": "string", "enum": [NOT_DISCUSSED, *SENTIMENTS]} for s in slugs}
    item = {"type": "object", "properties": props, "required": list(props), "additionalProperties": False}
    return {"type": "object", "properties": {"classifications": {"type": "array", "items": item}}, "required": ["classifications"], "additionalProperties": False}


def user_prompt(texts: list[str]) -> str:
    return f"{len(texts)} segments follow.\n\n" + "\n\n".join(f"[{i}] {t[:PROMPT_CHARS]}" for i, t in enumerate(texts))


def ask(df: DataFrame, client: ModelClient, system: str, schema: dict, retry: Retry = CLASS_RETRY, parallel: int | None = None) -> DataFrame:
    """``df`` (with batch_id, idx and segment_transcript) with answer, status and error; one call a batch.

    ``answer`` is the JSON object of the row without its index; of indices given twice the last holds and those out of
    range are dropped. A batch that fails has status failed and null answers. The rows of a batch are brought together
    with all their columns, which is the only time that they shuffle. Batches have a fixed size, so a group is never
    large; ``parallel`` is how many are asked at once, as many as there are partitions if it isn't given.
    """

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("idx")
        got: dict[int, Any] = {}
        status, error = "ok", None
        try:
            reply = retry.call(client, system, user_prompt([t or "" for t in batch["segment_transcript"].to_pylist()]), schema)
            for c in reply["classifications"]:
                got[int(c["index"])] = {k: v for k, v in c.items() if k != "index"}
        except Exception as e:  # noqa: BLE001 - a failed batch takes the fallback, the run goes on
            status, error = "failed", str(e)[:500]
        answers = [json.dumps(got[i], ensure_ascii=False) if i in got else None for i in range(batch.num_rows)]
        for name, values in (("answer", answers), ("status", [status] * batch.num_rows), ("error", [error] * batch.num_rows)):
            batch = batch.append_column(name, pa.array(values, pa.string()))
        return batch

    out = StructType([*df.schema.fields, *[StructField(c, StringType()) for c in ("answer", "status", "error")]])
    return (df.repartition(parallel, "batch_id") if parallel else df).groupBy("batch_id").applyInArrow(run, out)


class AnswerCache:
    """Answers by batch key, as Parquet under ``path``; the latest of several for a key and index holds."""

    kind = "key string, idx int, answer string, written_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """(key, idx, answer); empty before anything has been written. A cache that can't be read is an error, as all would be asked again."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], "key string, idx int, answer string")
        rows = self.spark.read.schema(self.kind).parquet(self.path)
        return rows.groupBy("key", "idx").agg(F.max_by("answer", "written_at").alias("answer"))

    def write(self, answers: DataFrame) -> None:
        answers.select("key", "idx", "answer").withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(self.path)


def classify(df: DataFrame, client: ModelClient, system: str, schema: dict, cache: AnswerCache | None = None, pos: str = "pos", size: int = BATCH, retry: Retry = CLASS_RETRY, parallel: int | None = None) -> DataFrame:
    """``df`` with ``answer`` (JSON or null) and ``status`` (ok, cached or failed); answers that are cached aren't asked for again.

    Keys are made and looked up without the texts. Then each row shuffles once: to the answers of its batch, or to the
    call of its batch.
    """
    rows = batch_columns(df, pos, size)
    own = ["batch_id", "idx"]
    if cache is None:
        return ask(rows, client, system, schema, retry, parallel).drop(*own, "error")
    keys = cut(batch_keys(rows, client.name, system))
    answers = F.map_from_entries(F.collect_list(F.struct("idx", "answer")))  # of one batch
    known = cut(keys.join(cache.read().groupBy("key").agg(answers.alias("_known")), "key"))
    misses = keys.join(known.select("key").distinct(), "key", "left_anti").select("batch_id")
    new = cut(ask(rows.join(misses, "batch_id"), client, system, schema, retry, parallel))  # asked once, used for the cache and the result, whatever executors are lost
    cache.write(new.filter("status = 'ok'").select(*own, "answer").join(keys, "batch_id"))
    hits = rows.join(known.select("batch_id", "_known"), "batch_id").withColumns({"answer": F.get(F.array(F.col("_known")[F.col("idx")]), 0), "status": F.lit("cached")})
    return hits.drop("_known").unionByName(new.drop("error")).drop(*own)


def with_labels(answered: DataFrame, labels: list[str], fallback: str) -> DataFrame:
    """``codebook_label`` from the answers; what is missing or not in the codebook becomes the fallback."""
    label = F.get_json_object("answer", "$.label")
    return answered.withColumn("codebook_label", F.when(label.isin(labels), label).otherwise(F.lit(fallback))).drop("answer")


def with_sentiments(answered: DataFrame, slugs: list[str]) -> DataFrame:
    """A column a subtopic and the map ``sentiments``; what is missing or no sentiment becomes not_discussed."""
    got = F.from_json("answer", "map<string,string>")
    value = lambda s: F.when(F.get(F.array(got[s]), 0).isin(*SENTIMENTS), got[s]).otherwise(NOT_DISCUSSED)
    return answered.withColumns({s: value(s) for s in slugs} | {"sentiments": F.create_map(*[x for s in slugs for x in (F.lit(s), value(s))])}).drop("answer")


def fill_missing(rows: DataFrame, replies: DataFrame, on: list[str], value: str, fallback: str) -> DataFrame:
    """``rows`` with the replies of the same place, and the fallback where there is none."""
    return rows.join(replies.select(*on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(fallback)))


def prompt_text(c: Column) -> Column:
    return preview(c, PROMPT_CHARS)
