"""The three stages: videos to segments, segments to labels, labelled segments to subtopics."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from talkmill.functions.arrow import map_rows
from talkmill.functions.text import strip
from talkmill.functions.timecode import ms_to_timecode
from talkmill.models import BOUNDARY_RETRY, CLASS_RETRY, ModelClient, Retry
from talkmill.operators import classify as cl
from talkmill.operators import sequence as seq
from talkmill.operators.overlap import unprocessed
from talkmill.operators.summary import label_summary, subtopic_summary
from talkmill.operators.vocabulary import check_slugs, fallback_label, with_position
from talkmill.sources.tables import metadata_columns, valid_videos
from talkmill.sources.transcripts import utterances

BOUNDARY_SYSTEM = (
    "You get part of a recording as timed blocks. Divide it into segments by topic: without gaps or overlaps, each at least 60 seconds long, joined where the change of topic is weak. "
    "The first begins at chunk_start_ms and the last ends at chunk_end_ms. Answer with times only."
)
BOUNDARY_SCHEMA = {
    "type": "object",
    "properties": {"segments": {"type": "array", "items": {"type": "object", "properties": {"timecode_in_ms": {"type": "integer"}, "timecode_out_ms": {"type": "integer"}}, "required": ["timecode_in_ms", "timecode_out_ms"], "additionalProperties": False}}},
    "required": ["segments"],
    "additionalProperties": False,
}

#: Labels or subtopics that a prompt may have; more are an error.
MOST_LABELS = 5000


def chunked(read: DataFrame, chunk_ms: int, overlap_ms: int) -> DataFrame:
    """``read`` (with utterances) and, for each of its chunks, span, owned span and the blocks that go into the prompt."""
    t0, t1 = seq.extent(F.col("utterances"))
    df = read.withColumns({"utterances": seq.complete_ends(F.col("utterances"))}).withColumns({"t0": t0, "t1": t1})
    df = seq.settled(df, utterances=F.col("utterances"), t0=F.col("t0"), t1=F.col("t1"), spans=seq.chunk_spans(F.col("t0"), F.col("t1"), chunk_ms, overlap_ms))
    df = df.withColumn("own", seq.owned(F.col("spans"), overlap_ms))
    return df.withColumn("blocks", seq.span_blocks(F.col("utterances"), F.col("spans")))


def ask_boundaries(df: DataFrame, client: ModelClient, retry: Retry = BOUNDARY_RETRY) -> DataFrame:
    """``df`` with ``replies``, an array of bounds for each chunk, and ``failed``; a chunk without blocks isn't asked about.

    Calls are made where the rows are; the number of partitions bounds how many run at once. A video one of whose
    calls fails is marked and left without segments, the others go on.
    """
    rest = [c for c in df.columns if c not in ("spans", "blocks")]
    schema = StructType([*[df.schema[c] for c in ("spans", "blocks", *rest)], *_parse_datatype_string("replies array<array<struct<a:bigint,b:bigint>>>, failed string").fields])

    def run(_: None, all_spans: list, all_blocks: list, *others: list) -> list:
        replies, failed = [], []
        for spans, blocks in zip(all_spans, all_blocks):
            out, error = [], None
            try:
                for s, b in zip(spans, blocks):
                    got = []
                    if b:
                        user = json.dumps({"chunk_start_ms": s["a"], "chunk_end_ms": s["b"], "blocks": b}, ensure_ascii=False)
                        got = [{"a": int(x["timecode_in_ms"]), "b": int(x["timecode_out_ms"])} for x in retry.call(client, BOUNDARY_SYSTEM, user, BOUNDARY_SCHEMA)["segments"]]
                    out.append(got)
            except Exception as e:  # noqa: BLE001 - one video's failure isn't the run's
                out, error = None, str(e)[:500]
            replies.append(out)
            failed.append(error)
        return [all_spans, all_blocks, *others, replies, failed]

    return map_rows(df.select("spans", "blocks", *rest), schema, run)


def bounds_from_replies(df: DataFrame) -> DataFrame:
    """``df`` with ``bounds``: each chunk's reply reconciled to its span, clipped to what it owns, merged over chunks, holes filled."""
    none = F.array().cast(seq.BOUNDS)
    tiles = seq.reconcile_chunks(F.col("replies"), F.col("spans"), F.col("own"))
    each = F.zip_with(tiles, F.col("blocks"), lambda t, blocks: F.when(F.size(blocks) > 0, t).otherwise(none))
    merged = seq.settled(df, bounds=seq.merge_chunks(each))
    return seq.settled(merged, bounds=F.when(F.size("spans") > 0, seq.fill_gaps(F.col("bounds"), F.col("t0"), F.col("t1"))).otherwise(none))


# The columns of a segment beside those of its video.
SEGMENT = ("video_url", "segment_id", "timecode_in_ms", "timecode_out_ms", "timecode_in", "timecode_out", "segment_duration_seconds", "segment_transcript", "topic")


def new_videos(videos: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """The valid videos whose address, without white space around it, is not among ``earlier``."""
    valid = valid_videos(videos)
    return valid if earlier is None else unprocessed(valid, earlier, address=strip(F.col("source_url")))


def segment_videos(
    videos: DataFrame, client: ModelClient, earlier: DataFrame | None = None, chunk_ms: int = 600_000, overlap_ms: int = 15_000, position: str | None = None, fetch: Callable[[str], str | None] | None = None, retry: Retry = BOUNDARY_RETRY
) -> DataFrame:
    """The segments of all valid videos that weren't processed before, a row each, with what belongs to the video.

    All columns of ``videos`` but the transcript go with each segment, as strings, and its length and place in the
    input; those that are named like a column of a segment are left out. Transcripts stay in their rows from reading to
    the text of the segments. A failed video has no segments.
    """
    todo = new_videos(videos, earlier)
    about = {name: c for name, c in metadata_columns(todo, position).items() if name not in SEGMENT}
    if "duration_seconds" not in todo.columns:
        todo = todo.withColumn("duration_seconds", F.lit(None).cast("string"))
    rows = todo.select(strip(F.col("source_url")).alias("video_url"), "transcript", F.col("duration_seconds").alias("_seconds"), F.struct(*[c.alias(n) for n, c in about.items()]).alias("_about"))
    read = utterances(rows, ["video_url", "_about"], seconds_col="_seconds", fetch=fetch).filter(F.size("utterances") > 0)
    asked = ask_boundaries(chunked(read, chunk_ms, overlap_ms), client, retry).filter("failed is null")
    done = bounds_from_replies(asked)
    done = done.select("video_url", "_about", F.explode(seq.segments(F.col("utterances"), F.col("bounds"))).alias("s"))
    own = {
        "segment_id": F.col("s.segment_id"),
        "timecode_in_ms": F.col("s.a"),
        "timecode_out_ms": F.col("s.b"),
        "timecode_in": ms_to_timecode(F.col("s.a")),
        "timecode_out": ms_to_timecode(F.col("s.b")),
        "segment_duration_seconds": F.round((F.col("s.b") - F.col("s.a")) / 1000, 3),
        "segment_transcript": F.col("s.text"),
        "topic": F.lit(""),
    }
    return done.select("video_url", "_about.*", *[c.alias(n) for n, c in own.items()])


def label_segments(segments: DataFrame, codebook: DataFrame, client: ModelClient, cache: cl.AnswerCache | None = None, size: int = cl.BATCH, retry: Retry = CLASS_RETRY) -> tuple[DataFrame, DataFrame]:
    """(labelled segments, summary) for segments with ``pos`` and a codebook (pos, label, definition)."""
    book = [(r.label, r.definition) for r in codebook.orderBy("pos").limit(MOST_LABELS + 1).collect()]
    if len(book) > MOST_LABELS:
        raise ValueError(f"the codebook has more than {MOST_LABELS} labels")
    labels = [x for x, _ in book]
    if not labels:
        raise ValueError("the codebook is empty")
    fallback = fallback_label(labels)
    answered = cl.classify(segments, client, cl.label_prompt(book, fallback), cl.label_schema(labels), cache, size=size, retry=retry)
    labelled = cl.with_labels(answered, labels, fallback)
    return labelled, label_summary(labelled, codebook, fallback)


def score_subtopics(segments: DataFrame, subtopics: DataFrame, topic: str, client: ModelClient, cache: cl.AnswerCache | None = None, topic_column: str = "codebook_label", size: int = cl.BATCH, retry: Retry = CLASS_RETRY, parallel: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments of ``topic`` with a column a subtopic, summary); subtopics (pos, slug, definition). Positions are given anew after the filter."""
    topics = [(r.slug, r.definition) for r in subtopics.orderBy("pos").limit(MOST_LABELS + 1).collect()]
    if len(topics) > MOST_LABELS:
        raise ValueError(f"there are more than {MOST_LABELS} subtopics")
    slugs = [s for s, _ in topics]
    check_slugs(slugs, segments.columns)
    chosen = with_position(segments.filter(F.col(topic_column) == topic).drop("pos").withColumn("topic_label", F.lit(topic)))
    scored = cl.with_sentiments(cl.classify(chosen, client, cl.subtopic_prompt(topics), cl.subtopic_schema(slugs), cache, size=size, retry=retry, parallel=parallel), slugs)
    return scored.drop("sentiments"), subtopic_summary(scored, subtopics)
