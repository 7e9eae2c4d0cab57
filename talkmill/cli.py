"""Commands: segment, label and subtopics."""

from __future__ import annotations

import argparse
import os
import re
import sys
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.models import Cached, Heuristic, Http, ModelClient
from talkmill.operators.classify import AnswerCache
from talkmill.operators.vocabulary import DEFAULT_TOPIC, default_subtopics, first_spellings, override, slugged, with_other, with_position
from talkmill.plans import pipelines
from talkmill.sinks import files
from talkmill.session import cut, is_local, ship
from talkmill.sources import tables

MODEL = "gpt-4.1-mini"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="talkmill")
    p.add_argument("--offline", action="store_true", help="answer with heuristics instead of a model")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("segment")
    s.add_argument("--input", required=True)
    s.add_argument("--output-dir", default="segments_out")
    s.add_argument("--chunk-minutes", type=float, default=10)
    s.add_argument("--overlap-seconds", type=float, default=15)
    s.add_argument("--no-fetch-timedtext", action="store_true")
    s.add_argument("--skip-segments", nargs="*", default=[])
    b = sub.add_parser("label")
    b.add_argument("--input", required=True)
    b.add_argument("--codebook", required=True)
    b.add_argument("--codebook-definitions")
    b.add_argument("--definitions-column", default="definition")
    t = sub.add_parser("subtopics")
    t.add_argument("--input", required=True)
    t.add_argument("--topic-label", default=DEFAULT_TOPIC)
    t.add_argument("--topic-column", default="codebook_label")
    t.add_argument("--subtopics")
    t.add_argument("--concurrency", type=int, default=8)
    for x in (b, t):
        x.add_argument("--output-dir", default="pipeline_output")
        x.add_argument("--batch-size", type=int, default=20)
    for x in (s, b, t):
        x.add_argument("--model", default=MODEL)
        x.add_argument("--cache-dir", default=".pipeline_cache")
    return p


def check(args: argparse.Namespace) -> None:
    if args.command == "segment" and not (args.chunk_minutes > 0 and 0 <= args.overlap_seconds < args.chunk_minutes * 60):
        raise SystemExit("the chunk must be positive and the overlap from 0 to less than the chunk")
    if args.command != "segment" and args.batch_size < 1:
        raise SystemExit("a batch has at least one row")


def client(args: argparse.Namespace) -> ModelClient:
    if args.offline:
        return Heuristic()
    if not os.environ.get("OPENAI_API_KEY"):
        raise SystemExit("OPENAI_API_KEY is not set")
    return Http(os.environ.get("OPENAI_BASE_URL", "https://api.openai.com/v1"), args.model, lambda: os.environ["OPENAI_API_KEY"])


def fetch(url: str) -> str | None:
    """A caption file, over https only."""
    if not url.startswith("https://"):
        return None
    try:
        with urllib.request.urlopen(url, timeout=15) as r:
            return r.read().decode("utf-8", "replace")
    except OSError:
        return None


def load_env(*folders: str) -> None:
    """Sets what the first ``.env`` of the folders says (NAME=value lines) and the environment doesn't say already."""
    for folder in folders:
        path = os.path.join(folder, ".env")
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                for line in f:
                    name, sep, value = line.strip().removeprefix("export ").partition("=")
                    if sep and re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                        os.environ.setdefault(name.strip(), value.strip().strip("'\""))
            return


def some(df: DataFrame, message: str) -> DataFrame:
    """``df`` if it has rows; else the run ends with ``message``."""
    if df.isEmpty():
        raise SystemExit(message)
    return df


def segment(spark: SparkSession, args: argparse.Namespace, model: ModelClient, out: str) -> None:
    videos = with_position(tables.read_csv(spark, args.input), "_row").withColumn("_row", F.col("_row") + 1)
    earlier = tables.processed_urls(spark, args.skip_segments) if args.skip_segments else None
    some(tables.valid_videos(videos), "the file has no video with an address and a transcript")
    some(pipelines.new_videos(videos, earlier), "all videos have been segmented already")
    asked = Cached(model, f"{args.cache_dir}/segment")
    done = pipelines.segment_videos(videos, asked, earlier, int(args.chunk_minutes * 60_000), int(args.overlap_seconds * 1000), "_row", fetch=None if args.no_fetch_timedtext else fetch)
    done = some(cut(done), "no video yielded a segment with text")
    files.write_json_array(done, f"{out}/segments.json")
    files.write_csv(files.review_rows(done), f"{out}/segments_review.csv")


def label(spark: SparkSession, args: argparse.Namespace, segments: DataFrame, model: ModelClient, cache: AnswerCache, out: str) -> None:
    book = with_other(first_spellings(tables.read_labels(spark, args.codebook, args.definitions_column)))
    if args.codebook_definitions:
        book = override(book, tables.read_definitions(spark, args.codebook_definitions, args.definitions_column))
    labelled, _ = pipelines.label_segments(segments, book, model, cache, args.batch_size)
    kept = cut(labelled.drop("status"))
    rows = files.label_first(kept.orderBy("pos").drop("pos"), ["codebook_label"])
    files.write_json_array(rows, f"{out}/segments.json")
    files.write_csv(rows, f"{out}/labeled_segments.csv", mode="overwrite")
    names = [r.label for r in book.collect()]
    files.write_csv(pipelines.label_summary(kept, book, pipelines.fallback_label(names)), f"{out}/codebook_summary.csv", single=True, mode="overwrite")


def subtopics(spark: SparkSession, args: argparse.Namespace, segments: DataFrame, model: ModelClient, cache: AnswerCache, out: str) -> None:
    topics = slugged(tables.read_subtopics(spark, args.subtopics)) if args.subtopics else default_subtopics(spark)
    some(segments.filter(F.col(args.topic_column) == args.topic_label), f"no segment has {args.topic_label} in {args.topic_column}")
    scored, summary = pipelines.score_subtopics(segments, topics, args.topic_label, model, cache, args.topic_column, args.batch_size, parallel=max(1, args.concurrency))
    slugs = [r.slug for r in topics.orderBy("pos").collect()]
    rows = files.label_first(cut(scored).orderBy("pos").drop("pos", "status"), slugs)
    files.write_json_array(rows, f"{out}/segments.json")
    files.write_csv(rows, f"{out}/{re.sub('[^a-z0-9]+', '_', args.topic_label.lower()).strip('_')}_subtopics_labeled.csv", mode="overwrite")
    files.write_csv(summary, f"{out}/subtopic_summary.csv", single=True, mode="overwrite")


def main(argv: list[str] | None = None) -> int:
    """Segments go into a folder of the run under the output folder; the other two stages write into the output folder itself, as their results replace those of a run before."""
    load_env(os.getcwd(), os.path.dirname(os.getcwd()))
    args = parser().parse_args(argv)
    check(args)
    model = client(args)
    spark = SparkSession.builder.appName("talkmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    if not is_local(spark) and "://" not in args.cache_dir:
        raise SystemExit("give --cache-dir as an address that all executors share")
    if args.command == "segment":
        segment(spark, args, model, files.run_directory(args.output_dir, args.input))
        return 0
    segments = with_position(some(tables.valid_segments(tables.read_csv(spark, args.input)), "the file has no segment with an address and text"))
    run = label if args.command == "label" else subtopics
    run(spark, args, segments, model, AnswerCache(spark, f"{args.cache_dir}/{args.command}"), args.output_dir.rstrip("/"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
