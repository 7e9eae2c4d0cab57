import json

import pytest
from pyspark.sql import functions as F

from talkmill import cli
from talkmill.models import AnswerError, Cached, Heuristic, Recorded, Retry, prompt_key
from talkmill.operators.vocabulary import first_spellings, slugged, with_other, with_position
from talkmill.plans import pipelines
from talkmill.sinks import files
from talkmill.sources import tables


class Halves:
    name = "halves"

    def complete(self, system, user, schema, max_tokens):
        c = json.loads(user)
        if "FAIL" in user:
            raise RuntimeError("no")
        mid = (c["chunk_start_ms"] + c["chunk_end_ms"]) // 2
        return {"segments": [{"timecode_in_ms": c["chunk_start_ms"], "timecode_out_ms": mid}, {"timecode_in_ms": mid, "timecode_out_ms": c["chunk_end_ms"]}]}


def videos(spark):
    talk = json.dumps([{"start": 10 * i, "end": 10 * i + 10, "text": f"w{i}"} for i in range(150)])
    return spark.createDataFrame(
        [("a", talk, None, "T"), ("b", "One. Two.", "240", "T"), ("c", "FAIL. Now.", "9", None), ("d", None, "9", "T"), ("e", "Old. One.", "9", "T")],
        "source_url string, transcript string, duration_seconds string, title string",
    )


def test_segments(spark):
    earlier = spark.createDataFrame([("e",)], "video_url string")
    got = pipelines.segment_videos(videos(spark), Halves(), earlier, retry=Retry(1, 10, False, 0)).orderBy("video_url", "segment_id").collect()
    assert {r.video_url for r in got} == {"a", "b"}
    a = [r for r in got if r.video_url == "a"]
    assert [r.segment_id for r in a] == list(range(len(a))) and a[0].timecode_in_ms == 0 and a[-1].timecode_out_ms == 1_500_000
    assert all(x.timecode_out_ms == y.timecode_in_ms for x, y in zip(a, a[1:]))
    assert [(r.timecode_in_ms, r.timecode_out_ms) for r in a] == [(0, 300000), (300000, 885000), (885000, 1335000), (1335000, 1500000)]
    assert a[0].segment_transcript.split()[0] == "w0" and [r.segment_transcript for r in got if r.video_url == "b"] == ["One.", "Two."]
    assert a[0].timecode_out == "5:00" and a[0].segment_duration_seconds == 300.0 and a[0].title == "T" and a[0].source_url == "a"
    assert (a[0].video_duration_seconds, next(r for r in got if r.video_url == "b").video_duration_seconds) == ("", "240.0")
    clash = videos(spark).withColumns({"topic": F.lit("x"), "segment_id": F.lit(9), "video_url": F.lit("z"), "spans": F.lit("s"), "row": F.lit(3), "_about": F.lit("q")})
    other = pipelines.segment_videos(clash, Halves(), earlier, position="row", retry=Retry(1, 10, False, 0)).filter("video_url = 'a'").orderBy("segment_id").collect()
    assert [(r.segment_id, r.topic, r.spans, r.input_row_index) for r in other] == [(i, "", "s", "3") for i in range(4)]
    assert pipelines.segment_videos(videos(spark).limit(0), Halves()).count() == 0


def test_labels_and_subtopics(spark):
    s = spark.createDataFrame([("u", 0, "prices and wages rise in markets", 5.0), ("u", 1, "songs and bands play concerts", 5.0), ("u", 2, "zzz", 5.0)], "video_url string, segment_id int, segment_transcript string, segment_duration_seconds double")
    book = with_other(first_spellings(spark.createDataFrame([(0, "Economy", "Prices, wages, markets."), (1, "Music", "Songs, bands, concerts.")], "pos long, label string, definition string")))
    labelled, summary = pipelines.label_segments(with_position(s), book, Heuristic())
    assert [r.codebook_label for r in labelled.orderBy("pos").collect()] == ["Economy", "Music", "Other / Not Listed"]
    assert [(r.label, r.n_segments) for r in summary.collect()] == [("Economy", 1), ("Music", 1), ("Other / Not Listed", 1)]
    topics = slugged(spark.createDataFrame([(0, "Wages", "prices wages"), (1, "Rents", "rents")], "pos long, label string, definition string"))
    scored, sub = pipelines.score_subtopics(labelled.drop("status"), topics, "Economy", Heuristic())
    assert [(r.wages, r.rents, r.topic_label) for r in scored.collect()] == [("neutral", "not_discussed", "Economy")]
    assert [(r.subtopic, r.n_segments_discussed, r.pct_of_filtered) for r in sub.collect()] == [("wages", 1, 100.0), ("rents", 0, 0.0)]


def test_too_many_labels_are_an_error(spark):
    s = with_position(spark.createDataFrame([("u", 0, "text", 5.0, "A")], "video_url string, segment_id int, segment_transcript string, segment_duration_seconds double, codebook_label string"))
    many = spark.range(pipelines.MOST_LABELS + 1).selectExpr("id pos", "concat('l', id) label", "concat('l', id) slug", "'' definition")
    with pytest.raises(ValueError, match="labels"):
        pipelines.label_segments(s, many, Heuristic())
    with pytest.raises(ValueError, match="subtopics"):
        pipelines.score_subtopics(s, many, "A", Heuristic())


def test_models():
    r = Recorded({prompt_key("s", "u"): {"x": 1}})
    assert r.complete("s", "u", {}, 1) == {"x": 1}
    waits, asked = [], []

    class Bad:
        name = "bad"

        def complete(self, system, user, schema, max_tokens):
            asked.append(max_tokens)
            raise AnswerError("no")

    with pytest.raises(AnswerError):
        Retry().call(Bad(), "s", "u", {}, waits.append)
    assert asked == [3000, 6000, 12000, 24000] and waits == [1.5, 3.0, 6.0]


def test_cached_answers(tmp_path):
    asked = []

    class Once:
        name = "once"

        def complete(self, system, user, schema, max_tokens):
            asked.append(user)
            if user == "bad":
                raise AnswerError("no")
            return {"x": user}

    c = Cached(Once(), str(tmp_path / "c"))
    assert [c.complete("s", u, {}, 1) for u in "aab"] == [{"x": "a"}, {"x": "a"}, {"x": "b"}] and asked == ["a", "b"]
    next((tmp_path / "c").iterdir()).write_text("{broken")
    assert [c.complete("s", u, {}, 1) for u in "ab"] == [{"x": "a"}, {"x": "b"}] and len(asked) == 3
    for _ in range(2):
        with pytest.raises(AnswerError):
            c.complete("s", "bad", {}, 1)
    assert asked.count("bad") == 2


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("u", 0, 'a "q"\nb, c', None), ("v", 1, "", "x" * 400)], "video_url string, segment_id int, segment_transcript string, title string")
    files.write_csv(files.review_rows(df), str(tmp_path / "r"), single=True)
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("*.csv"))
    assert text.startswith('"video_url","segment_id"') and '"a ""q""\nb, c"' in text
    back = tables.read_csv(spark, str(tmp_path / "r")).orderBy("segment_id").collect()
    assert back[0].segment_transcript == 'a "q"\nb, c' and back[0].creator_label is None and len(back) == 2
    files.write_json_array(df, str(tmp_path / "s.json"), "segment_id")
    assert [x["video_url"] for x in json.loads((tmp_path / "s.json").read_text())] == ["u", "v"]
    assert [r.video_url for r in tables.processed_urls(spark, [str(tmp_path / "s.json")]).orderBy("video_url").collect()] == ["u", "v"]
    assert tables.processed_urls(spark, []).count() == 0
    files.write_json_array(df, str(tmp_path / "s.json"))  # again, in the place of the first
    assert json.loads((tmp_path / "s.json").read_text())[0] == {"video_url": "u", "segment_id": 0, "segment_transcript": 'a "q"\nb, c', "title": None}
    files.write_json_array(df.limit(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == [] and not list(tmp_path.glob("*.parts-*"))
    df.write.json(str(tmp_path / "lines"))
    (tmp_path / "indented.json").write_text("\n " + json.dumps([{"video_url": f"w{i}", "x": {"y": [1]}} for i in range(10)], indent=2))
    with pytest.warns(UserWarning, match="gone.json"):
        got = tables.processed_urls(spark, [str(tmp_path / n) for n in ("s.json", "none.json", "lines", "indented.json", "gone.json")])
    assert sorted(r.video_url for r in got.collect()) == sorted(["u", "v", *[f"w{i}" for i in range(10)]])


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("Sport: balls: and all\n\nMusic\n")
    (tmp_path / "c.csv").write_text('﻿label,definition\nSport,"a, b"\nMusic,\n')
    assert [(r.label, r.definition) for r in tables.read_labels(spark, str(tmp_path / "c.txt")).orderBy("pos").collect()] == [("Sport", "balls: and all"), ("Music", None)]
    assert [(r.label, r.definition) for r in tables.read_labels(spark, str(tmp_path / "c.csv")).orderBy("pos").collect()] == [("Sport", "a, b"), ("Music", None)]
    assert {r.key: r.definition for r in tables.read_definitions(spark, str(tmp_path / "c.csv")).collect()} == {"sport": "a, b", "music": ""}


def test_commands(spark, tmp_path):
    run = lambda *a: cli.main(["--offline", *a, "--cache-dir", str(tmp_path / "cache")])
    source = tmp_path / "videos.csv"
    source.write_text('source_url,transcript,duration_seconds,title,extra\nu,"Prices rise. Wages fall. ""So"", he said.",90,T, x \n v ,One. Two.,,,\n,no address,1,,\n')
    out = tmp_path / "out"
    assert run("segment", "--input", str(source), "--output-dir", str(out)) == 0
    first = next(out.iterdir())
    review = tables.read_csv(spark, str(first / "segments_review.csv")).orderBy("video_url").collect()
    assert len(review) == 2 and review[0].segment_transcript.startswith("Prices rise.") and review[1].video_url == "v"
    written = sorted(json.loads((first / "segments.json").read_text()), key=lambda r: r["video_url"])
    assert [(r["video_url"], r["extra"], r["input_row_index"], r["video_duration_seconds"], r["segment_id"]) for r in written] == [("u", "x", "1", "90.0", 0), ("v", "", "2", "", 0)]
    # What a run wrote is skipped by the next: nothing is left, or what is new.
    with pytest.raises(SystemExit, match="segmented already"):
        run("segment", "--input", str(source), "--output-dir", str(tmp_path / "o2"), "--skip-segments", str(first / "segments.json"))
    source.write_text(source.read_text() + "w,Three. Four.,,,\n")
    with pytest.warns(UserWarning, match="nowhere"):
        run("segment", "--input", str(source), "--output-dir", str(tmp_path / "o3"), "--skip-segments", str(first / "segments.json"), str(tmp_path / "nowhere.json"))
    assert [r["video_url"] for r in json.loads((next((tmp_path / "o3").iterdir()) / "segments.json").read_text())] == ["w"]
    (tmp_path / "none.csv").write_text("source_url,transcript\n,x\n")
    with pytest.raises(SystemExit, match="no video with"):
        run("segment", "--input", str(tmp_path / "none.csv"), "--output-dir", str(tmp_path / "o4"))

    (tmp_path / "book.txt").write_text("Economy: prices and wages\n")
    done = tmp_path / "labelled"
    for _ in range(2):  # a second run finds its answers in the cache and replaces the results
        assert run("label", "--input", str(first / "segments_review.csv"), "--codebook", str(tmp_path / "book.txt"), "--output-dir", str(done)) == 0
        assert [r.codebook_label for r in tables.read_csv(spark, str(done / "labeled_segments.csv")).orderBy("video_url").collect()] == ["Economy", "Other / Not Listed"]
        assert sorted(r["codebook_label"] for r in json.loads((done / "segments.json").read_text())) == ["Economy", "Other / Not Listed"]
    (tmp_path / "sub.txt").write_text("Wages: prices wages\n")
    assert run("subtopics", "--input", str(done / "labeled_segments.csv"), "--topic-label", "Economy", "--subtopics", str(tmp_path / "sub.txt"), "--output-dir", str(tmp_path / "sub")) == 0
    assert tables.read_csv(spark, str(tmp_path / "sub" / "subtopic_summary.csv")).first().subtopic == "wages"
    assert [r["wages"] for r in json.loads((tmp_path / "sub" / "segments.json").read_text())] == ["neutral"]
    with pytest.raises(SystemExit, match="no segment has"):
        run("subtopics", "--input", str(done / "labeled_segments.csv"), "--topic-label", "Nothing", "--output-dir", str(tmp_path / "sub"))


def test_env_files(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# a comment\nexport TM_A = 'one'\nTM_B=two=2\nTM_C=no\n= x\n")
    monkeypatch.setenv("TM_C", "kept")
    for k in ("TM_A", "TM_B"):
        monkeypatch.delenv(k, raising=False)
    cli.load_env(str(tmp_path / "nowhere"), str(tmp_path))
    import os

    assert [os.environ.get(k) for k in ("TM_A", "TM_B", "TM_C")] == ["one", "two=2", "kept"]
    for k in ("TM_A", "TM_B"):
        monkeypatch.delenv(k)


@pytest.mark.parametrize("args", [["segment", "--input", "x", "--chunk-minutes", "1", "--overlap-seconds", "60"], ["label", "--input", "x", "--codebook", "y", "--batch-size", "0"]])
def test_bad_options(args):
    with pytest.raises(SystemExit):
        cli.main(["--offline", *args])


def test_streams(spark, tmp_path):
    from talkmill.streaming import incremental

    df = spark.createDataFrame([("a", "One. Two.", "2024-01-01 10:00:00", " X"), ("a", "One. Two.", "2024-01-01 10:05:00", "x"), ("b", "Three.", "2024-01-02 10:00:00", "y")], "source_url string, transcript string, t string, creator_label string")
    df.withColumn("arrived_at", F.to_timestamp("t")).drop("t").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    new = incremental.new_videos(incremental.arriving(spark, str(tmp_path / "in"), schema))
    incremental.segment_stream(new, Halves(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.video_url for r in got.collect()} == {"a", "b"} and got.filter("video_url = 'a'").count() == 2
    q = incremental.arrivals_by_creator(incremental.arriving(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.creator, r.n_videos) for r in spark.table("arrivals").collect()) == [("x", 2), ("y", 1)]
