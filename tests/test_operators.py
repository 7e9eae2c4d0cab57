import pytest
from pyspark.sql import functions as F

from talkmill.operators import classify as cl
from talkmill.operators import vocabulary as vo
from talkmill.operators.overlap import overlap_join, unprocessed
from talkmill.operators.skew import lookup_join
from talkmill.operators.summary import label_summary, subtopic_summary
from talkmill.sources.tables import metadata, valid_segments, valid_videos


def rows(df):
    return [tuple(r) for r in df.collect()]


def labels(spark, *names):
    return spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(names)], "pos long, label string, definition string")


def test_codebook(spark):
    got = rows(vo.with_other(vo.first_spellings(labels(spark, ("Sports", ""), ("sports", "balls"), (" Economy ", None), ("", "x")))).orderBy("pos").select("label", "definition"))
    assert got == [("Sports", "balls"), ("Economy", None), ("Other / Not Listed", None)]
    assert [r[0] for r in rows(vo.with_other(vo.first_spellings(labels(spark, ("Sports", None), ("Other", None)))).orderBy("pos").select("label"))] == ["Sports", "Other"]
    assert vo.fallback_label(["Sports", "Other"]) == "Other" and vo.fallback_label(["Sports"]) == vo.OTHER
    assert rows(vo.with_other(vo.first_spellings(labels(spark).limit(0) if False else labels(spark, ("", None)))).select("pos", "label")) == [(0, vo.OTHER)]


def test_override(spark):
    book = vo.first_spellings(labels(spark, ("A", "a"), ("B", "b")))
    other = spark.createDataFrame([("a", ""), ("z", "z")], "key string, definition string")
    assert sorted(rows(vo.override(book, other).select("label", "definition"))) == [("A", ""), ("B", "b")]


def test_slugs(spark):
    got = vo.slugged(labels(spark, ("Food prices", None), ("food  prices", "x"), ("--", "y"), ("Banks", None)))
    assert sorted(rows(got.select("slug", "pos", "definition"))) == [("banks", 3, ""), ("food_prices", 0, "x")]
    with pytest.raises(ValueError):
        vo.check_slugs(["topic"], ["topic"])


def test_positions(spark):
    got = rows(vo.with_position(spark.range(10).repartition(3)))
    assert sorted(p for _, p in got) == list(range(10))
    assert [p for _, p in sorted(rows(vo.with_position(spark.range(0, 1000, 1, 7))))] == list(range(1000))
    assert vo.with_position(spark.range(0)).columns == ["id", "pos"] and vo.with_position(spark.range(5).filter("id > 9")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_with_a_hot_key(spark, how):
    n = 60_000
    df = spark.range(n).select(F.col("id").alias("v"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 1000 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"))
    dim = df.filter("k is not null and k <> 'k7'").groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("first"))
    got = lookup_join(df, dim, "k", how, most_hot=3)
    want = df.join(dim.select("k", "first"), "k", how).select("v", "k", "first")
    assert got.columns == ["v", "k", "first"]
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    few = lookup_join(df.limit(100), dim, "k", how)
    assert few.exceptAll(df.limit(100).join(dim.select("k", "first"), "k", how).select("v", "k", "first")).count() == 0


def test_overlap_and_anti_join(spark):
    u = spark.createDataFrame([(1, 0, 10, "a"), (1, 10, 10, "z"), (1, 8, 14, "b"), (2, 0, 5, "c")], "v int, start_ms long, end_ms long, text string")
    s = spark.createDataFrame([(1, 0, 10), (1, 10, 20)], "v int, a long, b long")
    assert sorted(rows(overlap_join(u, s, "v").select("a", "text"))) == [(0, "a"), (0, "b"), (10, "b")]
    v = spark.createDataFrame([("x",), ("y",), (None,)], "source_url string")
    assert sorted(r[0] or "" for r in rows(unprocessed(v, spark.createDataFrame([("x",), (None,)], "video_url string")))) == ["", "y"]


def test_overlap_join_by_buckets(spark):
    """One video over many buckets, against brute force; each pair once."""
    import random

    rng = random.Random(3)
    us = [(1, a, a + rng.choice([0, 1, 40, 900]), i) for i, a in enumerate(rng.choices(range(2000), k=150))]
    ss = [(1, a, a + rng.choice([1, 30, 700]), 7) for a in rng.choices(range(2000), k=60)] + [(None, 0, 9, 7)]
    u = spark.createDataFrame(us, "v int, start_ms long, end_ms long, n int")
    s = spark.createDataFrame(ss, "v int, a long, b long, _bucket int").drop("_bucket")
    want = sorted((a, b, i) for _, x, y, i in us for v, a, b, _ in ss if v and y > a and x < b)
    for bucket in (50, 333, 1_000_000):
        assert sorted((r.a, r.b, r.n) for r in overlap_join(u, s, "v", bucket).collect()) == want


@pytest.mark.parametrize("most", [1 << 20, 200, 40, 0])
def test_skipping_whatever_the_sizes(spark, most):
    """The earlier addresses, the hits or the new ones are sent to the tasks, or the table shuffles: the result is the same."""
    v = spark.createDataFrame([(f"u{i % 9}", i) for i in range(40)] + [(None, 77), (" u1 ", 78)], "source_url string, n int")
    earlier = spark.createDataFrame([(f"u{i}",) for i in range(1, 3)] + [(f"old{i}",) for i in range(30)] + [(None,)], "video_url string")
    want = sorted([i for i in range(40) if i % 9 not in (1, 2)] + [77, 78])
    assert sorted(r.n for r in unprocessed(v, earlier, most_bytes=most).collect()) == want
    got = unprocessed(v, earlier, address=F.trim("source_url"), most_bytes=most)
    assert got.columns == v.columns and sorted(r.n for r in got.collect()) == want[:-1]


def test_texts_shuffle_once(spark):
    from talkmill.models import Heuristic

    s = spark.range(100).selectExpr("id pos", "'u' video_url", "id segment_id", "concat('t', id) segment_transcript", "1.5D segment_duration_seconds", "cast(null as int) key", "current_timestamp() answered")
    got = cl.classify(s, Heuristic(), cl.label_prompt([("A", "a"), ("Other", None)], "Other"), cl.label_schema(["A", "Other"]))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert got.columns == [*s.columns, "answer", "status"] and sorted(r.pos for r in got.collect()) == list(range(100))


def test_a_cache_that_cannot_be_read_is_an_error(spark, tmp_path):
    assert cl.AnswerCache(spark, str(tmp_path / "none")).read().count() == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark raises
        cl.AnswerCache(spark, str(tmp_path / "broken")).read().collect()


def test_validity(spark):
    v = spark.createDataFrame([("u", "t", "1.23456"), (" ", "t", None), ("u", None, None), ("u", "About Press Copyright Contact us Creators Advertise", None)], "source_url string, transcript string, duration_seconds string")
    one = valid_videos(v).select(metadata(v)).collect()
    assert [r[0] for r in one] == [{"source_url": "u", "duration_seconds": "1.23456", "video_duration_seconds": "1.235"}]
    with pytest.raises(ValueError):
        valid_videos(v.drop("transcript"))
    s = spark.createDataFrame([("u", "t", "0:10", "1:10", "x"), ("u", "t", "zz:1", "1:10", ""), ("u", "t", None, "", None), ("u", " ", "", "", "")], "video_url string, segment_transcript string, timecode_in string, timecode_out string, segment_duration_seconds string")
    assert rows(valid_segments(s).select("timecode_in_ms", "timecode_out_ms", "segment_duration_seconds")) == [(10000, 70000, 60.0), (0, 0, 0.0), (0, 0, 0.0)]
    assert valid_segments(s.select("video_url", "segment_transcript")).first().timecode_in == "0:00"


def test_label_summary(spark):
    s = spark.createDataFrame([(i, lab, d, f"t{i}") for i, (lab, d) in enumerate([("A", 1.25), (None, 2.0), ("A", 1.0), ("A", None), ("A", 0.0), ("gone", 1.0)])], "pos long, codebook_label string, segment_duration_seconds double, segment_transcript string")
    book = spark.createDataFrame([(0, "B"), (1, "A"), (2, "Other")], "pos long, label string")
    assert rows(label_summary(s, book, "Other")) == [("B", 0, 0.0, "", "", ""), ("A", 4, 2.3, "t0", "t2", "t3"), ("Other", 1, 2.0, "t1", "", "")]
    assert rows(label_summary(s.limit(0), book, "Other"))[1] == ("A", 0, 0.0, "", "", "")


def test_subtopic_summary(spark):
    s = spark.createDataFrame([(0, 2.0, "x", {"a": "positive", "b": "odd"}), (1, 1.0, "y", {"a": "not_discussed"}), (2, 1.0, "z", {"c": "neutral"})], "pos long, segment_duration_seconds double, segment_transcript string, sentiments map<string,string>")
    t = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c")], "pos long, slug string")
    assert rows(subtopic_summary(s, t))[:2] == [("a", 1, 33.33, 1, 0, 0, 2.0, "x", "", ""), ("c", 1, 33.33, 0, 0, 1, 1.0, "z", "", "")]
    assert rows(subtopic_summary(s.limit(0), t))[0] == ("b", 0, 0.0, 0, 0, 0, 0.0, "", "", "")


def segments(spark, n=5):
    return spark.createDataFrame([(i, f"u{i}", i, f"text {i}") for i in range(n)], "pos long, video_url string, segment_id int, segment_transcript string")


class Counting:
    """Answers from the text alone, and leaves a mark on disk for each call."""

    name = "counting"

    def __init__(self, path, fail=""):
        self.path, self.fail = path, fail

    def complete(self, system, user, schema, max_tokens):
        import re
        import uuid

        open(f"{self.path}/{uuid.uuid4()}", "w").close()
        if self.fail and self.fail in user:
            raise RuntimeError("no")
        return {"classifications": [{"index": int(i), "label": "A" if int(n) % 2 else "nowhere"} for i, n in re.findall(r"\[(\d+)\] text (\d+)", user) if n != "3"] + [{"index": 99, "label": "A"}]}


def run(spark, client, cache=None, size=2, n=5):
    retry = cl.Retry(attempts=2, first_wait_s=0)
    got = cl.with_labels(cl.classify(segments(spark, n), client, "system", cl.label_schema(["A", "Other"]), cache, size=size, retry=retry), ["A", "Other"], "Other")
    return sorted((r.pos, r.codebook_label, r.status) for r in got.collect())


def test_classify(spark, tmp_path):
    want = [(0, "Other"), (1, "A"), (2, "Other"), (3, "Other"), (4, "Other")]
    for size in (1, 2, 20):
        assert [x[:2] for x in run(spark, Counting(str(tmp_path)), size=size)] == want


def test_cache(spark, tmp_path):
    calls, cache = tmp_path / "calls", cl.AnswerCache(spark, str(tmp_path / "cache"))
    calls.mkdir()
    first = run(spark, Counting(str(calls)), cache)
    asked = len(list(calls.iterdir()))
    again = run(spark, Counting(str(calls)), cache)
    assert [x[:2] for x in first] == [x[:2] for x in again] and {x[2] for x in again if x[0] != 3} == {"cached"}
    assert len(list(calls.iterdir())) == asked


def test_failures_take_the_fallback_and_are_not_cached(spark, tmp_path):
    calls, cache = tmp_path / "calls", cl.AnswerCache(spark, str(tmp_path / "cache"))
    calls.mkdir()
    got = run(spark, Counting(str(calls), fail="text 1"), cache)
    assert got[1] == (1, "Other", "failed") and got[4][2] == "ok"
    assert run(spark, Counting(str(calls)), cache)[1][:2] == (1, "A")


def test_keys_change_with_the_text(spark):
    key = lambda df: {r.batch_id: r.key for r in cl.batch_keys(cl.batch_columns(df, size=2), "m", "s").collect()}
    a, b = key(segments(spark)), key(segments(spark).withColumn("segment_transcript", F.when(F.col("pos") == 4, "new").otherwise(F.col("segment_transcript"))))
    assert a[0] == b[0] and a[2] != b[2]
    with pytest.raises(ValueError):
        cl.batch_columns(segments(spark), size=0)


def test_sentiments(spark):
    df = spark.createDataFrame([('{"a":"positive","b":"great"}',), (None,)], "answer string")
    assert rows(cl.with_sentiments(df, ["a", "b"]).select("a", "b")) == [("positive", "not_discussed"), ("not_discussed", "not_discussed")]


def test_prompts():
    assert "- A: first" in cl.label_prompt([("A", "first"), ("B", None)], "B") and cl.user_prompt(["x" * 800]).endswith("x" * 700)
    assert cl.subtopic_schema(["a"])["properties"]["classifications"]["items"]["required"] == ["index", "a"]


def test_long_rows_are_handed_over_in_small_parts(spark):
    from talkmill.functions.arrow import map_rows

    df = spark.range(40).select("id", F.repeat(F.lit("x"), F.when(F.col("id") < 20, 2_000_000).otherwise(10).cast("int")).alias("t"))
    got = map_rows(df.coalesce(1), "id long, n long, most long", lambda _, ids, texts: [ids, [len(t) for t in texts], [sum(map(len, texts))] * len(ids)]).collect()
    assert sum(r.n for r in got) == 20 * 2_000_000 + 200 and max(r.most for r in got) < 64 << 20


def test_default_subtopics(spark):
    from talkmill.operators.vocabulary import DEFAULT_SUBTOPICS, default_subtopics

    assert [r.slug for r in default_subtopics(spark).orderBy("pos").collect()] == list(DEFAULT_SUBTOPICS)
