import json

from talkmill.sources import transcripts as tr


def read(x, s=0.0, **k):
    return tr.read(x if isinstance(x, str) else json.dumps(x), s, **k)


def test_records():
    assert read([{"start_ms": 0, "end_ms": 4200, "text": "a"}, {"start_ms": 4200, "end_ms": 9000, "text": "b"}]) == ("records", [(0, 4200, "a"), (4200, 9000, "b")])
    assert read([{"start": 0, "dur": 4, "text": "a"}, {"start": 10, "dur": 2, "text": "b"}])[1] == [(0, 4000, "a"), (10000, 12000, "b")]


def test_records_that_start_at_zero():
    one = [{"start_ms": 0, "end_ms": 4200, "text": "a"}]
    assert read(one)[1] == [(0, 4200, "a")]
    assert read(one, compat=True)[1] == [(0, 1000, "a")]
    assert read(one, 60.0, compat=True)[1] == [(0, 60000, "a")]


def test_records_with_holes():
    assert read([{"start_ms": 1000, "text": "a"}, {"text": "b"}, {"start_ms": 5000, "text": "c"}])[1] == [(1000, 5000, "a"), (5000, 6000, "b"), (5000, 6000, "c")]
    assert read(["x &amp; y", {"text": " "}, 7], 4.0)[1] == [(0, 2000, "x & y"), (2000, 4000, "7")]


def test_broken_records_are_text():
    assert read('[{"text": "a. b') == ("text", [(0, 1000, '[{"text": "a.'), (1000, 2000, "b")])
    assert read("[]")[0] == "text"


def test_words():
    t = "<00:00:00.000><c>hello</c><00:00:02.000><c>world</c><00:00:05.000><c>again</c><00:00:05.000><c>again</c>"
    assert read(t) == ("words", [(0, 5000, "hello world"), (5000, 6000, "again")])


def test_pages():
    page = "<html><head><title>t</title></head><body><script>var a = '<b>';</script><p>One&nbsp;two. </p><p>Three!</p></body></html>"
    assert read(page) == ("page", [(0, 1000, "One two."), (1000, 2000, "Three!")])
    assert tr.page_text("</style>a<style>b</style>c") == "a c"


def test_captions():
    data = {"captions": {"playerCaptionsTracklistRenderer": {"captionTracks": [{"languageCode": "de", "baseUrl": "https://x.example/d"}, {"languageCode": "en-GB", "baseUrl": "https://x.example/t?id=1&fmt=srv3&e="}]}}, "t": "a } \"q\" {"}
    page = f"<html><script>var ytInitialPlayerResponse = {json.dumps(data)};</script><p>Shown.</p></html>"
    assert tr.caption_url(page) == "https://x.example/t?id=1&fmt=json3"
    assert read(page)[0] == "page"
    events = json.dumps({"events": [{"tStartMs": 5, "dDurationMs": 10, "segs": [{"utf8": "a "}, {"utf8": "b"}]}, {"tStartMs": 20}]})
    assert read(page, fetch=lambda u: events) == ("captions", [(5, 15, "a b")])
    assert read(page, fetch=lambda u: None)[0] == "page"
    assert tr.from_captions('<t><text start="1.5" dur="2">x &amp;amp; y</text></t>') == [(1500, 3500, "x & y")]
    assert tr.from_captions("<broken") == []


def test_nothing():
    assert [read(x)[0] for x in ("", " \n", "a About Press Copyright Contact us Creators Advertise b", "<html></html>")] == ["none"] * 4
    assert tr.read(None) == ("none", [])


def test_long_text():
    assert len(read("word. " * 50_000, 10.0)[1]) == 50_000


def test_frame(spark):
    df = spark.createDataFrame([(1, "A. B.", "x", 9), (1, "A. B.", None, 9), (2, None, "4", 9)], "row_id long, transcript string, duration_seconds string, utterances int")
    got = sorted((r.row_id, r.form, len(r.utterances)) for r in tr.utterances(df, ["row_id"]).collect())
    assert got == [(1, "text", 2), (1, "text", 2), (2, "none", 0)]
    assert tr.utterances(df.limit(0), ["row_id"]).count() == 0
