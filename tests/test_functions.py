import pytest
from pyspark.sql import functions as F

from talkmill.functions import text, timecode
from talkmill.sources import transcripts as tr


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_ms_to_timecode(spark):
    assert one(spark, timecode.ms_to_timecode, 0, 59999, 61000, 3600000, 3661001, None, kind="long") == ["0:00", "0:59", "1:01", "1:00:00", "1:01:01", None]


def test_timecode_to_ms(spark):
    assert one(spark, timecode.timecode_to_ms, "1:01", "1:01:01", "61", " 0:05 ", "1:2x", "", None) == [61000, 3661000, 0, 5000, None, 0, None]


def test_caption_times():
    assert [tr.clock_ms(x) for x in ("00:00:01.2", "01:02.345", "1:02:03", "00:00:01.23456", "x")] == [1200, 62345, 3723000, 1234, None]


@pytest.mark.parametrize(("unit", "given", "want"), [("seconds", ["1.5", "1500ms", "1:02,5", "<00:00:01.000>", "abc", ""], [1500, 1500, 62500, 1000, None, None]), ("ms", ["2s", "7"], [2000, 7])])
def test_value_to_ms(unit, given, want):
    assert [tr.time_ms(v, 1000.0 if unit == "seconds" else 1.0) for v in given] == want


def test_time_values_that_are_no_times():
    assert [tr.time_ms(v, 1000.0) for v in (True, None, float("nan"), float("inf"), "nan", [1])] == [None] * 6
    assert tr.time_ms(1.5, 1000.0) == 1500


def test_slug_and_spaces(spark):
    assert one(spark, text.slug, "Gas prices", "--", "A&B (x)", None) == ["gas_prices", "", "a_b_x", None]
    assert one(spark, text.collapse, "a  b\x1c\nc ", "", " ") == ["a b c", "", ""]
    assert one(spark, text.is_blank, None, "", "  ", "x") == [True, True, True, False]


def test_sentences(spark):
    assert one(spark, text.sentences, "A b. C d! E", " ", "", "one", "x.y. z") == [["A b.", "C d!", "E"], [], [], ["one"], ["x.y.", "z"]]


def test_first_colon(spark):
    df = spark.createDataFrame([("a: b: c",), ("a",)], "v string")
    assert [tuple(r) for r in df.select(*text.first_colon(F.col("v"))).collect()] == [("a", "b: c"), ("a", None)]


def test_safe_seconds(spark):
    assert one(spark, timecode.safe_seconds, "12.5", "", None, "about", "1d", "1_0") == [12.5, 0.0, 0.0, None, None, None]
