import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkmill.operators import sequence as seq


def us(spark, rows):
    return spark.createDataFrame([(rows,)], f"u {seq.UTTERANCES}")


def tup(rows):
    return [tuple(r) for r in rows]


def test_even_spacing(spark):
    df = spark.createDataFrame([(["a", "b", "c"], 10.0), ([], 5.0), (["a", "b"], None)], "t array<string>, s double")
    got = [tup(r[0]) for r in df.select(seq.even_spacing(F.col("t"), F.col("s"))).collect()]
    assert got == [[(0, 3333, "a"), (3333, 6666, "b"), (6666, 10000, "c")], [], [(0, 1000, "a"), (1000, 2000, "b")]]


def test_fill_times(spark):
    df = us(spark, [(1000, None, "a"), (None, None, "b"), (5000, None, "c")])
    assert tup(df.select(seq.fill_times(F.col("u"))).first()[0]) == [(1000, 5000, "a"), (5000, 6000, "b"), (5000, 6000, "c")]
    assert us(spark, []).select(seq.fill_times(F.col("u"))).first()[0] == []


def test_complete_ends(spark):
    df = us(spark, [(5, None, "b"), (0, None, "a"), (9, 3, "c"), (9, None, "d")])
    assert tup(df.select(seq.complete_ends(F.col("u"))).first()[0]) == [(0, 5, "a"), (5, 9, "b"), (9, 9, "c"), (9, 1009, "d")]


def test_windows(spark):
    df = us(spark, [(0, 3000, "a"), (4000, 9000, "b"), (8000, 9000, "c"), (20000, 21000, "d")])
    assert tup(df.select(seq.coalesce_windows(F.col("u"))).first()[0]) == [(0, 9000, "a b"), (8000, 9000, "c"), (20000, 21000, "d")]
    assert us(spark, []).select(seq.coalesce_windows(F.col("u"))).first()[0] == []


def test_chunks(spark):
    df = spark.createDataFrame([(0, 1500000), (5, 5), (0, 600000), (None, None)], "a long, b long")
    got = [tup(r[0]) for r in df.select(seq.chunk_spans(F.col("a"), F.col("b"), 600000, 15000)).collect()]
    assert got == [[(0, 600000), (585000, 1185000), (1170000, 1500000)], [], [(0, 600000)], []]
    with pytest.raises(ValueError):
        seq.chunk_spans(F.col("a"), F.col("b"), 10, 10)


def bounds(spark, rows, a, b):
    df = spark.createDataFrame([(rows, a, b)], f"x {seq.BOUNDS}, a long, b long")
    return tup(df.select(seq.reconcile(F.col("x"), F.col("a"), F.col("b"))).first()[0])


def test_reconcile(spark):
    assert bounds(spark, [(10, 30), (20, 50), (90, 200)], 0, 100) == [(0, 10), (10, 30), (30, 50), (50, 90), (90, 100)]
    assert bounds(spark, [], 0, 100) == [(0, 100)]
    assert bounds(spark, [(5, 5), (-9, -1)], 0, 0) == []


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(-50, 150), st.integers(-50, 150)), max_size=12), end=st.integers(1, 120))
def test_reconcile_tiles(spark, rows, end):
    got = bounds(spark, rows, 0, end)
    assert got[0][0] == 0 and got[-1][1] == end
    assert all(a[1] == b[0] for a, b in zip(got, got[1:])) and all(a < b for a, b in got)
    assert bounds(spark, got, 0, end) == got


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(t0=st.integers(0, 50), length=st.integers(1, 400), chunk=st.integers(2, 60), part=st.floats(0, 0.95))
def test_chunks_as_a_loop(spark, t0, length, chunk, part):
    overlap = min(chunk - 1, math.floor(chunk * part))
    want, t, t1 = [], t0, t0 + length
    while True:
        want.append((t, min(t1, t + chunk)))
        if want[-1][1] == t1:
            break
        t = want[-1][1] - overlap
    df = spark.createDataFrame([(t0, t1)], "a long, b long").select(seq.chunk_spans(F.col("a"), F.col("b"), chunk, overlap).alias("s"))
    row = df.select("s", seq.owned(F.col("s"), overlap).alias("o")).first()
    assert tup(row.s) == want
    own = tup(row.o)
    assert own[0][0] == t0 and own[-1][1] == t1 and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_merge_and_gaps(spark):
    chunks = [[(0, 300000), (300000, 585000)], [(585000, 1170000)], [(1170000, 1300000), (1300000, 1500000)]]
    df = spark.createDataFrame([(chunks,)], "c array<array<struct<a:bigint,b:bigint>>>")
    assert tup(df.select(seq.merge_chunks(F.col("c"))).first()[0]) == [(0, 300000), (300000, 1300000), (1300000, 1500000)]
    df = spark.createDataFrame([([[(0, 5)], [], [(9, 12)]],)], "c array<array<struct<a:bigint,b:bigint>>>")
    merged = df.select(seq.merge_chunks(F.col("c")).alias("m"))
    assert tup(merged.first()[0]) == [(0, 5), (9, 12)]
    assert tup(merged.select(seq.fill_gaps(F.col("m"), F.lit(0), F.lit(14))).first()[0]) == [(0, 5), (5, 9), (9, 12), (12, 14)]


def test_overlap_text(spark):
    df = us(spark, [(0, 10, "a"), (8, 14, "b"), (10, 10, "z")])
    cut = lambda a, b: df.select(seq.overlap_text(F.col("u"), F.lit(a), F.lit(b))).first()[0]
    assert (cut(0, 10), cut(10, 20)) == ("a b", "b")
    x = df.withColumn("b", F.expr("array(named_struct('a',0L,'b',9L),named_struct('a',30L,'b',40L),named_struct('a',12L,'b',14L))"))
    assert [tuple(r) for r in x.select(seq.segments(F.col("u"), F.col("b"))).first()[0]] == [(0, 0, 9, "a b"), (1, 12, 14, "b")]


def test_a_hundred_thousand_utterances(spark):
    """Every operator over one long video, within a time that a quadratic one wouldn't keep."""
    import time

    n = 100_000
    long = f"transform(sequence(0L, {n - 1}L), i -> named_struct('start_ms', i * 300, 'end_ms', i * 300 + 250, 'text', concat('w', i)))"
    df = seq.settled(spark.range(1), u=F.expr(long)).withColumn("u", F.col("u").cast(seq.UTTERANCES))
    began = time.time()
    holes = F.transform("u", lambda x, i: F.struct(F.when(i % 5 != 2, x["start_ms"]).alias("start_ms"), F.when(i % 3 != 1, x["end_ms"]).alias("end_ms"), x["text"].alias("text")))
    assert df.select(F.size(seq.fill_times(holes))).first()[0] == n
    assert df.select(F.size(seq.complete_ends(F.col("u")))).first()[0] == n
    blocks = df.select(seq.coalesce_windows(F.col("u")).alias("b")).select(F.size("b"), F.col("b")[1]["text"]).first()
    assert blocks[0] == -(-n // 27) and blocks[1].split()[0] == "w27"
    x = seq.settled(df, x=F.transform("u", lambda v: F.struct((v["start_ms"] - 100).alias("a"), (v["end_ms"] + 100).alias("b"))))
    tiles = seq.settled(x, t=seq.reconcile(F.col("x"), F.lit(0), F.lit(n * 300)))
    assert tiles.select(F.size("t")).first()[0] == n
    assert tiles.select(F.size(seq.merge_chunks(F.transform("t", lambda v: F.array(v))))).first()[0] == 1
    spans = seq.settled(df, s=seq.chunk_spans(F.lit(0), F.lit(n * 300), 600_000, 15_000))
    assert spans.select(F.size(F.flatten(seq.span_blocks(F.col("u"), F.col("s"))))).first()[0] > n // 27
    assert spans.select(F.size(seq.segments(F.col("u"), F.col("s")))).first()[0] == spans.select(F.size("s")).first()[0]
    assert seq.settled(df, k=seq.running_sum(F.transform("u", lambda v: F.lit(2).cast("bigint")))).select(F.element_at("k", -1)).first()[0] == 2 * n
    assert time.time() - began < 60


def test_rows_without_arrays(spark):
    df = spark.createDataFrame([(None, None), ([], [])], f"u {seq.UTTERANCES}, x {seq.BOUNDS}")
    cols = [seq.fill_times(F.col("u")), seq.coalesce_windows(F.col("u")), seq.segments(F.col("u"), F.col("x")), seq.span_blocks(F.col("u"), F.col("x")), seq.complete_ends(F.col("u"))]
    for c in cols:
        assert [r[0] for r in df.select(c).collect()] == [None, []]
    assert [r[0] for r in df.select(seq.reconcile(F.col("x"), F.lit(0), F.lit(5))).collect()] == [None, [(0, 5)]]
