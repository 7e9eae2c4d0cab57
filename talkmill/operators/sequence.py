"""Interval and sequence operators over the utterances of a video.

A video is one row; its utterances are an array of (start_ms, end_ms, text) and its bounds an array of (a, b). All
operators are expressions on those arrays, so none shuffles. The work of a row is in proportion to its length, at most
times the logarithm of it: what depends on all elements before goes over the times alone in Arrow batches and gives
times or places, while texts stay where they are. (A fold that appends to an array copies it at each step.)
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

UTTERANCES = "array<struct<start_ms:bigint,end_ms:bigint,text:string>>"
BOUNDS = "array<struct<a:bigint,b:bigint>>"


def let(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` of ``values``, each of which is evaluated once a row.

    What a lambda of a higher-order function refers to outside of itself is evaluated for every element, and the
    optimizer puts the expressions of earlier projections in its place; a bound value is a variable instead.
    """
    if len(values) == 1:
        return F.get(F.transform(F.array(values[0]), body), F.lit(0))
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(bound), lambda s: body(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))


# Places of utterances, for each of several spans or blocks.
_PLACES = ArrayType(ArrayType(IntegerType()))
#: A time that is missing, in what goes to Python: arrays with nulls would become floating numbers there.
MISSING = -(1 << 62)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, which what follows takes as they are.

    A generator isn't merged with the projections after it, as a projection would be: an expression is neither
    repeated there nor does it end up among the arguments of a function over times, where the optimizer loses track of lambdas
    within lambdas.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_s")
    return df.select(*[c for c in df.columns if c not in columns], made).select("*", "_s.*").drop("_s")


def running_sum(values: Column) -> Column:
    """Of whole numbers without nulls. Not for use within a lambda."""
    return _running_sum(values)


@F.pandas_udf(ArrayType(LongType()))
def _running_sum(values: pd.Series) -> pd.Series:
    return values.map(np.cumsum, na_action="ignore")


def _utterance(start: Column, end: Column, text: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start_ms"), end.cast("bigint").alias("end_ms"), text.alias("text"))


def _bound(a: Column, b: Column) -> Column:
    return F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))


def even_spacing(texts: Column, duration_seconds: Column) -> Column:
    """Utterances of equal length over the duration, a second each if that is longer; the last takes what is left over."""

    def spaced(texts: Column, n: Column, total: Column) -> Column:
        step = F.greatest(F.floor(total / F.greatest(n, F.lit(1))), F.lit(1))
        return let(lambda texts, n, total, step: F.transform(texts, lambda x, i: _utterance(i * step, F.when(i == n - 1, total).otherwise((i + 1) * step), x)), texts, n, total, step)

    total = lambda t: F.greatest((F.coalesce(duration_seconds, F.lit(0.0)) * 1000).cast("bigint"), F.size(t).cast("bigint") * 1000)
    return let(lambda t: let(spaced, t, F.size(t), total(t)), texts)


def ordered(utterances: Column) -> Column:
    """By start; those that start together keep their order."""
    keyed = F.transform(utterances, lambda u, i: F.struct(u["start_ms"].alias("s"), i.alias("i"), u.alias("u")))
    return F.transform(F.array_sort(keyed), lambda k: k["u"])


def _given(utterances: Column, field: str) -> Column:
    return F.transform(utterances, lambda u: F.coalesce(u[field], F.lit(MISSING)))


@F.pandas_udf(ArrayType(StructType([StructField("start_ms", LongType()), StructField("end_ms", LongType()), StructField("i", IntegerType())])))
def _filled(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """(start, end, index) of each utterance, ordered by start."""

    def one(s: np.ndarray, e: np.ndarray) -> list[dict] | None:
        if s is None or e is None:
            return None
        following, later = [], None
        for x in s[::-1].tolist():
            following.append(later)
            later = x if x != MISSING else later
        out, reached = [], 0
        for i, (x, y, nxt) in enumerate(zip(s.tolist(), e.tolist(), reversed(following))):
            x = reached if x == MISSING else x
            if y == MISSING:
                y = nxt if nxt and nxt > x else x + 1000
            out.append((x, max(x, y), i))
            reached = max(reached, y)
        return [{"start_ms": x, "end_ms": y, "i": i} for x, y, i in sorted(out, key=lambda r: r[0])]

    return pd.Series([one(s, e) for s, e in zip(starts, ends)], dtype=object)


def fill_times(utterances: Column) -> Column:
    """Missing starts take the latest end so far, missing ends the next given start if that is later, else a second after the start.

    Entries have start_ms and end_ms or null. Where every start is missing, use :func:`even_spacing`. The result is
    ordered and no entry ends before it starts. Not for use within a lambda.
    """
    times = _filled(_given(utterances, "start_ms"), _given(utterances, "end_ms"))
    return let(lambda us, ts: F.transform(ts, lambda t: _utterance(t["start_ms"], t["end_ms"], F.get(us, t["i"])["text"])), utterances, times)


def complete_ends(utterances: Column) -> Column:
    """Ordered utterances in which a missing end is the next start, or a second after the start for the last; none ends before it starts."""
    nexts = lambda u: F.transform(F.slice(u, 2, F.greatest(F.size(u), F.lit(1))), lambda x: x["start_ms"])
    ended = lambda x, n: _utterance(x["start_ms"], F.greatest(F.coalesce(x["end_ms"], n, x["start_ms"] + 1000), x["start_ms"]), x["text"])
    return let(lambda u: F.zip_with(u, nexts(u), ended), ordered(utterances))


def _overlap(starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """For each span the places of the utterances, ordered by start, that end after ``a`` and start before ``b``."""
    reached = np.maximum.accumulate(ends) if len(ends) else ends
    low, high = np.searchsorted(reached, a, "right"), np.searchsorted(starts, b, "left")
    return [lo + np.flatnonzero(ends[lo:hi] > x) for lo, hi, x in zip(low.tolist(), high.tolist(), a.tolist())]


def _blocks(starts: np.ndarray, members: np.ndarray, window_ms: int) -> list[np.ndarray]:
    """``members`` in blocks, each of which has those that start within ``window_ms`` of its first."""
    out, at, s = [], 0, starts[members]
    while at < len(members):
        late = s[at:] >= s[at] + window_ms
        to = at + int(late.argmax()) if late.any() else len(members)
        out.append(members[at:to])
        at = to
    return out


@F.pandas_udf(_PLACES)
def _overlapping(starts: pd.Series, ends: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if any(x is None for x in row) else [m.tolist() for m in _overlap(*row)] for row in zip(starts, ends, a, b)], dtype=object)


@F.pandas_udf(ArrayType(_PLACES))
def _span_blocks(starts: pd.Series, ends: pd.Series, a: pd.Series, b: pd.Series, window_ms: pd.Series) -> pd.Series:
    return pd.Series([None if any(x is None for x in row) else [[m.tolist() for m in _blocks(row[0], members, w)] for members in _overlap(*row)] for *row, w in zip(starts, ends, a, b, window_ms)], dtype=object)


@F.pandas_udf(_PLACES)
def _all_blocks(starts: pd.Series, window_ms: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else [m.tolist() for m in _blocks(s, np.arange(len(s)), w)] for s, w in zip(starts, window_ms)], dtype=object)


def _joined(utterances: Column, members: Column) -> Column:
    return F.array_join(F.transform(members, lambda i: F.get(utterances, i)["text"]), " ")


def _block(utterances: Column, members: Column) -> Column:
    at = lambda i: F.get(utterances, F.get(members, i))
    return _utterance(at(F.lit(0))["start_ms"], at(F.size(members) - 1)["end_ms"], _joined(utterances, members))


def _field(rows: Column, name: str) -> Column:
    return F.transform(rows, lambda x: x[name])


def coalesce_windows(utterances: Column, window_ms: int = 8000) -> Column:
    """Blocks of utterances, ordered by start, that start within ``window_ms`` of the first of their block.

    A block ends where its last utterance ends, which isn't always the latest end; texts are joined by spaces. Not for
    use within a lambda.
    """
    places = _all_blocks(_field(utterances, "start_ms"), F.lit(window_ms))
    return let(lambda us, bs: F.transform(bs, lambda m: _block(us, m)), utterances, places)


def span_blocks(utterances: Column, spans: Column, window_ms: int = 8000) -> Column:
    """For each span the blocks of the utterances that it overlaps. Not for use within a lambda."""
    places = _span_blocks(_field(utterances, "start_ms"), _field(utterances, "end_ms"), _field(spans, "a"), _field(spans, "b"), F.lit(window_ms))
    return let(lambda us, ps: F.transform(ps, lambda bs: F.transform(bs, lambda m: _block(us, m))), utterances, places)


def extent(utterances: Column) -> tuple[Column, Column]:
    """The first start and the end of the last utterance; null without utterances."""
    return F.get(utterances, F.lit(0))["start_ms"], F.get(F.reverse(utterances), F.lit(0))["end_ms"]


def chunk_spans(t0: Column, t1: Column, chunk_ms: int, overlap_ms: int) -> Column:
    """Spans of ``chunk_ms`` over [t0, t1], each beginning ``overlap_ms`` before the one before it ends; none if t1 <= t0."""
    if chunk_ms <= 0 or not 0 <= overlap_ms < chunk_ms:
        raise ValueError("the chunk must be positive and the overlap less than it")
    step = chunk_ms - overlap_ms

    def spans(t0: Column, t1: Column) -> Column:
        n = F.when(t1 - t0 <= chunk_ms, 1).otherwise(1 + F.ceil((t1 - t0 - chunk_ms) / step)).cast("int")
        return F.when(t1 > t0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: _bound(t0 + k * step, F.least(t1, t0 + k * step + chunk_ms)))).otherwise(F.array().cast(BOUNDS))

    return let(spans, t0, t1)


def owned(spans: Column, overlap_ms: int) -> Column:
    """What each chunk speaks for: up to where the next one begins, the last to its end."""
    return let(lambda spans, n: F.transform(spans, lambda s, k: _bound(s["a"], F.when(k == n - 1, s["b"]).otherwise(s["b"] - overlap_ms))), spans, F.size(spans))


def _edges(a: np.ndarray, b: np.ndarray, start: int, end: int) -> np.ndarray:
    """Where the tiles of [start, end] begin and end that bounds make which may overlap, leave gaps or lie outside."""
    if end <= start:
        return np.zeros(0, np.int64)
    a, b = np.maximum(a, start), np.minimum(b, end)
    a, b = a[b > a], b[b > a]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    before = np.maximum.accumulate(np.concatenate(([start], b)))[:-1]
    a = np.maximum(a, before)
    return np.unique(np.concatenate(([start, end], a[b > a], b[b > a])).astype(np.int64))


@F.pandas_udf(ArrayType(LongType()))
def _tile_edges(a: pd.Series, b: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None or pd.isna(s) or pd.isna(e) else _edges(x, y, int(s), int(e)) for x, y, s, e in zip(a, b, start, end)], dtype=object)


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _chunk_edges(a: pd.Series, b: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([None if any(x is None for x in row) else [_edges(x, y, s, e).tolist() for x, y, s, e in zip(*row)] for row in zip(a, b, starts, ends)], dtype=object)


def _between(edges: Column) -> Column:
    """The bounds from each edge to the next."""
    return let(lambda es: F.transform(F.slice(es, 2, F.greatest(F.size(es) - 1, F.lit(0))), lambda x, i: _bound(F.get(es, i), x)), edges)


def reconcile(bounds: Column, start: Column, end: Column) -> Column:
    """A contiguous tiling of [start, end] from bounds that may overlap, leave gaps or lie outside; gaps become bounds. Not for use within a lambda."""
    return _between(_tile_edges(_field(bounds, "a"), _field(bounds, "b"), start.cast("bigint"), end.cast("bigint")))


def reconcile_chunks(replies: Column, spans: Column, own: Column) -> Column:
    """For each chunk its bounds made a tiling of its span and clipped to what it owns. Not for use within a lambda."""
    each = lambda name: F.transform(replies, lambda r: F.transform(r, lambda x: x[name]))
    edges = _chunk_edges(each("a"), each("b"), _field(spans, "a"), _field(spans, "b"))
    return F.zip_with(edges, own, lambda es, o: clip(_between(es), o["a"], o["b"]))


def clip(bounds: Column, a: Column, b: Column) -> Column:
    """``bounds`` within [a, b]; those without length are dropped."""
    return let(lambda bounds, a, b: F.filter(F.transform(bounds, lambda x: _bound(F.greatest(x["a"], a), F.least(x["b"], b))), lambda x: x["b"] > x["a"]), bounds, a, b)


def merge_chunks(per_chunk: Column) -> Column:
    """One array of bounds from those of each chunk, in order.

    Where the last bound of a chunk touches the first of the next, no topic can be said to change, so the two are
    one; a hole that a chunk without text left stays.
    """

    def merged(flat: Column) -> Column:
        places = F.transform(flat, lambda x, i: F.when(x["first"] & (F.get(flat, i - 1)["b"] == x["a"]), F.lit(None)).otherwise(i))
        return let(
            lambda flat, begins: F.transform(begins, lambda at, k: _bound(F.get(flat, at)["a"], F.get(flat, F.coalesce(F.get(begins, k + 1), F.size(flat)) - 1)["b"])),
            flat,
            F.filter(places, lambda i: i.isNotNull()),
        )

    flat = F.flatten(F.transform(per_chunk, lambda c: F.transform(c, lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), (i == 0).alias("first")))))
    return let(merged, flat)


def fill_gaps(bounds: Column, t0: Column, t1: Column) -> Column:
    """Sorted ``bounds`` with a bound in each hole between them and at both ends of [t0, t1]."""
    return reconcile(bounds, t0, t1)


def slice_overlap(utterances: Column, a: Column, b: Column) -> Column:
    """Utterances that end after ``a`` and start before ``b``; one that spans a border is on both sides of it."""
    return F.filter(utterances, lambda u: (u["end_ms"] > a) & (u["start_ms"] < b))


def overlap_text(utterances: Column, a: Column, b: Column) -> Column:
    return F.array_join(F.transform(slice_overlap(utterances, a, b), lambda u: u["text"]), " ")


def segments(utterances: Column, bounds: Column) -> Column:
    """(segment_id, a, b, text) of each bound with text, numbered from 0 after those without are dropped.

    Utterances are ordered by start. Not for use within a lambda.
    """

    def numbered(us: Column, bounds: Column, places: Column) -> Column:
        all_of = F.zip_with(bounds, places, lambda x, m: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.trim(_joined(us, m)).alias("text")))
        return F.transform(F.filter(all_of, lambda s: s["text"] != ""), lambda s, i: F.struct(i.alias("segment_id"), s["a"].alias("a"), s["b"].alias("b"), s["text"].alias("text")))

    places = _overlapping(_field(utterances, "start_ms"), _field(utterances, "end_ms"), _field(bounds, "a"), _field(bounds, "b"))
    return let(numbered, utterances, bounds, places)
