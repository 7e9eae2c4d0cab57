"""Cutting oversized texts at natural boundaries by lexical cohesion.

The words of a text are compared in two adjacent blocks that slide over it; valleys of their similarity mark changes
of topic. Within the part of a piece where a cut may fall, the boundary of the deepest valley is taken, and the next
piece begins ``overlap`` characters before it. Where no boundary stands within reach, the cut is forced at the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.arrow import map_rows
from talkmill.session import spread, table

#: Words of a step of the sliding blocks, and steps of a block.
STEP_WORDS, BLOCK_STEPS = 20, 6
#: Cuts are looked for in the last part of what a piece may hold, so that pieces stay large.
LAST_PART = 0.5

_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
# Natural boundaries in falling rank: the end of a paragraph, line, sentence, any of the characters that part a text.
_RANKS = [re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n\s*|</(?:p|div|li|tr|h\d)>\s*"), re.compile(r"[.!?][\"'”’)\]]*(?=\s)\s*|[。！？]+\s*"), re.compile(r"\s+|[.!?。！？]+")]
_BROKEN = re.compile(r"[\s.!?。！？]")


def in_stretch(text: str, at: int, more_than: int) -> bool:
    """Whether a cut at ``at`` parts more than ``more_than`` characters in a row that are neither white space nor one of . ! ? 。 ！ ？"""
    if not 0 < at < len(text) or _BROKEN.match(text, at - 1) or _BROKEN.match(text, at):
        return False
    low, high = max(0, at - more_than - 1), min(len(text), at + more_than + 1)
    before = low
    for step in range(at, low, -64):  # from the cut backwards, as a parting character is mostly near
        found = [m.end() for m in _BROKEN.finditer(text, max(low, step - 64), step)]
        if found:
            before = found[-1]
            break
    after = _BROKEN.search(text, at, high)
    return (after.start() if after else high) - before > more_than


def depths(words: list[str]) -> list[float]:
    """Depth of the similarity valley after each step but the last: how far it falls from the peaks on both sides."""
    counts: list[dict[str, int]] = []
    for i in range(0, len(words), STEP_WORDS):
        c: dict[str, int] = {}
        for w in words[i : i + STEP_WORDS]:
            c[w] = c.get(w, 0) + 1
        counts.append(c)
    n = len(counts)
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    dot = ll = rr = 0

    def move(block: dict[str, int], other: dict[str, int], step: dict[str, int], sign: int) -> tuple[int, int]:
        d = s = 0
        for w, k in step.items():
            old = block.get(w, 0)
            new = old + sign * k
            block[w] = new
            s += new * new - old * old
            d += (new - old) * other.get(w, 0)
        return d, s

    for c in counts[:BLOCK_STEPS]:
        d, s = move(right, left, c, 1)
        dot, rr = dot + d, rr + s
    sims = []
    for g in range(1, n):
        d, s = move(right, left, counts[g - 1], -1)
        dot, rr = dot + d, rr + s
        d, s = move(left, right, counts[g - 1], 1)
        dot, ll = dot + d, ll + s
        if g > BLOCK_STEPS:
            d, s = move(left, right, counts[g - 1 - BLOCK_STEPS], -1)
            dot, ll = dot + d, ll + s
        if g - 1 + BLOCK_STEPS < n:
            d, s = move(right, left, counts[g - 1 + BLOCK_STEPS], 1)
            dot, rr = dot + d, rr + s
        sims.append(dot / (ll * rr) ** 0.5 if ll and rr else 0.0)
    before, peak = [], 0.0
    for i, s in enumerate(sims):  # the peak that one climbs to, going left from the valley
        peak = max(peak, s) if i and sims[i - 1] >= s else s
        before.append(peak)
    out, peak = [0.0] * len(sims), 0.0
    for i in range(len(sims) - 1, -1, -1):
        peak = max(peak, sims[i]) if i + 1 < len(sims) and sims[i + 1] >= sims[i] else sims[i]
        out[i] = before[i] + peak - 2 * sims[i]
    return out


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(start, end, natural) of each piece of ``text``; pieces have at most ``limit`` characters and consecutive ones share ``overlap``."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be from 0 to less than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, True)]
    spans = [(m.start(), m.group().lower()) for m in _WORD.finditer(text)]
    deep = depths([w for _, w in spans])
    gaps = [spans[(g + 1) * STEP_WORDS][0] for g in range(len(deep))]
    out, start, done = [], 0, 0
    while n - start > limit:
        low, high = max(done + 1, start + overlap + 1, start + int(limit * LAST_PART)), start + limit
        cut = _cut(text, low, high, gaps, deep) or _cut(text, max(done + 1, start + overlap + 1), high, gaps, deep)
        natural = cut is not None
        if cut is None:
            cut = high
        out.append((start, cut, natural))
        done, start = cut, cut - overlap
    out.append((start, n, True))
    return out


def _cut(text: str, low: int, high: int, gaps: list[int], deep: list[float]) -> int | None:
    """The best natural boundary in (low, high]: of the highest rank there is, near the deepest valley."""
    if low > high:
        return None
    a, b = bisect_left(gaps, low), bisect_right(gaps, high)
    valley = gaps[max(range(a, b), key=lambda g: (deep[g], g))] if a < b else high
    reach = (high - low) // 8 + 1
    for rank in _RANKS:
        ends = [m.end() for m in rank.finditer(text, max(0, low - 1), min(len(text), high + 1)) if low <= m.end() <= high]
        if ends:
            near = [e for e in ends if abs(e - valley) <= reach]
            if near:
                return min(near, key=lambda e: abs(e - valley))
            if rank is _RANKS[-1] or rank is _RANKS[-2]:
                return min(ends, key=lambda e: abs(e - valley))
    return None


def split_texts(df: DataFrame, limit: int, overlap: int, id_col: str = "row_id", text_col: str = "transcript") -> DataFrame:
    """Pieces of each text: (row_id, piece_no, start, stop, cut, stretched, piece), one pass without a shuffle.

    ``start`` and ``stop`` are offsets in code points; ``cut`` says how the piece ends: natural, forced or end;
    ``stretched`` whether it ends within more than ``limit`` characters in a row without a parting character, which no
    piece can hold. Texts within the limit come out whole, empty ones as one empty piece; null texts have no pieces;
    repeated rows are split each.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def fn(_: None, ids: list, texts: list) -> list:
        out: list[list] = [[] for _ in range(7)]
        for i, t in zip(ids, texts):
            if t is None:
                continue
            pieces = cuts(t, limit, overlap)
            for k, (a, b, natural) in enumerate(pieces):
                for col, v in zip(out, (i, k, a, b, "end" if k + 1 == len(pieces) else "natural" if natural else "forced", in_stretch(t, b, limit), t[a:b])):
                    col.append(v)
        return out

    return map_rows(df.select(id_col, text_col), f"`{id_col}` {kind}, piece_no int, start int, stop int, cut string, stretched boolean, piece string", fn)


def cut_kinds(df: DataFrame, limit: int, overlap: int, id_col: str = "row_id", text_col: str = "transcript") -> DataFrame:
    """(row_id, cut) of each text longer than ``limit``, a row a text: forced if one of its cuts parts an overlong stretch, else natural.

    Of a stretch longer than the limit some cut has to fall inside, whatever the pieces before it, so the cuts tell.
    A cut that finds no boundary within what the overlap leaves of a piece, in a shorter stretch, is no reason.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def fn(_: None, ids: list, texts: list) -> list:
        return [ids, ["forced" if any(in_stretch(t, b, limit) for _, b, _ in cuts(t, limit, overlap)) else "natural" for t in texts]]

    return map_rows(df.select(id_col, text_col).filter(F.length(text_col) > limit), f"`{id_col}` {kind}, cut string", fn)


def settings(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    rows = {r["setting"]: r["chars"] for r in spark.read.parquet(f"{sf_dir}/split_settings.parquet").filter(F.col("setting").isin("max_chars", "overlap_chars")).collect()}
    return rows["max_chars"], rows["overlap_chars"]


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every transcript, with its text."""
    return split_texts(spread(table(spark, sf_dir, "videos").select("row_id", "transcript")), *settings(spark, sf_dir)).drop("stretched")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oversized transcripts and how their pieces are cut."""
    return cut_kinds(spread(table(spark, sf_dir, "videos").select("row_id", "transcript")), *settings(spark, sf_dir))
