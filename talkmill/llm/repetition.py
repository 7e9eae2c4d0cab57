"""The share of a transcript's spoken words that stand in second or later copies of what it said before.

The lines of a page are labelled content or boilerplate by a linear-chain conditional random field: what a line says, its
place, its neighbours and the labels around it speak for one or the other, and the best path (Viterbi) decides. It is
fitted on pages that mark their own parts, as they stand and with their tags taken off. The lines of all other
transcripts are content. The content is cut into units (sentences, or windows where there are no sentence ends); what
of it is covered by word sequences or whole sentences said earlier is repeated, and the share of the rest decides
whether a transcript is retained.
"""

from __future__ import annotations

import html
import json
import re
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.arrow import map_rows
from talkmill.llm.crf import ChainCRF
from talkmill.llm.pages import NOTICE, NOTICE_WORDS, Line, PageModel, heading_of, is_markup, line_hash, line_score, noticed, page_lines, page_model, page_table, seed_lines, shown
from talkmill.llm.turns import _LABEL, _NOTES, _STAMP, _STARRED

#: Words of the shortest phrase whose copies count, and of the shortest whole sentence.
PHRASE, SENTENCE = 8, 4
#: Words of a unit where no sentence ends.
WINDOW = 25
#: A transcript is heavily repetitive from this share on.
HEAVY = 0.3
#: Labelled pages that the random field is fitted on, those with the smallest hashes of the text; and lines of one sequence of the fit.
FITTED, SEQUENCE = 150, 80

_VTT = re.compile(r"<\d+:\d\d:\d\d[.,]\d+>|</?c[^>]*>|^WEBVTT.*$|^\s*(?:\d+:)?\d+:\d\d[.,]\d+\s*-->.*$", re.M)
_TIME_TAG = re.compile(r"<\d+:\d\d:\d\d")
_TAG = re.compile(r"<[^<>]*>")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
# A CJK run is read two characters at a time; numbers are all alike; letters with their apostrophes and hyphens are words.
_END = re.compile(r"[.!?。！？…\n]")
_WORD = re.compile(r"#|[぀-ヿ㐀-鿿]{1,2}|[^\W\d_぀-ヿ㐀-鿿]+(?:['’-][^\W\d_]+)*")
# The same for ASCII, several times as fast.
_ASCII_WORD = re.compile(r"#|[a-z]+(?:['-][a-z]+)*")
_MAY_NOTE = re.compile(r"[\[({*♪]")
_KEYS = ("text", "caption", "content", "transcript", "snippet", "utf8")


def line_features(lines: list[Line], own: list[float], head: int | None) -> np.ndarray:
    """Features by line: its own score and those of its neighbours, its place, length and end, links, and whether it is the heading."""
    n = len(lines)
    score = np.clip(np.array(own) / 3, -2, 2)
    around = np.pad(score, 2, constant_values=-1)
    at = np.arange(n)
    size = np.array([x.text.count(" ") + 1 for x in lines])
    stops = np.array([x.text.rstrip("\"'”’)」 ")[-1:] in set(".!?。！？…") for x in lines])
    links = np.array([min(x.links, 3) for x in lines])
    near = (around[1:-3] + around[3:-1]) / 2
    far = (around[:-4] + around[4:]) / 2
    return np.stack([np.ones(n), score, score > 0, near, far, np.exp(-at / 3), np.exp((at + 1 - n) / 3), np.log1p(size) / 3, stops, links / 3, at == (-1 if head is None else head)], 1).astype(float)


def fit_field(model: PageModel, fitted: int = FITTED) -> ChainCRF:
    """The random field, fitted on at most ``fitted`` of the pages lent to the model, each also without its tags; if there are none, on the seed lines."""
    w, notices = model.task()
    pages = [[(Line(i, t, tags, links), main) for i, (t, tags, links, main) in enumerate(page)] for kind, page in model.given if kind == "page"][:fitted]
    if not pages:
        rest, main = [[t for t, m in seed_lines() if m == kind] for kind in (False, True)]
        pages = [[(Line(i, t), m) for i, (t, m) in enumerate([(t, 0) for t in rest[k : k + 9]] + [(t, 1) for t in main] + [(t, 0) for t in rest[k + 9 : k + 15]])] for k in range(0, len(rest), 15)]
    xs, ys = [], []
    for page in pages:
        for bare in (False, True):
            lines = [Line(x.no, x.text) if bare else x for x, _ in page]
            own = [min(line_score(x, w), NOTICE) if x.text.count(" ") + 1 >= NOTICE_WORDS and line_hash(x.text) in notices else line_score(x, w) for x in lines]
            x = line_features(lines, own, next((k for k, (_, m) in enumerate(page) if m == 2), None))
            y = np.array([int(m == 0) for _, m in page])
            xs += [x[i : i + SEQUENCE] for i in range(0, len(x), SEQUENCE)]
            ys += [y[i : i + SEQUENCE] for i in range(0, len(y), SEQUENCE)]
    return ChainCRF.fit(xs, ys)


def content(text: str, title: str | None, weights: dict[str, float], field: ChainCRF | None, notices: frozenset[int] = frozenset()) -> str:
    """The lines of ``text`` that the field labels content; all of them where it is no page, or without a field."""
    page = page_lines(text, weights, notices)
    if page is None:
        return "\n".join(x.text for x in shown(text)) if is_markup(text) else text
    lines, own = page
    if field is None or not lines:
        return "\n".join(x.text for x in lines)
    head = heading_of(text, title, lines, own)
    states = field.decode(line_features(lines, own, head))
    return "\n".join(x.text for k, (x, state) in enumerate(zip(lines, states)) if not state or k == head)


def _without_notes(text: str, escaped: bool = True) -> str:
    text = html.unescape(text) if escaped else text
    return _NOTES.sub(" ", text) if _MAY_NOTE.search(text) else text


def spoken(text: str | None, title: str | None, weights: dict[str, float], field: ChainCRF | None = None, notices: frozenset[int] = frozenset()) -> str:
    """What is said in a transcript: no markup, keys, times, speaker labels, sound notes or page boilerplate."""
    if not text or not text.strip():
        return ""
    lead = text.lstrip("﻿ \t\r\n")
    if re.match(r"\[\s*[\"{]", lead):
        try:
            records = json.loads(lead)
        except ValueError:
            records = None
        if isinstance(records, list):
            said = (next((r[k] for k in _KEYS if isinstance(r.get(k), str) and r[k].strip()), "") if isinstance(r, dict) else r if isinstance(r, str) else "" for r in records)
            return _without_notes("\n".join(said))
    if _TIME_TAG.search(text) or "</c>" in text:
        return _without_notes(_TAG.sub("", _VTT.sub("", text)))
    plain = content(text, title, weights, field, notices)
    if is_markup(text):
        return _without_notes(plain, False)
    lines = plain.split("\n")
    rest, named = [], 0
    for line in lines:
        if m := _STARRED.match(line):
            rest.append((line[m.end() :],) * 2)
            continue
        if m := _STAMP.match(line):
            line = line[m.end() :]
        m = _LABEL.match(line)
        named += bool(m)
        rest.append((line, line[m.end() :] if m else line))
    labelled = named > 0.4 * sum(bool(a.strip()) for a, _ in rest)
    return _without_notes("\n".join(b if labelled else a for a, b in rest))


def units(said: str) -> list[list[str]]:
    """The units of a transcript as lists of words, without case; numbers are #."""
    out: list[list[str]] = []
    find = (_ASCII_WORD if said.isascii() else _WORD).findall
    for sentence in _END.split(_NUMBER.sub("#", said.lower())):
        if words := find(sentence):
            if len(words) <= 2 * WINDOW:
                out.append(words)
            else:
                out.extend(words[i : i + WINDOW] for i in range(0, len(words), WINDOW))
    return out


def _seen_before(codes: np.ndarray, n: int) -> np.ndarray:
    """For each word whether it stands in a sequence of ``n`` words that began earlier as well."""
    size = len(codes) - n + 1
    if size < 2:
        return np.zeros(len(codes), bool)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ codes[k : k + size]
        h ^= h >> np.uint64(29)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    again = first[inverse] < np.arange(size)
    edge = np.zeros(len(codes) + 1, np.int32)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def copies(us: list[list[str]]) -> np.ndarray:
    """For each word of the units whether it stands in a phrase or a whole sentence that was said before."""
    codes = np.fromiter(map(hash, chain.from_iterable(us)), np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    codes ^= codes >> np.uint64(32)
    covered, at = _seen_before(codes, PHRASE), 0
    seen: set[tuple] = set()
    for u in us:
        if len(u) >= SENTENCE:
            key = tuple(u)
            if key in seen:
                covered[at : at + len(u)] = True
            seen.add(key)
        at += len(u)
    return covered


def share(text: str | None, title: str | None, weights: dict[str, float], field: ChainCRF | None = None, notices: frozenset[int] = frozenset()) -> tuple[int, int]:
    """(spoken words, repeated words) of a transcript; each covered word of the content counts."""
    us = units(spoken(text, title, weights, field, notices))
    return (sum(map(len, us)), int(copies(us).sum())) if us else (0, 0)


def shares(videos: DataFrame, model: PageModel | None = None, field: ChainCRF | None = None) -> DataFrame:
    """(row_id, n_words, n_repeated, share, content_share) of each row, in one pass beside that of the model.

    Null, empty and blank transcripts have no words, share 0 and content share 1. Copies of a row have their own
    shares. Very long transcripts take time and memory in proportion to their length.
    """
    model = page_model(videos) if model is None else model
    field = fit_field(model) if field is None else field
    shared = videos.sparkSession.sparkContext.broadcast((*model.task(), field))

    def fn(state: tuple, ids: list, texts: list, titles: list, notices: list) -> list:
        w, every, crf = state
        counts = [share(t, n, w, crf, frozenset(own) if own else every) for t, n, own in zip(texts, titles, notices)]
        part = [b / a if a else 0.0 for a, b in counts]
        return [ids, [a for a, _ in counts], [b for _, b in counts], part, [1 - p for p in part]]

    rows = noticed(videos.select("row_id", "transcript", "title"), model)
    return map_rows(rows, "row_id long, n_words long, n_repeated long, share double, content_share double", fn, lambda: shared.value)


def retained(found: DataFrame, most: float = HEAVY) -> Column:
    """Whether a transcript of :func:`shares` is kept: what is said once makes up more than the rest of its content but for ``most``."""
    return F.col("share") < most


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shares(page_table(spark, sf_dir))
    return found.filter(~retained(found)).select("row_id")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(page_table(spark, sf_dir))
