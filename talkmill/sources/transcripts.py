"""Reading a transcript, in whatever form it was delivered, as timed utterances.

The forms are tried in turn: records in JSON, captions timed word by word, captions that an HTML page points to, and
text, which an HTML page is reduced to. A form that yields nothing lets the next one try.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections.abc import Callable
from html.parser import HTMLParser
from typing import Any
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.arrow import map_rows
from talkmill.functions.text import NO_CAPTIONS

Utterance = tuple[int, int, str]

# The fields under which records keep text and times; those in milliseconds are asked before those in seconds.
TEXT_FIELDS = ("text", "caption", "content", "transcript", "snippet", "utf8")
TIME_FIELDS = {
    "start": (("start_ms", "startMs", "start_time_ms", "startTimeMs", "offset_ms", "offsetMs", "timecode_in_ms"), ("start", "start_seconds", "startSecond", "start_time", "startTime", "offset", "startOffset")),
    "end": (("end_ms", "endMs", "end_time_ms", "endTimeMs", "timecode_out_ms"), ("end", "end_seconds", "endSecond", "end_time", "endTime")),
    "length": (("duration_ms", "durationMs", "dur_ms", "dDurationMs"), ("duration", "duration_seconds", "durationSeconds", "dur")),
}
# Elements whose text isn't shown.
UNSHOWN = {"script", "style", "head", "noscript"}
# Lengths of word groups, of an utterance without an end, in milliseconds.
GROUP_MS, SECOND = 5000, 1000

_WORD_TAG = re.compile(r"<(\d{1,2}:\d{2}:\d{2}\.\d+)>(?:<c>)?([^<]*)(?:</c>)?")
_TIMING = re.compile(r"<\d{1,2}:\d{2}:\d{2}\.\d+>|</?c>")
_CLOCK = re.compile(r"(?:(\d+):)?(\d+):(\d+)(?:\.(\d*))?")


def flat(text: str) -> str:
    return " ".join(text.split())


def clock_ms(text: str) -> int | None:
    m = _CLOCK.fullmatch(text.strip())
    return None if m is None else ((int(m[1] or 0) * 60 + int(m[2])) * 60 + int(m[3])) * SECOND + int(f"{m[4] or '':0<3.3}")


def time_ms(value: Any, unit: float) -> int | None:
    """``value`` in milliseconds; numbers are in units of ``unit`` ms unless a suffix says otherwise. Nothing that isn't a finite time counts."""
    if isinstance(value, str):
        text = value.strip().strip("<>")
        if ":" in text:
            return clock_ms(text.replace(",", "."))
        for suffix, of in (("ms", 1.0), ("s", 1000.0)):
            if text.endswith(suffix):
                text, unit = text[: -len(suffix)], of
                break
        try:
            value = float(text)
        except ValueError:
            return None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return None
    return int(value * unit)


def field_time(record: dict, which: str, compat: bool = False) -> int | None:
    """The first field that reads as a time. ``compat``: a 0 in milliseconds lets the fields in seconds speak."""
    in_ms, in_s = ([t for k in names if (t := time_ms(record.get(k), unit)) is not None] for names, unit in zip(TIME_FIELDS[which], (1.0, 1000.0)))
    if in_ms and not (compat and in_ms[0] == 0):
        return in_ms[0]
    return in_s[0] if in_s else None


def field_text(record: dict) -> str:
    return next((t for k in TEXT_FIELDS if record.get(k) is not None and (t := flat(html.unescape(str(record[k]))))), "")


def timed(items: list[tuple[int | None, int | None, str]], duration_s: float) -> list[Utterance]:
    """Complete times for (start, end, text): spread evenly if no start is given, else filled from what is around."""
    items = [(a, b, t) for a, b, t in items if t]
    if not items:
        return []
    if all(a is None for a, _, _ in items):
        return spread([t for _, _, t in items], duration_s)
    following: list[int | None] = []
    later = None
    for a, _, _ in reversed(items):
        following.append(later)
        later = a if a is not None else later
    out, reached = [], 0
    for (a, b, t), nxt in zip(items, reversed(following)):
        start = reached if a is None else a
        if b is None:
            b = nxt if nxt and nxt > start else start + SECOND
        reached = max(reached, b)
        out.append((start, max(start, b), t))
    return sorted(out, key=lambda u: u[0])


def spread(texts: list[str], duration_s: float) -> list[Utterance]:
    n = len(texts)
    whole = max(int(duration_s * SECOND), n * SECOND)
    step = max(1, whole // n) if n else 0
    return [(k * step, whole if k + 1 == n else (k + 1) * step, t) for k, t in enumerate(texts)]


def record_items(text: str, compat: bool = False) -> list[tuple[int | None, int | None, str]]:
    """(start, end, text) of each record of a JSON array as far as given; an end follows from a start and a length. None if ``text`` is no array."""
    if not text.startswith("["):
        return []
    try:
        records = json.loads(text)
    except ValueError:
        return []
    items = []
    for r in records if isinstance(records, list) else []:
        if isinstance(r, dict):
            start, end, length = (field_time(r, w, compat) for w in ("start", "end", "length"))
            if end is None and start is not None and length is not None:
                end = start + max(1, length)
            if compat and end == 0:
                end = None
            items.append((None if compat and start == 0 and "start" not in r else start, end, field_text(r)))
        else:
            items.append((None, None, flat(html.unescape(str(r)))))
    return items


def from_records(text: str, duration_s: float, compat: bool = False) -> list[Utterance]:
    return timed(record_items(text, compat), duration_s)


def from_word_tags(text: str, duration_s: float) -> list[Utterance]:
    """Words with their own times, in groups of at most GROUP_MS; a group ends where the next begins."""
    words = list(dict.fromkeys((clock_ms(at), w) for at, raw in _WORD_TAG.findall(text) if (w := html.unescape(raw).strip())))
    groups: list[tuple[int, list[str]]] = []
    for at, w in words:
        if not groups or at - groups[-1][0] >= GROUP_MS:
            groups.append((at, []))
        groups[-1][1].append(w)
    if not groups:
        return []
    last = max(int(duration_s * SECOND), words[-1][0] + SECOND)
    ends = [*[a for a, _ in groups[1:]], last]
    return timed([(a, b, flat(" ".join(ws))) for (a, ws), b in zip(groups, ends)], duration_s)


class _Shown(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.unshown, self.runs = 0, []

    def handle_starttag(self, tag: str, attrs: Any) -> None:
        self.unshown += tag in UNSHOWN

    def handle_endtag(self, tag: str) -> None:
        self.unshown = max(0, self.unshown - (tag in UNSHOWN))

    def handle_data(self, data: str) -> None:
        if not self.unshown and data.strip():
            self.runs.append(data)


def page_text(page: str) -> str:
    """What a page shows, on one line."""
    reader = _Shown()
    try:
        reader.feed(page)
    except Exception:  # noqa: BLE001 - whatever a broken page raises, its text is still wanted
        return flat(re.sub(r"<[^>]+>", " ", page))
    return flat(" ".join(reader.runs))


def player_data(page: str) -> dict | None:
    """The object that a page assigns to ytInitialPlayerResponse."""
    m = re.search(r"ytInitialPlayerResponse\s*=\s*(?=\{)", page)
    if not m:
        return None
    try:
        found, _ = json.JSONDecoder().raw_decode(page, m.end())
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def caption_url(page: str) -> str | None:
    """Where a page's captions are: English ones if there are any, asked for as JSON."""
    tracks: Any = player_data(page)
    for key in ("captions", "playerCaptionsTracklistRenderer", "captionTracks"):
        tracks = tracks.get(key) if isinstance(tracks, dict) else None
    tracks = [t for t in tracks if isinstance(t, dict)] if isinstance(tracks, list) else []
    if not tracks:
        return None
    track = next((t for t in tracks if str(t.get("languageCode", "")).startswith("en")), tracks[0])
    if not (url := track.get("baseUrl")):
        return None
    parts = urlsplit(url)
    query = [(k, v) for k, v in parse_qsl(parts.query) if k != "fmt"]
    return urlunsplit(parts._replace(query=urlencode([*query, ("fmt", "json3")])))


def from_captions(data: str) -> list[Utterance]:
    """A caption file in JSON events or in XML."""
    items: list[tuple[int | None, int | None, str]] = []
    try:
        if data.lstrip().startswith("{"):
            for e in json.loads(data).get("events", []):
                text = html.unescape(flat("".join(str(s.get("utf8", "")) for s in e.get("segs") or [])))
                start = int(e.get("tStartMs") or 0)
                items.append((start, start + max(1, int(e.get("dDurationMs") or SECOND)), text))
        else:
            for e in ElementTree.fromstring(data).iter("text"):
                start, length = float(e.get("start", 0)), float(e.get("dur", 1))
                items.append((int(start * SECOND), int((start + length) * SECOND), html.unescape(flat("".join(e.itertext())))))
    except (ValueError, TypeError, AttributeError, ElementTree.ParseError):
        return []
    return timed([(a, b, flat(html.unescape(t))) for a, b, t in items], 0.0)


def from_text(text: str, duration_s: float) -> list[Utterance]:
    return spread([s for p in re.split(r"(?<=[.!?])\s+", text) if (s := p.strip())], duration_s)


def read(transcript: str | None, duration_s: float = 0.0, fetch: Callable[[str], str | None] | None = None, compat: bool = False) -> tuple[str, list[Utterance]]:
    """(form, utterances) of a transcript: records, words, captions, page, text or none.

    ``fetch`` gets the address of a page's captions and returns the file or None; without it nothing is fetched.
    """
    text = (transcript or "").strip()
    if not text or NO_CAPTIONS in text:
        return "none", []
    for form, found in (("records", lambda: from_records(text, duration_s, compat)), ("words", lambda: from_word_tags(text, duration_s))):
        if out := found():
            return form, out
    if text.startswith("<"):
        if fetch and (url := caption_url(text)) and (data := fetch(url)) and (out := from_captions(data)):
            return "captions", out
        out = from_text(flat(_TIMING.sub(" ", page_text(text))), duration_s)
        return ("page", out) if out else ("none", [])
    out = from_text(flat(_TIMING.sub(" ", text)), duration_s)
    return ("text", out) if out else ("none", [])


def seconds_of(videos: DataFrame, column: str) -> Column:
    """A duration as a number; what can't be read, isn't finite or is beyond all reason counts as 0."""
    seconds = F.expr(f"try_cast(trim(`{column}`) as double)") if dict(videos.dtypes)[column] == "string" else F.col(column).cast("double")
    return F.when(F.isnan(seconds) | (F.abs(seconds) > 1e9), 0.0).otherwise(seconds)


def utterances(videos: DataFrame, keys: list[str], text_col: str = "transcript", seconds_col: str = "duration_seconds", fetch: Callable[[str], str | None] | None = None, compat: bool = False) -> DataFrame:
    """``keys``, form and the array ``utterances`` for each row of ``videos``; one pass without a shuffle.

    Null, blank and unreadable transcripts have the form none and an empty array; repeated rows are read each.
    """
    kinds = ", ".join(f"`{k}` {videos.schema[k].dataType.simpleString()}" for k in keys)

    def fn(_: None, texts: list, seconds: list, *rest: list) -> list:
        got = [read(t, s or 0.0, fetch, compat) for t, s in zip(texts, seconds)]
        return [*rest, [f for f, _ in got], [[{"start_ms": a, "end_ms": b, "text": t} for a, b, t in u] for _, u in got]]

    return map_rows(videos.select(text_col, seconds_of(videos, seconds_col).alias("_s"), *keys), f"{kinds}, form string, utterances array<struct<start_ms:bigint,end_ms:bigint,text:string>>", fn)
