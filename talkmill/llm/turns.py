"""Speech transcripts into clean, ordered speaker turns.

Lines or records are read into timed entries; labels are resolved to the speakers of the channel; each file segment
(a clock that starts anew begins another) has its timestamps repaired against an isotonic regression of them; sound
notes, fillers and stammers are taken out; neighbouring entries of one speaker, in order of time, are one turn.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.arrow import map_rows
from talkmill.functions.text import collapse
from talkmill.operators.skew import lookup_join
from talkmill.session import spread, table

#: A time further than this from the isotonic fit of its segment is wrong rather than out of order.
FAR_MS = 60_000
#: A fall of the clock by more than this, to under a quarter of what it had reached, starts another file.
RESET_MS = 30_000
#: channel_speakers is small; more rows than this are joined by channel, with hot channels apart, instead of sent to every task.
MOST_SPEAKERS = 50_000

# How times are written.
_TIME = r"(?:(?:\d+:)?\d{1,3}:\d{2}(?:[.,]\d+)?|(?:\d+h)?\d+m\d{1,2}(?:\.\d+)?s)"
_CLOCK = re.compile(r"(?:(\d+):)?(\d+):(\d+)(?:[.,](\d+))?|(?:(\d+)h)?(\d+)m(\d+)(?:\.(\d+))?s")
_NAME = r"[^\W\d_][^:|\[\]()<>*\n]{0,60}?"
# The forms of a line: a time (and an end) or none, a label or none, words or none.
_STAMP = re.compile(rf"\s*[\[(]?({_TIME})[\])]?(?:\s*-->\s*{_TIME})?\s*\|?\s*")
_STARRED = re.compile(rf"\s*\*\*\s*([^*\n]{{1,60}}?)\s*:?\s*\*\*\s*:?\s*(?:[\[(]({_TIME})[\])])?\s*")
_LABEL = re.compile(rf"\s*(?:>>+\s*)?({_NAME})\s*(?:[\[(]({_TIME})[\])])?\s*(?::|\s[-–—]\s|[–—](?=\s))\s*")
_MAY_LABEL = re.compile(r"[:*–—]|\s-\s")
# Fillers and notes of sounds.
FILLER = r"(?:u+[mh]+|uhm+|e+r+m*|h+m+|hm+|mm+-?h+m+|m+h?m+|uh-?huh|ah+|eh+|huh|[äö]h+m*|えーと|えっと|あのー)"
_FILLERS = re.compile(rf"(?<![\w'’-]){FILLER}(?![\w'’-])[,.…]*", re.I)
_PHRASES = re.compile(r"(?<![\w'’-])(?:you know|I mean)(?![\w'’-]),?")
_NOTES = re.compile(r"\[[^\[\]]*\]|\({1,2}[^()]*\){1,2}|\{[^{}]*\}|(?<!\*)\*[^*\n]+\*(?!\*)|[♪♫][^♪♫\n]*[♪♫]|[♪♫]+")
_NOTED = re.compile(r"\[[^\W\d_][^\[\]\n]*\]")
_STAMMER = re.compile(r"\b(\w+)((?:,? \1\b)+)", re.I)


def clock_ms(t: str) -> int | None:
    m = _CLOCK.fullmatch(t.strip())
    if not m:
        return None
    h, mi, s, f = m.groups()[:4] if m[2] is not None else m.groups()[4:]
    return ((int(h or 0) * 60 + int(mi)) * 60 + int(s)) * 1000 + int(f"{f or '':0<3}"[:3])


def bare(text: str) -> str:
    """``text`` without sound notes and fillers; empty if it has nothing else."""
    text = _FILLERS.sub(" ", _NOTES.sub(" ", text))
    return " ".join(text.split()) if re.search(r"\w", text) else ""


def clean(text: str) -> str:
    """The utterance as it should read: no notes, fillers or words said twice in a row; first letter kept as it is."""
    return re.sub(r"\s+([,.!?])", r"\1", _STAMMER.sub(r"\1", " ".join(_PHRASES.sub(" ", bare(text)).split()))).strip(" ,")


def _plain(label: str) -> str:
    return " ".join(re.sub(r"[^\w' -]+", " ", label.casefold()).split())


def aliases(speakers: list[tuple[int, str, str]]) -> dict[str, int]:
    """What each of a channel's speakers may be called, without what fits more than one of them.

    ``speakers`` has (id, name, role). The full name comes before first names, initials and roles.
    """
    tiers: list[dict[str, set[int]]] = [{}, {}, {}, {}]
    for sid, name, role in speakers:
        parts = _plain(name or "").split()
        put = lambda tier, k, sid=sid: k and tiers[tier].setdefault(k, set()).add(sid)
        put(0, " ".join(parts))
        if len(parts) > 1:
            first, last = parts[0], parts[-1]
            for k in (f"{first} {last[0]}", f"{first[0]} {last}", f"{last} {first}"):
                put(1, k)
            put(1, first)
            put(2, last)
            put(3, f"{first[0]}{last[0]}")
            put(3, f"{first[0]} {last[0]}")
            put(3, "".join(x[0] for x in re.split(r"[\s-]+", " ".join(parts)) if x))
        role = _plain(role or "")
        put(1, role)
        put(1, role.replace("-", " "))
        put(1, role.replace("-", ""))
    out: dict[str, int] = {}
    for tier in tiers:
        for k, ids in tier.items():
            if len(ids) == 1:
                out.setdefault(k, next(iter(ids)))
    return out


@lru_cache(maxsize=4096)
def _inline(names: tuple[str, ...]) -> re.Pattern:
    """Finds labels anywhere in a line, with the time before or after them; the longest name first."""
    spelled = [r"\.?[ ]+".join(re.escape(w) for w in n.split()) + r"\.?" for n in sorted(names, key=len, reverse=True)]
    return re.compile(rf"(?<![\w*@.-])(?:[\[(]?{_TIME}[\])]?(?:[ ]*-->[ ]*{_TIME})?[ ]*\|?[ ]*)?(?:>>+[ ]*)?(?:\*\*[ ]*)?(?:{'|'.join(spelled)})[ ]*(?:\*\*[ ]*[\[(]{_TIME}[\])]|(?:[\[(]{_TIME}[\])])?[ ]*(?::|[ ][-–—](?=[ ])))", re.I)


def isotonic(values: list[float]) -> list[float]:
    """The nearest non-decreasing sequence (least squares), by pooling adjacent violators."""
    pools: list[list[float]] = []  # [mean, weight]
    for v in values:
        pools.append([v, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            b = pools.pop()
            a = pools[-1]
            a[0], a[1] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]
    return [m for m, n in pools for _ in range(int(n))]


def repaired(times: list[int | None]) -> list[tuple[int, float]]:
    """(file segment, time) for each entry: missing times take that before them, far ones the isotonic fit."""
    segment, top, last, segments = 0, 0, 0, []
    for i, t in enumerate(times):
        t = last if t is None else t
        ahead = next((x for x in times[i + 1 : i + 4] if x is not None), None)
        if top - t > RESET_MS and t * 4 < top and (ahead is None or ahead * 4 < top or ahead - t < RESET_MS < top - ahead):
            segment, top = segment + 1, 0
        top, last = max(top, t), t
        segments.append((segment, t))
    out: list[tuple[int, float]] = []
    for s, group in groupby(segments, key=lambda x: x[0]):
        own = [t for _, t in group]
        if all(a <= b for a, b in zip(own, own[1:])):
            out += [(s, t) for t in own]
        else:
            out += [(s, t if abs(t - f) <= FAR_MS else f) for t, f in zip(own, isotonic(own))]
    return out


def entries(transcript: str, names: dict[str, int]) -> list[tuple[int | None, int | None, str]]:
    """(time, speaker, text) of each line or record as written; empty if the transcript names none of ``names``.

    A record's ``speaker``, or a label at the beginning of its text where no record has that field, or a line's label
    names a speaker; words before a colon that are no name stay words. A line without a time that follows words has
    the time of those.
    """
    text = transcript.lstrip("﻿ \t\r\n")
    if text.startswith(("[{", "[ {", "[\n")) or re.match(r"\[\s*[\"{]", text):
        try:
            records = json.loads(text)
        except ValueError:
            records = None
        if isinstance(records, list):
            return _records(records, names)
    if text.startswith("<") or not names:
        return []
    out: list[tuple[int | None, int | None, str]] = []
    named, now, who = 0, None, None
    for at, label, rest in _labelled(transcript, names):
        ms = clock_ms(at) if at else None
        named += label is not None
        if ms is not None:
            now, who = ms, None
        if label is not None:
            who = label
        if rest.strip():
            out.append((now, who, html.unescape(rest).strip()))
    return out if named else []


def _labelled(text: str, names: dict[str, int]) -> Iterator[tuple[str | None, int | None, str]]:
    """(time, speaker, words) of each line of ``text``, or of each part of a line that begins with a label; None for what isn't given."""
    label_at = _inline(tuple(names))
    # A time within a note, as of what couldn't be heard, is no time of the line.
    for line in (part for whole in _NOTED.sub("[note]", text).splitlines() for part in label_at.sub(lambda m: "\n" + m[0], whole).split("\n")):
        if not line.strip():
            continue
        at, label, rest = None, None, line
        if m := _STARRED.match(line):
            if (sid := names.get(_plain(m[1]))) is not None:
                label, at, rest = sid, m[2], line[m.end() :]
        if label is None:
            if m := _STAMP.match(rest):
                at, rest = m[1], rest[m.end() :]
            if (m := _LABEL.match(rest)) and (sid := names.get(_plain(m[1]))) is not None:
                label, at, rest = sid, m[2] or at, rest[m.end() :]
        yield at, label, rest


def _records(records: list, names: dict[str, int]) -> list[tuple[int | None, int | None, str]]:
    """Entries of records. Where no record has a field that names a speaker, the labels are read off their texts."""
    read = []
    for r in records:
        if isinstance(r, str):
            r = {"text": r}
        if isinstance(r, dict):
            text = next((r[k] for k in ("text", "caption", "content", "transcript", "snippet", "utf8") if isinstance(r.get(k), str) and r[k].strip()), "")
            label = next((r[k] for k in ("speaker", "speaker_name", "speakerName", "name") if isinstance(r.get(k), str)), None)
            if text:
                read.append((_record_ms(r), names.get(_plain(label)) if label else None, html.unescape(text)))
    if any(sid is not None for _, sid, _ in read):
        return read
    out, named = [], False
    for ms, _, text in read if names else ():
        who = None
        for at, label, rest in _labelled(text, names) if _MAY_LABEL.search(text) else ((None, None, text),):
            named, who = named or label is not None, who if label is None else label
            if rest.strip():
                out.append((clock_ms(at) if ms is None and at else ms, who, rest.strip()))
    return out if named else []


def _record_ms(r: dict) -> int | None:
    for k, unit in (("start_ms", 1), ("startMs", 1), ("offset_ms", 1), ("start", 1000), ("startTime", 1000), ("start_time", 1000)):
        v = r.get(k)
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) < 1e15:
            return int(v * unit)
        if isinstance(v, str) and (v := v.strip()):
            if (ms := clock_ms(v)) is not None:
                return ms
            if m := re.fullmatch(r"(-?\d+(?:\.\d+)?)(ms|s)?", v):
                return int(float(m[1]) * {"ms": 1, "s": 1000, None: unit}[m[2]])
    return None


def turns(transcript: str | None, names: dict[str, int]) -> list[tuple[int, str]]:
    """(speaker, clean text) of each turn in order."""
    if not transcript or not names:
        return []
    found = entries(transcript, names)
    order = [(s, t, i) for i, (s, t) in enumerate(repaired([e[0] for e in found]))] if any(e[0] is not None for e in found) else [(0, 0, i) for i in range(len(found))]
    out: list[tuple[int, list[str]]] = []
    who = None
    for _, _, i in sorted(order):
        _, label, text = found[i]
        words = bare(text)
        if not words:
            continue
        who = who if label is None else label
        if who is None:
            continue
        if out and out[-1][0] == who:
            out[-1][1].append(text)
        else:
            out.append((who, [text]))
    return [(w, " ".join(filter(None, map(clean, t)))) for w, t in out]


def speaker_turns(videos: DataFrame, speakers: DataFrame, most: int = MOST_SPEAKERS) -> DataFrame:
    """(row_id, turn_no, speaker_id, text): the turns of each transcript that names speakers of its channel.

    Channels match by name without case and padding; rows with a null channel, a null or blank transcript or no
    known name have no turns. Copies of a row have turns each. Transcripts never shuffle if the speakers are at
    most ``most``; beyond that only those of channels without many rows do.
    """
    channel = lambda c: F.lower(collapse(F.col(c)))
    by = speakers.filter("speaker_id is not null").groupBy(channel("creator_label").alias("channel")).agg(F.sort_array(F.collect_list(F.struct(F.col("speaker_id"), F.coalesce("speaker_name", F.lit("")).alias("name"), F.coalesce("speaker_role", F.lit("")).alias("role")))).alias("people"))
    by = by.select("channel", F.to_json("people").alias("people"))
    # Any transcript with turns has a colon, stars or a dash between label and words.
    rows = videos.select("row_id", "transcript", channel("creator_label").alias("channel")).filter(F.col("transcript").rlike(r"[:*–—-]"))
    if speakers.select("speaker_id").limit(most + 1).count() <= most:
        found = rows.join(F.broadcast(by), "channel")
    else:
        found = lookup_join(rows, by.join(rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n")), "channel"), "channel")
    return map_rows(found.select("row_id", "transcript", "people"), "row_id long, turn_no int, speaker_id long, text string", _batch)


@lru_cache(maxsize=4096)
def _names(people: str) -> dict[str, int]:
    return aliases([(p["speaker_id"], p["name"], p["role"]) for p in json.loads(people)])


def _batch(_: None, ids: list, transcripts: list, people: list) -> list:
    out: list[list] = [[], [], [], []]
    for i, t, p in zip(ids, transcripts, people):
        for k, (who, text) in enumerate(turns(t, _names(p)), 1):
            for col, v in zip(out, (i, k, who, text)):
                col.append(v)
    return out


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns(spread(table(spark, sf_dir, "videos").select("row_id", "transcript", "creator_label")), table(spark, sf_dir, "channel_speakers"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_turns(spark, sf_dir).select("row_id", "turn_no", "speaker_id")
