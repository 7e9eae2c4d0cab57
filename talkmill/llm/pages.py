"""The main body of web pages, as HTML or as dumped text, by maximum-scoring subsequences.

Pages that mark their parts themselves (main, nav, aside, footer) serve as labelled pages: from a bounded sample of
them a weight is fitted to each word, word pair and mark, positive for main body and negative for the rest; tags weigh
against a line too. A linear scan then finds the maximal contiguous regions of positive score (Ruzzo and Tompa); what is
outside of them, and lines inside that speak clearly against themselves, is boilerplate. Sentences that stand word for
word on a part of the pages of a site, under different titles, as notices do, weigh against themselves whatever their words.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.arrow import map_rows
from talkmill.operators.skew import lookup_join
from talkmill.session import cut, spread, table

#: Labelled pages that the weights are fitted on; all others are only read. Those with the smallest hashes of the text.
LABELLED_PAGES = 1200
#: Transcripts in records, which are speech and no pages, that lend their lines as main body in all languages.
SPEECH_ROWS = 600
#: Rows of a table, pages or not, that the samples are drawn from; and lines that one row lends, and their characters, at most.
#: So what the driver gets for the fit has a bound in rows and bytes, however many and long the pages are.
DRAWN_ROWS, LENT_LINES, LENT_CHARS = 20_000, 200, 1000
#: With fewer labelled pages than this the seed lines are used as well.
SEED_BELOW = 50
#: Notices that are sent to every task; more are joined back by their hashes.
MOST_NOTICES = 1_000_000
#: A line of at least so many words is a notice if clearly more than this part of the titles of a site, or of all, have it:
#: if at least so many do, and the logarithm of how much likelier their number is at its own part than at this is so large.
#: That is evidence only; what a site's part is doesn't change with the size of the table.
NOTICE_WORDS, NOTICE_PART, NOTICE_TITLES, NOTICE_EVIDENCE = 4, 0.003, 5, 6.0
#: What such a line scores at most.
NOTICE = -3.0
#: Passes of the fit, its step and its pull of the weights to zero.
PASSES, STEP, DECAY = 120, 0.5, 1e-6
#: A line inside the main body is boilerplate if its own score is below this.
AGAINST = -0.5
#: What a line's opening and closing tags that hold no words of their own weigh; links weigh more.
TAG, LINK = -0.02, -0.3
#: Text without markup is a page if at least so many lines score below SURE.
PAGE_LINES, SURE = 2, -2.0

# A few labelled lines, parted by ¦, that hold where there are hardly any labelled pages.
SEED_BOILERPLATE = (
    "Home¦Menu¦Search¦About us¦Contact¦Sign up¦Log in¦Newsletter¦Archive¦Settings¦Episodes¦Live¦"
    "Explore¦Careers¦Store¦Downloads¦Topics¦Schedule¦Help centre¦Press room¦My library¦Shows¦Hosts¦Charts¦"
    "Donate¦Skip to main content¦Back to top¦Share this page: mail · copy link · print¦Terms of use | Privacy | Imprint¦© 2020 Example1. All rights reserved.¦We use cookies and similar tools to measure visits.¦By staying on this site you agree to our use of cookies.¦Cookies help us deliver our services. Got it!¦Accept | Reject | More options¦Advertisement¦Sponsored¦"
    "Story continues below this ad¦Trending now¦Related episodes¦Up next¦You may also like¦More from this show¦Most played this week¦12 likes · 3 replies · share¦4.2K subscribers    Subscribe¦Play ▶ 0:00 / 12:30  1x  ⤓¦‹ Prev 1 2 3 Next ›¦#topic #other¦"
    "Tags: one, two¦Home › Archive › Title¦Report a problem with this page¦Download our app¦Follow us wherever you listen¦Turn off autoplay¦Accessibility statement¦Change language: English, Español, Deutsch¦Rate this transcript: ★★★★★ (12 votes)¦Transcript · Chapters · Reviews (3)¦Inicio¦Buscar¦"
    "Contacto¦Iniciar sesión¦Boletín¦Tienda¦Ayuda¦Archivo¦En directo¦Temas¦Programas¦Volver arriba¦Página 2 de 9¦Aviso legal | Privacidad | Contacto¦"
    "Todos los derechos reservados.¦También te puede interesar¦Síguenos en todas las plataformas¦Startseite¦Suche¦Kontakt¦Anmelden¦Laden¦Hilfe¦Themen¦Sendungen¦Archiv¦"
    "Nach oben¦Seite 2 von 9¦Impressum | Datenschutz | AGB¦Alle Rechte vorbehalten.¦Das könnte Sie auch interessieren¦Warenkorb (2)¦Usamos cookies para medir las visitas. Aceptar o rechazar.¦Su privacidad es importante para nosotros y nuestros socios.¦Wir und unsere Partner verarbeiten Ihre Daten. Einstellungen ändern.¦Diese Seite verwendet Cookies. Annehmen oder ablehnen.¦Newsletter bestellen.¦Suscríbete al boletín.¦"
)
SEED_MAIN = (
    "We talked about it for a long time, and nobody had an answer.¦She said that the first one was better.¦Why did they leave so early?¦Exactly.¦"
    "No.¦In the end it was all for nothing.¦He read the page aloud, and the guests laughed.¦I think it is time to go home.¦"
    "Nobody questioned the results until last spring.¦The sign on the door asked us to accept the rules, which took a while.¦"
)

_MARKUP = re.compile(r"\s*(?:<!doctype\b|<!--|</?(?:html|head|body|div|nav|main|section|article|header|table|tr|td|p|ul|ol|li|h\d|span|a|title|meta|aside|footer|center|font|br|script|style)\b)", re.I)
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.I | re.S)
_TAGS = re.compile(r"<(/?)([a-z][a-z0-9]*)\b[^<>]*>|<[!/?][^<>]*>", re.I)
_PARTS = re.compile(r"<(/?)(main|article|nav|aside|footer|header)\b[^<>]*>", re.I)
# Characters that count as marks of their own.
_TOKENS = re.compile(r"[^\W\d_]+\d+\w*|[^\W_]+(?:['’-][^\W_]+)*|[›‹»«|·/©→▶★⤓♥#@&•*…—–:]+")
# The same for ASCII in lower case, several times as fast.
_ASCII_TOKENS = re.compile(r"[a-z]+\d+\w*|[a-z0-9]+(?:['-][a-z0-9]+)*|[|/#@&*:]+", re.A)
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_NOT_PAGES = re.compile(r"\s*(?:\[|WEBVTT|<\d|>>|\*\*|\d+:\d\d|\d+m\d\ds)")
_LABELLED = re.compile(r"\s*([^\W\d_][^.!?:\n|›(\[]{0,40}?)\s*(?:[(\[][\d:.hms]+[)\]]\s*)?(?::|\s[-–—])\s")
#: Where more of the lines than this begin with one of several labels that recur, text without markup is a conversation.
TALK = 0.5


@dataclass
class Line:
    no: int
    text: str  # what the line shows
    tags: int = 0
    links: int = 0
    main: bool | None = None  # None: the page doesn't say


def is_markup(text: str) -> bool:
    return bool(_MARKUP.match(text))


def shown(text: str, with_parts: bool = False) -> list[Line]:
    """The lines of ``text`` that show something, with what they show; lines are what stands between line feeds."""
    if not is_markup(text):
        return [Line(i, " ".join(x.split())) for i, x in enumerate(text.split("\n")) if x.strip()]
    text = _HIDDEN.sub(lambda m: "\n" * m[0].count("\n"), text)
    parts: list[tuple[int, bool]] = []
    if with_parts:
        depth, aside = 0, 0
        for m in _PARTS.finditer(text):
            step = -1 if m[1] else 1
            if m[2].lower() in ("main", "article"):
                depth = max(0, depth + step)
            else:
                aside = max(0, aside + step)
            parts.append((m.start(), depth > 0 and not aside))
    out, at, k, inside, open_tag = [], 0, 0, False, False
    for i, line in enumerate(text.split("\n")):
        end = at + len(line)
        while k < len(parts) and parts[k][0] < end:
            inside = parts[k][1]
            k += 1
        at = end + 1
        if open_tag:  # a tag that began on an earlier line
            _, sep, line = line.partition(">")
            if not sep:
                continue
            open_tag = False
        tags = _TAGS.findall(line)
        bare = _TAGS.sub(" ", line)
        if (lt := bare.rfind("<")) >= 0 and re.match(r"</?[a-z!]", bare[lt:], re.I):
            bare, open_tag = bare[:lt], True
        bare = " ".join(html.unescape(bare).split())
        if bare:
            out.append(Line(i, bare, len(tags), sum(t[1].lower() == "a" and not t[0] for t in tags), inside if parts else None))
    return out


@lru_cache(maxsize=100_000)
def _words(token: str) -> tuple[str, ...]:
    if token[0].isdigit():
        return ("0",)
    if token[-1].isdigit() and token[0].isalpha():
        return ("a0",)
    return tuple(token[i : i + 2] for i in range(0, len(token), 2)) if _CJK.search(token) else (token,)


def features(text: str) -> list[str]:
    """Words, word pairs and marks of a line; numbers and names with numbers in them are all alike, case doesn't count."""
    words = list(chain.from_iterable(map(_words, (_ASCII_TOKENS if text.isascii() else _TOKENS).findall(text.lower()))))
    end = text.rstrip("\"'”’)」 ")[-1:]
    end = "." if end in ".。" else "?" if end in "!?！？…" else "w" if end.isalnum() else "o"
    n = len(words)
    size = n if n < 4 else 4 if n < 6 else 6 if n < 9 else 9 if n < 15 else 15
    edges = ["^", *words, "$" + end]
    return [*words, *[f"{a} {b}" for a, b in zip(edges, edges[1:])], f"=e{end}", f"=n{size}", f"=n{size}{end}"]


def seed_lines() -> list[tuple[str, bool]]:
    return [(t, main) for text, main in ((SEED_BOILERPLATE, False), (SEED_MAIN, True)) for t in text.split("¦") if t]


def fit(lines: list[tuple[str, bool]]) -> dict[str, float]:
    """Weights of a logistic regression of main body (True) against boilerplate; the bias has the empty name."""
    names: dict[str, int] = {"": 0}
    index, starts, y = [], [], []
    for text, main in lines:
        starts.append(len(index))
        index.append(0)
        index += {names.setdefault(f, len(names)) for f in features(text)}
        y.append(main)
    idx, st, t = np.array(index), np.array(starts), np.array(y, float)
    size = np.diff(np.append(st, len(idx)))
    scale = 1 / np.sqrt(size)  # long lines don't outweigh short ones
    share = np.where(t > 0, 0.5 / max(1, t.sum()), 0.5 / max(1, (1 - t).sum())) * len(t)
    w, g2 = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(PASSES):
        z = np.add.reduceat(w[idx], st) * scale
        err = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - t)
        g = np.bincount(idx, np.repeat(err * scale, size), len(names)) / len(t) + DECAY * w
        g2 += g * g
        w -= STEP * g / np.sqrt(g2)
    return {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 0.01 or not f}


def line_score(line: Line, weights: dict[str, float]) -> float:
    fs = set(features(line.text))
    z = (weights[""] + sum(map(weights.get, fs, [0.0] * len(fs)))) / (1 + len(fs)) ** 0.5
    return max(-6.0, min(6.0, z)) + TAG * line.tags + LINK * line.links


def maximal_regions(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring contiguous regions [a, b) of ``scores``, in one scan.

    ``low`` has the regions that a later one can still be joined to; the score before each is greater than before
    the one under it, so each region enters and leaves it once.
    """
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    low: list[int] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        a, left, right = i, before, total
        while True:
            while low and found[low[-1]][2] >= left:
                low.pop()
            if not low or found[low[-1]][3] >= right:
                low.append(len(found))
                found.append((a, i + 1, left, right))
                break
            j = low.pop()
            a, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b) for a, b, _, _ in found]


def same_title(a: str) -> str:
    return re.sub(r"[\W_]+", " ", html.unescape(a).casefold()).strip()


def heading(lines: list[Line], own: list[float], title: str | None, titles: list[str]) -> int | None:
    """Which line is the heading: the first that has the title, else the last step of a breadcrumb, else what stands on top of the body."""
    given = {same_title(t) for t in (title, re.sub(r"\s*[\[(][^\[\]()]*[\])]\s*$", "", title or ""), *titles) if t} - {""}
    crumbs = {same_title(x.text.rpartition("›")[2]) for x in lines if "›" in x.text and "‹" not in x.text} - {""}
    for names in (given, crumbs):
        if (k := next((k for k, x in enumerate(lines) if same_title(x.text) in names), None)) is not None:
            return k
    first = next((k for k, s in enumerate(own) if s > 1.5), 0)
    return first - 1 if first and lines[first - 1].text[-1] not in ".!?…。" and len(lines[first - 1].text.split()) > 1 and not re.search(r"[|›·©#]", lines[first - 1].text) else None


def line_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(same_title(text)) - (1 << 63)


def page_lines(text: str | None, weights: dict[str, float], notices: frozenset[int] = frozenset()) -> tuple[list[Line], list[float]] | None:
    """The lines of a page and what each scores by itself, or None for what is no page. ``notices`` has hashes of lines."""
    if not text or not text.strip():
        return None
    markup = is_markup(text)
    if not markup and (_NOT_PAGES.match(text) or "\n" not in text.strip()):
        return None
    lines = shown(text)
    own = [line_score(x, weights) for x in lines]
    if not markup and sum(s < SURE for s in own) < PAGE_LINES:
        return None
    if not markup:
        labels = [m[1].casefold().strip() if (m := _LABELLED.match(x.text)) else "" for x in lines]
        often = {k for k, n in Counter(labels).items() if k and n > 1}
        if len(often) > 1 and sum(k in often for k, s in zip(labels, own) if s > 0) > TALK * sum(s > 0 for s in own):
            return None
    if notices:
        own = [min(s, NOTICE) if x.text.count(" ") + 1 >= NOTICE_WORDS and line_hash(x.text) in notices else s for x, s in zip(lines, own)]
    return lines, own


def heading_of(text: str, title: str | None, lines: list[Line], own: list[float]) -> int | None:
    return heading(lines, own, title, _TITLE.findall(text) if is_markup(text) else [])


def boilerplate(text: str | None, title: str | None, weights: dict[str, float], notices: frozenset[int] = frozenset()) -> list[int]:
    """Numbers of the boilerplate lines of a page; none for what is no page. ``notices`` has hashes of lines."""
    if (page := page_lines(text, weights, notices)) is None:
        return []
    lines, own = page
    if (k := heading_of(text, title, lines, own)) is not None:
        own[k] = 6.0
    keep = [False] * len(lines)
    for a, b in maximal_regions(own):
        keep[a:b] = [s >= AGAINST for s in own[a:b]]
    return [x.no for x, k in zip(lines, keep) if not k]


def body(text: str | None, title: str | None, weights: dict[str, float], notices: frozenset[int] = frozenset()) -> str | None:
    """The main body of a page as plain text, or ``text`` where it is no page."""
    if not text:
        return text
    drop = set(boilerplate(text, title, weights, notices))
    return "\n".join(x.text for x in shown(text) if x.no not in drop) if drop or is_markup(text) else text


def lent(text: str, markup: bool) -> str | None:
    """What a row lends to the fit, as JSON: (text, tags, links, main body or not) of its lines, or None if it doesn't say what is main body."""
    if markup:
        titles = {same_title(x) for x in _TITLE.findall(text)}
        # A heading is told by the title, so it says nothing about words.
        found = [(x.text, x.tags, x.links, 2 if x.main and same_title(x.text) in titles else int(x.main)) for x in shown(text, True) if x.main is not None]
    else:
        found = [(" ".join(html.unescape(x).split()), 0, 0, 1) for x in re.findall(r'"(?:text|content|caption|snippet|utf8)": ?"((?:[^"\\]|\\.)+)"', text) if "\\u" not in x]
    step = -(-len(found) // LENT_LINES) or 1
    return json.dumps([x for x in found[::step] if len(x[0]) <= LENT_CHARS], ensure_ascii=False) if found else None


def read_lines(videos: DataFrame, drawn: int = DRAWN_ROWS) -> DataFrame:
    """What the pages among ``videos`` have in common and lend to the fit, in one pass: (page, site, title, line, kind, lent).

    A row for each line of at least NOTICE_WORDS words, by hash, with line 0 for the page itself, and for each row drawn a row
    with what it lends and its kind, page or speech. The draw is by a limit of the hash of the text, set by the number
    of rows, so that the same texts come whatever the partitions. Nothing but hashes and the drawn lines is kept.
    """

    def fn(_: None, pages: list, sites: list, texts: list, titles: list, several: list, drawn: list) -> list:
        out: list[list] = [[] for _ in range(6)]
        for p, s, t, n, lines, draw in zip(pages, sites, texts, titles, several, drawn):
            markup = is_markup(t)
            found: dict[int, tuple[str | None, str | None]] = {}
            if lines and (markup or not _NOT_PAGES.match(t)):
                found = dict.fromkeys({line_hash(x.text) for x in shown(t) if x.text.count(" ") + 1 >= NOTICE_WORDS} | {0}, (None, None))
            if draw and (gives := lent(t, markup)):
                found[-1] = ("page" if markup else "speech", gives)
            name = line_hash(re.sub(r"\s*[\[(][^\[\]()]*[\])]\s*$", "", n or ""))
            for line, (kind, gives) in found.items():
                for col, v in zip(out, (p, s, name, line, kind, gives)):
                    col.append(v)
        return out

    n = videos.count()  # of a Parquet table its footers tell
    below = lambda most: F.col("page") < -(1 << 63) + int((1 << 64) * min(1.0, most / max(1, n))) - 1
    t = F.col("transcript")
    rows = videos.select("source_url", "transcript", "title").filter(t.isNotNull()).withColumn("page", F.xxhash64("transcript"))
    draw = (t.rlike(r"(?i)^\s*<[a-z!]") & t.rlike(r"(?i)<main\b") & below(drawn)) | (t.rlike(r"^\s*\[\s*\{") & ~t.contains('"speaker"') & below(drawn / 5))
    rows = rows.select("page", site(), "transcript", "title", t.contains("\n").alias("several"), draw.alias("drawn")).filter("several or drawn")
    return cut(map_rows(rows, "page long, site long, title long, line long, kind string, lent string", fn))


def site() -> Column:
    """The hash of the host that an address has, of the empty text if it has none."""
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce("source_url", F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]+)", 1))).alias("site")


def lent_pages(read: DataFrame, pages: int = LABELLED_PAGES, speech: int = SPEECH_ROWS) -> list[tuple[str, list]]:
    """(kind, lines) of at most so many of the drawn pages that mark their own parts and of transcripts in records; each text once, by hash."""
    given = read.filter("lent is not null").groupBy("page", "kind").agg(F.min("lent").alias("lent"))
    rows = [r for kind, most in (("page", pages), ("speech", speech)) for r in given.filter(F.col("kind") == kind).orderBy("page").limit(most).collect()]
    return [(r.kind, json.loads(r.lent)) for r in sorted(rows, key=lambda r: r.page)]


def fit_pages(given: list[tuple[str, list]], seed_below: int = SEED_BELOW) -> dict[str, float]:
    """Weights from what was lent; the seed lines are added where hardly any page marks its parts."""
    lines = sorted({(i, t, main == 1) for i, (_, page) in enumerate(given) for t, _, _, main in page if main != 2}) if given else []
    few = sum(kind == "page" for kind, _ in given) < seed_below
    return fit([(t, main) for _, t, main in lines] + (seed_lines() if few else []))


def recurring_lines(lines: DataFrame, part: float = NOTICE_PART, least: int = NOTICE_TITLES, evidence: float = NOTICE_EVIDENCE) -> DataFrame:
    """(line, n): the hashes of the notices among ``lines`` (page, site, title, line), with the number of their rows there.

    Copies of a page have one title and count once. Line 0 stands on every page; a null site is all of them.
    """
    once = lines.select("site", "title", "line").distinct()
    titles = once.unionByName(once.select(F.lit(None).cast("bigint").alias("site"), "title", "line").distinct()).withColumn("site", F.struct("site"))
    have = cut(titles.groupBy("site", "line").agg(F.count(F.lit(1)).alias("have")))
    sites = have.groupBy("site").agg(F.max(F.when(F.col("line") == 0, F.col("have"))).alias("titles"), F.count(F.lit(1)).alias("n"))
    k, due = F.col("have"), part * F.col("titles")
    sure = (k >= least) & (k > due) & (k * F.log(k / due) - k + due >= evidence)
    notices = lookup_join(have.filter((F.col("line") != 0) & (k >= least)), cut(sites), "site").filter(sure).select("line").distinct()
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).join(notices, "line", "left_semi")


@dataclass
class PageModel:
    """What pages are read by: weights of words, the pages lent to the fit, and the hashes of notices, None where they are too many to hand out."""

    weights: dict[str, float]
    given: list[tuple[str, list]]
    notices: frozenset[int] | None
    read: DataFrame | None = None  # the lines, where notices have to be joined
    recurring: DataFrame | None = None

    def task(self) -> tuple[dict[str, float], frozenset[int]]:
        return self.weights, self.notices or frozenset()


def page_model(videos: DataFrame, pages: int = LABELLED_PAGES, most: int = MOST_NOTICES) -> PageModel:
    """The model of the pages of ``videos``, from one pass over them."""
    read = read_lines(videos)
    given = lent_pages(read, pages)
    recurring = cut(recurring_lines(read.filter("kind is null").select("page", "site", "title", "line")))
    notices = [r.line for r in recurring.select("line").limit(most + 1).collect()]
    return PageModel(fit_pages(given), given, frozenset(notices) if len(notices) <= most else None, read, recurring)


def noticed(videos: DataFrame, model: PageModel) -> DataFrame:
    """``videos`` with ``notices``: null where the model has them all, else the hashes of the notices of each page.

    Then what recurs is joined back by the hash of the line and of the page; rows without a line feed aren't shuffled.
    """
    if model.notices is not None:
        return videos.withColumn("notices", F.lit(None).cast("array<bigint>"))
    several = F.coalesce(F.col("transcript").contains("\n"), F.lit(False))
    hits = lookup_join(model.read.filter("kind is null").select("page", "line"), model.recurring.withColumn("is", F.lit(True)), "line")
    hits = hits.groupBy("page", "line").agg(F.count(F.lit(1)).alias("n")).groupBy("page").agg(F.collect_set("line").alias("notices"), F.max("n").alias("n"))
    found = lookup_join(videos.filter(several).withColumn("page", F.xxhash64("transcript")), cut(hits), "page", "left").drop("page")
    return found.unionByName(videos.filter(~several).withColumn("notices", F.lit(None).cast("array<bigint>")))


def boilerplate_lines(videos: DataFrame, model: PageModel) -> DataFrame:
    """(row_id, line_no) of every boilerplate line of every page; one pass, without a shuffle unless there are more than MOST_NOTICES notices.

    Null, blank and empty transcripts and those that are no pages have none; copies of a page have theirs each. The
    model has a weight for each word of at most LABELLED_PAGES pages, so its size doesn't grow with the data.
    """
    shared = videos.sparkSession.sparkContext.broadcast(model.task())

    def fn(state: tuple, ids: list, texts: list, titles: list, notices: list) -> list:
        out: list[list] = [[], []]
        for i, t, title, own in zip(ids, texts, titles, notices):
            for no in boilerplate(t, title, state[0], frozenset(own) if own else state[1]):
                out[0].append(i)
                out[1].append(no)
        return out

    # What has no line feed shows one line at most, its body.
    rows = videos.select("row_id", "transcript", "title").filter(F.col("transcript").contains("\n") | F.col("transcript").contains("<"))
    return map_rows(noticed(rows, model), "row_id long, line_no int", fn, lambda: shared.value)


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "videos").select("row_id", "source_url", "transcript", "title"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = page_table(spark, sf_dir)
    return boilerplate_lines(videos, page_model(videos))


def p3_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, body): the transcripts with only the main body of those that are pages."""
    videos = page_table(spark, sf_dir)
    model = page_model(videos)
    shared = spark.sparkContext.broadcast(model.task())

    def fn(state: tuple, ids: list, texts: list, titles: list, notices: list) -> list:
        return [ids, [body(t, n, state[0], frozenset(own) if own else state[1]) for t, n, own in zip(texts, titles, notices)]]

    return map_rows(noticed(videos.select("row_id", "transcript", "title"), model), "row_id long, body string", fn, lambda: shared.value)
