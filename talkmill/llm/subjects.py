"""The subject areas of a spoken segment by subject-specific interpolated n-gram language models.

Each subject of the codebook, and small talk, has a bigram model interpolated with its unigram model and the
background; what a subject says about a token is its log probability over that of the background model. A path over the tokens
that changes subject seldom, and most easily where a sentence ends, gives each token a subject. The models start from
the labels known so far, which are one a segment and partly wrong, and are fitted again to the tokens they claim.
A segment has every subject whose share of its talk passes a threshold, which is calibrated on labelled segments that the
models scoring them weren't fitted on.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkmill.functions.arrow import map_rows
from talkmill.llm.sample import sampled
from talkmill.session import spread, table

#: Labelled segments that the models are fitted on, by hash; the bound keeps the driver's work constant.
LABELLED_ROWS = 20_000
#: Labelled segments longer than this aren't among them, so what the driver gets is bounded in bytes too. All segments are scored, whatever their length.
LABELLED_CHARS = 10_000
#: Rounds of fitting the models to what they claim.
ROUNDS = 5
#: Weight of the bigram model, and pseudo-counts that tie a subject's words to the background.
BIGRAM, TIE = 0.6, 20.0
#: What a change of subject costs at the end of a sentence and inside of one.
COST_END, COST_INSIDE = 1.5, 4.0
#: Words and pairs of which no subject has more than the first part, were all subjects alike in size, say nothing; from the second part on they say all they can.
MUTE, FULL = 0.3, 0.55
#: Segments that are decoded together, and tokens of theirs counted as if all were as long as the longest.
TOGETHER, TOGETHER_TOKENS = 256, 60_000
#: What small talk has ahead on every token, so that words that say nothing are small talk.
NOTHING = 1e-4
#: A segment has a subject at all if its largest has this share of all words; else it is small talk.
LEAST = 0.25
#: A further subject counts if it has this part of what it and the largest have together: what calibration starts from, and as many labelled segments as that start weighs.
RATIO, PRIOR = 0.29, 50
#: What the labels may make of it: a part under the first is in passing, two subjects from the second on share a segment.
BOUNDS = (0.2, 0.4)
#: Labels of a codebook that the models are made for; more are an error.
MOST_LABELS = 1000

_TOKEN = re.compile(r"[.!?。！？]|[぀-ヿ㐀-鿿]{1,2}|\d+(?:[.,:]\d+)*|[^\W\d_぀-ヿ㐀-鿿]+(?:['’-][^\W\d_]+)*")
# Fillers, which no subject has.
_FILLERS = frozenset("um uh uhm erm er hmm hm mm-hmm mhm uh-huh like".split())
_ENDS = frozenset(".!?。！？")


def tokens(text: str) -> tuple[list[str], list[bool]]:
    """Words in lower case without fillers, numbers as #, and whether a sentence ended before each."""
    words, ends, end = [], [], True
    for t in _TOKEN.findall(text.lower()):
        if t in _ENDS:
            end = True
        elif t not in _FILLERS:
            words.append("#" if t[0].isdigit() else t)
            ends.append(end)
            end = False
    return words, ends


def label_keys(labels: list[str]) -> dict[str, int]:
    return {_plain(x): i for i, x in enumerate(labels)}


def _plain(label: str) -> str:
    return " ".join(re.sub(r"[^\w ]+", " ", label.casefold()).split())


def known_labels(raw: str | None, keys: dict[str, int], other: int) -> list[int]:
    """The codebook entries that a stored label means: case, padding, cut-off ends and two joined by a slash are repaired. Fallbacks and nulls mean none."""
    if raw is None or _plain(raw) in ("", "none", "n a", "other", "unknown", "unlabeled", "unlabelled"):
        return []
    if (k := keys.get(_plain(raw))) is not None:
        return [k]
    out = []
    for part in re.split(r"[/;,|]", raw):
        p = _plain(part)
        hits = [k] if (k := keys.get(p)) is not None else [i for name, i in keys.items() if len(p) >= 3 and name.startswith(p)]
        if len(hits) == 1 and hits[0] not in out:
            out.append(hits[0])
    if not out:
        p = _plain(raw)
        hits = [i for name, i in keys.items() if len(p) >= 3 and name.startswith(p)]
        out = hits if len(hits) == 1 else []
    return out


@dataclass
class SubjectModels:
    labels: list[str]
    other: int
    words: dict[str, int]  # row of each word
    pairs: dict[tuple[int, int], int]  # row of each word pair
    word_llr: np.ndarray  # words + 1 x subjects, the last row of unknown words
    pair_llr: np.ndarray

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        get, pair = self.words.get, self.pairs.get
        w = [get(t, -1) for t in words]
        return np.array(w), np.array([-1, *[pair(p, -1) for p in zip(w, w[1:])]])[: len(w)]

    def scores(self, words: list[str]) -> np.ndarray:
        """Tokens x subjects: log probability of each token under each subject's model over the background's."""
        w, p = self.rows(words)
        return np.where(p[:, None] >= 0, self.pair_llr[p], self.word_llr[w])


def paths(scores: list[np.ndarray], ends: list[list[bool]]) -> list[np.ndarray]:
    """The best subject of each token of each segment; segments are decoded together, longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list[np.ndarray] = [np.zeros(0, int)] * len(scores)
    at = 0
    while at < len(order) and len(scores[order[at]]):
        size = max(1, min(TOGETHER, TOGETHER_TOKENS // len(scores[order[at]])))
        group = [i for i in order[at : at + size] if len(scores[i])]
        at += size
        n, long, k = len(group), len(scores[group[0]]), scores[group[0]].shape[1]
        s, cost = np.zeros((long, n, k), np.float32), np.full((long, n), COST_INSIDE, np.float32)
        for j, i in enumerate(group):
            s[: len(scores[i]), j] = scores[i]
            cost[: len(ends[i]), j] = np.where(ends[i], COST_END, COST_INSIDE)
        best, jump, top = s[0], np.zeros((long, n, k), bool), np.zeros((long, n), np.int16)
        for t in range(1, long):
            top[t] = best.argmax(1)
            other = np.take_along_axis(best, top[t][:, None].astype(int), 1) - cost[t][:, None]
            jump[t] = other > best
            best = np.maximum(best, other) + s[t]
        # Past its end a segment scores 0 everywhere, so its path stays where it was best.
        state = best.argmax(1)
        states = np.zeros((long, n), np.int16)
        cols = np.arange(n)
        for t in range(long - 1, -1, -1):
            states[t] = state
            state = np.where(jump[t, cols, state], top[t], state)
        for j, i in enumerate(group):
            out[i] = states[: len(scores[i]), j].astype(int)
    return out


def _models(labels: list[str], other: int, docs: list[np.ndarray], claims: list[np.ndarray], words: dict[str, int], pairs: dict[tuple[int, int], int], pair_rows: list[np.ndarray]) -> SubjectModels:
    """Models from tokens and who claims them: for each token a subject, or for each segment the weights of all subjects."""
    k, nw, npair = len(labels), len(words), len(pairs)
    w, p = np.concatenate(docs), np.concatenate(pair_rows)
    p = np.where(p < 0, npair, p)
    uni, bi = np.zeros((nw + 1, k)), np.zeros((npair + 1, k))
    if claims[0].dtype.kind == "i":
        c = np.concatenate(claims)
        uni += np.bincount(w * k + c, minlength=(nw + 1) * k).reshape(nw + 1, k)
        bi += np.bincount(p * k + c, minlength=(npair + 1) * k).reshape(npair + 1, k)
    else:
        size = [len(d) for d in docs]
        for s in range(k):
            c = np.repeat([x[s] for x in claims], size)
            uni[:, s] = np.bincount(w, c, nw + 1)
            bi[:, s] = np.bincount(p, c, npair + 1)
    uni[-1] = 0
    all_uni = uni.sum(1)
    bg = (all_uni + 0.5) / (all_uni.sum() + 0.5 * (nw + 1))
    p_uni = (uni + TIE * bg[:, None]) / (uni.sum(0) + TIE)
    first = np.array([a for a, _ in pairs], int) if pairs else np.zeros(0, int)
    second = np.array([b for _, b in pairs], int) if pairs else np.zeros(0, int)
    after = uni + 1e-9
    bi, all_bi = bi[:-1], bi[:-1].sum(1)
    # The fewer tokens of the first word a subject has, the less its bigram counts for.
    trust = BIGRAM * after[first] / (after[first] + 3.0)
    p_bi = trust * bi / after[first] + (1 - trust) * p_uni[second]
    trust_bg = BIGRAM * all_uni[first] / (all_uni[first] + 3.0)
    bg_bi = trust_bg * all_bi / np.maximum(all_uni[first], 1e-9) + (1 - trust_bg) * bg[second]
    word_llr = (np.log(p_uni / bg[:, None]) * _telling(p_uni, other)).astype(np.float32)
    word_llr[-1] = 0
    word_llr[:, other] += NOTHING
    pair_llr = (np.log(p_bi / bg_bi[:, None]) * _telling(p_bi, other)).astype(np.float32)
    pair_llr[:, other] += NOTHING
    return SubjectModels(labels, other, words, pairs, word_llr, pair_llr if len(pair_llr) else np.zeros((1, k), np.float32))


def _telling(p: np.ndarray, other: int) -> np.ndarray:
    """How far a word is taken from the background model to the subjects' models: words that are in all subjects alike stay with the background. Small talk keeps what it says."""
    own = p.copy()
    own[:, other] = 0
    out = np.repeat(np.clip((own.max(1) / np.maximum(own.sum(1), 1e-12) - MUTE) / (FULL - MUTE), 0, 1)[:, None], p.shape[1], 1)
    out[:, other] = 1
    return out


def fit(labels: list[str], rows: list[tuple[str, str | None]], rounds: int = ROUNDS) -> SubjectModels:
    """Models of all ``labels`` from (text, stored label) rows; labels without rows keep the background's probabilities."""
    other = next((i for i, x in enumerate(labels) if x.casefold().startswith("other")), len(labels) - 1)
    keys = label_keys(labels)
    texts = [(tokens(t), known_labels(lab, keys, other)) for t, lab in rows if t and t.strip()]
    texts = [(w, e, lab) for (w, e), lab in texts if w]
    count = Counter(t for w, _, _ in texts for t in w)
    words = {w: i for i, w in enumerate(sorted(w for w, n in count.items() if n >= 2))}
    docs = [np.array([words.get(t, len(words)) for t in w]) for w, _, _ in texts]
    both = Counter(p for d in docs for p in zip(d[:-1].tolist(), d[1:].tolist()) if len(words) not in p)
    pairs = {p: i for i, p in enumerate(sorted(p for p, n in both.items() if n >= 3))}
    pair_rows = [np.array([-1, *[pairs.get(p, -1) for p in zip(d[:-1].tolist(), d[1:].tolist())]]) for d in docs]
    k = len(labels)
    # To begin with every token of a segment is claimed by its labels alike, and by small talk a little.
    claims = []
    for _, _, lab in texts:
        c = np.zeros(k) if lab else np.full(k, 0.15 / k)
        c[lab] = 1 / max(1, len(lab))
        c[other] += 0.15 if lab and lab != [other] else 0.0
        claims.append(c)
    if not docs:
        return SubjectModels(labels, other, {}, {}, NOTHING * np.eye(k, dtype=np.float32)[[other]], np.zeros((1, k), np.float32))
    models = _models(labels, other, docs, claims, words, pairs, pair_rows)
    ends = [e for _, e, _ in texts]
    for _ in range(rounds):
        claims = []
        for at in range(0, len(docs), 1024):
            some = zip(docs[at : at + 1024], pair_rows[at : at + 1024])
            claims += paths([np.where(p[:, None] >= 0, models.pair_llr[p], models.word_llr[w]) for w, p in some], ends[at : at + 1024])
        models = _models(labels, other, docs, claims, words, pairs, pair_rows)
    return models


def shares(models: SubjectModels, texts: list[str]) -> list[np.ndarray]:
    """For each text the share of its words that each subject has."""
    toks = [tokens(t) for t in texts]
    found = paths([models.scores(w) if w else np.zeros((0, len(models.labels))) for w, _ in toks], [e for _, e in toks])
    return [np.bincount(p, minlength=len(models.labels)) / max(1, len(p)) for p in found]


def ratios(share: np.ndarray, other: int) -> np.ndarray:
    """What each subject has of what it and the largest one have together; small talk none."""
    own = share.copy()
    own[..., other] = 0
    top = own.max(-1, keepdims=True)
    return np.where(own > 0, own / np.maximum(own + top, 1e-9), 0)


def chosen(share: np.ndarray, other: int, ratio: float = RATIO) -> list[int]:
    """The subjects of a segment, or small talk alone if none is large enough."""
    own = share.copy()
    own[other] = 0
    if own.max() < LEAST:
        return [other]
    return [int(i) for i in np.flatnonzero(ratios(share, other) >= ratio)]


def held_out(labels: list[str], rows: list[tuple[str, str | None]]) -> list[np.ndarray]:
    """For each row the shares that models fitted on the other half of the rows give it; a text is in one half only, however spaced."""
    half = [zlib.crc32(" ".join(t.split()).encode()) & 1 for t, _ in rows]
    out: list[np.ndarray] = [np.zeros(0)] * len(rows)
    for h in (0, 1):
        models = fit(labels, [r for r, x in zip(rows, half) if x != h])
        own = [i for i, x in enumerate(half) if x == h]
        for at in range(0, len(own), 1024):
            some = own[at : at + 1024]
            for i, s in zip(some, shares(models, [rows[i][0] for i in some])):
                out[i] = s
    return out


def calibrated(found: list[np.ndarray], known: list[list[int]], other: int) -> float:
    """The ratio from which on a second subject shares its segment more often than not, by what the labels say.

    A label names one of the subjects that share a segment, and one in passing by mistake only. So of the segments with
    a ratio the part that shares is the part whose label names the second subject, over that part where both are clearly
    large. The ratio is the one beyond which the labels outweigh half of it by most, drawn to ``RATIO`` as by
    ``PRIOR`` segments: the same rule at every size, in which the labels count by their number.
    """
    one = [i for i, k in enumerate(known) if len(k) == 1 and k[0] != other]
    if not one:
        return RATIO
    share, label = np.array([found[i] for i in one]), np.array([known[i][0] for i in one])
    second = np.argsort(-ratios(share, other), axis=1, kind="stable")[:, 1]
    ratio, named = ratios(share, other)[np.arange(len(one)), second], label == second
    share[:, other] = 0
    some = (share.max(1) >= LEAST) & (ratio >= BOUNDS[0])
    ratio, named = ratio[some], named[some]
    large = named[ratio >= BOUNDS[1]]
    even = (large.sum() + PRIOR / 2) / (len(large) + PRIOR)
    # PRIOR segments evenly between the bounds, named more often the larger their ratio, half of ``even`` at RATIO.
    drawn = PRIOR * even / 2 / (BOUNDS[1] - BOUNDS[0]) ** 2
    steps = [t for k in range(-100, 100) if BOUNDS[0] <= (t := round(RATIO + k / 200, 3)) <= BOUNDS[1]]
    gain = [float((named[ratio >= t] - even / 2).sum()) - drawn * (t - RATIO) ** 2 for t in steps]
    return steps[int(np.argmax(gain))]


def train(labeled: DataFrame, codebook: DataFrame, rows: int = LABELLED_ROWS) -> tuple[SubjectModels, float]:
    """The models and the calibrated ratio, from about ``rows`` labelled segments, chosen by hash; repeated texts with one label count once."""
    labels = [r.label for r in codebook.select("label").filter("label is not null").dropDuplicates(["label"]).orderBy("label").limit(MOST_LABELS + 1).collect()]
    if len(labels) > MOST_LABELS:
        raise ValueError(f"the codebook has more than {MOST_LABELS} labels")
    if not labels:
        raise ValueError("the codebook is empty")
    texts = labeled.filter(F.col("segment_transcript").rlike(r"(?U)\S") & (F.length("segment_transcript") <= LABELLED_CHARS)).select("segment_transcript", F.coalesce("codebook_label", F.lit("")).alias("label"))
    pairs = sorted((r[0], r[1]) for r in sampled(texts, rows, "segment_transcript", "label").collect())
    models, keys = fit(labels, pairs), label_keys(labels)
    return models, calibrated(held_out(labels, pairs), [known_labels(x, keys, models.other) for _, x in pairs], models.other)


def subject_areas(segments: DataFrame, models: SubjectModels, ratio: float = RATIO) -> DataFrame:
    """(video_url, segment_id, codebook_label, share): a row for each subject of each segment with text.

    Segments delivered twice come out once; null and blank texts not at all; null keys are kept as keys. Texts are read
    whole and scored where they are; what shuffles is the keys and labels. The models are of the codebook's size
    times the vocabulary of at most LABELLED_ROWS segments.
    """
    shared = segments.sparkSession.sparkContext.broadcast((models, ratio))

    def fn(state: tuple, urls: list, ids: list, texts: list) -> list:
        m, r = state
        out: list[list] = [[], [], [], []]
        for u, i, s in zip(urls, ids, shares(m, texts)):
            for k in chosen(s, m.other, r):
                for col, v in zip(out, (u, i, m.labels[k], float(s[k]))):
                    col.append(v)
        return out

    rows = segments.select("video_url", "segment_id", "segment_transcript").filter(F.col("segment_transcript").rlike(r"(?U)\S"))
    found = map_rows(rows, "video_url string, segment_id int, codebook_label string, share double", fn, lambda: shared.value)
    return found.groupBy("video_url", "segment_id", "codebook_label").agg(F.max("share").alias("share"))


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = spread(table(spark, sf_dir, "segments_review").select("video_url", "segment_id", "segment_transcript"))
    return subject_areas(segments, *train(table(spark, sf_dir, "labeled_segments"), table(spark, sf_dir, "codebook")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _areas(spark, sf_dir).select("video_url", "segment_id", "codebook_label")


def p1_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(codebook_label, n_segments, part): how many segments treat each subject, and what part of all subject mentions that is."""
    n = _areas(spark, sf_dir).groupBy("codebook_label").agg(F.count(F.lit(1)).alias("n_segments"))
    return n.withColumn("part", F.col("n_segments") / F.sum("n_segments").over(Window.partitionBy(F.lit(0))))
