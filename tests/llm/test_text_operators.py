"""Operators on single texts against brute force, round trips and held-out cases."""

import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talkmill.llm import pages, repetition, residue, split, subjects, tokenize, turns
from talkmill.llm.crf import ChainCRF

# ---- tokenizer


@pytest.fixture(scope="module")
def bpe():
    return tokenize.encoder()


def naive(enc, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        ranked = [(enc.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(ranked)
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [enc.ranks[p] for p in parts]


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_round_trip_and_merges(bpe, text):
    ids = bpe.encode(text)
    assert bpe.decode(ids) == text
    assert ids == [i for p in bpe.pieces(text) for i in naive(bpe, p.encode())]


def test_against_the_library(bpe):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokenize.VOCAB_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["", " ", "a  b\n\n c", "It's ours, we'll go; they'RE 12345678901", "<|endoftext|> twice <|endoftext|>", "日本語のテキスト", "é́ \U0001f469‍\U0001f467 \x00\x1f", "x" * 3000, "ab" * 2000 + " " * 500]
    assert [bpe.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert bpe.encode(None) == []


def test_memo_never_changes_ids(bpe, monkeypatch):
    monkeypatch.setattr(tokenize, "MEMO_PIECES", 2)
    a = " ".join(f"word{i} thing" for i in range(50))
    assert bpe.encode(a) == bpe.encode(a)


# ---- splitting


def check_pieces(text, limit, overlap):
    got = split.cuts(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b, _ in got)
    assert all(q[0] == p[1] - overlap and q[1] > p[1] for p, q in zip(got, got[1:]))
    return got


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet="ab .!\n。é", max_size=400), limit=st.integers(5, 60), part=st.floats(0, 0.8))
def test_pieces(text, limit, part):
    overlap = min(limit - 1, int(limit * part))
    got = check_pieces(text, limit, overlap)
    for a, b, natural in got[:-1]:
        if natural:
            assert text[b - 1] in " .!\n。" or text[b : b + 1] in " \n"
    # The pieces tell whether the text has an overlong stretch.
    assert any(split.in_stretch(text, b, limit) for _, b, _ in got) == bool(re.search(r"[^\s.!?。！？]{%d}" % (limit + 1), text))


@pytest.mark.parametrize(("text", "forced"), [("word " * 30 + "x" * 25 + " end" * 9, False), ("word " * 30 + "x" * 26 + " end" * 9, True), ("<p>ab</p>" * 30, True), ("<p>ab</p> " * 30, False), ("。" * 60, False), ("x" * 26, True), ("\u2003".join(["x" * 24] * 9), False), ("word " * 30 + "x" * 22 + ". end" * 9, False)])
def test_how_texts_are_cut(text, forced):
    # A stretch within the limit but longer than what the overlap leaves of a piece is cut inside, and natural all the same.
    pieces = check_pieces(text, 25, 6)
    assert any(split.in_stretch(text, b, 25) for _, b, _ in pieces) == forced
    assert not any(split.in_stretch(text, b, 25) for b in (0, len(text)))


def test_cut_at_the_change_of_topic():
    rng = random.Random(1)
    a, b = "apple pear plum fig grape".split(), "steel iron zinc copper lead".split()
    say = lambda words: " ".join(rng.choice(words) for _ in range(9)) + ". "
    text = "".join(say(a) for _ in range(14)) + "".join(say(b) for _ in range(14))
    change = text.index(next(w for w in text.split() if w.strip(".") in b))
    first = check_pieces(text, 1000, 50)[0]
    assert abs(first[1] - change) < 120


def test_short_texts_and_bad_settings():
    assert split.cuts("", 10, 2) == [(0, 0, True)] and split.cuts("abc", 3, 1) == [(0, 3, True)]
    with pytest.raises(ValueError):
        split.cuts("abc", 3, 3)


# ---- pages


def test_maximal_regions():
    # The example of the published algorithm.
    assert pages.maximal_regions([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1), (2, 3), (4, 11)]
    assert pages.maximal_regions([]) == [] and pages.maximal_regions([-1, 0]) == []


@settings(max_examples=100, deadline=None)
@given(scores=st.lists(st.integers(-5, 5), max_size=14))
def test_best_region_by_brute_force(scores):
    got = pages.maximal_regions(scores)
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
    assert max((sum(scores[a:b]) for a, b in got), default=0) == max(0, best)
    assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))


MAIN = ["The judges read the letter and nobody said a word.", "In the end she was right about the river.", "We talked about it for hours, and it was still dark.", "They read the terms of use aloud for 9 minutes, as a joke."]
REST = ["Home", "Log in", "Newsletter", "© 2021 Othercast3. All rights reserved.", "Back to top", "Episode 12: rivers (30 min)", "Accept | Reject | More options"]


def labelled(n=200, seed=2):
    rng = random.Random(seed)
    return [(rng.choice(MAIN), True) if rng.random() < 0.5 else (rng.choice(REST), False) for _ in range(n)]


def test_pages():
    w = pages.fit(labelled())
    html = "<html>\n<head><title>A title</title>\n<style>x</style></head>\n<body>\n<div>Home</div>\n<div>A title</div>\n<p>" + MAIN[0] + "</p>\n<p>" + MAIN[3] + "</p>\n<div>Log in</div>\n<p>" + MAIN[1] + "</p>\n<!-- a\nb -->\n<div>Back to top</div>\n</body></html>"
    assert pages.boilerplate(html, None, w) == [4, 8, 12]
    assert pages.body(html, None, w) == "\n".join(["A title", MAIN[0], MAIN[3], MAIN[1]])
    dump = "\n".join(["Home", "", "Newsletter", "A title", *MAIN, "Back to top"])
    assert pages.boilerplate(dump, "a TITLE", w) == [0, 2, 8]
    for no_page in (None, "", " \n ", "\n".join(MAIN), MAIN[0], '[{"text": "Home"}]', "A: yes.\nB: no.\nA: Home.\nB: Log in.\nA: Search."):
        assert pages.boilerplate(no_page, None, w) == []


def test_lines_are_counted_by_line_feeds():
    t = "<div>\r\n<script>\nx\n</script>a\n\n<p\nclass='x'>b</p>\n<!-- c -->"
    assert [(x.no, x.text) for x in pages.shown(t)] == [(3, "a"), (6, "b")]
    parts = pages.shown("<nav>\na\n</nav>\n<main>\nb\n<aside>\nc\n</aside></main>", True)
    assert [(x.text, x.main) for x in parts] == [("a", False), ("b", True), ("c", False)]


def test_held_out_lines():
    w = pages.fit(labelled(300))
    new = [("The crowd said nothing until the rain was over.", True), ("She was sure that we had read it.", True), ("Archive", False), ("© 1999 Mycast7. All rights reserved.", False), ("Sign up", False)]
    assert [pages.line_score(pages.Line(0, t), w) > 0 for t, _ in new] == [m for _, m in new]


def test_lent_lines():
    page = "<html>\n<head><title>T</title></head><body>\n<nav>\n<a href='x'>Home</a>\n</nav>\n<main>\n<h1>T</h1>\n<p>" + "\n<p>".join(MAIN * 100) + "\n<p>" + "long " * 900 + "\n</main></body></html>"
    got = json.loads(pages.lent(page, True))
    assert [m for *_, m in got[:2]] == [0, 1] or [m for *_, m in got[:2]] == [0, 2]
    assert len(got) <= pages.LENT_LINES and all(len(t) <= pages.LENT_CHARS for t, *_ in got)
    assert pages.lent("<html><body>Home</body></html>", True) is None
    assert json.loads(pages.lent('[{"start": 1, "text": "One &amp; two."}]', False)) == [["One & two.", 0, 0, 1]]


def test_seeds_only_without_labelled_pages():
    rng = random.Random(11)
    few, many = [made_page(rng) for _ in range(pages.SEED_BELOW - 1)], [made_page(rng) for _ in range(pages.SEED_BELOW)]
    assert "warenkorb" in pages.fit_pages(few) and "warenkorb" not in pages.fit_pages(many)
    assert ("Terms of use | Privacy | Imprint", False) in pages.seed_lines() and ("Accept | Reject | More options", False) in pages.seed_lines()


# ---- repetition


def brute_cover(words, n):
    out = [False] * len(words)
    for i in range(len(words) - n + 1):
        if any(words[j : j + n] == words[i : i + n] for j in range(i)):
            out[i : i + n] = [True] * n
    return out


@settings(max_examples=80, deadline=None)
@given(words=st.lists(st.sampled_from("abc"), max_size=40), n=st.integers(1, 6))
def test_cover(words, n):
    codes = np.array([ord(c) for c in words], np.uint64)
    assert repetition._seen_before(codes, n).tolist() == brute_cover(words, n)


def made_page(rng, n_main=6):
    """Lines as a page lends them: boilerplate before and after the heading and the main body."""
    rest = lambda k: [(rng.choice(REST), 1, 0, 0) for _ in range(k)]
    return "page", rest(rng.randint(1, 4)) + [("A title", 1, 0, 2)] + [(rng.choice(MAIN), 1, 0, 1) for _ in range(n_main)] + rest(rng.randint(1, 4))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(9)
    given = [made_page(rng) for _ in range(60)]
    return pages.PageModel(pages.fit_pages(given), given, frozenset())


@pytest.fixture(scope="module")
def field(model):
    return repetition.fit_field(model)


def test_lines_of_held_out_pages(model, field):
    rng = random.Random(10)
    right = n = 0
    for _ in range(60):
        _, page = made_page(rng, rng.randint(1, 12))
        dump = "\n".join(t for t, *_ in page)
        kept = repetition.content(dump, "A title", model.weights, field).split("\n")
        want = [t for t, _, _, main in page if main]
        right += sum((Counter(kept) & Counter(want)).values())
        n += max(len(kept), len(want))
    assert right > 0.98 * n


def test_a_field_without_labelled_pages():
    m = pages.PageModel(pages.fit_pages([]), [], frozenset())
    f = repetition.fit_field(m)
    dump = "\n".join(["Home", "Newsletter", "Log in", "A title", *MAIN, "© 2020 Example1. All rights reserved.", "Back to top"])
    assert repetition.content(dump, "A title", m.weights, f).split("\n") == ["A title", *MAIN]
    talk = "\n".join(MAIN)
    assert repetition.content(talk, None, m.weights, f) == talk


def test_boilerplate_is_not_spoken(model, field):
    """Menus that recur on a page don't make its text repetitive; without the field they would."""
    menu = ["Home", "Log in", "Newsletter", "Back to top", "© 2021 Othercast3. All rights reserved."]
    dump = "\n".join(["A title", *MAIN, *menu * 12])
    assert repetition.share(dump, "A title", model.weights, field)[1] == 0
    n, again = repetition.share(dump, "A title", model.weights)
    assert again / n > 0.3


def test_time_tags_anywhere_in_a_transcript(model):
    late = "One two three. " * 300 + "<00:00:01.000>four <00:00:02.000>five."
    assert repetition.spoken(late, None, model.weights).split()[-2:] == ["four", "five."]


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="abZ09 '-_.#:|/@&*[]x", max_size=60))
def test_ascii_is_read_like_other_text(text):
    assert pages._ASCII_TOKENS.findall(text.lower()) == pages._TOKENS.findall(text.lower())
    assert repetition._ASCII_WORD.findall(text.lower()) == repetition._WORD.findall(text.lower())
    assert repetition.units(text) == [u for u in repetition.units(text + ". é") if u != ["é"]]


def test_shares(field, model):
    crf, w = field, model.weights
    rng = random.Random(4)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)) + "."
    once, said = " ".join(fresh(12) for _ in range(10)), fresh(20)
    share = lambda t: (lambda a, b: b / max(1, a))(*repetition.share(t, None, w, crf))
    assert share(once) == 0 and share(None) == 0 and share(" ") == 0
    assert abs(share(once + " " + " ".join([said] * 6)) - 100 / 240) < 0.02
    shouted = said.upper().replace(" ", ", ", 3)
    assert abs(share(said + " " + shouted) - 0.5) < 0.01
    records = json.dumps([{"start": i, "text": said} for i in range(4)])
    assert abs(share(records) - 0.75) < 0.01
    assert share("thank you " * 50) > 0.9


def test_phrases_that_fill_less_than_half_of_their_sentences_count(field, model):
    crf, w = field, model.weights
    rng = random.Random(6)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    phrase, n = fresh(12), 40
    spoken, repeated = repetition.share(" ".join(f"{fresh(14)} {phrase}." for _ in range(n)), None, w, crf)
    assert (spoken, repeated) == (26 * n, 12 * (n - 1)) and repeated / spoken > 0.3


def test_spoken():
    w = pages.fit(labelled())
    say = lambda t: repetition.spoken(t, None, w).split()
    assert say("<00:00:01.000><c>One</c> <00:00:02.000><c>two.</c>") == ["One", "two."]
    assert say("[0:01] ANN: One [applause] two.\n[0:05] BOB: Three.") == ["One", "two.", "Three."]
    assert say("**Ann** [0m01s]\nOne two.\n**Bob** [0m09s]\nThree.") == ["One", "two.", "Three."]


def test_random_field_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(5)
    crf = ChainCRF(rng.normal(size=(2, 3)), rng.normal(size=(2, 2)))
    for n in range(1, 7):
        x = rng.normal(size=(n, 3))
        s = x @ crf.emit.T
        value = lambda y: sum(s[i, a] for i, a in enumerate(y)) + sum(crf.move[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert crf.decode(x) == list(max(product(range(2), repeat=n), key=value))
    assert crf.decode(np.zeros((0, 3))) == []
    xs = [rng.normal(size=(20, 3)) for _ in range(30)]
    ys = [(x[:, 0] > 0).astype(int) for x in xs]
    fitted = ChainCRF.fit(xs[:20], ys[:20])
    right = np.mean([np.mean(np.array(fitted.decode(x)) == y) for x, y in zip(xs[20:], ys[20:])])
    assert right > 0.95


# ---- turns

PEOPLE = [(1, "Ann Lee-Ray", "Host"), (2, "Bob Stone", "Guest"), (3, "Cy Lark", "Co-host")]


@pytest.fixture(scope="module")
def names():
    return turns.aliases(PEOPLE)


def test_aliases(names):
    assert [names.get(turns._plain(x)) for x in ("ANN", "Ann L.", "A. Lee-Ray", "AL", "host", "Bob Stone", "BS", "co-host", "cohost", "C. Lark", "Note")] == [1, 1, 1, 1, 1, 2, 2, 3, 3, 3, None]
    twins = turns.aliases([(1, "Ann Lee", "Host"), (2, "Ann Low", "Guest")])
    assert twins.get("ann") is None and twins["ann lee"] == 1 and twins["guest"] == 2
    assert turns.aliases([(1, None, None), (2, "", "")]) == {}


@pytest.mark.parametrize(
    "text",
    [
        "[0:01] ANN: One.\n[0:09] Bob: Two.\n[0:12] BS: Three. \n[0:15] Note: this.\n[0:20] ann lee-ray: [applause]\n[0:22] Guest: [inaudible 3:09] \n[0:25] Host: Four.",
        "**Ann** [0m01s]\nOne.\n**bob stone** [0m09s]\nTwo.\n\nThree.\nNote: this.\n**Host** [0m20s]\n(laughter)\nFour.",
        ">> ANN: One.\n>> BOB: Two.\nThree.\nNote: this.\n>> HOST: Four.",
        "0:01\nAnn – One.\n0:09\nBob - Two.\nThree. Note: this.\n0:20\nHost: Four.",
        "00:00:01.000 --> 00:00:02.000 | Ann: One.\n00:00:05.000 --> 00:00:06.000 | Bob: Two. Three. Note: this.\n00:00:20.000 --> 00:00:21.000 | Ann: Four.",
        "Ann: One. Bob: Two. Three. Note: this. Host: Four.",
        json.dumps([{"start_ms": 1, "speaker": "ANN", "text": "One."}, {"start_ms": 9000, "speaker": "Host", "text": "Four."}, {"start_ms": 5, "speaker": "Guest", "text": "um, Two."}, {"start_ms": 6, "text": "Three. Note: this."}]),
    ],
)
def test_turns(names, text):
    assert turns.turns(text, names) == [(1, "One."), (2, "Two. Three. Note: this."), (1, "Four.")]


def test_times(names):
    assert [w for w, _ in turns.turns("Ann (0:10): One.\nBob (0:05): Two.\nAnn (0:12): Three.", names)] == [2, 1]
    reset = "Ann (10:00): One.\nBob (10:30): Two.\nAnn (0:02): Three.\nBob (0:09): Four."
    assert [w for w, _ in turns.turns(reset, names)] == [1, 2, 1, 2]
    wrong = "Ann (0:01): One.\nBob (59:09): Two.\nAnn (0:12): Three.\nBob (0:19): Four.\nAnn (0:25): Five."
    assert [w for w, _ in turns.turns(wrong, names)] == [1, 2, 1, 2, 1]
    assert [turns.clock_ms(x) for x in ("1:02", "1:02:03.5", "2m03s", "1h2m3s", "x")] == [62000, 3723500, 123000, 3723000, None]


@pytest.mark.parametrize("style", [("ANN: ", "Bob S.: ", "BS : ", "host: "), ("Ann Lee-Ray : ", "GUEST: ", "Bob : ", "A. Lee-Ray: "), ("**Ann** ", "**Bob Stone:** ", "**guest** ", "**HOST** "), ("Ann – ", "bob stone - ", "Guest - ", "AL – ")])
@pytest.mark.parametrize("times", ["start", "offset_ms", None])
def test_labels_in_the_texts_of_records(names, style, times):
    a, b, b2, c = style
    said = [(0, f"{a}One."), (9, f"{b}um, Two."), (12, f"{b2}[applause]"), (14, "Three. Note: this."), (20, f"{c}um uh"), (25, f"{c}Four.")]
    rows = [{"text": t} | ({times: s if times == "start" else s * 1000} if times else {}) for s, t in said]
    if times:
        random.Random(1).shuffle(rows)
    assert turns.turns(json.dumps(rows), names) == [(1, "One."), (2, "Two. Three. Note: this."), (1, "Four.")]


def test_records_without_labels_or_with_fields(names):
    assert turns.turns(json.dumps([{"start": 0, "text": "We met. Note: at nine."}, {"start": 4, "text": "Then - so they say - it rained."}]), names) == []
    assert turns.turns(json.dumps([{"start": 0, "text": "Ann: um"}, {"start": 4, "text": "Bob: [music]"}]), names) == []
    # A field speaks for its record: a name with a colon in the text is then what is said.
    assert turns.turns(json.dumps([{"speaker": "Ann", "text": "Bob: a name."}, {"text": "Guest: a role."}]), names) == [(1, "Bob: a name. Guest: a role.")]
    assert turns.turns(json.dumps(["Ann: One.", "Two.", None, 7, ["x"], {"text": "BOB: Three. Ann: Four."}]), names) == [(1, "One. Two."), (2, "Three."), (1, "Four.")]


def test_no_turns(names):
    for t in (None, "", "Plain. Note: text.", "<p>Ann: x</p>", "[]", '[{"text": "Anna: x"}]', "x" * 100_000):
        assert turns.turns(t, names) == []
    assert turns.turns("Ann: One.", {}) == []
    assert len(turns.turns("\n".join(f"{'Ann' if i % 2 else 'Bob'}: w{i}." for i in range(20_000)), names)) == 20_000


@settings(max_examples=100, deadline=None)
@given(values=st.lists(st.integers(-20, 20), max_size=9))
def test_isotonic(values):
    got = turns.isotonic(values)
    assert len(got) == len(values) and all(a <= b + 1e-9 for a, b in zip(got, got[1:]))
    # Means of the pools and no better fit by shifting any suffix.
    assert abs(sum(got) - sum(values)) < 1e-6
    loss = sum((a - b) ** 2 for a, b in zip(got, values))
    for i in range(len(values)):
        for d in (-0.01, 0.01):
            moved = [g + d * (j >= i) for j, g in enumerate(got)]
            if all(a <= b + 1e-9 for a, b in zip(moved, moved[1:])):
                assert sum((a - b) ** 2 for a, b in zip(moved, values)) >= loss - 1e-9


# ---- residue

FOUND = [
    "Dear {{ name }}, welcome to %%show%%!", "Lorem ipsum dolor sit amet magna vitae lorem quis.", "404 Not Found", "Notes: TBD", "[object Object] 123", "Error 410: this recording is gone.", "Please enable JavaScript to view this page.", "Some talk.\nTraceback (most recent call last):\n  File \"a.py\", line 3, in f\nKeyError: 'x'\nMore talk.",
    "<p>Something went wrong</p><p>Request id 77</p>", "Seite nicht gefunden (404).", "Your text goes here.", "The talk went on. Video unavailable. We left.", "Amber player – Access denied.", "Hosted by null, with guest NaN.", "Video​ unavailable.", "TODO: write this down",
    "In this episode {{guest_name}} explains how markets work.", "{{host}} said hello to everybody.",
]
CONTENT = [
    None, "", "  ", "A talk about rivers.", "The song is called Access Denied and runs 12 bars.", "In the shell you write ${HOME} instead of the full path.", "We kept seeing a 404 error on item 7, and it took a week.", "He explained why lorem ipsum is used as dummy text.", "Curly braces like {x} delimit a set, and we counted them.",
    "A 503 means the service is unavailable, and ours said so for 9 minutes.", "12345", "I keep a TODO list with 4 entries.", "The token called <|startoftext|> comes first.", "He printed a 'please enable JavaScript' sign as a joke.",
]


@pytest.mark.parametrize("text", FOUND)
def test_residue(text):
    assert "strong" in [residue.message_kind(u) for u in residue.units(text) if residue.has_cue(u)]


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert not any(residue.message_kind(u) for u in residue.units(text))


def _spelled(nodes, rng):
    """A string that the parsed rule matches; each alternative may come."""
    out = ""
    for op, arg in nodes:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "IN":
                o, a = rng.choice([x for x in arg if str(x[0]) != "NEGATE"]) if str(arg[0][0]) != "NEGATE" else ("ANY", None)
                out += chr(a) if str(o) == "LITERAL" else chr(a[0]) if str(o) == "RANGE" else "k"
            case "ANY" | "NOT_LITERAL":
                out += "k"
            case "SUBPATTERN":
                out += _spelled(arg[3], rng)
            case "BRANCH":
                out += _spelled(rng.choice(arg[1]), rng)
            case "MAX_REPEAT" | "MIN_REPEAT":
                out += "".join(_spelled(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
    return out


@pytest.mark.parametrize("rule", [rule for _, rule in residue.STRONG + residue.WEAK[:2] + residue.WEAK[3:]])
def test_whatever_a_rule_matches_has_one_of_its_cues(rule):
    rng = random.Random(5)
    compiled = re.compile(rf"(?:{rule})(?![\w])")
    for _ in range(600):
        text = _spelled(re._parser.parse(rule), rng)
        if compiled.fullmatch(text):
            given = text.replace("#", "7")
            assert residue.has_cue(given), given
            assert compiled in {r for _, rules in residue._CUES.iter(text) for _, r in rules}, text


@pytest.mark.parametrize(
    "text",
    ["We can't find that page", "We cannot find this page", "The requested URL could not be found", "The requested page does not exist", "No results found", "No episodes found", "Cannot POST /x", "Connection closed by peer", "Application error", "Malformed request", "Confirm you are not a bot", "This channel has been blocked", "You have been limited", "Server unavailable"],
)
def test_messages_of_every_alternative(text):
    assert ["strong"] == [residue.message_kind(u) for u in residue.units(text) if residue.has_cue(u)]


@pytest.mark.parametrize(
    "text",
    [
        "Please enable JavaScript " * 40, "Page not found. " * 3 + "The page could not be found, " * 30, "Traceback (most recent call last): " + 'File "/srv/app/main.py", line 12, in run ' * 20 + "ValueError: bad", "SQLSTATE[42S02]: Base table or view not found: " + "1146 Table missing in statement " * 20,
        'Exception in thread "main" java.lang.IllegalStateException ' + "at a.b.Runner(Runner.java:12) " * 30, "Stack trace: " + "#0 /srv/app/a.php(12): run() " * 30, '{"error":{"code":500,"message":"failed","trace":[' + '"at a.b.Runner line 12",' * 40 + "]}}", '{"status":500,"error":"failed","trace":"' + "at a.b.Runner line 12, " * 40 + '"}',
    ],
)
def test_messages_of_any_length(text):
    assert "strong" in [residue.message_kind(u) for u in residue.units(text) if residue.has_cue(u) and len(u) > 400]


def test_long_content_is_none():
    said = "we looked at the page that was not found and then somebody said that scripts are required to see it "
    assert residue.message_kind(said * 10) is None
    assert residue.message_kind('{"status":"ok","error":null,"text":"' + said * 10 + '"}') is None
    for text in ("please enable javascript " * 20_000 + "or not at all", "error " * 50_000, "x" * 200_000 + " not found", "a." * 100_000 + "error", "{{a}} " * 60 + "is said to be " + "x" * 50):
        residue.message_kind(text)


def test_groups_of_messages():
    same = [["Amber player – Access denied.", "Access denied.", "VELVET CAST | access denied."], ["Lorem ipsum dolor sit amet.", "magna vitae lorem quis dolor"], ["Error 404: see http://a.example/x", "error 12: see www.b.example"], ["Dear {{a}}, hello", "dear %%b%%, hello"]]
    for units in same:
        assert len({residue.group_text(u) for u in units}) == 1
    assert len({residue.group_text(units[0]) for units in same}) == len(same)


def test_what_counts_by_itself():
    sure = lambda t: {s for _, s in residue.text_messages(t)[0].values()}
    # In words beside other text a message has to recur; alone, or by its form, it needn't.
    assert sure("We met at nine.\nVideo unavailable.\nThen it rained.") == {False} and sure("Video unavailable.\n503") == {True}
    assert sure("We met at nine.\nDear {{name}}, welcome.") == {True} and sure("We met. Lorem ipsum dolor sit amet magna vitae quis.") == {True}
    assert residue.text_messages(None) == residue.text_messages("") == residue.text_messages("We met.") == ({}, False)


def test_masks():
    assert residue.masked("See http://a.example/x or mail a@b.example on 2024-01-02") == "see ⟨⟩ or mail ⟨⟩ on #"
    assert residue.masked("Request id 12") == residue.masked("REQUEST ID 99")


# ---- subjects


def test_stored_labels():
    labels = ["Economy", "Film and Television", "Health", "Other / Not Listed", "Public Affairs"]
    keys = subjects.label_keys(labels)
    got = [subjects.known_labels(x, keys, 3) for x in ("Economy", " economy.", "Econ.", "Public Affairs / Health", "Other / Not Listed", "FILM AND TELEVISION", "None", "n/a", "Other", None, "", "Sports")]
    assert got == [[0], [0], [0], [4, 2], [3], [1], [], [], [], [], [], []]


def corpus(n=900, seed=6):
    rng = random.Random(seed)
    words = {"Food": "bread soup oven cook spice stew".split(), "Law": "court judge fine statute clause jury".split(), "Sport": "league match coach goal serve sprint".split(), "Other": "aunt mug sweater carpet sticker umbrella".split()}
    say = lambda k: f"the {rng.choice(words[k])} was near the {rng.choice(words[k])} in {rng.randint(1900, 2000)}"
    rows = []
    for _ in range(n):
        own = rng.sample(["Food", "Law", "Sport"], rng.choice([1, 1, 1, 2])) if rng.random() > 0.15 else []
        parts = [say(k) for k in own for _ in range(6 // len(own))] + [say("Other") for _ in range(rng.randint(1, 2) if own else 5)]
        if len(own) == 1 and rng.random() < 0.3:
            parts.append(say(rng.choice([k for k in ("Food", "Law", "Sport") if k not in own])))
        flat = rng.random() < 0.3
        if not flat:
            rng.shuffle(parts)
        label = (rng.choice(own) if own else "Other") if rng.random() > 0.1 else rng.choice(["Food", "Law", "Sport"])
        rows.append((" ".join(parts) if flat else ". ".join(parts) + ".", label, set(own) or {"Other"}))
    return rows


def test_subjects_on_held_out_segments():
    rows = corpus()
    m = subjects.fit(["Food", "Law", "Other", "Sport"], [(t, lab) for t, lab, _ in rows[:600]])
    got = [{m.labels[i] for i in subjects.chosen(s, m.other)} for s in subjects.shares(m, [t for t, _, _ in rows[600:]])]
    right = Counter(a == b for a, (_, _, b) in zip(got, rows[600:]))
    assert right[True] > 0.93 * len(got)


def test_paths_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(7)
    for n in (1, 2, 5):
        s, ends = rng.normal(size=(n, 3)) * 3, [bool(x) for x in rng.integers(0, 2, n)]
        cost = [subjects.COST_END if e else subjects.COST_INSIDE for e in ends]
        value = lambda y: sum(s[i, a] for i, a in enumerate(y)) - sum(cost[i] for i in range(1, n) if y[i] != y[i - 1])  # noqa: B023, E731
        best = max(product(range(3), repeat=n), key=value)
        longer = rng.normal(size=(9, 3))
        got = subjects.paths([s, longer, np.zeros((0, 3))], [ends, [False] * 9, []])
        assert tuple(got[0]) == best and len(got[1]) == 9 and len(got[2]) == 0


def test_subjects_without_data():
    m = subjects.fit(["A", "Other"], [])
    assert [subjects.chosen(s, m.other) for s in subjects.shares(m, ["x y", "...", ""])] == [[1], [1], [1]]


def test_long_inputs_take_linear_time():
    import time

    began = time.time()
    assert len(pages.maximal_regions([1, -3] * 200_000)) == 200_000 and len(pages.maximal_regions([2, -1] * 200_000)) == 1
    assert len(turns.isotonic(list(range(100_000, 0, -1)))) == 100_000
    assert len(split.cuts("word and word. " * 60_000, 6000, 200)) > 100
    assert residue.units("a b. " * 50_000)
    assert len(repetition.units("some words here. " * 30_000)) == 30_000
    assert time.time() - began < 30


@pytest.mark.parametrize("text", ["Sorry, this page does not exist.", "500 Internal Server Error", "This site works best with JavaScript.", "Diese Seite benötigt JavaScript.", "Página não encontrada", "ページが見つかりません。", "Hello [NAME], welcome!", "Guest: %s", "Type your text here", "Rate limit exceeded, retry in 33 s", "Please verify you are a human"])
def test_messages_in_other_words(text):
    assert "strong" in [residue.message_kind(u) for u in residue.units(text) if residue.has_cue(u)]


def test_likely_messages_count_where_they_recur():
    assert residue.message_kind("Reload to see the transcript of item 12.") == "likely"
    assert residue.message_kind("We had to reload the truck.") is None and residue.message_kind("The exception was said aloud.") is None


def test_one_long_segment_among_short_ones():
    rows = corpus(200)
    m = subjects.fit(["Food", "Law", "Other", "Sport"], [(t, lab) for t, lab, _ in rows])
    short = [t for t, _, _ in rows[:100]]
    alone = [s.tolist() for s in subjects.shares(m, short)]
    both = [s.tolist() for s in subjects.shares(m, [*short[:50], "the judge was near the court. " * 20_000, *short[50:]])]
    assert both[:50] + both[51:] == alone and both[50][1] > 0.95
