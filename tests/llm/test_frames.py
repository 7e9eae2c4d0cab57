"""Operators on tables: nulls, empty tables, repeated rows, clashing columns, hot keys, brute force."""

import json
import os
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkmill.llm import dedup, mix, pages, repetition, residue, sample, split, subjects, tokenize, turns

SMALL = os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001")
VIDEO = "row_id long, source_url string, transcript string, title string, creator_label string, batch_no int, line_no int, key string, ids string, piece string, share double"


def videos(spark, rows):
    """Rows of (row_id, source_url, transcript, title, creator_label) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 0, 1, "k", "i", "p", 0.5) for r in rows], VIDEO)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- tokens


def test_tokens(spark):
    d = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (2, None, "x"), (3, "", None), (None, " ", "x")], "doc_id long, text string, ids string")
    got = tokenize.encode_texts(d)
    enc = tokenize.encoder()
    assert rows(got) == sorted([(1, enc.encode("a b"))] * 2 + [(2, []), (3, []), (None, enc.encode(" "))], key=repr)
    assert got.schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    assert tokenize.encode_texts(d.limit(0)).count() == 0


# ---- mixing


def documents(spark, sizes, extra="n_tokens int, quota int"):
    d = [(i, " a" * n if n is not None else None, s, 7, 7) for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(d, f"doc_id long, text string, source string, {extra}")


def targets(spark, *t):
    return spark.createDataFrame(list(t), "source string, target_share double, max_repeats int")


def test_quotas(spark):
    d = documents(spark, [("Big", 60), ("big ", 20), ("SMALL-one", 4), ("small_one", None), (None, 10), ("odd", 6), ("big", 0)])
    t = targets(spark, ("big", 0.5, 1), ("small_one", 0.3, 2), ("none_of_it", 0.2, 3), (None, 0.5, 1))
    got = {r.spelled: (r.tokens, r.quota, r.short) for r in mix.plan(mix.sized(d), t).collect()}
    assert got == {"big": (80, 50, False), "small_one": (4, 8, True), "none_of_it": (0, 0, True)}
    assert {r.spelled: r.short for r in mix.plan(mix.sized(d.limit(0)), t).collect()} == {"big": False, "small_one": False, "none_of_it": False}


def test_schedule_keeps_the_shares():
    quotas = {"a": 5000, "b": 2500, "c": 2400, "d": 100, "e": 0}
    size, schedule, missed = mix.pfair(quotas, blocks=200)
    assert missed == []
    assert len(schedule) == sum(-(-q // size) for q in quotas.values()) and len({s for _, _, s in schedule}) == len(schedule)
    n = {s: -(-q // size) for s, q in quotas.items() if q}
    done = Counter()
    for slot, (s, k, at) in enumerate(sorted(schedule, key=lambda x: x[2])):
        assert k == done[s]
        done[s] += 1
        assert all(abs(done[x] - (at + 1) * n[x] / sum(n.values())) < 1 + 1e-9 for x in n)
    assert mix.pfair({}) == (1, [], []) and mix.pfair({"a": 0}) == (1, [], [])


@settings(max_examples=80, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 40), st.integers(1, 4), st.integers(0, 10)), min_size=1, max_size=6), blocks=st.sampled_from([3, 17, 4096]))
def test_missed_deadlines_are_the_short_sources(rows, blocks):
    """By the schedule, and by comparing what there is with the target, to a part of a token."""
    whole, all_of = sum(t for t, _, _ in rows), max(1, sum(w for _, _, w in rows))
    plan = [{"source": f"s{i}", "spelled": f"S{i}", "tokens": t, "max_repeats": m, "target_share": round(w / all_of, 3), "whole": whole} for i, (t, m, w) in enumerate(rows)]
    want = [r["spelled"] for r in plan if r["tokens"] * r["max_repeats"] < Fraction(str(r["target_share"])) * whole]
    assert mix.unreachable(plan, blocks) == want


def test_slots_of_a_source_that_runs_out_go_to_the_others():
    size, schedule, missed = mix.pfair({"a": 100, "b": 100}, 20, {"a": 35})
    assert size == 10 and missed == ["a"] and [k for s, k, _ in schedule if s == "a"] == [0, 1, 2] and [k for s, k, _ in schedule if s == "b"] == list(range(10))
    assert mix.pfair({"a": 95, "b": 100}, 20, {"a": 95})[2] == [] and mix.pfair({"a": 95, "b": 100}, 20, {"a": 94})[2] == ["a"]


def test_mix(spark):
    d = documents(spark, [("a", 3)] * 300 + [("b", 5)] * 20 + [(None, 2)] * 10)
    t = targets(spark, ("a", 0.5, 1), ("b", 0.5, 4))
    got = mix.mix(d, t, blocks=64).collect()
    quota = {r.source: r.quota for r in mix.plan(mix.sized(d), t).collect()}
    used = Counter()
    for r in got:
        used[r.source] += r.n_tokens
    assert quota == {"a": 510, "b": 400} and all(0 <= quota[s] - used[s] < 5 for s in quota)
    uses = Counter((r.doc_id, r.source) for r in got)
    assert max(n for (_, s), n in uses.items() if s == "a") == 1 and max(n for (_, s), n in uses.items() if s == "b") == 4
    assert len({(r.doc_id, r.copy_no) for r in got}) == len(got)
    order = sorted(got, key=lambda r: (r.slot, r.at))
    part = Counter()
    for r in order[: len(order) // 2]:
        part[r.source] += r.n_tokens
    assert abs(part["a"] / sum(part.values()) - 510 / 910) < 0.05
    assert mix.unreachable(mix.planned(mix.sized(d), t)) == ["b"]
    again = sorted(tuple(r) for r in mix.mix(d.repartition(7), t, blocks=64).collect())
    assert again == sorted(tuple(r) for r in got)
    assert {r.source: r.most_uses for r in mix.shares(d, t, 64).collect()} == {"a": 1, "b": 4}
    assert mix.mix(d.limit(0), t).count() == 0


# ---- history

HOSTS = [("www.t.example", "t"), ("t.example", "t"), ("s.example", "t"), ("p.example", "p"), ("hop.example", None)]
SITES = dict(HOSTS)


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://www.t.example/watch?v=AbC", "t AbC"), ("HTTP://T.EXAMPLE:80/watch?x=1&amp;v=A%62C#t=9", "t AbC"), (" s.example/AbC?si=1\n", "t AbC"), ("https://t.example/embed/abc/", "t abc"), ("https://p.example/show/A/episode/07?x=1", "p #7"), ("https://p.example/embed?show=b&ep=7", "p #7"),
        ("https://hop.example/out?cid=3&to=https%3A%2F%2Fhop.example%2Fout%3Fto%3Dhttps%253A%252F%252Fs.example%252FAbC", "t AbC"), ("https://other.example/watch?v=AbC", None), ("https://hop.example/out?to=" + "https%3A%2F%2Fhop.example%2Fout%3Fto%3D" * 1, None), ("https://t.example/", None), ("", None), (" ", None), (None, None), ("https://hop.example/out?cid=3", None),
    ],
)
def test_addresses(url, key):
    assert dedup.video_key(url, SITES) == key


def test_many_forwarders():
    from urllib.parse import quote

    url = "s.example/AbC"
    for _ in range(9):  # each level escapes the one before
        url = "https://hop.example/out?to=" + quote(url if "://" in url else f"https://{url}", safe="")
    assert dedup.video_key(url, SITES) == "t AbC"
    flat = "https://hop.example/out?to=" * 40 + "https://s.example/AbC"
    assert dedup.video_key(flat, SITES) == "t AbC"


def urls(n):
    return [(i, f"https://www.t.example/watch?v=code{i % 37:03d}" if i % 3 else "https://t.example/live/HOT", None, None, None) for i in range(1, n)] + [(n, None, None, None, None), (n + 1, " ", None, None, None)]


def hosts(spark):
    return spark.createDataFrame(HOSTS, "host string, site string")


def brute(keys):
    first, out = {}, []
    for i, k in sorted(keys):
        if k is not None and first.setdefault(k, i) != i:
            out.append((first[k], i))
    return sorted(out)


def test_repeats_against_brute_force(spark):
    r = dedup.keyed(videos(spark, urls(300)), hosts(spark))
    want = brute([(x.row_id, x.key) for x in r.collect()])
    all_of = lambda r: (dedup.entries(r), dedup.blocks(dedup.entries(r).drop("n")))
    got = dedup.repeats(r, *all_of(r))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200
    assert dedup.repeats(r.limit(0), *all_of(r)).count() == 0
    same = dedup.keyed(videos(spark, [(1, "s.example/a", None, None, None)] * 2), hosts(spark))
    assert dedup.repeats(same, *all_of(same)).count() == 0


def test_batches_against_history(spark, tmp_path):
    r = dedup.keyed(videos(spark, urls(200)), hosts(spark)).cache()
    store, found = dedup.PrintStore(spark, str(tmp_path / "store")), []
    for b in range(4):
        batch = r.filter((F.col("row_id") > 55 * b) & (F.col("row_id") <= 55 * (b + 1)))
        found += [tuple(x) for x in store.check(batch, str(b)).collect()]
        store.append(batch, str(b))
        store.append(batch, str(b))  # a batch that is written again changes nothing
    assert sorted(found) == brute([(x.row_id, x.key) for x in r.collect()])


def test_batches_through_a_compacted_store(spark, tmp_path):
    r = dedup.keyed(videos(spark, urls(200)), hosts(spark)).cache()
    store, found = dedup.PrintStore(spark, str(tmp_path / "store"), bits=1, folder_rows=4, batches=2), []
    for b in range(8):
        found += [tuple(x) for x in store.accept(r.filter((F.col("row_id") > 26 * b) & (F.col("row_id") <= 26 * (b + 1))), str(b)).collect()]
    assert sorted(found) == brute([(x.row_id, x.key) for x in r.collect()])
    assert len(store._folders()) <= 3 and store.tables().filter("t = 0").count() >= r.select("key").distinct().count() - 1
    dedup.PrintStore(spark, str(tmp_path / "none")).compact()
    # A batch larger than a folder should be is written by several tasks.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # which would join parts as small as these
    big = dedup.PrintStore(spark, str(tmp_path / "big"), folder_rows=10)
    big.append(r, "0")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "big").rglob("t=0/p=0/*.parquet"))) > 1


def test_a_batch_reads_no_more_of_a_larger_history(spark, tmp_path):
    """What a batch opens stays the same while the history grows tenfold, as the folders keep their size."""
    site = spark.createDataFrame([("t.example", "t")], "host string, site string")
    rows = lambda a, b: dedup.keyed(spark.range(a, b).selectExpr("id + 1 row_id", "concat('t.example/watch?v=c', id) source_url"), site)
    read = []
    for k, n in enumerate((4_000, 40_000)):
        store = dedup.PrintStore(spark, str(tmp_path / str(k)), folder_rows=250)
        store.append(rows(0, n), "0")
        store.compact()
        own = dedup.entries(rows(n - 1, n + 2))
        files = lambda d: [r[0] for r in d.select(F.input_file_name()).distinct().collect()]
        opened = files(store.tables(own))
        read.append(sum(os.path.getsize(f.removeprefix("file://")) for f in opened))
        assert len(files(store.tables())) > 5 * len(opened)
        plan = store.tables(own)._jdf.queryExecution().executedPlan().toString()
        assert " IN (" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
        assert sorted(map(tuple, store.check(rows(n - 1, n + 2).withColumn("row_id", F.col("row_id") + n), "1").collect())) == [(n, 2 * n)]
    assert read[1] < 1.5 * read[0]


@pytest.mark.parametrize(("bits", "pieces"), [(1, 2), (3, 4), (3, 6), (0, 1), (1, 3)])
def test_near_prints_are_found(spark, bits, pieces):
    """Every pair within so many bits shares the block of a table: recall against brute force is 1."""
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(60)]
    flipped = [(p, p ^ sum(1 << b for b in rng.sample(range(64), k))) for p in base for k in (0, 1, 2, 3, 4)]
    long = lambda p: p - (1 << 64) if p >= 1 << 63 else p
    table = spark.createDataFrame([("k", long(p), i) for i, (p, _) in enumerate(flipped)], "key string, print long, first_row_id long")
    probes = spark.createDataFrame([(f"k{i}", long(q), 1) for i, (_, q) in enumerate(flipped)], "key string, print long, n long")
    got = dedup.look_up(probes, dedup.blocks(table, bits, pieces), bits, pieces, same=F.substring("a.key", 1, 1) == F.col("b.key"))
    want = {f"k{i}": min(near) for i, (_, q) in enumerate(flipped) if (near := [j for j, (p, _) in enumerate(flipped) if (p ^ q).bit_count() <= bits])}
    assert {r.key: r.first_row_id for r in got.collect()} == want
    assert dedup.look_up(probes, dedup.blocks(table, bits, pieces), bits, pieces).count() == 0  # other texts


def test_more_pieces_than_bits(spark):
    with pytest.raises(ValueError):
        dedup.blocks(spark.createDataFrame([(1,)], "print long"), 2, 2)


def test_prints():
    a, b, c = dedup.fingerprints(["a long text about rivers and boats", "a long text about rivers and boats", None])
    assert a == b and c is None and dedup.fingerprints([]) == [] and dedup.fingerprints([""])[0] is not None


def test_near_texts_have_near_prints_and_are_found(spark):
    """The grams decide the fingerprint, so a text with a word changed is found through the tables, and no other text."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9)))
    texts = [[word() for _ in range(1500)] for _ in range(40)]
    changed = [[*t[:i], word(), *t[i + 1 :]] for t in texts for i in [rng.randrange(1500)]]
    old, new = (dedup.fingerprints([" ".join(t) for t in x]) for x in (texts, changed))
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert sum(bits(a, b) <= 3 for a, b in zip(old, new)) >= 36 and any(a != b for a, b in zip(old, new))
    assert min(bits(a, b) for i, a in enumerate(old) for j, b in enumerate(new) if i != j) > 9
    table = spark.createDataFrame([(f"k{i}", p, i) for i, p in enumerate(old)], "key string, print long, first_row_id long")
    probes = spark.createDataFrame([(f"k{i} changed", p, 1) for i, p in enumerate(new)], "key string, print long, n long")
    got = dedup.look_up(probes, dedup.blocks(table, 3, 4), 3, 4, same=F.lit(True)).collect()
    assert len(got) >= 36 and all(r.key == f"k{r.first_row_id} changed" for r in got)


def test_prints_of_short_texts_fill_no_block():
    """Numbered episodes, which share most of their grams, spread over the blocks of both tables and over the first bits."""
    for texts in ([f"#{i}" for i in range(1, 100_000)], [f"talk{i:06d}" for i in range(100_000)]):
        prints = np.array(dedup.fingerprints(texts, kinds=["t"] * len(texts)), np.int64).view(np.uint64)
        for block in (prints >> np.uint64(32), prints & np.uint64(0xFFFFFFFF)):
            assert (np.unique(block, return_counts=True)[1] ** 2).sum() < 4 * len(texts)
        assert np.bincount((prints >> np.uint64(58)).astype(int), minlength=64).max() < 4 * len(texts) / 64
    a, b, c = dedup.fingerprints(["#1", "#1", "#1"], kinds=["t", "p", "t"])
    assert a == c != b


# ---- texts of videos

TALK = json.dumps([{"start_ms": i * 1000, "speaker": s, "text": t} for i, (s, t) in enumerate([("Ann", "One."), ("um", "Two."), ("Bob", "[applause]"), ("BOB", "Three.")])])


def speakers(spark):
    return spark.createDataFrame([(" Channel", 1, "Ann Lee", "Host"), ("channel", 2, "Bob Ray", None), (None, 3, "No One", "Host"), ("channel", None, "Who", "x")], "creator_label string, speaker_id long, speaker_name string, speaker_role string")


def test_turns(spark):
    v = videos(spark, [(1, None, TALK, None, "CHANNEL "), (1, None, TALK, None, "channel"), (2, None, TALK, None, None), (3, None, None, None, "channel"), (4, None, " ", None, "channel"), (5, None, TALK, None, "elsewhere")])
    got = [(r.row_id, r.turn_no, r.speaker_id, r.text) for r in turns.speaker_turns(v, speakers(spark)).collect()]
    assert sorted(got) == sorted([(1, 1, 1, "One. Two."), (1, 2, 2, "Three.")] * 2)
    assert rows(turns.speaker_turns(v, speakers(spark), most=1)) == rows(turns.speaker_turns(v, speakers(spark)))
    assert turns.speaker_turns(v.limit(0), speakers(spark)).count() == 0 and turns.speaker_turns(v, speakers(spark).limit(0)).count() == 0


def test_pieces(spark):
    v = videos(spark, [(1, None, "a " * 30, None, None), (2, None, None, None, None), (3, None, "", None, None), (4, None, "x" * 61, None, None), (4, None, "x" * 61, None, None)])
    got = split.split_texts(v, 25, 5).collect()
    assert Counter(r.row_id for r in got) == {1: 3, 3: 1, 4: 6}
    assert all(len(r.piece) == r.stop - r.start <= 25 for r in got) and {r.cut for r in got if r.row_id == 4} == {"forced", "end"}
    assert split.split_texts(v.limit(0), 25, 5).count() == 0


def test_boilerplate(spark):
    weights = pages.fit([("Home", False), ("Log in", False), ("The judge said that it was over.", True), ("We heard it in the end.", True)] * 20)
    page = "<div>\n<div>Home</div>\n<div>Title</div>\n<p>The judge said that it was over.</p>\n<div>Log in</div>\n</div>"
    v = videos(spark, [(1, None, page, "Title", None), (1, None, page, "Title", None), (2, None, None, None, None), (3, None, " ", None, None), (4, None, "plain talk", None, None), (5, None, page, None, None)])
    model = pages.PageModel(weights, [], frozenset())
    got = rows(pages.boilerplate_lines(v, model))
    assert [x for x in got if x[0] == 1] == [(1, 1), (1, 1), (1, 4), (1, 4)] and {x[0] for x in got} == {1, 5}
    assert pages.boilerplate_lines(v.limit(0), model).count() == 0
    assert pages.page_model(v.limit(0)).notices == frozenset() and pages.page_model(v.limit(0)).given == []


def test_many_notices_are_joined(spark):
    """The same lines come out whether the notices are sent to the tasks or joined by their hashes."""
    notice = "He thought that the old lamp was here before they came."
    page = lambda i: (i, f"https://a.example/{i}", f"<div>\n<p>They counted {i * 'very '} many boats on that day.</p>\n<p>{notice}</p>\n<p>She said so.</p>\n</div>", f"Title {i}", None)
    v = videos(spark, [page(i) for i in range(1, 31)] + [page(30), (40, None, "plain", None, None), (41, None, None, None, None), (42, None, "[1]\n", None, None)])
    sent, joined = pages.page_model(v), pages.page_model(v, most=0)
    assert len(sent.notices) == 1 and joined.notices is None
    assert rows(pages.boilerplate_lines(v, sent)) == rows(pages.boilerplate_lines(v, joined)) == sorted([(i, 2) for i in [*range(1, 31), 30]], key=repr)
    assert rows(repetition.shares(v, sent)) == rows(repetition.shares(v, joined))


def test_notices_of_all_sites(spark):
    """A line that one page each of many sites has is a notice though no site has it often."""
    notice = "He thought that the old lamp was here before they came."
    v = videos(spark, [(i, f"https://site{i}.example/x", f"<div>\n<p>They counted {i * 'very '} boats on that day.</p>\n<p>{notice}</p>\n</div>", f"Title {i}", None) for i in range(30)])
    assert pages.page_model(v).notices == {pages.line_hash(notice)}


def test_pages_are_read_twice(spark, tmp_path):
    """Once for the model and once for the result, whose plan has no shuffle."""
    videos(spark, [(i, "https://a.example/x", f"<div>\n<p>We met {i}.</p>\n<main>\n<p>So they said, and left {i}.</p>\n</main></div>", f"T{i}", None) for i in range(40)]).repartition(4).write.parquet(f"{tmp_path}/videos.parquet")
    for query in (pages.p3_found, repetition.p6_found):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and "Exchange" not in plan
    model = pages.page_model(spark.read.parquet(f"{tmp_path}/videos.parquet"))
    assert len(model.given) == 40 and len(pages.page_model(spark.read.parquet(f"{tmp_path}/videos.parquet"), pages=7).given) == 7


def test_drawn_pages_do_not_depend_on_partitions(spark):
    v = videos(spark, [(i, None, f"<div>\n<main>\n<p>So they said, and left {i}.</p>\n</main></div>", "T", None) for i in range(400)])
    some = [pages.lent_pages(pages.read_lines(d, drawn=100)) for d in (v, v.repartition(3))]
    assert some[0] == some[1] and 50 < len(some[0]) < 150


@pytest.mark.parametrize("n", [12, 20])
def test_notices_do_not_depend_on_the_size_of_the_table(spark, tmp_path, n):
    """What stands on all pages of a small site is a notice in a table of this site and in one of many."""
    said = ["The judge said that it was over.", "We heard nothing until the rain had ended.", "She asked why they had left so early."]
    notice = "He thought that the old lamp was here before they came."
    made = lambda i, site, lines: (i, f"https://{site}.example/{i}", "<div>\n" + "\n".join(f"<p>{x}</p>" for x in lines) + "\n</div>", f"Title {i}", None)
    own = [made(i, "small", [said[0], f"They counted {i * 'very '} many boats on that day.", notice, *said[1 + i % 2 :]]) for i in range(n)]
    others = [made(1000 + i, f"site{i % 50}", ["We talked about it, and nobody had an answer.", "It was " + "so " * (i // 50) + f"cold{'x' * (i % 50)} in the end."]) for i in range(7000)]
    got = []
    for k, table in enumerate((own + others[:200], own + others)):
        videos(spark, table).write.parquet(f"{tmp_path}/{k}/videos.parquet")
        got.append({r.line_no for r in pages.p3_found(spark, f"{tmp_path}/{k}").collect() if r.row_id == 1})
    assert 3 in got[0] and got[0] == got[1]


def test_repetition(spark):
    said = "a listener wrote to us about seven red boats on the long river near town. "
    v = videos(spark, [(1, None, said * 4, None, None), (2, None, None, None, None), (3, None, "", None, None), (4, None, said, None, None), (4, None, said, None, None)])
    found = repetition.shares(v).collect()
    assert {(r.row_id, r.n_words, r.n_repeated) for r in found} == {(1, 60, 45), (2, 0, 0), (3, 0, 0), (4, 15, 0)}
    assert all(r.share + r.content_share == 1 for r in found)
    assert repetition.shares(v.limit(0)).count() == 0


def test_residue(spark):
    d = [(i, "oops!", s) for i, s in enumerate(["a", "b", "a", None])] + [(10, "oops!\nA talk about boats.", "c"), (11, "404 Not Found", "x"), (11, "404 Not Found", "x"), (12, None, "x"), (13, " ", None), (14, "Just a talk.", "x"), (15, "loading", "x"), (None, "Notes: TBD", "x")]
    docs = spark.createDataFrame([(*x, "k", 1) for x in d], "doc_id long, text string, source string, kind string, hash int")
    assert sorted((r.doc_id for r in residue.with_residue(docs).collect()), key=str) == sorted([0, 1, 2, 3, 10, 11, None], key=str)
    assert residue.with_residue(docs.limit(0)).count() == 0


def test_messages_in_words_count_where_they_recur(spark):
    said = [(i, f"Part {'one two three four five six'.split()[i]} of the talk.\nReload to see the transcript of item {i}.", "ab"[i % 2]) for i in range(6)]
    copies = [(10 + i, "We met.\nThe upload was not found and a reload is due.", "ab"[i % 2]) for i in range(6)]  # one text six times is no recurrence
    docs = spark.createDataFrame([(*x, "t") for x in said + copies + [(20, "Before.\nWe could not find this page.\nAfter.", "a")]], "doc_id long, text string, source string, wide string")
    assert sorted(r.doc_id for r in residue.with_residue(docs).collect()) == list(range(6))
    assert residue.with_residue(docs.filter("source = 'a'")).count() == 0  # of one source only
    clean = residue.without_residue(docs)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [*range(10, 16), 20]
    assert sorted(r.doc_id for r in residue.without_residue(docs, most=0).collect()) == [*range(10, 16), 20]
    assert residue.without_residue(docs.limit(0)).count() == 0
    plan = residue.without_residue(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_subject_areas(spark):
    say = {"Food": "bread soup oven", "Law": "court judge fine"}
    labelled = spark.createDataFrame([(f"{w} and {w} again.", k) for k, w in say.items() for w in w.split()] * 3 + [(None, "Law"), ("x", None)], "segment_transcript string, codebook_label string")
    book = spark.createDataFrame([("Food", ""), ("Law", ""), ("Other / Not Listed", ""), (None, "")], "label string, definition string")
    m, ratio = subjects.train(labelled, book)
    s = spark.createDataFrame([("u", 0, "bread and soup.", "x"), ("u", 0, " bread  and soup. ", "x"), ("u", 1, None, "x"), ("u", 2, "  ", "x"), ("u", 3, "court and judge.", "x"), (None, 4, "zzz", "x")], "video_url string, segment_id int, segment_transcript string, codebook_label string")
    got = [tuple(r) for r in subjects.subject_areas(s, m, ratio).select("video_url", "segment_id", "codebook_label").collect()]
    assert sorted(got, key=str) == sorted([("u", 0, "Food"), ("u", 3, "Law"), (None, 4, "Other / Not Listed")], key=str)
    assert subjects.subject_areas(s.limit(0), m).count() == 0
    with pytest.raises(ValueError):
        subjects.train(labelled, book.limit(0))
    long = labelled.unionByName(spark.createDataFrame([("soup " * subjects.LABELLED_CHARS, "Law")], labelled.schema))
    assert (subjects.train(long, book)[0].word_llr == m.word_llr).all()


def test_one_ratio_at_every_size_and_no_label_is_lost(spark):
    rng = random.Random(3)
    words = {"A": "goal team match player".split(), "B": "court judge trial law".split()}
    said = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    # Many segments with a second subject, most of them of a part under the ratio.
    rows = [(f"{said('A', 60)}. {said('B', rng.choice([18, 20, 40, 60]))}. {i}", "A") for i in range(500)] + [(f"{said('B', 60)}. {i}", "B") for i in range(100)]
    book = spark.createDataFrame([("A",), ("B",), ("Other / Not Listed",)], "label string")
    labeled = spark.createDataFrame(rows, "segment_transcript string, codebook_label string")
    assert subjects.train(labeled, book)[1] == subjects.train(labeled.limit(20), book)[1] == subjects.RATIO
    with pytest.raises(ValueError, match="1000 labels"):
        subjects.train(labeled, spark.range(1001).selectExpr("concat('L', id) label"))


@pytest.mark.parametrize(("passing", "shared"), [(20, 42), (12, 16)])
def test_the_ratio_is_calibrated_on_the_labels(spark, passing, shared):
    """Labels never name a second subject of ``passing`` words beside 48, and name one of ``shared`` words as often as the first."""
    rng = random.Random(5)
    words = {"A": "goal team match player".split(), "B": "court judge trial law".split()}
    said = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = []
    for i in range(1200):
        a, b = rng.sample("AB", 2)
        n = (0, passing, shared)[i % 3]
        rows.append((f"{said(a, 48)}. {said(b, n)}.", rng.choice([a, b]) if n == shared else a))
    labeled = spark.createDataFrame(rows, "segment_transcript string, codebook_label string")
    book = spark.createDataFrame([("A",), ("B",), ("Other / Not Listed",)], "label string")
    ratio = subjects.train(labeled, book)[1]
    assert passing / (passing + 48) < ratio <= shared / (shared + 48)
    few = subjects.train(labeled.limit(12), book)[1]
    assert abs(few - subjects.RATIO) <= abs(ratio - subjects.RATIO)  # the fewer labels, the nearer to the start


def test_held_out_shares_come_from_the_other_half():
    rows = [("alpha beta. " * 9, "A"), ("alpha  beta. " * 9, "A"), ("gamma delta. " * 9, "B")]
    labels = ["A", "B", "Other"]
    found = subjects.held_out(labels, rows)
    # However spaced, a text is in one half: no row was fitted on itself, so nothing is known of the words of either.
    assert found[0].tolist() == found[1].tolist() == found[2].tolist() == [0, 0, 1]
    m = subjects.fit(labels, rows)
    assert subjects.shares(m, [rows[0][0]])[0][0] == 1


def test_samples(spark):
    d = spark.range(20_000).select((F.col("id") % 5000).cast("string").alias("t"))
    some = sample.sampled(d, 500, "t")
    n = some.count()
    assert 400 < n <= 500 and some.distinct().count() == n
    assert sorted(r.t for r in some.collect()) == sorted(r.t for r in sample.sampled(d.repartition(3), 500, "t").collect())
    assert sample.sampled(d, 50_000, "t").count() == 5000 and sample.sampled(d.limit(0), 5, "t").count() == 0


# ---- the queries


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_shares_that_are_reached(spark):
    """The mix of the test tables against counts made without Spark: each source within one document of what it should give."""
    enc = tokenize.encoder()
    docs = [(mix_source(r.source), len(enc.encode(r.text))) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    whole, longest, has = sum(n for _, n in docs), Counter(), Counter()
    for s, n in docs:
        has[s] += n
        longest[s] = max(longest[s], n)
    got = {r.source: r for r in mix.p8_shares(spark, SMALL).collect()}
    short = {r.source for r in mix.p8_found(spark, SMALL).collect()}
    targets = spark.read.parquet(f"{SMALL}/mix_targets.parquet").collect()
    assert set(got) == {t.source for t in targets}
    for t in targets:
        quota = min(has[t.source] * t.max_repeats, int(Fraction(str(t.target_share)) * whole))
        assert 0 <= quota - got[t.source].mixed_tokens < longest[t.source] or quota == got[t.source].mixed_tokens
        assert got[t.source].most_uses <= t.max_repeats and (t.source in short) == (has[t.source] * t.max_repeats < Fraction(str(t.target_share)) * whole)
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9


def mix_source(spelled):
    return spelled and re.sub(r"[-\s]+", "_", spelled.strip().lower())


SHAPES = {
    "p1_found": "video_url string,segment_id int,codebook_label string", "p2_found": "row_id bigint,cut string", "p3_found": "row_id bigint,line_no int", "p4_found": "first_row_id bigint,row_id bigint", "p5_found": "row_id bigint,turn_no int,speaker_id bigint",
    "p6_found": "row_id bigint", "p7_ids": "doc_id bigint,ids array<int>", "p8_found": "source string", "p9_found": "doc_id bigint",
}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_queries(spark):
    from talkmill.llm.queries import QUERIES

    for name, f in QUERIES.items():
        df = f(spark, SMALL)
        assert df.count() >= 0
        if name in SHAPES:
            assert ",".join(f"{c} {t}" for c, t in df.dtypes) == SHAPES[name]
            assert df.count() == df.distinct().count() > 0
