import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stipple.llm import leakage, packing, subtitles, truncation

ITEMS = [
    (1, "The marble river forgot the second photograph just when the fiddle polished a theater somehow. This honest ticket measured the restless cathedral."),
    (2, "Kaswarin réveille Meltulda dès l'aube à jamais parce que Quelulda protège Oskulda. Ilvemo achète le sentier ce soir."),
    (3, "too short"),
    (4, None),
    (5, ""),
]
PHRASES = ("subtitles by", "the end")
SCHEMA = "doc_id long, text string, item_id string, source string"


def srt(*cues, sep="\n"):
    return sep.join(f"{k + 1}{sep}00:00:{k:02d},000 --> 00:00:{k:02d},900{sep}{c.replace(chr(10), sep)}{sep}" for k, c in enumerate(cues))


def leaked(spark, *texts):
    docs = spark.createDataFrame([(i, t, "clash", "s") for i, t in enumerate(texts)], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.n_words for r in leakage.leaks(docs, items, phrases=PHRASES).collect()}


def test_leaks_through_damage(spark):
    got = leaked(
        spark,
        srt("Before it.", "The marble river forgot\nthe second photo-\ngraph just when the", "[door creaks]", "MAN: fiddle polished", "Subtitles by team x", "a theater somehow", "After."),
        srt("<i>The rnarble river</i> f0rgot the sec0nd photograph just\nwhen fhe ficldle polishecl a theoter", "other words come then"),
        srt("THE MARBLE RIVER FORGOT THE SECOND", "♪ la la la la la la ♪", "PHOTOGRAPH JUST WHEN THE FIDDLE POLISHED A THEATER SOMEHOW?", sep="\r\n"),
        srt("Kaswarin rÃ©veille Meltulda dÃ¨s l'aube Ã jamais parce que Quelulda protÃ¨ge Oskulda. Ilvemo achÃ¨te"),
        srt("Kaswarin r?veille Meltulda d?s l'aube ? jamais parce que", "Quelulda prot?ge Oskulda. Ilvemo ach?te le"),
        srt("kaswarin reveille meltulda des l'aube a jamais parce que", "quelulda protege oskulda ilvemo achete le"),
    )
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2)}
    assert all(n >= 14 for n in got.values())


def test_no_leaks(spark):
    assert leaked(
        spark,
        srt("The marble river forgot the second photograph just when the fiddle polished"),  # 12 words
        srt("just when the fiddle polished a theater somehow", "The marble river forgot the second photograph"),  # another order
        srt("The marble river forgot the second photograph", "No brass gate envied the widow again today.", "just when the fiddle polished a theater"),  # dialogue between
        srt("The marble river forgot the second kettle just when the fiddle polished a cellar somehow"),  # a similar sentence
        srt("too short"), "", None, "   ", "x" * 200_000,
    ) == {}


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert leakage.leaks(docs, items).collect() == []
    some = spark.createDataFrame([(1, ITEMS[0][1], "", "")], SCHEMA)
    assert leakage.leaks(some, items.limit(0)).collect() == []
    per = {r.item_id: r.n_docs for r in leakage.leaked_items(leakage.leaks(some, items).select("doc_id", "item_id"), items).collect()}
    assert per == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0}


def test_prefix_join_keeps_all_damaged_passages():
    """Every window with KEEP undamaged shingles is met by one of its prefix."""
    pairs = [(subtitles.fold(w), subtitles.fold_plain(w)) for w in ITEMS[0][1].split()]
    folded, plain = [a for a, _ in pairs], [b for _, b in pairs]
    own = sorted(leakage.item_shingles(folded, plain))
    prefix = {i for _, i, _ in leakage.prefixes(own, {h: (k * 7) % 11 for k, (h, _, _) in enumerate(own)}, len(folded), 14, leakage.KEEP)}
    n = 14 - leakage.WORDS + 1
    for at in range(len(folded) - 13):
        assert len(set(range(at, at + n)) - prefix) < leakage.KEEP
    assert leakage.prefixes(own, {}, len(folded), 14, 1) == set(own)


def test_a_bounded_filter_and_all_shingles_give_the_same(spark):
    rng = random.Random(6)
    words = [f"word{k}x" for k in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(40))) for k in range(60)]
    docs = [(k, srt(*(" ".join(rng.choice(words) for _ in range(9)) for _ in range(6)), *([items[k % 60][1].split(" ", 5)[5][:150]] if k % 3 else [])), "", "s") for k in range(150)]
    docs, items = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    found = [sorted(tuple(r) for r in leakage.leaks(docs, items, **k).collect()) for k in ({}, {"keep": 1}, {"filter_bytes": 4096})]
    assert len(found[0]) == 100 and found[0] == found[1] == found[2]
    with pytest.raises(ValueError):
        leakage.leaks(docs, items, keep=11)


def test_filter_has_no_misses(spark):
    rng = np.random.default_rng(3)
    own = rng.integers(-(2**63), 2**63 - 1, 5000)
    table = spark.createDataFrame([(int(h),) for h in own] + [(0,), (32768,), (-32768,)], "h long")
    for size in (4096, 40_000, 10_000_000):
        made = leakage.Filter.of(table, size)
        assert made.may_have(np.append(own, [0, 32768, -32768])).all()
        wrong = made.may_have(rng.integers(-(2**63), 2**63 - 1, 5000)).mean()
        assert wrong < (0.2 if size < 10_000_000 else 1e-9)


def test_no_cue_leaves_the_text(spark):
    """A passage within cues that look like credits or sounds is met, and so is one around them."""
    first, second = "The marble river forgot the second photograph just", "when the fiddle polished a theater somehow."
    assert set(leaked(spark, srt("Support us, please.", f"[{first}]", f"[{second}]"), srt(first, "www.some-where.org", "[a door creaks loudly somewhere]", second), srt(f"Support us: {first} {second}"))) == {(0, 1), (1, 1), (2, 1)}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdhilmnrtuvw01é", max_size=12))
def test_fold_is_blind_to_look_alikes(word):
    for a, b in (("m", "rn"), ("d", "cl"), ("h", "li"), ("w", "vv"), ("u", "ii"), ("l", "1"), ("o", "0"), ("c", "e"), ("é", "?"), ("a", "o"), ("t", "f")):
        assert subtitles.fold(word.replace(a, b)) == subtitles.fold(word)


def lengths(counts):
    return [k for k, n in enumerate(counts) for _ in range(n)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=4, max_size=40))
def test_plan_uses_every_item_once(counts):
    counts[0] = 0
    own = np.array(counts)
    plan = packing.plan(own)
    used = np.zeros(len(own), dtype=int)
    for times, pattern in plan:
        assert times > 0 and 0 < sum(pattern) <= len(own) - 1
        for k in pattern:
            used[k] += times
    assert (used == own).all()


def optimum(items, room):
    best = [len(items)]

    def go(at, bins):
        if len(bins) >= best[0]:
            return
        if at == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[at] <= room:
                bins[i] += items[at]
                go(at + 1, bins)
                bins[i] -= items[at]
        bins.append(items[at])
        go(at + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_plan_is_near_the_optimum():
    rng = random.Random(1)
    for _ in range(25):
        room = rng.choice([10, 17, 30])
        items = sorted((rng.randint(1, room) for _ in range(9)), reverse=True)
        n = sum(t for t, _ in packing.plan(np.bincount(items, minlength=room + 1)))
        assert n <= optimum(items, room) + 1


@pytest.mark.parametrize("room,lengths,bins", [(2048, [*range(1, 61), 500], 2), (1200, [*range(1, 101), 200], 5), (2048, [1] * 5000, 3)])
def test_many_lengths_share_a_container(room, lengths, bins):
    assert sum(t for t, _ in packing.plan(np.bincount(lengths, minlength=room + 1))) == bins


def test_index_of_sums_follows_used_up_lengths():
    rng = np.random.default_rng(4)
    left = rng.integers(0, 3, 50)
    left[0] = 0
    sums = packing.Sums(left)
    for k in rng.permutation(np.flatnonzero(left)):
        left[k] = 0
        sums.remove(int(k))
        new = packing.Sums(left)
        assert (sums.one == new.one).all() and (sums.two == new.two).all() and (sums.three == new.three).all()


def test_every_length_salted(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 1)
    df = spark.range(3 * 2048).selectExpr("id", "id % 2048 + 1 AS n")
    got = packing.pack(df, "id", "n", 2048)
    room = {r.container: r.n for r in got.groupBy("container").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got.select("id").distinct().count() == got.count() == 3 * 2048
    assert max(room.values()) == 2048 and len(room) <= 1.01 * 3 * 2048 * 2049 / 2 / 2048


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 40)  # so that lengths are ranked in parts
    rng = random.Random(2)
    sizes = [rng.choice([0, 3, 3, 3, 17, 50, 99, 100, 101, 250, rng.randint(1, 100)]) for _ in range(900)] + [None]
    df = spark.createDataFrame([(i, n, "c", 1) for i, n in enumerate(sizes)], "doc_id long, n int, container string, piece int")
    got = packing.pack(df, "doc_id", "n", 100).collect()
    room, by_doc = defaultdict(int), defaultdict(list)
    for r in got:
        room[r.container] += r.n_tokens
        by_doc[r.doc_id].append((r.piece, r.n_tokens))
    assert max(room.values()) <= 100 and sorted(room) == list(range(len(room)))
    for i, n in enumerate(sizes):
        n = n or 0
        want = [100] * (n // 100) + ([n % 100] if n % 100 or not n else [])
        assert sorted(by_doc[i]) == list(enumerate(want))
    assert sum(room.values()) / (100 * len(room)) > 0.99
    assert packing.pack(df.limit(0), "doc_id", "n", 100).collect() == []


@pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no vocabulary file")
def test_tokens(spark):
    texts = [None, "", "Hello world", "<|endoftext|>", "é" * 50, "a" * 50_000, "  \n\n x  ", "don't I'll we've"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("n", packing.count_tokens(F.col("t")))
    got = {r.i: r.n for r in df.collect()}
    own = packing.encoding(packing.VOCABULARY)
    assert got == {i: len(own.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert got[2] == 2 and own.decode(own.encode_ordinary(texts[6])) == texts[6]


SENTENCES = ["The marble river forgot the photograph.", "A fiddle polished the old theater.", "Her uncle refused the wooden gate."]


def judged(spark, texts, source="s"):
    docs = [(i, t, "c", s if isinstance(s, str) or s is None else source) for i, (t, s) in enumerate(texts)]
    return {r.doc_id: r.why if r.cut else None for r in truncation.judge(spark.createDataFrame(docs, SCHEMA), phrases=PHRASES).collect()}


def test_cut_files(spark):
    whole = srt(*SENTENCES * 6)
    corpus = [(whole.replace("photograph", f"photograph{k}"), "s") for k in range(30)]
    head = srt(*SENTENCES)
    more = head + "\n"
    cut = [
        more + "4\n00:01:0", more + "4\n00:01:00,000 --> 00:01:0", more + "4\n00:01:00,000 --> 00:01:04,100\n", more + "4", more + "4\n00:01:00,000 --> 00:01:04,100\nThe marble riv",
        more + "4\n00:01:00,000 --> 00:01:04,100\nThe marble river forgot the\n", more + "4\n00:01:00,000 --> 00:01:04,100\nThe marble r��", (more + "4\n00:01:00,000 --> 00:01:04,100\nA fid").replace("\n", "\r\n"),
    ]
    fine = [
        head, head.rstrip("\n"), more + "4\n00:01:00,000 --> 00:01:04,100\nThe marble river…", more + "4\n00:01:00,000 --> 00:01:04,100\nThe marble river --", more + "4\n00:01:00,000 --> 00:01:04,100\n[door creaks]",
        more + "4\n00:01:00,000 --> 00:01:04,100\n♪ la la ♪", more + "4\n00:01:00,000 --> 00:01:04,100\nSubtitles by team x", more + "4\n00:01:00,000 --> 00:01:04,100\nTHE END\n", more + "4\n00:01:00,000 --> 00:01:04,100\nwww.x.example",
    ]
    got = judged(spark, corpus + [(t, "s") for t in cut] + [(t, None) for t in fine] + [(None, "s"), ("", "s"), (" \n", "s")])
    n = len(corpus)
    assert [got[i] is not None for i in range(n, n + len(cut))] == [True] * len(cut)
    assert [got[i] for i in range(n + len(cut), n + len(cut) + len(fine))] == [None] * len(fine)
    assert set(got) == set(range(n + len(cut) + len(fine)))


def test_limits_are_learned_per_source(spark):
    rng = random.Random(3)
    whole = lambda k: srt(*(rng.choice(SENTENCES).lower().rstrip(".") for _ in range(12 + k % 9)))
    texts = [(whole(k)[:700], "short") for k in range(40)] + [(whole(k), "long") for k in range(60)]
    # copies of one file are no limit
    texts += [(whole(5), "copies")] * 12
    got = judged(spark, texts)
    assert sum(got[i] is not None for i in range(40)) >= 36
    assert all(got[i] is None for i in range(40, len(texts)))
    docs = spark.createDataFrame([(i, t, "", s) for i, (t, s) in enumerate(texts)], SCHEMA)
    share = {r.source: (r.n_files, r.n_cut) for r in truncation.by_source(truncation.judge(docs)).collect()}
    assert share["long"] == (60, 0) and share["short"][0] == 40 and share["short"][1] >= 36
    assert truncation.judge(docs.limit(0)).collect() == []


def test_strict_prefixes(spark):
    rng = random.Random(9)
    draw = lambda: re.sub(" +", lambda m: rng.choice(" \n\r"), "".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))).strip())
    plain = lambda v: re.sub("[\n\r]", " ", v)
    values = [v for v in (draw() for _ in range(1500)) if v] + ["é", "éa", "a" * 40_000]
    rows = [(v, [3], 1) for v in values] + [("", [], 1), (None, None, 1)]
    got = {r.value: r for r in truncation.strict_prefixes(spark.createDataFrame(rows, "body string, halts array<int>, part int")).collect()}
    longer = {v: [w for w in values if plain(w) != v and plain(w).startswith(v)] for v in map(plain, values)}
    assert set(got) == {v for v, more in longer.items() if more}
    for v, r in got.items():
        n = len(v)
        ways = {(w[n] not in " \n\r", w[n] == " ", w[n] in "\n\r", w[n] == " " and n == 3) for w in longer[v]}
        found = (r.in_word, r.in_cue, r.new_cue, r.halted)
        assert any(found[:3]) and all(any(w[i] for w in ways) for i in range(4) if found[i])
    assert truncation.strict_prefixes(spark.createDataFrame([], "body string, halts array<int>")).collect() == []


def test_strict_prefixes_over_ranges(spark):
    """Values whose first characters are alike stay in one range, whatever they go on with; others meet across ranges."""
    rng = random.Random(4)
    same = "ab " * truncation.RANGE
    draw = lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(1, 7))).strip()
    values = {v for _ in range(400) if (v := rng.choice(["", same, same[: truncation.RANGE], same[: truncation.RANGE - 2], "b" + same]) + draw()).strip()}
    got = {r.value for r in truncation.strict_prefixes(spark.createDataFrame([(v, []) for v in values], "body string, halts array<int>")).collect()}
    assert got == {v for v in values if any(w != v and w.startswith(v) for w in values)}


def test_the_driver_holds_single_steps(spark, monkeypatch):
    """No step plans all joins at once, and no sample of whole dialogues is sent to the driver."""
    plans, write = [], truncation.materialize
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(truncation, "materialize", lambda df: (plans.append(plan(df)), write(df))[1])
    last = plan(truncation.judge(spark.createDataFrame([(1, srt(*SENTENCES), "c", "s")], SCHEMA)))
    assert "Aggregate" not in last and max(len(re.findall(r"\bJoin ", p)) for p in [*plans, last]) <= 8
    ranges = [line for p in plans for line in p.split("\n") if "RepartitionByExpression" in line]
    assert ranges and all("substring(value" in line and f", 1, {truncation.RANGE})" in line for line in ranges)


def test_occurrences(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 18)))
    values, ends = [(word(), rng.randint(1, 3)) for _ in range(600)] + [(None, 1), ("é" * 14, 2)], [word() for _ in range(200)] + [None, "", "é" * 13, "a" * 12]
    got = {r.value: (r.total, r.longer) for r in truncation.occurrences(spark.createDataFrame([(v, 1) for v in ends], "value string, n int"), spark.createDataFrame(values, "value string, n int")).collect()}
    want = {}
    for v in filter(None, ends):
        total, longer = sum(n for w, n in values if w == v), sum(n for w, n in values if w and w != v and w.startswith(v))
        if total or longer:
            want[v] = (total, longer)
    assert got == want


def test_long_cues_are_joined_too(spark):
    """A last cue of more words than any limit meets longer ones, and its author's end elsewhere keeps it whole."""
    long = " ".join(["the marble river forgot the second photograph just when the fiddle polished a theater"] * 2)
    whole = srt("a fiddle polished it", long + " somehow tonight", "her uncle refused")
    other = [srt(f"a fiddle{k} polished it", long + " somehow tonight", "her uncle refused") for k in range(3)]
    got = judged(spark, [(t, None) for t in [srt("her uncle refused it", long + " somehow"), whole, *other]])
    assert got[0] == "prefix of a longer cue" and [got[i] for i in range(1, 5)] == [None] * 4


def test_longer_copies(spark):
    """Files without any closed sentence, so that only the copy tells."""
    lines = [f"the marble river{k} forgot the photograph" for k in range(12)]
    whole = srt(*lines)
    cut = srt(*lines[:5], "the marble river5 forgot")
    other = srt(*(f"a fiddle{k} polished the old theater" for k in range(9)))
    got = judged(spark, [(whole, "a"), (cut.replace("\n", "\r\n"), "b"), (other, "c")] + [(whole, "d")] * 5)
    assert got[1] == "prefix of a longer copy"
    assert [got[i] for i in (0, 2, 3, 7)] == [None] * 4


def test_cut_after_a_speakers_dash(spark):
    """A dash that opens a speaker's turn is no author's mark; one behind a word is."""
    last = srt(*SENTENCES) + "\n4\n00:01:00,000 --> 00:01:04,100\n"
    cut = [last + "- ", last + "-\n", last + "- The marble river.\n- ", last + "- the marble river\n–", last + "- The marble river. - ", last + "<i>—", last + "- The marble river!\r\n- \"", last + "- The river\nâ€“ "]
    fine = [last + "The marble river-", last + "The marble river -", last + "What?-", last + "Well, —", last + "The marble river\n--", last + "- The river.\n- The marble -"]
    got = judged(spark, [(t, None) for t in cut + fine])
    assert [got[i] for i in range(len(cut))] == ["broken cue head"] * len(cut)
    assert [got[i] for i in range(len(cut), len(cut + fine))] == [None] * len(fine)


def test_a_copys_next_words_tell_whether_the_end_was_a_cut(spark):
    lines = [f"- The marble river{k} forgot the photograph.\n- A fiddle{k} polished it." for k in range(4)]
    one, two = "- The marble river9 forgot the photograph.", "- A fiddle9 - polished it."
    more = "The marble river8 was old."
    whole = srt(*lines, one + "\n" + two, more)
    few = srt("- Her uncle refused.\n- The wooden gate.", "No humble ledger blamed the widow or the doctor tonight.")
    cut = [srt(*lines, one), srt(*lines, one + "\n- A fiddle9 -"), srt("- Her uncle refused."), srt("- Her uncle refused.\n- The woo"), srt("- Her uncle")]
    fine = [srt(*lines, one + "\n" + two), srt(*lines, (one + "\n" + two).rstrip(".")), srt(*lines, one + "\n- A…"), srt("- Her uncle refused.\n- The wooden gate."), srt("Her."), srt("Her uncle."), whole, few]
    got = judged(spark, [(t, None) for t in cut + fine])
    assert [got[i] for i in range(len(cut))] == ["prefix of a longer copy"] * len(cut)
    assert [got[i] for i in range(len(cut), len(cut + fine))] == [None] * len(fine)


def test_rare_multiples_of_a_block(spark):
    """Lengths that one or two files have are limits where all multiples of a size pile up, and only there."""
    rng = random.Random(5)
    words = [w for line in SENTENCES for w in line.lower().rstrip(".").split()]
    line = lambda: " ".join(rng.choice(words) for _ in range(6))
    text = lambda n: srt(*(line() for _ in range(n)))
    sizes = [512] * 6 + [1024] * 3 + [1536] * 3 + [2560] * 2 + [3584, 3072]
    # cut behind a whole word, so that nothing else tells
    cut = [text(80)[: n - 6] + " river" for n in sizes]
    fine = [srt(*(line() for _ in range(40)))[:n].rsplit(" ", 1)[0] for n in (700, 900)]
    texts = [(t, "blocks") for t in cut] + [(text(12 + k % 30), "blocks") for k in range(60)] + [(text(70)[: n - 6] + " river", "other") for n in (1536, 2560)] + [(t, "other") for t in fine]
    docs = spark.createDataFrame([(i, t, "c", s) for i, (t, s) in enumerate(texts)], SCHEMA)
    rows = truncation.judge(docs, debug=True).select("doc", "n_chars", "c_blocks").collect()
    assert {tuple(r.c_blocks) for r in rows if r.doc < 76} == {(512,)} and all(r.c_blocks is None for r in rows if r.doc >= 76)
    got = judged(spark, texts)
    # a size that is cut inside a time line is marked by that
    assert all(got[i] is not None for i in range(len(sizes)))
    assert sum(got[i] == "limit" for i in range(9, len(sizes))) >= 5


@pytest.mark.parametrize("mark", ["\ufeff", "ï»¿", "Ã¯Â»Â¿"])
def test_byte_order_mark_before_the_first_times(spark, mark):
    times, text = "00:00:01,000 --> 00:00:02,000\n", ITEMS[0][1]
    assert subtitles.cues(mark + times + "One two.\n\n" + times + "Three.") == subtitles.cues(times + "One two.\n\n" + times + "Three.")
    assert set(leaked(spark, mark + times + text + "\n\n" + times + "After.")) == {(0, 1)}
