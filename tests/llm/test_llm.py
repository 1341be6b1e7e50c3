"""The operators for training data on small tables, against brute force where SQL can't tell."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F


from axiomill.llm import history
from axiomill.llm.groups import match_groups
from axiomill.llm.history import HistoryStore, canonical, repeats, winnow
from axiomill.llm.saying import same_numbers, same_saying, tokens
from axiomill.llm.leaks import Automaton, leak_spans, leaks, places, without_leaks, words_of
from axiomill.llm.mixing import cube_sample, flight, landing, mix, pieces
from axiomill.llm.truncation import cut_documents, cut_rates
from axiomill.workspace import Workspace


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- groups (problem 1)


def brute_groups(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_groups(spark, seed):
    r = random.Random(seed)
    n = (40, 120, 200)[seed]
    pairs = [(f"t{r.randrange(n):03}", f"t{r.randrange(n):03}") for _ in range(n * 2 // 3)]
    pairs += [(f"c{k:03}", f"c{k + 1:03}") for k in r.sample(range(60), 60)]  # a chain
    pairs += [("m", f"leaf{k}") for k in range(300)] + [("self", "self")] + pairs[:5]  # a hub, a group of one, repeats
    spelled = [(f" <{a}> " if r.random() < 0.1 else a, b, "x", "y") for a, b in pairs] + [(None, "a", "x", "y"), ("a", None, "x", "y"), (" ", "b", "x", "y")]
    df = spark.createDataFrame(spelled, "s string, o string, term string, u string")
    assert dict(rows(match_groups(df))) == brute_groups(pairs)


def test_groups_of_nothing(spark):
    df = spark.createDataFrame([], "s string, o string")
    assert rows(match_groups(df)) == []
    assert rows(match_groups(spark.createDataFrame([("a", "a")], "s string, o string"))) == [("a", "a")]


# --- history (problem 7)

ACCEPTED = [
    (1, "urn:a", "hv:note", '"Filter replaced at the cold store, order 17 item 4"@en'),
    (2, "urn:a", "hv:note", '"Filter replaced at the cold store, order 17 item 5"'),
    (3, "urn:a", "hv:note", '"Filter cleaned at the cold store, order 17 item 4"'),
    (4, "urn:b", "hv:note", '"Filter replaced at the cold store, order 17 item 4"'),
    (5, "urn:a", "hv:label", '"Filter replaced at the cold store, order 17 item 4"'),
    (6, "urn:a", "hv:note", '"ok"'),
    (7, "urn:a", "hv:note", '""'),
    (8, "urn:a", "hv:ref", "urn:z"),
    *((20 + k, f"urn:f{k}", "hv:note", f'"{w} replaced and cleaned at the store, order {k}"') for k, w in enumerate(["Filter", "Pump", "Valve", "Coil"] * 5)),
]
ARRIVALS = [
    (101, 1, " <URN:A> ", "hv:note", '"FILTER  replaced at cold store; order 17, item 4"', 1),  # case, signs, an article
    (102, 1, "urn:a", "hv:note", '"Filtre repl. at the cold store, order 17 item 4"', 1),  # slip, shortened
    (103, 1, "urn:a", "hv:note", '"order 17 item 4, Filter replaced at the cold store"^^xsd:string', 1),  # order of words
    (104, 2, "urn:a", "hv:note", '"Filter replaced at the cold store, order 18 item 4"', 2),  # another number: new
    (105, 2, "urn:a", "hv:note", '"Filter cleaned at the cold store, order 18 item 4"', 2),  # another word: new
    (106, 2, "urn:a", "hv:note", '"Filter clened at the cold store, order 18 item 4"', 2),  # repeats one of its own batch
    (107, 3, "urn:a", "hv:note", '"OK!"', 3),
    (108, 3, "urn:a", "hv:note", '"."', 3),  # as empty as the empty one
    (109, 3, "urn:a", "hv:ref", "<urn:z>", 3),
    (110, 3, "urn:a", "hv:note", None, 3),
    (111, None, "urn:a", "hv:note", '"ok"', 3),
    (112, 3, None, "hv:note", '"ok"', 3),
    (113, 3, "urn:a", "hv:note", '"' + "long text " * 20_000 + '"', 3),
    (114, 3, "urn:a", "hv:note", '"' + "Long  text " * 20_000 + '"', 3),
    (115, 3, "urn:a", "hv:note", '"Filter clened at the cold store, order 18 item 4"', 3),
]


@pytest.mark.parametrize("send_rows", [0, 10**9])
def test_repeats(spark, send_rows, monkeypatch):
    monkeypatch.setattr(history, "SEND_ROWS", send_rows)
    acc = spark.createDataFrame(ACCEPTED, "stmt_id bigint, s string, p string, o string")
    arr = spark.createDataFrame(ARRIVALS, "stmt_id bigint, batch_no int, s string, p string, o string, fid int")
    assert sorted(rows(repeats(acc, arr))) == [(1, 101), (1, 102), (1, 103), (6, 107), (7, 108), (8, 109), (105, 106), (105, 115), (113, 114)]
    assert rows(repeats(acc, arr.limit(0))) == []
    alone = sorted(rows(repeats(acc.limit(0), arr)))
    assert alone == [(101, 102), (101, 103), (105, 106), (105, 115), (113, 114)]


def test_repeats_against_all_pairs(spark):
    r = random.Random(11)
    nouns, verbs = ["damper", "filter", "coil", "pump", "valve"], ["cleaned", "replaced", "sealed", "rewired"]
    said = [f"{r.choice(verbs)} {r.choice(nouns)} after noise reported, order {r.randrange(4)} item {r.randrange(3)}" for _ in range(160)]

    def slip(t):
        w = t.split()
        k = r.randrange(len(w))
        if len(w[k]) > 4 and w[k].isalpha():
            j = r.randrange(1, len(w[k]) - 1)
            w[k] = w[k][:j] + w[k][j + 1 :]
        return " ".join(w)

    first = list(dict.fromkeys(said[:80]))
    acc = [(k, "urn:a", "hv:n", f'"{t}"') for k, t in enumerate(first)]
    arr = [(1000 + k, 1 + k // 20, "urn:a", "hv:n", f'"{slip(t) if r.random() < 0.5 else t}"') for k, t in enumerate(said[80:])]
    known = {w for t in first for w in tokens(t) if not w.isdigit()}
    seen, expected = [], set()
    for i, *_, o in [(i, s, p, o) for i, s, p, o in acc] + [(i, s, p, o) for i, _, s, p, o in arr]:
        words = " ".join(sorted(tokens(o.strip('"'))))
        hit = min((f for f, w in seen if w == words or same_saying(w, words, known)), default=i)
        if hit < i and i >= 1000:
            expected.add((hit, i))
        seen.append((hit, words))
    got = set(rows(repeats(spark.createDataFrame(acc, "stmt_id bigint, s string, p string, o string"), spark.createDataFrame(arr, "stmt_id bigint, batch_no int, s string, p string, o string"))))
    assert got == expected and len(expected) > 20


def test_numbers_in_groups_of_digits(spark):
    """A separator of thousands makes no other number; a blank that may also part two numbers is read both ways."""
    acc = [(1, "Order 9251 item 31: dust removed"), (2, "Filter at 4, 120 Pa"), (3, "Filter at 5120 Pa"), (4, "8758"), (5, "1234567 l, 36 m"), (6, "Run of 2533.5 Pa")]
    said = ["Order 9 251 item 31: dust removed", "order 9\u2019251 item 31 dust remvoed", "Order 9\u202f251 item 31: dust removed", "Filter at 4 120 Pa", "Filter at 5'120 Pa", "Filter at 4'120 Pa"]
    said += ["8 758", "36 m, 1 234 567 l", "Run of 2,533.5 Pa", "Run of 2 533.5 Pa", "Order 9 252 item 31: dust removed", "Filter at 5 121 Pa", "Order 9 25 item 31: dust removed"]
    a = spark.createDataFrame([(k, "urn:a", "hv:n", f'"{t}"') for k, t in acc], "stmt_id bigint, s string, p string, o string")
    b = spark.createDataFrame([(100 + k, 1, "urn:a", "hv:n", f'"{t}"') for k, t in enumerate(said)], "stmt_id bigint, batch_no int, s string, p string, o string")
    # 105 says what 103 may say, but not what 2 says
    assert sorted(rows(repeats(a, b))) == [(1, 100), (1, 101), (1, 102), (2, 103), (3, 104), (4, 106), (5, 107), (6, 108), (6, 109), (103, 105)]


def test_a_store_is_opened_where_it_was_left(spark, monkeypatch):
    """Batch after batch by stores of their own, over small buckets that merge, gives what one store gives."""
    monkeypatch.setattr(history, "BUCKET_PRINTS", 64)
    monkeypatch.setattr(history, "BUCKET_FORMS", 4)
    acc = spark.createDataFrame(ACCEPTED, "stmt_id bigint, s string, p string, o string")
    arr = spark.createDataFrame([(*r[:5], k // 2) for k, r in enumerate(ARRIVALS)], "stmt_id bigint, batch_no int, s string, p string, o string, n int")
    root = Workspace(spark).path("store")
    HistoryStore(spark, root).accept(canonical(acc, "stmt_id", "s", "p", "o", F.lit(0)))
    arr = arr.where("batch_no is not null")
    found = []
    for n in range(9):
        other = HistoryStore(spark.newSession(), root)  # knows nothing but the folder
        batch = canonical(arr.where(F.col("n") == n), "stmt_id", "s", "p", "o", F.lit(n))
        found += rows(other.check(batch, f"b{n}"))
        assert rows(HistoryStore(spark, root).check(batch, f"b{n}")) == rows(other.check(batch, f"b{n}"))  # once only
    assert sorted(found) == [(1, 101), (1, 102), (1, 103), (6, 107), (7, 108), (8, 109), (105, 106), (105, 115), (113, 114)]
    last = HistoryStore(spark, root).state
    assert 1 < len(last.segments) < 6 and len(last.done) == 9


def test_texts_of_known_words_are_found_by_all_their_words(spark):
    """Compounds, articles and readings of numbers, where every word is known."""
    said = ["the fan belt is worn", "a fan belt is torn", "an airflow is low", "the air flow is low now", "belt 4 120 is worn", "air flow fan belt"] * 3
    acc = [(k, f"urn:{k}", "hv:n", f'"{t} {k // 6}"') for k, t in enumerate(said)]
    arr = [(100, 0, "fan belt is worn 0"), (101, 1, "a fan belt is worn 0"), (102, 2, "an air flow is low 0"), (103, 3, "airflow is low now 0"), (104, 4, "the belt 4120 worn is 0"), (105, 1, "the fan belt is torn 0")]
    a = spark.createDataFrame(acc, "stmt_id bigint, s string, p string, o string")
    b = spark.createDataFrame([(i, 1, f"urn:{k}", "hv:n", f'"{t}"') for i, k, t in arr], "stmt_id bigint, batch_no int, s string, p string, o string")
    assert sorted(rows(repeats(a, b))) == [(0, 100), (2, 102), (3, 103), (4, 104)]


def test_readings_of_numbers():
    same = lambda a, b: same_numbers(tokens(a), tokens(b))
    assert same("4 120", "4120") and same("4 120", "4, 120") and not same("4120", "4, 120") and not same("4 120", "4 121")
    assert same("4 120; 4120", "4 120; 4, 120") and not same("4 120; 4120", "4, 120; 4, 120")
    assert same("1 234 567", "1; 234567") and same("1 234 567", "1234; 567") and not same("1 234 567", "234567; 1234")


def test_a_long_chain_of_near_repeats(spark):
    """Each says the same as the next alone; all of one batch repeat the first."""
    n = 200
    arr = [(k, 1, "urn:a", "hv:n", f'"{"b" * 2 * k + "a" * 2 * (n - k)}"') for k in range(1, n)]
    arr = spark.createDataFrame(arr, "stmt_id bigint, batch_no int, s string, p string, o string")
    assert sorted(rows(repeats(arr.limit(0).drop("batch_no"), arr))) == [(1, k) for k in range(2, n)]


def test_winnowing_shares_what_texts_share():
    r = random.Random(2)
    texts = ["".join(r.choice(string.ascii_lowercase) for _ in range(60)) for _ in range(20)]
    both = [a[:20] + "COMMONRUN" + a[20:] for a in texts]
    row, fp = winnow(both, np.zeros(len(both), np.uint64))
    prints = [set(fp[row == k].tolist()) for k in range(len(both))]
    assert all(prints[a] & prints[b] for a in range(20) for b in range(a))
    alone = winnow(both[3:4], np.zeros(1, np.uint64))[1]
    assert set(alone.tolist()) == prints[3]  # no text depends on its neighbours
    assert len(winnow(["", "a"], np.zeros(2, np.uint64))[0]) == 2


# --- leaks (problem 8)


def test_automaton_against_search():
    r = random.Random(4)
    items = [(k, [r.choice("abcd") for _ in range(r.randrange(0, 30))]) for k in range(6)]
    auto = Automaton(items)
    for _ in range(100):
        doc = [r.choice("abcde") for _ in range(40)]
        nums = np.array([auto.number.get(w, 0) for w in doc], np.int64)
        for state, end, length in auto.seeds(nums):
            piece = doc[end - length : end]
            places_ = {(k, p) for k, s in items for p in range(length - 1, len(s)) if s[p - length + 1 : p + 1] == piece}
            assert set(auto.ends[state]) == places_ and places_
        # no longest match of three words is missed
        best = max((n for a in range(40) for n in range(3, 41 - a) if any("".join(doc[a : a + n]) in "".join(s) for _, s in items)), default=0)
        assert max((n for *_, n in auto.seeds(nums)), default=0) == best


PASSAGE = "once a technician loosens the outer seal the plenum tube settles against the slotted shaft and a reading near 177 kPa appears"


def test_leaks(spark):
    w = PASSAGE.split()
    docs = [
        (1, "Intro. " + PASSAGE.upper() + ". More text.", "x"),
        (2, "before " + " ".join(w[3:15]) + " after", "x"),  # twelve words
        (3, "before " + " ".join(w[3:14]) + " after", "x"),  # eleven
        (4, "Once a techni-\ncian loosens the outer (12) seal, the plenum tube\nsettles against [0003] the slotted shaft", "x"),
        (5, "once a technician lossens the outer seal thus the plenum tube settles against slotted shaft and a reading", "x"),  # slips
        (6, "once a technician loosens the red gate the plenum tube settles against its new frame and a reading near 5", "x"),  # pieces
        (7, None, "x"), (None, PASSAGE, "x"), (8, "", "x"), (9, "word " * 100_000 + PASSAGE, "x"), (1, "Intro. " + PASSAGE, "x"),
    ]
    items = [(10, PASSAGE + " which reading is reported"), (11, "nothing of this " + PASSAGE), (12, None), (None, PASSAGE), (13, ""), (14, "short item here")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(rows(leaks(d, i))) == sorted((k, n) for k in (1, 2, 4, 5, 9) for n in (10, 11))
    assert rows(leaks(d.limit(0), i)) == [] == rows(leaks(d, i.limit(0)))
    clean = {r[0]: r[1:] for r in rows(without_leaks(d, i, max_share=1.0))}
    assert clean[2] == ("before  after", 1) and clean[3][1] == 0 and clean[8] == ("", 0)
    assert 1 not in {r[0] for r in rows(without_leaks(d.where("doc_id = 1"), i, max_share=0.1))}
    assert {(r[1], r[4]) for r in rows(leak_spans(spark.createDataFrame([(1, "a short item here too")], "doc_id bigint, text string"), i))} == {(14, 3)}


def test_nothing_that_leaks_is_left(spark):
    """Two passages of an item, one passage twice, and halves that a cut brings together."""
    w = (PASSAGE + " which is then written down by hand before the shift ends and the next crew takes over the plant for the night").split()
    two = "one " + " ".join(w[:15]) + " between " + " ".join(w[24:40]) + " end"
    twice = "one " + PASSAGE + " and again " + PASSAGE + " end"
    halves = "start " + " ".join(w[:8]) + " " + " ".join(w[20:36]) + " " + " ".join(w[8:16]) + " stop"
    docs = spark.createDataFrame([(1, two), (2, twice), (3, halves), (3, halves)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(w))], "item_id bigint, text string")
    clean = without_leaks(docs, items, max_share=1.0)
    got = sorted(rows(clean))
    assert got[0] == (1, "one  between  end", 2) and got[1] == (2, "one  and again  end", 2) and got[2] == got[3]
    assert got[2][1].split() == ["start", "stop"]
    assert rows(leaks(clean, items)) == []


def test_leaks_of_items_that_share_a_passage(spark):
    """A document that goes on with one item's words, after the passage or before it, leaks the other too."""
    items = [(20, "as stated above " + PASSAGE + " which reading is reported"), (21, PASSAGE + " so what is its cause"), (22, "by contrast " + PASSAGE)]
    docs = [(1, PASSAGE + " which reading is reported then"), (2, "it is as stated above " + PASSAGE + " which reading"), (3, "by contrast " + PASSAGE + " so what is its")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(rows(leaks(d, i))) == [(k, n) for k in (1, 2, 3) for n in (20, 21, 22)]


def test_seeds_reach_every_place():
    """Each place's own longest match is among the seeds, as search finds them."""
    r = random.Random(5)
    items = [(k, [r.choice("abc") for _ in range(r.randrange(0, 20))]) for k in range(5)]
    auto = Automaton(items)
    for _ in range(60):
        doc = [r.choice("abcd") for _ in range(30)]
        seeds = {(k, p, e, n) for v, e, n in auto.seeds(np.array([auto.number.get(w, 0) for w in doc], np.int64)) for k, p in auto.ends[v]}
        for k, s in items:
            for e in range(1, 31):
                for p in range(len(s)):
                    n = 0
                    while n < min(e, p + 1) and doc[e - 1 - n] == s[p - n]:
                        n += 1
                    if n >= 3 and (e == 30 or p + 1 == len(s) or doc[e] != s[p + 1]):
                        assert (k, p, e, n) in seeds


def test_places_follow_words():
    for t in ("Foo-bar (12) bäz, qu-\n ux ﬁlter  1.5 [3a] end_", "", "(1)", "a­b -\nc", "Ⅰ x² ß"):
        assert len(places(t)) == len(words_of(t))
    t = "Say: the (7) Fil-\nter!"
    assert [t[a:b] for a, b in places(t)] == ["Say", "the", "Fil-\nter"]


# --- mixing (problem 9)


def test_flight_keeps_totals():
    r = np.random.default_rng(0)
    x = r.integers(1, 900, 3000)
    pi = np.full(3000, 0.37)
    out = flight(pi, x, r)
    open_ = (out > 1e-9) & (out < 1 - 1e-9)
    assert open_.sum() <= 2
    assert abs(out.sum() - pi.sum()) < 1e-4 and abs((out * x).sum() - (pi * x).sum()) < 1e-2
    done = landing(out.copy(), r)
    assert set(done.tolist()) <= {0.0, 1.0} and abs(done.sum() - pi.sum()) <= 1.0


def test_flight_keeps_probabilities():
    r = np.random.default_rng(1)
    pi, x = np.array([0.2, 0.5, 0.7, 0.4, 0.2]), np.array([5, 5, 9, 1, 40])
    mean = np.mean([landing(flight(pi, x, r), r) for _ in range(8000)], axis=0)
    assert np.abs(mean - pi).max() < 0.03


def test_blocks_of_a_large_source(spark):
    n = 9000  # more than a block: several levels
    units = spark.range(n).select(F.lit("a").alias("source"), F.col("id").alias("doc_id"), (F.col("id") % 97 + 1).alias("n_tokens"), F.lit(0.25).alias("pi"))
    out = cube_sample(units, Workspace(spark))
    got = rows(out.groupBy(F.round("pi").alias("x")).agg(F.count("*"), F.sum("n_tokens")))
    assert {x for x, *_ in got} == {0.0, 1.0} and sum(k for _, k, _ in got) == n
    taken = next((k, t) for x, k, t in got if x == 1.0)
    total = sum(k % 97 + 1 for k in range(n))
    assert abs(taken[0] - n / 4) <= 1 and abs(taken[1] - total / 4) <= 97


def test_mix(spark):
    docs = [(k, "big", "many words stand in this text " * (1 + k % 3), 1) for k in range(60)] + [(100 + k, "small", "few words", 1) for k in range(5)]
    docs += [(200, None, "no source", 1), (201, "other", "no target", 1), (202, "big", None, 1), (203, "big", "", 1), (None, "big", "x", 1), (100, "small", "few words", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string, n_tokens int")
    t = spark.createDataFrame([("big", 0.8, 1), ("small", 0.15, 3), ("none", 0.05, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    taken, shares = mix(d, t)
    taken = rows(taken)
    assert {r[1] for r in taken} == {"big", "small"} and len({r[0] for r in taken}) == len(taken)
    assert {r[3] for r in taken if r[1] == "small"} == {3} and {r[3] for r in taken if r[1] == "big"} == {1}
    by = {r["source"]: r for r in shares.collect()}
    assert by["none"]["actual_share"] == 0 and by["none"]["short"]
    assert abs(by["small"]["actual_share"] / by["big"]["actual_share"] - 0.15 / 0.8) < 0.02
    # a fixed total, more than the small source can give
    by = {r["source"]: r for r in mix(d, t, total_tokens=600)[1].collect()}
    assert by["small"]["short"] and not by["big"]["short"]
    assert rows(mix(d.limit(0), t)[0]) == [] == rows(mix(d, t.limit(0))[0])


def test_pieces_of_long_texts():
    text = "some words to cut " * 30_000
    assert "".join(pieces(text)) == text and max(map(len, pieces(text))) <= 100_000
    assert "".join(pieces("x" * 250_000)) == "x" * 250_000


# --- truncation (problem 10)


def test_cut_documents(spark):
    r = random.Random(8)
    nouns = ["valve", "coil", "pump", "fan", "duct", "filter", "belt", "motor"]

    def body():
        return " ".join(f"In this design the {r.choice(nouns)} is coupled to the {r.choice(nouns)} so that wear is reduced by {r.randrange(99)} percent." for _ in range(r.randrange(6, 14)))

    def text():
        return body() + f" The invention ends with claim {r.randrange(9)} of the {r.choice(nouns)}."

    docs = [(k, "feed", None, text()) for k in range(400)]
    cut = [(1000 + k, "feed", None, t[: t.rindex("is coupled") + 10]) for k, t in ((k, text()) for k in range(6))]
    no_stop = [(2000 + k, "feed", None, text()[:-1]) for k in range(20)]
    at_limit = [(3000 + k, "cards", k, (text() * 3)[:600]) for k in range(40)]
    bad = [(None, "feed", 1, "x"), (5000, "feed", 1, None), (5001, None, None, ""), (5002, "feed", None, "word"), (5003, "feed", None, "ends in a &am"), (1000, "feed", None, cut[0][3])]
    df = spark.createDataFrame(docs + cut + no_stop + at_limit + bad, "doc_id bigint, source string, family_id bigint, text string")
    df = df.withColumn("tri", F.lit(1)).withColumn("src", F.lit(2))
    got = {x[0] for x in rows(cut_documents(df))}
    assert {1000 + k for k in range(6)} <= got and {3000 + k for k in range(40)} <= got and 5003 in got
    assert not got & {k for k in range(400)} and not got & {2000 + k for k in range(20)} and not got & {5000, 5001, 5002}
    assert len(rows(cut_documents(df))) == len(got)
    assert rows(cut_documents(df.limit(0))) == []
    rates = {x[0]: x[1:] for x in rows(cut_rates(df))}
    assert rates["cards"] == (40, 40, 1.0) and rates[None][0] == 1


def test_cuts_after_usual_words(spark):
    """A cut just after a whole sentence, or where one other family of the source has the same words before its end, stays a cut."""
    r = random.Random(3)
    nouns = ["valve", "coil", "pump", "fan", "duct", "filter", "belt", "motor"]

    def body():
        return " ".join(f"In this design the {r.choice(nouns)} is coupled to the {r.choice(nouns)} so that wear is kept low by design." for _ in range(8))

    whole = [(k, "feed", k, f"{body()} The invention ends with the drive belt.") for k in range(200)]
    begun = [(1000, "feed", 1000, f"{body()} The invention ends with the drive belt.\n[0023] Th"), (1001, "feed", 1001, f"{body()} The invention ends with the drive belt. In this design the")]
    no_stop = [(2000 + k, "feed", 2000 + k, f"{body()} The invention ends with the drive belt") for k in range(5)]
    df = spark.createDataFrame(whole + begun + no_stop, "doc_id bigint, source string, family_id bigint, text string")
    assert {x[0] for x in rows(cut_documents(df))} == {1000, 1001}
