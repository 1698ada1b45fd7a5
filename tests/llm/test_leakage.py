import random
from itertools import combinations

import numpy as np

from loregraph.llm.leakage import EDIT, MATCH, alignment_score, extend, find_leaks, least_score, least_seeds, runs, words_of

VOCAB = [f"w{i}" for i in range(400)]


def brute(passage, doc, share=0.1, least=15):
    """Whether some stretch of at least ``least`` passage words lies in the document with at most one word in ten altered (by full dynamic programming)."""
    p, w = words_of(passage), words_of(doc)
    for a in range(len(p)):
        # edit distance of p[a:b] to any stretch of w
        row = [0] * (len(w) + 1)
        for b in range(a + 1, len(p) + 1):
            new = [row[0] + 1]
            for j in range(1, len(w) + 1):
                new.append(min(row[j - 1] + (p[b - 1] != w[j - 1]), row[j] + 1, new[j - 1] + 1))
            row = new
            if b - a >= least and p[a] in w and p[b - 1] in w and min(row) <= share * (b - a):
                return True
    return False


def test_normal_form():
    assert words_of("A​b­c, <b>D</b>&nbsp;**e**\xa0_f_") == ["abc", "d", "e", "f"]
    assert words_of(None) == words_of("") == []


def test_alignment_scores():
    """The banded score is that of the whole table where the band is wide, and no copy scores below the gate."""

    def whole(p, t):
        row, best = [0] * (len(t) + 1), 0
        for x in p:
            new = [0]
            for j, y in enumerate(t):
                new.append(max(0, row[j] + (MATCH if x == y else EDIT), row[j + 1] + EDIT, new[j] + EDIT))
            row, best = new, max(best, *new)
        return best

    rng = random.Random(5)
    for _ in range(200):
        p, t = rng.choices(range(6), k=rng.randrange(1, 14)), rng.choices(range(6), k=rng.randrange(0, 14))
        assert alignment_score(p, np.array(t, int), 0, 30) == whole(p, t)
    assert least_score() == 13 and least_score(20, 0.1) == 16 and least_seeds() == 6
    assert alignment_score(list(range(20)), np.array([*range(7), 99, *range(8, 13), 98, *range(14, 20)]), 0, 2) == 16


def test_runs_in_steps():
    rng = np.random.default_rng(3)
    doc, item = rng.integers(0, 4, 300), rng.integers(0, 4, 25)
    sure = []
    for d in range(300):
        for i in range(25):
            if doc[d] == item[i] and not (d and i and doc[d - 1] == item[i - 1]):
                n = 0
                while d + n < 300 and i + n < 25 and doc[d + n] == item[i + n]:
                    n += 1
                sure.append((d, i, n))
    for step in (1, 7, 50, 1000):
        assert sorted(runs(doc, item, step)) == sorted(sure), step


def test_against_brute_force(spark):
    rng = random.Random(11)
    items = [(i, " ".join(rng.choices(VOCAB, k=rng.choice([10, 16, 40])))) for i in range(12)]
    docs = []
    for k in range(120):
        words = rng.choices(VOCAB, k=rng.randrange(5, 60))
        if k % 2:
            p = rng.choice(items)[1].split()
            n = min(len(p), rng.choice([8, 13, 15, 20, 40]))
            a = rng.randrange(len(p) - n + 1)
            part = p[a : a + n]
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(part))
                part[at : at + 1] = rng.choice([[], ["new"], [part[at], "extra"]])
            words[3:3] = [w.upper() + rng.choice(["", ",", "**"]) for w in part]
        docs.append((k, rng.choice([" ", "  ", "\n"]).join(words)))
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")).collect()}
    sure = {(d, i) for d, t in docs for i, p in items if brute(p, t)}
    assert got == sure and len(got) >= 8


def test_degenerate(spark):
    passage = " ".join(VOCAB[:30])
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, passage, 1), (3, passage, 1), (4, "x " * 100_000 + passage + " y" * 100_000, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, passage, "q"), (8, passage, "q"), (9, None, "q"), (10, "", "q"), (11, " ".join(VOCAB[:14]), "q")], "item_id long, passage string, words string")
    got = sorted((r.doc_id, r.item_id, r.copied_words, r.altered_words) for r in find_leaks(docs, items).collect())
    assert got == [(d, i, 30, 0) for d in (3, 4) for i in (7, 8)]
    assert find_leaks(docs.limit(0), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0


def test_every_shape_of_a_short_copy(spark):
    """All places of the altered words in copies of 15 to 20 words, substituted, left out and put in."""
    passage = VOCAB[:60]
    docs = {}
    for n in range(15, 21):
        for places in combinations(range(1, n - 1), n // 10):
            for change in (lambda w: ["new"], lambda w: [], lambda w: [w, "extra"]):
                part = [x for k, w in enumerate(passage[20 : 20 + n]) for x in (change(w) if k in places else [w])]
                docs[len(docs)] = " ".join([*VOCAB[100:110], *part, *VOCAB[110:120]])
    got = {r.doc_id: r for r in find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(1, " ".join(passage))], "item_id long, passage string")).collect()}
    assert set(got) == set(docs)
    assert all(r.copied_words >= 15 and r.altered_words <= r.copied_words / 10 and 11 <= r.first_word <= 17 for r in got.values())


def test_two_stretches_in_one_window(spark):
    """A run of 14 words does not hide the altered copy of 15 words beside it; 14 words alone are no case."""
    passage = VOCAB[:60]
    run, copy = passage[:14], [*passage[40:47], "new", *passage[48:55]]
    docs = [(1, " ".join([*run, "x", "y", *copy])), (2, " ".join(run)), (3, " ".join([*run, *VOCAB[100:103], *run]))]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(passage))], "item_id long, passage string")).collect()
    assert [(r.doc_id, r.copied_words, r.altered_words, r.first_word) for r in got] == [(1, 15, 1, 17)]


def test_extension():
    p = VOCAB[:30]
    assert extend(p, ["x", *p[:2], "new", *p[3:], "y"], 3, 4, 27) == (30, 1, 1)
    assert extend(p, p, 0, 0, 30) == (30, 0, 0)
    assert extend(p, [*p[:10], "new", *p[11:19]], 0, 0, 10) == (19, 1, 0)
    assert extend(p, [*p[:10], "new", *p[11:18]], 0, 0, 10) == (18, 1, 0)
    assert extend(p, [*p[:7], "new"], 0, 0, 7) == (7, 0, 0)


def test_two_altered_of_twenty_amid_boilerplate(spark):
    """The 7th and 14th of 20 words altered leave runs of six; phrases that all documents and items share are found by their rarer neighbours."""
    boiler = [f"common{i}" for i in range(12)]
    items = [(i, " ".join([*boiler, *(f"i{i}w{k}" for k in range(20)), *boiler])) for i in range(30)]
    docs = [(i, " ".join(boiler * 3)) for i in range(200)]
    part = items[4][1].split()[12:32]
    part[6], part[13] = "new", "other"
    docs += [(500, " ".join(["x", *part, "y"])), (501, " ".join(items[7][1].split()[4:27]))]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")).collect()
    assert sorted((r.doc_id, r.item_id, r.copied_words, r.altered_words) for r in got) == [(500, 4, 20, 2), (501, 7, 23, 0)]


def test_hot_seeds_are_spread(spark, monkeypatch):
    """A passage that most documents hold: the same rows whether or not its seeds are spread over parts."""
    from loregraph.llm import leakage

    items = spark.createDataFrame([(1, " ".join(VOCAB[:40])), (2, " ".join(VOCAB[20:60]))], "item_id long, passage string")
    docs = spark.createDataFrame([(i, " ".join([f"d{i}", *VOCAB[:40], f"e{i}"])) for i in range(60)] + [(100, " ".join(VOCAB[30:60]))], "doc_id long, text string")
    rows = sorted(map(tuple, find_leaks(docs, items).collect()))
    monkeypatch.setattr(leakage, "HOT_SEED", 7)
    assert sorted(map(tuple, find_leaks(docs, items).collect())) == rows
    assert {(r[0], r[1]) for r in rows} == {(i, j) for i in range(60) for j in (1, 2)} | {(100, 2)}
