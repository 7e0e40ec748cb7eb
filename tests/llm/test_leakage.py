from __future__ import annotations

import random

import numpy as np
import regex

from graphloom.llm import leakage

DOCS, ITEMS = "doc_id bigint, text string, item_id string", "item_id bigint, suite string, text string, answer string"


def words(text):
    return [w.casefold() for w in regex.findall(r"[\p{L}\p{Nd}]+", text)]


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(*x, "clash") for x in docs], DOCS)
    i = spark.createDataFrame([(n, "s", t, None) for n, t in items], ITEMS)
    return leakage.leaks(d, i, **more).collect()


def brute(docs, items, n):
    out = set()
    for d, text in docs:
        own = words(text or "")
        grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
        for i, other in items:
            w = words(other or "")
            if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_index_against_brute_force():
    rng = np.random.default_rng(3)
    s = np.concatenate([[0], rng.integers(0, 4, 400), [0, 1, 2, 1, 2, 1, 2, 0]])
    index = leakage.FMIndex(s, 4)
    sa = leakage.suffix_array(s)
    phrases = rng.integers(1, 4, (40, 3))
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi):
        want = [k for k in range(len(s) - 2) if (s[k : k + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
        assert sorted(sa[a:b].tolist()) == want


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["edge", "Graph", "NODE", "straße", "ÉTÉ", "x1", "of", "the"]
    sep = [" ", ", ", "\n", " -- ", "_", "."]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice(sep) for _ in range(n))
    items = [(i, make(rng.randrange(2, 20))) for i in range(30)] + [(30, None), (31, ""), (1, "edge of the edge of the edge of")]
    docs = [(d, make(rng.randrange(0, 60))) for d in range(200)] + [(500, None), (501, " "), (None, make(40))]
    docs += [(600 + k, f"some lead {t} and a tail") for k, t in items[:20]] + docs[:20]
    for n in (3, 5):
        got = found(spark, docs, items, words=n)
        assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items, n)


def test_other_dress_and_spans(spark):
    passage = "One two three four five six seven eight nine ten eleven twelve thirteen"
    dressed = "intro! " + passage.upper().replace(" ", " -\n ") + " outro"
    short = " ".join(passage.split()[:11])
    got = found(spark, [(1, dressed), (2, short), (3, passage.replace("seven", "SEVEN_"))], [(9, passage)])
    assert sorted((r.doc_id, r.item_id, r.start_word, r.end_word) for r in got) == [(1, 9, 1, 14), (3, 9, 0, 13)]
    (one,) = [r for r in got if r.doc_id == 1]
    assert dressed[one.start_char : one.end_char].startswith("ONE") and dressed[one.start_char : one.end_char].endswith("THIRTEEN")
    spans = leakage.removal_spans(spark.createDataFrame(got)).collect()
    assert {(r.doc_id, r.start_char) for r in spans} == {(1, 7), (3, 0)}


def test_shards_and_blocks(spark, monkeypatch):
    passage = [f"w{k}" for k in range(40)]
    long = " ".join(["w1 w2 w3"] * 3000 + passage + ["w5"] * 5000)
    shard = leakage._Shard(leakage.Phrases([(1, " ".join(passage))], 12))
    monkeypatch.setattr(leakage, "SHARD", 500)
    rows = [r for part in shard.add(7, long) for r in part] + shard.hits()
    covered = set()
    for r in rows:
        covered |= set(range(r[2], r[3]))
    assert covered == set(range(9000, 9040))
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 50)
    items = [(i, " ".join(f"b{i}x{k}" for k in range(14))) for i in range(6)]
    got = found(spark, [(i, t) for i, t in items], items)
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(6)]


def test_empty(spark):
    assert found(spark, [], [(1, "a b")]) == [] and found(spark, [(1, "a b")], []) == []
