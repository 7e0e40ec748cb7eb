from __future__ import annotations

import random

import numpy as np
import pytest

from graphloom.llm import text_quality as tq
from graphloom.llm.quality_holdout import HOLDOUT
from tests.llm.held_out_texts import HELD_OUT

PROSE = [
    "The old mill was rebuilt by two brothers who had never seen a water wheel before. They read about it in a book, and it worked.",
    "Nobody knew why the light on the hill was burning again, but everyone had a story about it. Most of the stories were wrong.",
    "Der Müller hat das alte Rad gekauft, weil es noch aus Eiche war. Im Sommer läuft es kaum, aber im Winter hört man es im ganzen Tal.",
    "La meunière a vendu la roue parce que personne ne voulait la réparer. Elle dit que le bois était encore bon, mais que le fer ne valait rien.",
    "El molinero vendió la rueda porque nadie quería repararla. Dice que la madera era buena, pero que el hierro no servía para nada.",
]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(7)
    texts = [" ".join(rng.sample(PROSE, 2)) for _ in range(60)] + PROSE
    return tq.train(texts)


def at(values, name):
    return values[tq.STATS.index(name)]


def test_statistics():
    s = tq.statistics("The cat sat.\nOn 2 mats!\n- a thing")
    assert (at(s, "words"), at(s, "lines")) == (7, 3)
    assert at(s, "punctuated_lines") == pytest.approx(2 / 3)
    assert at(s, "marked_lines") == pytest.approx(1 / 3)
    assert at(s, "mean_word_length") == 3
    assert at(s, "common_words") == pytest.approx(3 / 7)
    table = tq.statistics("a,b,c\n1,2,3\n4,5,6")
    assert at(table, "row_lines") == 1 and at(table, "prose_chars") == 0
    wrapped = tq.statistics("It was late and the\nrain had not stopped\nsince the morning, so\nwe stayed in.")
    assert at(wrapped, "prose_chars") == 1


@pytest.mark.parametrize("text", ["", " ", "\n\n", "…", "x", "́", "😀😀", "\x00", "a" * 400_000, "a,b\n" * 50_000])
def test_odd_texts_have_finite_statistics(text):
    s = tq.statistics(text)
    assert len(s) == len(tq.STATS) and np.isfinite(s).all()


def test_held_out_accuracy(model):
    """On texts that were neither trained nor calibrated on."""
    assert not {t for _, t in HELD_OUT} & {t for _, t in HOLDOUT}
    stats = [tq.statistics(t) for _, t in HELD_OUT]
    p = model.probabilities(np.array(stats))
    right = [tq.KINDS[i] == k for i, (k, _) in zip(p.argmax(1), HELD_OUT)]
    assert sum(right) / len(right) >= 0.9
    unsure = [r for r, s in zip(right, stats) if tq.weak_label(s) is None]
    assert len(unsure) >= len(right) / 10 and sum(unsure) / len(unsure) >= 0.8
    assert np.allclose(p.sum(1), 1)
    print(f"held out: {sum(right)} of {len(right)} right, {sum(unsure)} of {len(unsure)} where the rules are unsure")


def test_sure_rules_are_right():
    for kind, text in HELD_OUT + HOLDOUT:
        assert tq.weak_label(tq.statistics(text)) in (None, kind), text


def test_a_corpus_without_prose():
    rng = random.Random(5)
    lists = [t for k, t in tq._made([], rng) if k == "list"][:50]
    model = tq.train(lists)
    assert tq.KINDS[model.probabilities(np.array([tq.statistics(PROSE[0])])).argmax()] == "prose"


def test_made_examples_are_told_apart(model):
    rng = random.Random(99)
    made = list(tq._made([t.replace("mill", "bridge") for t in PROSE], rng))
    p = model.probabilities(np.array([tq.statistics(t) for _, t in made]))
    assert sum(tq.KINDS[i] == k for i, (k, _) in zip(p.argmax(1), made)) / len(made) >= 0.95


def test_few_items_in_prose_are_no_case(model):
    text = PROSE[0] + "\n\n- old wheel\n- new axle\n- iron pins\n\n" + PROSE[1]
    assert tq.KINDS[model.probabilities(np.array([tq.statistics(text)])).argmax()] == "prose"


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(8)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = tq.BoostedTrees.fit(x[:1500], y[:1500], 2, rounds=30)
    assert (model.probabilities(x[1500:]).argmax(1) == y[1500:]).mean() > 0.95


def test_over_a_corpus(spark, model):
    docs = [(1, PROSE[0]), (2, "- oak\n- ash\n- old elm\n- birch\n- grey alder"), (3, None), (4, "  "), (5, "a,b\n1,2\n3,4\n5,6"), (6, "=====\n-----\n====="), (None, PROSE[1]), (1, PROSE[0])]
    df = spark.createDataFrame([(d, t, "clash", 1.0) for d, t in docs], "doc_id bigint, text string, kind string, words double")
    got = sorted(((r.doc_id, r.kind) for r in tq.document_kinds(df, model).collect()), key=str)
    assert got == sorted([(1, "prose"), (2, "list"), (3, None), (4, None), (5, "table"), (6, "junk"), (None, "prose"), (1, "prose")], key=str)
    stats = {r.doc_id: r for r in tq.document_statistics(df).collect()}
    assert stats[3].words is None and stats[4].words == 0
    empty = df.limit(0)
    assert tq.document_statistics(empty).count() == 0 and tq.document_kinds(empty).count() == 0
