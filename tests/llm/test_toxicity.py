"""Deobfuscation against all readings, counts against a plain count, and held-out accuracy."""

import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from brackenlog.llm import toxicity as tox

BAD = ["grumblet", "vexorius", "plonkard", "snidewick"]
PLAIN = "the river runs under an old stone bridge while children throw small pebbles into slow water and count rings that fade".split()


def symbol(c):
    return int(tox._tables()[0][ord(c)])


def costs_of(words, times=40):
    n = np.zeros((64, 64, 64))
    for w in words:
        s = [0, 0, *map(symbol, w), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            n[a, b, c] += times
    return tox.model_costs(n)


COSTS = costs_of(PLAIN + BAD)


def price(reading, costs):
    """Cost of a sequence of symbols under the model; boundaries begin words anew."""
    a = b = 0
    total = 0.0
    for c in [*reading, 0]:
        if c == 0:
            total += costs[a, b, 0] if b else 0.0
            a = b = 0
        else:
            total += costs[a, b, c]
            a, b = b, c
    return total


@pytest.mark.parametrize("seed", range(3))
def test_decode_is_the_cheapest_of_all_readings(seed):
    rng = random.Random(seed)
    for _ in range(40):
        run = "".join(rng.choice("gr01eu $-!sé") for _ in range(rng.randint(1, 6)))
        options, repeated = [], 0
        for i, c in enumerate(run):
            repeated = repeated + 1 if i and c == run[i - 1] else 0
            options.append(tox.readings(c, repeated))
        best = min(sum(p for _, p in way) + price([symbol(x) if x != " " else 0 for x, _ in way if x], COSTS) for way in product(*options))
        found = tox.decode(run, COSTS)
        # The reading found, at the cheapest way to write it.
        same = [way for way in product(*options) if " ".join("".join(x for x, _ in way).split()) == found]
        mine = min(sum(p for _, p in way) + price([symbol(x) if x != " " else 0 for x, _ in way if x], COSTS) for way in same)
        assert abs(mine - best) < 1e-3, run


def test_hidden_words_come_back_and_plain_text_stays():
    again = tox.Restorer(COSTS)
    for hidden, word in (("gr4mbl3t", None), ("grumb1et", "grumblet"), ("v3x0r1u5", "vexorius"), ("p l o n k a r d", "plonkard"), ("p.l.0.n.k.a.r.d", "plonkard"), ("sssniidewwwick", "snidewick"), ("$nidewick!", "snidewick")):
        if word:
            assert again(f"the old {hidden} bridge") in (f"the old {word} bridge", f"the old {word}! bridge"), hidden
    for text in ("", "a", "Plain words, stay. As they are!", "in 2024 or 3.14, 10-20 %", "x y", "..."):
        assert again(text) == text


def test_memory_is_bounded_on_long_runs():
    run = "sni" * 3 + "d3" * 20_000
    assert len(tox.decode(run, COSTS)) >= 20_000


@pytest.mark.parametrize("text", ["", "ab", "Ab  c,d ÉÉ 7x", "one\ntwo two"])
def test_trigrams_and_ngrams_equal_a_plain_count(text):
    words = re.findall(r"[^\W\d_]+", text)
    want = Counter()
    for w in words:
        s = [0, 0, *map(symbol, w), 0]
        want.update((a * 64 + b) * 64 + c for a, b, c in zip(s, s[1:], s[2:]))
    found = Counter(g for g in tox.trigrams(text).tolist() if not (g // 64 % 64 == 0 and (g % 64 == 0 or g // 4096)))
    assert found == want
    owners, buckets = tox.ngrams([text, text, ""])
    assert (owners == 0).sum() == (owners == 1).sum() == sum(max(0, len(w) + 2 - n + 1) for w in words for n in (3, 4, 5)) and not (owners == 2).any()
    assert sorted(buckets[owners == 0]) == sorted(buckets[owners == 1])


def hide(word, rng):
    way = rng.randrange(4)
    if way == 0:
        return word.translate(str.maketrans("oise", "015€".replace("€", "3")))
    if way == 1:
        return rng.choice(" .-").join(word)
    if way == 2:
        return "".join(c * rng.choice([1, 3]) for c in word)
    return word


def corpus(count, seed, hidden):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(count):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(1, 3)):
                bad = rng.choice(BAD)
                words.insert(rng.randrange(len(words)), hide(bad, rng) if hidden else bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_on_hidden_words(spark):
    rows, labels = corpus(600, 1, hidden=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tox.train(docs, marks.where(~tox.held_out("doc_id")), tox.language_model(docs))
    for hidden in (False, True):
        fresh, truth = corpus(300, 2, hidden)
        found = {r.doc_id: r for r in tox.predict(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
        wrong = [i for i, y in truth if found[i].predicted != y]
        assert len(wrong) <= (6 if hidden else 0), [(fresh[i][1], found[i].restored) for i in wrong[:5]]
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())


def test_odd_rows_and_extra_columns(spark):
    rows, labels = corpus(120, 3, hidden=False)
    odd = [(None, "the grumblet"), (1007, None), (1008, ""), (1008, ""), (1009, "vexorius " * 50_000)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumns({"score": F.lit("x"), "toxic": F.lit(9), "predicted": F.lit(None), "restored": F.lit(1)})
    marks = spark.createDataFrame([*labels, *labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = tox.train(docs, marks, tox.language_model(docs))
    found = tox.predict(docs, model)
    assert set(found.columns) == {"doc_id", "text", "toxic", "score", "predicted", "restored"}
    got = found.collect()
    assert len(got) == len(rows) + len(odd)
    empty = [r for r in got if not r.text]
    assert len(empty) == 3 and len({r.score for r in empty}) == 1 and empty[0].predicted == 0
    assert [r.predicted for r in got if r.text and len(r.text) > 10_000] == [1]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.train(empty, none, tox.language_model(empty))
    assert tox.predict(empty, model).count() == 0
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    for marks, want in ((none, 0), (spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), 1), (spark.createDataFrame([(1, 0)], "doc_id long, toxic int"), 0)):
        got = tox.predict(docs, tox.train(docs, marks, tox.language_model(docs))).collect()
        assert [r.predicted for r in got] == [want, want]
