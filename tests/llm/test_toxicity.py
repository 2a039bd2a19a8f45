import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cubelark.llm import common, toxicity


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ou", "in", "es", "re"]) for _ in range(rng.randrange(1, 5)))
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [word() for _ in range(rng.randrange(5, 60))]
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = "blarg" + rng.choice(["", "an", "er", "ish"])
        docs.append((i, " ".join(words), "toxic"))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs + [(9000, None, ""), (9001, "", ""), (None, "x y", ""), (9002, "anan " * 20_000, "")], "doc_id long, text string, label string")
    model = toxicity.train(df, spark.createDataFrame(labels + [(None, 1), (9001, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean([got[i].predicted == y for i, y in held]) > 0.95
    assert got[9000].score == got[9001].score < 0.5 and got[9002].predicted == 0


def test_labels_of_held_out_rows_are_never_used(spark):
    docs, labels = corpus(150)
    df = spark.createDataFrame(docs, "doc_id long, text string, x string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score(df, toxicity.train(df, spark.createDataFrame(x, "doc_id long, toxic int"))).collect()) for x in (labels, turned))
    assert a == b


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).count() == 0


def kneser_ney(docs, labels, halves):
    """Word probabilities of both classes from counts in dictionaries."""
    seen, shared = {0: Counter(), 1: Counter()}, Counter()
    marks = dict(labels)
    for i, text in docs:
        half = {1: 1, 2: 1, 3: 2, 4: 2}.get(zlib.crc32(str(i).encode()) % 5)
        if half in halves:
            seen[marks[i]].update(text.split())
            shared.update(set(text.split()))
    size, total = len(shared), shared.total()

    def p(label, word):
        """Sums to 1 over the words of `shared` and one more."""
        counts = seen[label]
        base = (max(shared[word] - 0.75, 0) + 0.75 * size / (size + 1)) / total
        return (max(counts[word] - 2.5, 0) + sum(min(n, 2.5) for n in counts.values()) * base) / counts.total()

    return p, [*shared, "unseen"]


def test_ratios_against_brute_force(spark):
    docs, labels = corpus(200)
    docs = [d[:2] for d in docs]
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = {r.word: r for r in model.words.collect()}
    every = {w for _, t in docs for w in t.split()}
    assert 20 < len(rows) < len(every)  # words that no class has often are not listed
    for name, halves in toxicity.MODELS.items():
        p, known = kneser_ney(docs, labels, halves)
        assert sum(p(1, w) for w in known) == pytest.approx(1) and sum(p(0, w) for w in known) == pytest.approx(1)
        for word in [*every, "unseen"]:
            got = (rows[word][f"ratio_{name}"] if word in rows else 0) + model.rest[name]
            assert got * toxicity.UNIT == pytest.approx(math.log(p(1, word)) - math.log(p(0, word)), abs=1e-6)


def test_words_grow_with_the_input(spark):
    """Every word that is seen often has its own row, however many there are."""
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(400)) + " ") for i in range(800)]
    docs = [(i, t * 3) for i, t in docs]
    labels = [(i, i % 2) for i, _ in docs]
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.words.count() == 400 * sum(zlib.crc32(str(i).encode()) % 5 > 0 for i, _ in docs)


def test_filter_passes_every_label(spark):
    ids = list(range(-5, 3000, 7)) + [2**62, -(2**63)]
    found = common.bloom_filter(spark.createDataFrame([(i,) for i in ids], "doc_id long"), 10)
    assert common.passes(found, np.array(ids)).all()
    assert common.passes(found, np.arange(10**6, 10**6 + 20_000)).mean() < 0.05
    assert not common.passes(common.bloom_filter(spark.createDataFrame([], "doc_id long"), 10), np.arange(100)).any()


def test_scores_do_not_depend_on_the_broadcast(spark, monkeypatch):
    docs, labels = corpus(150)
    df = spark.createDataFrame([*docs, (None, "blargan x", ""), (7, None, "")], "doc_id long, text string, x string")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = []
    for most in (1 << 18, 40, 0):
        monkeypatch.setattr(toxicity, "TABLE_WORDS", most)
        found.append(sorted((r.doc_id or -1, r.score, r.log_ratio) for r in toxicity.score(df, model).collect()))
    assert len(found[0]) == 152 and found[0] == found[1] == found[2]
