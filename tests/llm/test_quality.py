import itertools
import random
import re

import numpy as np

from cubelark.llm import quality


def brute_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def samples():
    rng = random.Random(4)
    yield from ["", " \n\t", "one", "a b c a b c a b c", "x\nx\nx", "\xa0 \x1c a"]
    for _ in range(120):
        yield "".join(rng.choice(["a", "b", "c ", " ", "\n", "dd ", "#", "%%", "É", "word ", "\r", "\x0b"]) for _ in range(rng.randrange(200)))


def test_counts_against_brute_force():
    for text in samples():
        assert quality.statistics(text)[0] == brute_counts(text), repr(text)


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(0)
    for n in range(1, 7):
        for _ in range(20):
            x = rng.normal(size=(n, len(quality.FEATURES)))
            crf = quality.Crf(rng.normal(size=(2, len(quality.FEATURES))), rng.normal(size=(2, 2)))
            score = lambda s: sum(crf.emission[y] @ f for y, f in zip(s, x)) + sum(crf.transition[a, b] for a, b in zip(s, s[1:]))
            assert tuple(crf.viterbi(x).astype(int)) == max(itertools.product((0, 1), repeat=n), key=score)


def test_trained_model_tells_prose_from_junk(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    prose = lambda: "\n".join(" ".join(word() for _ in range(20)).capitalize() + "." for _ in range(5))
    junk = lambda: "\n".join(" ".join(word() + "$$$" for _ in range(20)) for _ in range(5))
    rows = [(i, prose() if i % 2 else junk(), "c") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (5000, None)], "doc_id long, quality int")
    crf = quality.train(docs, labels)
    got = {r.doc_id: r.kept for r in quality.assess(docs, crf).collect()}
    assert all(got[i] == bool(i % 2) for i in range(200))
    kept = quality.keep_good(docs, crf)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(200) if i % 2}


def prose_and_junk(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    prose = lambda n=20: " ".join(word() for _ in range(n)).capitalize() + "."
    junk = lambda n=20: " ".join(word() + rng.choice(["$$$", "###"]) for _ in range(n))
    return rng, prose, junk


def test_lines_of_one_document_part():
    """Boilerplate in good documents and prose in bad ones, learnt from labels of whole documents."""
    rng, prose, junk = prose_and_junk(3)

    def lines(good):
        many, few = (prose, junk) if good else (junk, prose)
        out = [(many(), good) for _ in range(rng.randrange(5, 9))]
        if rng.random() < 0.5:
            at, n = rng.randrange(len(out) + 1), rng.randrange(1, 3)
            out[at:at] = [(few(), not good)] * n
        return out

    documents = [lines(i % 2 == 0) for i in range(400)]
    texts = ["\n".join(t for t, _ in d) for d in documents]
    stats = [quality.statistics(t) for t in texts]
    crf = quality.fit([(f, s, int(i % 2 == 0)) for i, (_, f, s) in enumerate(stats[:300])])
    right = mixed = total = 0
    for i in range(300, 400):
        row = quality.judge(texts[i], crf)
        want = "".join("BC"[c] for _, c in documents[i])
        right += sum(a == b for a, b in zip(row[7], want, strict=True))
        total += len(want)
        mixed += 0 < row[6] < 1
        assert row[-1] == (i % 2 == 0)
    assert mixed >= 40 and right / total > 0.98


def test_the_share_decides():
    """A document that is half prose, half junk goes by its characters."""
    rng, prose, junk = prose_and_junk(5)
    texts = ["\n".join((prose if i % 2 else junk)() for _ in range(6)) for i in range(200)]
    crf = quality.fit([(f, s, i % 2) for i, (_, f, s) in enumerate(map(quality.statistics, texts))])
    for n in range(11):
        row = quality.judge("\n".join([prose() for _ in range(n)] + [junk() for _ in range(10 - n)]), crf)
        assert row[7] == "C" * n + "B" * (10 - n)
        assert row[-1] == (row[6] >= quality.CONTENT_SHARE) and abs(row[6] - n / 10) < 0.25


def test_expected_labels_against_all_sequences():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 1, 5, 2])
    x = rng.normal(size=(11, len(quality.FEATURES)))
    crf = quality.Crf(rng.normal(size=(2, len(quality.FEATURES))), rng.normal(size=(2, 2)))
    single, pair = quality._Sequences(lengths).expected(crf, x)
    odds = quality._Sequences(lengths).odds(crf, x)
    at = 0
    for n in lengths:
        weights = {}
        for s in itertools.product((0, 1), repeat=int(n)):
            weights[s] = np.exp(sum(crf.emission[y] @ x[at + i] for i, y in enumerate(s)) + sum(crf.transition[a, b] for a, b in zip(s, s[1:])))
        z = sum(weights.values())
        for i in range(n):
            p = sum(w for s, w in weights.items() if s[i]) / z
            assert np.isclose(np.exp(single[at + i, 1]), p) and np.isclose(odds[at + i], np.log(p / (1 - p)))
        at += n
    assert np.allclose(np.exp(pair).sum((1, 2)), 1)


def test_labels_keep_to_the_document():
    odds = np.array([5.0, -1, -2, 3, 1, 2, -4])
    got = quality.constrained(odds, np.array([10, 10, 10, 10, 10, 10, 10]), np.array([0, 0, 0, 0, 1, 1, 1]), np.array([0, 1]))
    assert got.tolist() == [1, 0, 0, 0, 1, 1, 0]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (3, "w " * 60), (3, "w " * 60)], "doc_id long, text string")
    crf = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.assess(docs, crf).collect()
    assert len(got) == 4 and all(r.base_failed and not r.kept for r in got)
    assert quality.assess(docs.limit(0), crf).count() == 0
