import random
from collections import Counter

import numpy as np
import pyarrow as pa

from cubelark.llm import ngram_join, shingles


def brute(rows):
    """(class_id, n_links) of every row by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = shingles.WORD.findall((text or "").lower())
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    n = len(rows)
    link = [[i != j and bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    root = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            best = min([root[i], *(root[j] for j in range(n) if link[i][j])])
            changed |= best < root[i]
            root[i] = best
    return {rows[i][0]: (root[i], sum(link[i])) for i in range(n)}


def corpus(seed=2, group=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    texts = [None, "", "one two", "One, two!", "one two three four five", "!!!"]
    passage = [word() for _ in range(40)]
    base = [word() for _ in range(120)]
    for _ in range(group):  # near-copies of one text, more than a leaf holds
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    for _ in range(60):  # a passage that many share
        texts.append(" ".join([word() for _ in range(60)] + passage + [word() for _ in range(60)]))
    for _ in range(40):
        w = [word() for _ in range(rng.randrange(5, 200))]
        for _ in range(rng.randrange(1, 4)):
            v = list(w)
            for _ in range(rng.randrange(0, 4)):
                v[rng.randrange(len(v))] = word()
            texts.append(" ".join(v))
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = ngram_join.links(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute(rows)


def test_against_brute_force(spark):
    check(spark, corpus())


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "LEAF", 8)
    check(spark, corpus(seed=3))


def test_one_of_each_class_stays(spark):
    rows = corpus(seed=4, group=10)
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, name long")
    kept = ngram_join.keep_one(df)
    want = brute(rows)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i][0] == i)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_links, r.n_shingles) for r in ngram_join.links(df).collect())
    assert got == Counter({(5, 2, 2): 2, (None, 2, 2): 1, (None, 0, 0): 1})
    assert ngram_join.links(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs whose similarity is exactly the threshold: 40 of 50 shingles shared."""
    rows = []
    for i in range(0, 1200, 2):
        words = [f"w{i}x{k}" for k in range(49)]
        rows += [(i, " ".join(words)), (i + 1, " ".join([*words[:44], *(f"v{i}x{k}" for k in range(5))]))]
    got = ngram_join.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, i - i % 2, 1) for i, _ in rows}


def test_missed_pairs_are_reckoned():
    """The formula against the paths that random tokens take."""
    assert ngram_join.missed(ngram_join.runs_needed()) <= 1 - ngram_join.TARGET_RECALL < ngram_join.missed(ngram_join.runs_needed() - 1)
    rng = np.random.default_rng(3)

    def together(equal, depth, used):
        """Whether a pair stays together down to the depth on some path."""
        free = [c for c in range(64) if c not in used]
        return depth == 0 or any(equal[c] and together(equal, depth - 1, {*used, c}) for c in rng.permutation(free)[: ngram_join.BRANCH])

    shared = 38
    equal = np.arange(64) < shared
    q = 1.0
    for _ in range(4):
        q = 1 - (1 - shared / 64 * q) ** 2
    assert abs(np.mean([together(equal, 4, set()) for _ in range(4000)]) - q) < 0.03


def test_repeated_identifiers_with_other_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a), (1, b), (1, b), (7, a + " x"), (8, b + " x"), (9, b)]
    got = sorted(map(tuple, ngram_join.links(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect()))
    assert got == [(1, 1, 1), (1, 1, 3), (1, 1, 3), (7, 1, 1), (8, 1, 3), (9, 1, 3)]


def test_clashing_names_pass_through(spark):
    df = spark.createDataFrame([(2, "a b c d e", 1, "k", "n"), (1, "a b c d e", 2, "k", "n"), (3, None, 3, "k", "n")], "doc_id long, text string, name long, kept string, _name string")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.fillna("").collect()) == [(1, "a b c d e", 2, "k", "n"), (3, "", 3, "k", "n")]
    assert ngram_join.keep_one(df.limit(0)).count() == 0


def test_bytes_of_many_rows_stay_together():
    batch = pa.record_batch([pa.array([1]), pa.array([b"x"], pa.binary())], ["part", "members"])
    whole = ngram_join._whole([batch, batch])
    assert whole.num_rows == 2 and pa.types.is_large_binary(whole.schema.field("members").type)


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 100)).astype(np.uint64) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) if a is not b else 0 for b in sets] for a in sets]
    got = ngram_join.overlaps(sets)
    np.fill_diagonal(got, 0)
    assert got.tolist() == want
    assert ngram_join.overlaps([np.zeros(0, np.uint64)] * 4).sum() == 0
