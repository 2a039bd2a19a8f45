import random

import numpy as np

from cubelark.llm import licenses, shingles


def brute(text):
    """Containment of every template in the whole text."""
    words = [w for w, _, _ in licenses._words(text or "")]
    own = licenses._shingles(words)
    templates = {k: licenses._shingles(shingles.WORD.findall(t.lower())) for k, t in licenses.TEMPLATES.items()}
    return {k for k, t in templates.items() if len(t & own) >= licenses.CONTAINMENT * len(t)}


def samples():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    yield from [None, "", "Released under the MIT License", "İİİ Released under the MIT License.", "x " * 30_000]
    for _ in range(120):
        words = [word() for _ in range(rng.randrange(0, 300))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(list(licenses.TEMPLATES.values())).split()
            if rng.random() < 0.3 and len(notice) > 40:
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        yield " ".join(words)


def test_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(samples())]
    got = licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert {(r.doc_id, r.license) for r in got} == {(i, k) for i, t, _ in rows for k in brute(t)}
    texts = {i: t for i, t, _ in rows}
    for r in got:
        assert brute(texts[r.doc_id][r.start : r.end]) >= {r.license}
    assert [r.start for r in got if r.doc_id == 3] == [4]


def test_bounds_and_empty_table(spark):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    assert max(licenses.miss_bound(len(own), w) for w, ts in scanner.windows.items() for _, own in ts) <= licenses.MISS
    assert licenses.find_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_put_in_between_at_every_alignment():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name in ("bsd-disclaimer", "isc", "gpl-3.0", "mit-disclaimer"):
        notice = licenses.TEMPLATES[name].split()
        own = len(licenses._shingles(shingles.WORD.findall(licenses.TEMPLATES[name].lower())))
        for at in (len(notice) // 2, 2):
            for more in (1, licenses.longest_run(own) - own):
                text = " ".join([*notice[:at], *(f"new{k}" for k in range(more)), *notice[at:]])
                if name in brute(text):
                    texts = [" ".join([f"w{k}" for k in range(n)] + [text] + ["end"] * 40) for n in range(0, 150, 3)]
                    found = {i for i, license, *_ in scanner.scan(texts) if license == name}
                    assert found == set(range(len(texts))), (name, at, more)


def test_band_tables_find_what_comparing_finds():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rng = np.random.default_rng(1)
    for window, (values, order) in scanner.tables.items():
        joined = np.where(rng.random((licenses.BANDS, 50)) < 0.02, values[np.arange(licenses.BANDS)[:, None], rng.integers(0, values.shape[1], (licenses.BANDS, 50))], rng.integers(0, 2**32, (licenses.BANDS, 50), dtype=np.uint32)).astype(np.uint32)
        own = np.empty_like(values)
        np.put_along_axis(own, order, values, axis=1)
        want = {(i, t) for i in range(50) for t in range(values.shape[1]) if (joined[:, i] == own[:, t]).any()}
        assert set(scanner._collisions(window, joined)) == want


def test_shingle_hashes_follow_the_words():
    texts = ["a b c d e f", "", "a b", "A, b c. D e", "a b c d e"]
    hashes, offsets = shingles.shingle_hashes(texts)
    assert list(offsets) == [0, 2, 2, 3, 4, 5]
    assert hashes[0] == hashes[3] == hashes[4] and len(set(hashes.tolist())) == 3
