import hashlib
from collections import defaultdict

import pytest

from cubelark.llm import exact_dedup


@pytest.mark.parametrize("keep", ["max", "min"])
def test_against_brute_force(spark, monkeypatch, keep):
    monkeypatch.setattr(exact_dedup, "HOT_KEYS", 40)  # so that small groups count as hot
    rows = [(i, f"text {i % 7}" if i % 3 else "hot") for i in range(200)] + [(500, None), (501, ""), (502, "é" * 10_000), (503, "é" * 10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = max if keep == "max" else min
    want = {(i, best(groups[t or ""]), len(groups[t or ""]), i == best(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    got = [tuple(r) for r in exact_dedup.exact_dedup(df, keep=keep).collect()]
    assert len(got) == len(rows) and set(got) == want


def test_rows_stay_whole(spark):
    df = spark.createDataFrame([(1, "a", "u", 1), (2, "a", "v", 2), (None, "a", "w", 3), (4, None, "x", 4), (5, "b", None, None)], "doc_id long, text string, row string, h int")
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} == {(2, "a", "v", 2), (4, None, "x", 4), (5, "b", None, None)}
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_repeated_identifiers_keep_one(spark):
    df = spark.createDataFrame([(7, "a"), (7, "a"), (None, "c"), (None, "c")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == 4 and sum(r.kept for r in got) == 2
