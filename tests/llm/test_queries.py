"""The registered queries and the pipeline over a small folder of tables, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cubelark.llm import pii, quality, queries
from cubelark.llm.common import table
from tests.llm.test_ngram_join import brute as near_brute
from tests.llm.test_pii import brute as pii_brute


def rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ou", "in", "es", "re"]) for _ in range(rng.randrange(1, 4)))
    prose = lambda n=8: "\n".join(" ".join(word() for _ in range(14)).capitalize() + "." for _ in range(n))
    texts = [None, "", "short one"]
    for i in range(60):
        text = prose()
        if i % 4 == 0:
            text += f" Write to a{i}@b.co or +1 (555) 123-4567, card 4111111111111111."
        if i % 7 == 0:
            text += " Released under the MIT License. token = 'abcdefghijkl12345'"
        texts.append(text)
        if i % 5 == 0:
            texts += [text, text]
        if i % 6 == 0:
            texts.append(text.replace(text.split()[3], "changed", 1))
    texts += ["\n".join(" ".join(word() + "$$$" for _ in range(14)) for _ in range(6)) for _ in range(25)]
    texts.append(prose(400))
    ids = rng.sample(range(1000), len(texts))
    labels = [(i, int("$$$" not in (t or "$$$")), int(i % 3 == 0)) for i, t in zip(ids, texts)]
    return [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    documents, labels = rows()
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


COLUMNS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op3_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op4_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op5_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_licenses": {"doc_id": "bigint", "license": "string"},
    "op7_ngram_join": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op8_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op10_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
}


@pytest.fixture(scope="module")
def results(spark, folder):
    return {name: query(spark, folder) for name, query in queries.QUERIES.items()}


def test_columns_and_rows(results):
    documents, _ = rows()
    assert set(results) == set(COLUMNS)
    for name, columns in COLUMNS.items():
        found = dict(results[name].dtypes)
        assert {c: found.get(c) for c in columns} == columns, name
        if name not in ("op4_packing", "op6_licenses"):
            assert sorted(r.doc_id for r in results[name].select("doc_id").collect()) == sorted(d[0] for d in documents), name


def test_against_brute_force(results):
    documents, _ = rows()
    text = {d[0]: d[1] or "" for d in documents}
    groups = defaultdict(list)
    for i, t in text.items():
        groups[t].append(i)
    for r in results["op3_exact_dedup"].collect():
        own = groups[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(own), len(own), r.doc_id == max(own), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = {i: len(library.encode(t, add_special_tokens=False)) for i, t in text.items()}
    for r in results["op9_token_counts"].collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), count[r.doc_id], count[r.doc_id] > 512)
    assert Counter(r.doc_id for r in results["op6_licenses"].collect()) == Counter(i for i, t in text.items() if "MIT License" in t)
    near = near_brute([(d[0], d[1]) for d in documents])
    assert {r.doc_id: (r.class_id, r.n_links) for r in results["op7_ngram_join"].collect()} == near
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in results["op1_toxicity"].collect())
    for r in results["op10_pii"].collect():
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in pii_brute(text[r.doc_id])).encode()).hexdigest()


def redacted(text):
    """Base spans only: the texts here hold no others."""
    out, at = [], 0
    for kind, a, b in sorted(pii_brute(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join(out) + text[at:]


def test_pipeline_against_brute_force(spark, folder):
    documents, _ = rows()
    crf = quality.train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    kept = {d[0]: d[1] for d in documents if quality.judge(d[1] or "", crf)[-1]}
    assert 40 < len(kept) < len(documents) - 20
    best = {}
    for i, t in kept.items():
        best[t] = max(i, best.get(t, -1))
    kept = {i: t for t, i in best.items()}
    near = near_brute(list(kept.items()))
    kept = {i: redacted(t) for i, t in kept.items() if near[i][0] == i}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {i: len(library.encode(t, add_special_tokens=False)) + 1 for i, t in kept.items()}

    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {r.doc_id: r.text for r in docs.collect()} == kept
    packed = corpus_pipeline.run(spark, folder).collect()
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.length
    assert dict(total) == size
    whole, rest = sum(n // 1024 for n in size.values()), [n % 1024 for n in size.values() if n % 1024]
    # no packing has fewer: by length, and by how many of the shortest fit together
    least = whole + max(-(-sum(rest) // 1024), -(-len(rest) // (1024 // min(rest))))
    assert len({r.sequence_id for r in packed}) == least


def test_pii_patterns_are_known():
    assert set(pii.PATTERNS) == set(pii.BASE_KINDS + pii.ADDED_KINDS)
