import base64
import hashlib
import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from cubelark.llm import bpe_chunks, packing, queries, token_counts


def samples():
    rng = random.Random(3)
    yield from [None, "", " ", "  x", "a<|endoftext|>b <|endoftext|>", "中文 text 😀", "word " * 900, "x" * 9000, "été ça  va\n\n ok 's it's", "1" * 500 + " " * 3000 + "end of it"]
    bits = [" ", "  ", "\n", "\t", "a", "the", "é", "12", "²", "'s", "!", "\xa0", "\x85", "ß", "—", "’", "\x1c", "ª"]
    for _ in range(150):
        yield "".join(rng.choice(bits) for _ in range(rng.randrange(60)))
    for n in (500, 5000):
        yield "".join(rng.choice(bits) for _ in range(n))


def frame(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(samples())], "doc_id long, text string, ids string")


def test_encoding_round_trip(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe_chunks.digest(bpe_chunks.encode(frame(spark), chunk=300, overlap=40)).collect()}
    for i, text in enumerate(samples()):
        ids = array("I", library.encode_ordinary(text or "")).tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest()), i
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_chunks_meet():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice([" ", "a", "b", "1", "\n", "é", "  ", "xx yy"]) for _ in range(rng.randrange(1, 800)))
        parts = bpe_chunks.cut(text, 50, 20)
        reached = 0
        for k, (start, part) in enumerate(parts):
            a, b = bpe_chunks.in_step(part, k == 0, k == len(parts) - 1, 20)
            assert start + a == reached
            reached = start + b
        assert reached == len(text)


SCRIPTS = ["мир", "Ωδη", "中文字", "かな", "한국", "عربي", "עברית", "हिन्दी", "ไทย", "١٢", "Ⅷ", "½", "é́", "。", "，", "\u3000", "\u2028", "😀", "🫠", "\U0001e900", "\U00030000", "\ua7c0", "'s", "a", "7", " ", "\n", "’", "_"]


def test_every_script_is_in_step(spark):
    """Chunks and counts of texts in any script, with letters that later versions of Unicode brought."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(SCRIPTS) for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    texts += ["漢字、" * 400, "\n".join(["слово"] * 400), "字" * 900, "a1" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks = bpe_chunks.bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids_sha256 for r in bpe_chunks.digest(bpe_chunks.encode(df, chunk=60, overlap=20)).collect()}
    assert got == {i: hashlib.sha256(array("I", library.encode_ordinary(t)).tobytes()).hexdigest() for i, t in enumerate(texts)}
    assert len(bpe_chunks.cut(texts[-4], 60, 20)) > 10 < len(bpe_chunks.cut(texts[-3], 60, 20)) and len(bpe_chunks.cut(texts[-2], 60, 20)) == 1
    counter = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()}
    assert got == {i: len(counter.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}
    assert not token_counts.UNSURE.search("мир Ωδη 中文 かな 한국 عربي हिन्दी ١٢ 😀")


def test_counts_match_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(frame(spark)).collect()}
    for i, text in enumerate(samples()):
        assert got[i] == (len((text or "").encode()), len(library.encode(text or "", add_special_tokens=False))), i
    assert token_counts.count_tokens(frame(spark).limit(0)).count() == 0


def test_packing_is_whole_and_tight(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(packing.with_crc(packing.pieces(frame(spark)))).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
    for i, text in enumerate(samples()):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(of_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:]) and [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes()) for r in own]
    for own in of_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 1024
    assert len(of_sequence) == -(-sum(r.length for r in rows) // 1024)
    assert {(r.n_sequences, r.least_sequences) for r in rows} == {(len(of_sequence), len(of_sequence))}
    assert packing.pack(packing.with_crc(packing.pieces(frame(spark).limit(0)))).count() == 0


def test_queries_pack_the_librarys_ids(spark, tmp_path):
    """Added tokens in a text are one id each, as the library's default has them."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert library.encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65]
    texts = [*samples(), "x  <|endoftext|>  y<|endoftext|><|endoftext|>\n", "<|endoftext|", "<|endoftext|>" * 1500, "<|<|endoftext|>|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for packed in (queries.op4_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, df, str(tmp_path))):
        of_doc = defaultdict(list)
        for r in packed.collect():
            of_doc[r.doc_id].append(r)
        for i, text in enumerate(texts):
            ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
            assert sum(r.length for r in of_doc[i]) == len(ids), i
            assert all(r.ids_crc32 == zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes()) for r in of_doc[i]), i


def test_bin_completion_beats_or_equals_best_fit():
    rng = random.Random(2)
    for _ in range(60):
        counts = defaultdict(int)
        for _ in range(rng.randrange(1, 40)):
            counts[rng.randrange(1, 101)] += rng.randrange(1, 5)
        patterns, least, _ = packing.solve(dict(counts), 100)
        assert packing._used(patterns) >= least
        got = defaultdict(int)
        for filling, copies in patterns:
            assert sum(k * n for k, n in filling) <= 100
            for k, n in filling:
                got[k] += n * copies
        assert got == counts
        assert packing._used(patterns) <= packing._used(packing.best_fit(dict(counts), 100))


def fewest(sizes, limit):
    """The least number of sequences, over all subsets of documents."""
    full = (1 << len(sizes)) - 1
    best = [(0, 0)] + [(len(sizes) + 1, 0)] * full  # (sequences, fill of the last one) for each subset
    for subset in range(full):
        used, fill = best[subset]
        for i, size in enumerate(sizes):
            if not subset >> i & 1:
                got = (used, fill + size) if used and fill + size <= limit else (used + 1, size)
                best[subset | 1 << i] = min(best[subset | 1 << i], got)
    return best[full][0]


def test_bin_completion_finds_the_optimum():
    rng = random.Random(7)
    searched = 0
    for _ in range(300):
        limit = rng.choice([20, 50, 100, 1024])
        low, high = rng.choice([(1, limit), (limit // 6, limit // 2), (limit // 5, limit // 2)])
        sizes = [rng.randrange(low, high + 1) for _ in range(rng.randrange(1, 13))]
        counts = Counter(sizes)
        patterns, least, proven = packing.solve(dict(counts), limit)
        want = fewest(sizes, limit)
        assert proven and least <= want == packing._used(patterns), (limit, sizes)
        searched += packing._used(packing.best_fit(dict(counts), limit)) > want
    hard = [210, 221, 278, 281, 302, 335, 341, 353, 367, 427, 461, 461, 475, 487]
    assert packing._used(packing.solve(Counter(hard), 1024)[0]) == 5 and searched


def test_packing_ties_and_clashing_names(spark):
    rows = [(1, 0, 700, "x", 9, 0)] * 3 + [(1, 0, 300, "x", 9, 1), (None, 0, 324, None, None, 2), (2, 0, 1024, "y", 1, 1)] * 2
    names = "doc_id long, piece int, length long, bucket string, rank int, `before` int"
    got = packing.pack(spark.createDataFrame(rows, names)).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, rows))
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
    assert len(places) == 6
