"""Token counts by a two-tier lookup on the map side.

Tier one is a table of the token counts of frequent pre-tokens, broadcast to all
workers; its size is bounded (TABLE_ENTRIES entries of at most KEY_CHARS code
points).  Tier two is a bounded cache in each worker, filled by encoding misses
with the library.  No pre-token is shuffled: the frequent ones are those of a
sample of SAMPLE_DOCUMENTS documents, whose counts go straight to the driver.  The
sample only decides what is looked up fast; every document is counted in full.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

#: Entries of the broadcast table, code points of a key in it.
TABLE_ENTRIES = 65_536
KEY_CHARS = 32
#: Documents that the table is made from at most, and pre-tokens that a task reports of them.
SAMPLE_DOCUMENTS = 2_000
SUMMARY_ROWS = 8_192
#: Pre-tokens that a worker's cache holds; a full one starts anew.
CACHE_ENTRIES = 300_000

#: Texts with code points of an unsure class, or that regular expressions treat as white space and Unicode does not, go to the library as they are.
UNSURE = re.compile(f"[{bpe.UNSURE}]|[\x1c-\x1f]")
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{bpe.LETTERS}]+| ?[{bpe.NUMBERS}]+| ?[^{bpe.SPACES}{bpe.LETTERS}{bpe.NUMBERS}]+|[{bpe.SPACES}]+(?![^{bpe.SPACES}])|[{bpe.SPACES}]+")


def frequent_pieces(docs: DataFrame, entries: int = TABLE_ENTRIES, sample: int = SAMPLE_DOCUMENTS) -> list[str]:
    """The most frequent pre-tokens of a sample of the documents, drawn by a hash of the identifier."""
    draw = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    bits = common.bloom_filter(draw.where("doc_id IS NOT NULL"), 16)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(p for p in PIECES.findall(text.as_py()) if len(p) <= KEY_CHARS)
        best = counts.most_common(SUMMARY_ROWS)
        yield pa.record_batch([pa.array([k for k, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["piece", "n"])

    found = common.may_have(docs.where("doc_id IS NOT NULL"), "doc_id", bits).mapInArrow(summarise, "piece string, n long").toArrow()
    total: Counter[str] = Counter()
    for piece, n in zip(found.column("piece").to_pylist(), found.column("n").to_pylist(), strict=True):
        total[piece] += n
    return sorted(total, key=lambda piece: (-total[piece], piece))[:entries]


def count_tokens(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens.  A null or empty text has none; rows may repeat.

    Special strings inside a text count as the library's default has them: as one token.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    docs = common.documents(df, id_col, text_col)
    pieces = frequent_pieces(docs)
    lengths = _Library(path).lengths(pieces)
    table = df.sparkSession.sparkContext.broadcast((pieces, bytes(min(n, 255) for n in lengths)))

    def make():
        counter = _Counter(path, dict(zip(*table.value, strict=True)))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            return pa.record_batch([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        return work

    return common.map_arrow(docs, make, "doc_id long, n_bytes long, n_tokens long")


class _Library:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


class _Counter:
    """Counts the tokens of texts by table, cache and library, in this order."""

    def __init__(self, path: str, table: dict[str, int]):
        self.library = _Library(path)
        self.table = {k: n for k, n in table.items() if n < 255}
        self.known = dict(self.table)
        self.special = re.compile("|".join(map(re.escape, self.library.specials)) or r"(?!)")

    def count(self, texts: list[str]) -> list[int]:
        counts = [0] * len(texts)
        split: list[tuple[int, list[str]]] = []
        missing: dict[str, None] = {}
        for i, text in enumerate(texts):
            if UNSURE.search(text):
                counts[i] = self.library.lengths([text])[0]
                continue
            parts = self.special.split(text)
            counts[i] = len(parts) - 1
            for part in parts:
                pieces = PIECES.findall(part)
                split.append((i, pieces))
                missing.update(dict.fromkeys(set(pieces).difference(self.known)))
        if missing:
            if len(self.known) + len(missing) > CACHE_ENTRIES + len(self.table):
                self.known = dict(self.table)
                missing = dict.fromkeys({p for _, pieces in split for p in pieces}.difference(self.known))
            self.known.update(zip(missing, self.library.lengths(list(missing)), strict=True))
        known = self.known.__getitem__
        for i, pieces in split:
            counts[i] += sum(map(known, pieces))
        return counts
