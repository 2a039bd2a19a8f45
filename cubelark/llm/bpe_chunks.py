"""Byte-level BPE encoding of whole texts in overlapping chunks, and decoding.

Texts of up to CHUNK code points are encoded where they are read.  Longer ones
are cut into chunks that overlap by OVERLAP; each chunk is pre-tokenised on its
own, on any executor.  In the overlap both neighbours look for the first
pre-token boundary from which they run in step; what lies between two such
points is encoded by one chunk only, and the pieces' ids are put in a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

#: Code points of a chunk without its overlap, and of the overlap.
CHUNK = 65_536
OVERLAP = 512
#: Here every pre-tokenisation begins a piece, whatever stands to the left, and what stands to the left has the same
#: pieces alone: at a blank before a letter or number, and at a letter or number after something else that is no blank,
#: no apostrophe, and no longer white space.  Two code points to the left are looked at.
_L, _N, _S = bpe.LETTERS, bpe.NUMBERS, bpe.SPACES
IN_STEP = re.compile(f" (?=[{_L}{_N}])|(?<=[{_S}])(?<! )(?<![{_S}][{_S}])(?=[{_L}{_N}])|(?<=[^{_S}{_L}{_N}{bpe.UNSURE}'])(?=[{_L}{_N}])|(?<=[{_L}])(?=[{_N}])|(?<=[{_N}])(?=[{_L}])")

_CHUNKS = "doc_id long, row long, k int, last boolean, base long, text string"
_PIECES = "doc_id long, row long, k int, last boolean, begin long, finish long, ids binary"


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers).

    A null or empty text has no tokens.  Rows may repeat; each is encoded.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = common.documents(df, id_col, text_col).withColumn("long", F.length("text") > chunk)
    short = common.map_arrow(docs.where("NOT long").select("doc_id", "text"), _encode_short(path), "doc_id long, n_tokens long, ids binary")
    cut = common.map_arrow(docs.where("long").select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), _cut(chunk, overlap), _CHUNKS)
    pieces = common.map_arrow(cut.repartition("row", "k"), _encode_chunk(path, overlap), _PIECES)
    whole = pieces.repartition("row").sortWithinPartitions("row", "k").mapInArrow(_stitch, "doc_id long, n_tokens long, ids binary")
    return short.unionByName(whole)


def decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, n_tokens and raw, the bytes of the ids' tokens in a row."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))

    def make():
        codec = bpe.encoder(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("ids").to_pylist()
            return pa.record_batch([batch.column("doc_id"), batch.column("ids"), pa.array([codec.decode(i) for i in ids], pa.binary())], ["doc_id", "ids", "raw"])

        return work

    return common.map_arrow(rows, make, "doc_id long, ids binary, raw binary")


def digest(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Token count and digests of ids and of what they decode to."""
    return decode(encoded, path).select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def _encode_short(path: str):
    def make():
        codec = bpe.encoder(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [codec.encode(t) for t in batch.column("text").to_pylist()]
            return pa.record_batch([batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

        return work

    return make


def chunk_starts(text: str, chunk: int, overlap: int) -> list[int]:
    """Where chunks begin: about every `chunk` code points, only where the overlap holds a place to fall in step.

    A run without such a place (one endless word) stays in one chunk.
    """
    starts, at = [0], chunk
    while at + overlap < len(text):
        if not IN_STEP.search(text, at + 2, at + overlap):
            later = IN_STEP.search(text, at + 2)
            if later is None or later.start() - 2 + overlap >= len(text):
                break
            at = later.start() - 2
        starts.append(at)
        at += chunk
    return starts


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    starts = chunk_starts(text, chunk, overlap)
    ends = [s + overlap for s in starts[1:]] + [len(text)]
    return [(s, text[s:e]) for s, e in zip(starts, ends, strict=True)]


def _cut(chunk: int, overlap: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
            parts = cut(text, chunk, overlap)
            rows += [(doc, row, k, k == len(parts) - 1, start, part) for k, (start, part) in enumerate(parts)]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [n.split()[0] for n in _CHUNKS.split(", ")])

    return lambda: work


def in_step(text: str, first: bool, last: bool, overlap: int) -> tuple[int, int]:
    """From where to where this chunk's own pre-tokens count.

    In either overlap that is the first pre-token boundary at which both neighbours run in step.
    """
    boundaries = _boundaries(text)
    step = lambda low, high: next(b for b in boundaries if low <= b < high and IN_STEP.match(text, b))
    begin = 0 if first else step(2, overlap)  # a chunk doesn't know what stands before it
    finish = len(text) if last else step(len(text) - overlap + 2, len(text))
    return begin, finish


def _boundaries(text: str) -> list[int]:
    import regex

    spaces = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return [m.start() for m in regex.finditer(spaces, text)]


def _encode_chunk(path: str, overlap: int):
    def make():
        codec = bpe.encoder(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            begin, finish, ids = [], [], []
            for k, last, base, text in zip(*(batch.column(c).to_pylist() for c in ("k", "last", "base", "text")), strict=True):
                a, b = in_step(text, k == 0, last, overlap)
                begin.append(base + a)
                finish.append(base + b)
                ids.append(codec.encode(text[a:b]))
            return pa.record_batch([batch.column(c) for c in ("doc_id", "row", "k", "last")] + [pa.array(begin, pa.int64()), pa.array(finish, pa.int64()), pa.array(ids, pa.binary())], [n.split()[0] for n in _PIECES.split(", ")])

        return work

    return make


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the pieces of each row together; pieces come by row and k."""
    held: list[bytes] = []
    reached = 0
    for batch in batches:
        done: list[tuple[int, bytes]] = []
        for doc, k, last, begin, finish, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k", "last", "begin", "finish", "ids")), strict=True):
            if k == 0:
                held, reached = [], 0
            if begin != reached:
                raise ValueError(f"the chunks of document {doc} don't meet at {begin} and {reached}")
            held.append(ids)
            reached = finish
            if last:
                done.append((doc, b"".join(held)))
                held = []
        if done:
            yield pa.record_batch([pa.array([d for d, _ in done], pa.int64()), pa.array([len(i) // 4 for _, i in done], pa.int64()), pa.array([i for _, i in done], pa.binary())], ["doc_id", "n_tokens", "ids"])
