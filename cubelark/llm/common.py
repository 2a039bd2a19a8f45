"""What the operators share: tables, the shared folder, Arrow plumbing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelark.plans.components import discard, join_counted, written  # noqa: F401  operators take them from here

#: Longest text, in code points, that shares an Arrow slice with others.
SLICE_CHARS = 4_000_000
#: Bits of a Bloom filter at most (8 MB); a fuller filter lets more pass, it loses nothing.
MOST_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier and whole text only, under fixed names; a null text is empty."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores in front until no column of `df` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """`mapInArrow` with a per-task worker object; long batches are sliced by text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if work is None:
                work = make()
            for part in slices(batch):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of a slice stay below SLICE_CHARS together."""
    if batch.nbytes <= SLICE_CHARS or batch.num_rows == 1:
        yield batch
        return
    half = batch.num_rows // 2
    step = max(1, min(half, batch.num_rows * SLICE_CHARS // batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _positions(ids: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Three bits of a Bloom filter for each identifier."""
    for seed in range(1, 4):
        with np.errstate(over="ignore"):
            values = ids.astype(np.int64).view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
            for shift, factor in ((31, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
        yield (values ^ (values >> np.uint64(31))) & np.uint64(bits - 1)


def bloom_filter(ids: DataFrame, bits_per_id: int) -> np.ndarray:
    """The Bloom filter of a frame's only column, as words of 64 bits; their number is a power of two."""
    bits = min(MOST_BITS, 1 << max(6, math.ceil(math.log2(1 + bits_per_id * ids.count()))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(list(_positions(batch.column(0).to_numpy(zero_copy_only=False), bits))))
            place, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(place):
                yield pa.record_batch([pa.array(place.astype(np.int64)), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first).view(np.int64))], ["place", "bits"])

    out = np.zeros(bits // 64, dtype=np.uint64)
    found = ids.mapInArrow(spread, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()  # MOST_BITS / 64 rows at most
    out[found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which identifiers the filter lets pass: all it was made of, and few others."""
    passed = np.ones(len(ids), dtype=bool)
    for at in _positions(ids, 64 * len(words)):
        passed &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return passed


def may_have(df: DataFrame, id_col: str, words: np.ndarray) -> DataFrame:
    """Rows of `df` whose identifier (not null) the filter lets pass, taken where they are read."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(shared.value, batch.column(id_col).to_numpy(zero_copy_only=False))))

    return df.mapInArrow(run, df.schema)
