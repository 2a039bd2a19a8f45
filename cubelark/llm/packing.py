"""Packing documents into sequences of fixed length: bin completion.

A document longer than a sequence is cut; only its first piece can be shorter
than a sequence.  So what has to be packed is one length below the limit for
each document, and the problem is its histogram: at most `limit` counts, however
many documents there are.  The driver solves the histogram by branch and bound
and hands out patterns with multiplicities; the documents then find their place
by their rank among those of their length, counted in parallel buckets.

The search enumerates the undominated fillings around the longest document left,
least waste first and without a cut, each at several multiplicities down to one,
and leaves a branch whose waste no better packing could afford.  Best fit is the
first incumbent.  Mostly it meets the lower bound and nothing is searched; where
a search of NODE_LIMIT fillings neither meets the bound nor ends, the incumbent
stays and `least_sequences` shows the gap.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common

LIMIT = 1024
#: Fillings that the search looks at before it settles for the best packing found; `solve` says if that happened.
NODE_LIMIT = 100_000
#: Rows of one length in a bucket in which ranks are counted, about.
BUCKET_ROWS = 1_000

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how often), ...), how many sequences


def pieces(df: DataFrame, path: str | None = None, end_id: int | None = 2, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit integers).

    A document's ids, then `end_id`; if they exceed `limit` they are cut so that
    all pieces but the first are full.  A null or empty text is `end_id` alone.
    Added tokens of the vocabulary are one id each, as the library's default has it.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def make():
        codec = bpe.encoder(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = codec.encode(text, added_tokens=True) + end
                for k, (start, length) in enumerate(cuts(len(ids) // 4, limit)):
                    rows.append((doc, k, start, length, ids[4 * start : 4 * (start + length)]))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

        return work

    return common.map_arrow(common.documents(df, id_col, text_col), make, "doc_id long, piece int, start long, length long, ids binary")


def cuts(length: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = length % limit or min(length, limit)
    return [(0, first), *((s, limit) for s in range(first, length, limit))] if length else []


def with_crc(df: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids instead of these."""
    return df.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))


def pack(items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds sequence_id, offset, and the numbers n_sequences and least_sequences (a lower bound) to rows with doc_id, piece and length (1 to `limit`).

    The rows are written once to the shared folder, so lengths and ranks come
    from the same data even if executors are lost.  Repeated rows each get a
    place; rows that differ in nothing are interchangeable.  An empty table gives
    no rows.  Other columns are passed through under whatever name.
    """
    items = common.written(items, "pieces")
    counts = {r.length: r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `limit` rows
    patterns, least = solve(counts, limit)[:2]
    rows = items.select("length", F.struct("doc_id", "piece", *items.columns).alias("order"), F.struct(*items.columns).alias("row"))
    parts = items.sparkSession.createDataFrame([(k, 1 + n // BUCKET_ROWS) for k, n in counts.items()], "length long, parts long")
    spread = rows.join(F.broadcast(parts), "length").withColumn("bucket", F.pmod(F.xxhash64("order"), F.col("parts")))
    sizes = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("order")
    ranked = spread.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranges = items.sparkSession.createDataFrame(_ranges(patterns), "p_length long, low long, high long, times long, first_sequence long, first_offset long")
    placed = ranked.join(F.broadcast(ranges), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return placed.select(
        *[F.col("row")[c].alias(c) for c in items.columns],
        (F.col("first_sequence") + (nth - nth % F.col("times")) / F.col("times")).cast("long").alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("times") * F.col("length")).cast("long").alias("offset"),
        F.lit(_used(patterns)).cast("long").alias("n_sequences"),
        F.lit(least).cast("long").alias("least_sequences"),
    )


def _ranges(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """For each pattern and length: which ranks of that length it takes, and where they go."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for filling, copies in patterns:
        offset = 0
        for length, times in filling:
            low = used.get(length, 0)
            used[length] = low + times * copies
            out.append((length, low, used[length], times, sequence, offset))
            offset += length * times
        sequence += copies
    return out


def lower_bound(counts: dict[int, int], limit: int) -> int:
    """Sequences that no packing can do without.

    By volume, and for each k by the documents above limit - k, which share with
    none of at least k, those above half, which share with none of their kind,
    and what of the rest finds no room beside these.
    """
    sizes = sorted(n for n, c in counts.items() if c)
    best = -(-sum(n * counts[n] for n in sizes) // limit)
    for k in {0, *(n for n in sizes if 2 * n <= limit)}:
        alone = sum(counts[n] for n in sizes if n > limit - k)
        halves = [n for n in sizes if limit < 2 * n and n <= limit - k]
        room = sum(counts[n] * (limit - n) for n in halves)
        rest = sum(counts[n] * n for n in sizes if k <= n and 2 * n <= limit)
        best = max(best, alone + sum(counts[n] for n in halves) + max(0, -(-(rest - room) // limit)))
    return best


def solve(counts: dict[int, int], limit: int, node_limit: int = NODE_LIMIT) -> tuple[list[Pattern], int, bool]:
    """Packs `counts` documents of each length into few sequences of `limit`: patterns, a lower bound, whether no packing is shorter.

    Branch and bound: the largest document left is completed with undominated
    fillings, those of least waste first, as often as can be, then half as often,
    down to once; a branch is left when its waste exceeds what a better packing
    could afford, or when the same documents were left at no more waste before.
    """
    counts = {k: n for k, n in counts.items() if n > 0}
    total, least = sum(k * n for k, n in counts.items()), lower_bound(counts, limit)
    best = best_fit(counts, limit)
    left, chosen, nodes = dict(counts), [], 0
    seen: dict[frozenset, int] = {}
    waste = [0]
    todo = [_branches(left, limit)]
    while todo and _used(best) > least and nodes < node_limit:
        nodes += 1
        afford = (_used(best) - 1) * limit - total
        branch = next(todo[-1], None)
        if branch == _DOMINATED:
            continue
        filling, copies = branch or ((), 0)
        lost = waste[-1] + copies * (limit - sum(k * n for k, n in filling))
        if branch is None or copies == 1 and lost > afford:  # later fillings waste more
            todo.pop()
            if chosen:
                _put_back(left, chosen.pop())
                waste.pop()
            continue
        if lost > afford:
            continue
        for k, n in filling:
            left[k] -= n * copies
            if not left[k]:
                del left[k]
        chosen.append((filling, copies))
        waste.append(lost)
        state = frozenset(left.items())
        if not left:
            best = list(chosen)
        if left and seen.get(state, lost + 1) > lost:
            seen[state] = lost
            todo.append(_branches(left, limit))
        else:
            _put_back(left, chosen.pop())
            waste.pop()
    return best, least, not todo or _used(best) <= least


def _used(patterns: list[Pattern]) -> int:
    return sum(copies for _, copies in patterns)


def _put_back(left: dict[int, int], pattern: Pattern) -> None:
    for k, n in pattern[0]:
        left[k] = left.get(k, 0) + n * pattern[1]


#: Instead of a filling that is dominated, so that these count as looked at.
_DOMINATED: Pattern = ((), 0)


def _branches(left: dict[int, int], limit: int) -> Iterator[Pattern]:
    """Fillings around the largest length of `left` as it is now, each with falling multiplicities down to one."""
    left = dict(left)
    for filling in _fillings(left, limit):
        if not filling:
            yield _DOMINATED
            continue
        copies = min(left[k] // n for k, n in filling)
        while copies:
            yield filling, copies
            copies //= 2


def _fillings(left: dict[int, int], limit: int) -> Iterator[tuple[tuple[int, int], ...]]:
    """All undominated ways to complete the largest length, least waste first; nothing in place of dominated ones.

    One document that fills the gap exactly dominates every other filling.
    """
    largest = max(left)
    gap = limit - largest
    rest = dict(left)
    rest[largest] -= 1
    if rest.get(gap):
        yield _pattern((largest, gap))
        return
    sizes = sorted((k for k, n in rest.items() if n and k <= gap), reverse=True)
    # sums that the sizes from the i-th on can have, as bits
    sums = [1]
    for size in reversed(sizes):
        reached, n, step = sums[-1], min(rest[size], gap // size), 1
        while n:
            take = min(step, n)
            reached |= reached << (take * size)
            n, step = n - take, 2 * step
        sums.append(reached & ((1 << (gap + 1)) - 1))
    sums.reverse()

    def exactly(at: int, amount: int) -> Iterator[tuple[int, ...]]:
        """Fillings of this amount from the sizes from `at` on, larger documents first; never in vain."""
        if not amount:
            yield ()
            return
        for i in range(bisect_left(sizes, -amount, at, key=lambda k: -k), len(sizes)):
            if not sums[i] >> amount & 1:
                return
            for n in range(min(rest[sizes[i]], amount // sizes[i]), 0, -1):
                if sums[i + 1] >> (amount - n * sizes[i]) & 1:
                    for more in exactly(i + 1, amount - n * sizes[i]):
                        yield (sizes[i],) * n + more

    for waste in range(gap + 1):
        if sums[0] >> (gap - waste) & 1:
            for filling in exactly(0, gap - waste):
                yield () if _dominated(filling, rest, sizes, waste) else _pattern((largest, *filling))


def _dominated(filling: tuple[int, ...], rest: dict[int, int], sizes: list[int], waste: int) -> bool:
    """Whether a document left out can take the place of some of the filling's, and of the waste."""
    parts = {0}
    for k in filling:
        parts |= {p + k for p in parts}
    single = set(filling)
    for part in parts:
        # left out, at least as long as the part, and no longer than part and waste
        for i in range(bisect_left(sizes, -(part + waste), key=lambda k: -k), len(sizes)):
            if sizes[i] < part or not part and not sizes[i]:
                break
            if rest[sizes[i]] > filling.count(sizes[i]) and not (sizes[i] == part and part in single):
                return True
    return False


def _pattern(sizes: tuple[int, ...]) -> tuple[tuple[int, int], ...]:
    return tuple((k, sizes.count(k)) for k in sorted(set(sizes), reverse=True))


def best_fit(counts: dict[int, int], limit: int) -> list[Pattern]:
    """Best fit decreasing on the histogram: each sequence takes, again and again, the longest document that fits."""
    left, out = dict(counts), []
    while left:
        gap, taken = limit, []
        while True:
            size = max((k for k, n in left.items() if k <= gap and taken.count(k) < n), default=0)
            if not size:
                break
            taken.append(size)
            gap -= size
        filling = _pattern(tuple(taken))
        copies = min(left[k] // n for k, n in filling)
        for k, n in filling:
            left[k] -= n * copies
            if not left[k]:
                del left[k]
        out.append((filling, copies))
    return out


