"""N-gram Jaccard join: a chosen-path join with exact verification.

Documents are sets of five-word shingles; two are linked if their Jaccard
similarity is THRESHOLD at least.  Documents with the same set form one class
and take part once.

A set is embedded as COORDINATES MinHash tokens.  In every run all sets start in
one bucket.  A bucket chooses BRANCH coordinates by a hash of its own path and
splits its sets by the tokens at each of them, so similar sets are likely to
stay together.  Buckets of at most LEAF sets are compared in full.  A bucket
that a split hardly shrinks holds near-copies, so it is compared in full, too, in
blocks if it is large.  The runs are repeated until a pair at the threshold is
missed with a probability below 1 - TARGET_RECALL.  All runs draw on the same
tokens, so this is reckoned for each number of tokens that such a pair can share,
with what the agreement below rules out.

Within a bucket the tokens' agreement rules out most pairs; the rest is verified
on whole sets.  A pair that meets in several buckets counts in the least of
them.  Buckets give back one row for each set (its number of links, a tree of
links), never pairs, so a group of near-copies costs no quadratic output.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubelark.plans.components import connected_components

from . import common, shingles

#: Least Jaccard similarity of a link, as a fraction.
THRESHOLD = (4, 5)
COORDINATES = 64
BRANCH = 2
LEAF = 64
TARGET_RECALL = 0.99999
#: A child with more than this share of its parent's sets is not split further.
DENSE = 0.6
#: Splits after which a bucket is compared as it is (in blocks).
MOST_SPLITS = 8
#: Sets that one task compares with each other at most, per side.
BLOCK = 2048
#: Tokens of COORDINATES in which a pair must agree to be verified.
AGREE = 34
#: Bits of the filter of texts for each set that is verified.
BITS_PER_SET = 10


def missed(runs: int) -> float:
    """The probability that a pair at the threshold is missed.

    A split keeps a pair that shares the part t of its tokens with probability
    1 - (1 - t q)^BRANCH, where q is the same for the splits below; most buckets need fewer splits.
    """
    s, total = THRESHOLD[0] / THRESHOLD[1], 0.0
    for shared in range(COORDINATES + 1):
        q = 1.0
        for _ in range(MOST_SPLITS):
            q = 1 - (1 - shared / COORDINATES * q) ** BRANCH
        lost = 1.0 if shared < AGREE else (1 - q) ** runs
        total += math.comb(COORDINATES, shared) * s**shared * (1 - s) ** (COORDINATES - shared) * lost
    return total


def runs_needed(target: float = TARGET_RECALL) -> int:
    """The least number of runs that misses a pair at the threshold with probability 1 - target at most."""
    runs = 1
    while missed(runs) > 1 - target:
        runs += 1
        if missed(runs) == missed(runs - 1):
            raise ValueError(f"AGREE = {AGREE} rules out too many pairs for a recall of {target}")
    return runs


def links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_shingles.

    `class_id` is the smallest identifier among the documents that links connect
    (its own for a document without links), `n_links` the number of other rows
    that are linked to the row, copies included.  A text of one to four words
    has one shingle; a null, empty or wordless text has none and links to
    nothing.  Rows that repeat an identifier count each with its own text.
    A null identifier is replaced by a hash of the text.  An empty table gives no rows.
    """
    docs = common.documents(df, id_col, text_col).withColumn("name", F.coalesce("doc_id", F.xxhash64("text")))
    sketches = common.written(common.map_arrow(docs, _sketches, "doc_id long, name long, node long, size int, sketch binary"), "sketches")
    # a node is a set of shingles, by its hash; `name` is the smallest of the documents that have it
    first = sketches.where("size > 0").groupBy("node").agg(F.min(F.struct("name", "size", "sketch")).alias("first"), F.count("*").alias("copies"))
    nodes = common.written(first.select("node", "first.name", "copies", "first.size", "first.sketch"), "nodes")
    found = _linked(docs, nodes)
    components = common.written(connected_components(found.where("root != node").select(F.col("node").alias("u"), F.col("root").alias("v"))), "components")
    names = components.join(nodes.select("node", "name"), "node").groupBy("component").agg(F.min("name").alias("class_id"), F.count("*").alias("n"))
    classes = common.join_counted(components, names, "component", "n", components.count()).select("node", "class_id")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    settled = (
        nodes.select("node", "name", "copies")
        .join(classes, "node", "left")
        .join(counts, "node", "left")
        .select("node", F.coalesce("class_id", "name").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    )
    settled = common.written(settled, "settled")
    rows = sketches.select("doc_id", "name", "node", F.col("size").cast("long").alias("n_shingles"))
    linked = common.join_counted(rows.where("n_shingles > 0"), settled, "node", "copies", sketches.count()).select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), "n_shingles")
    return linked.unionByName(rows.where("n_shingles = 0").select("doc_id", F.col("name").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_shingles"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with one document of each class of linked documents: the one that names the class.

    Documents without links stay, those without words as well.  Rows that repeat
    an identifier stay or go together, and stay if one of them names its class.
    """
    name, kept = common.unused(df, "name", "kept")
    names = links(df, id_col, text_col).where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id"))).select(F.col("class_id").alias(kept)).dropDuplicates()
    named = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    out = df.withColumn(name, named)
    return out.join(names.hint("shuffle_hash"), F.col(name) == F.col(kept), "left_semi").drop(name)


def _node(members: np.ndarray) -> int:
    """64 bits for a set of shingles, given as sorted distinct hashes."""
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketches():
    factors = shingles.multipliers(COORDINATES, 29)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        hashes, offsets = shingles.shingle_hashes(texts)
        sets = [np.unique(hashes[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        full = np.flatnonzero(np.diff(offsets))
        sketch = np.zeros((len(texts), COORDINATES), dtype=np.uint32)
        if len(full):
            with np.errstate(over="ignore"):
                for c, factor in enumerate(factors):
                    sketch[full, c] = np.minimum.reduceat(((hashes * factor) >> np.uint64(32)).astype(np.uint32), offsets[full])
        columns = [pa.array(list(map(_node, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.array([s.tobytes() for s in sketch], pa.binary())]
        return pa.record_batch([batch.column("doc_id"), batch.column("name"), *columns], ["doc_id", "name", "node", "size", "sketch"])

    return work


def _linked(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, links, root): for each bucket with links of a node, how many, and a smaller node it is connected to."""
    leaves = _leaves(nodes)
    every = leaves.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))  # at most runs x BRANCH ^ splits keys a node
    tagged = leaves.join(nodes.select("node", "copies", "size", "sketch").join(every, "node"), "node").select("part", "key", "side", "node", "keys", "copies", "size", "sketch")
    schema = "part long, key long, side int, node long, keys array<long>, copies long, size int"
    likely = common.written(tagged.repartition("part").sortWithinPartitions("part", "node").mapInArrow(_by_part(_likely), schema), "likely")
    common.discard(leaves)
    wanted = common.written(likely.select("node").distinct().join(nodes.select("node", "name"), "node").select("node", F.col("name").alias("of")), "wanted")
    bits = common.bloom_filter(wanted.select("of"), BITS_PER_SET)
    # texts that nothing asks for stay where they are; the hint keeps one plan at every size: the rest is hashed to
    # where the wanted names are, never sorted.  Rows that repeat identifier and text count once.
    asked = common.may_have(docs.select("name", "text"), "name", bits)
    texts = asked.join(wanted.hint("shuffle_hash"), F.col("name") == F.col("of")).select("name", "node", "text", F.xxhash64("text").alias("h"))
    texts = texts.groupBy("name", "node", "h").agg(F.first("text").alias("text")).select("node", "text")
    filled = likely.join(common.map_arrow(texts, _sets, "node long, members binary"), "node")
    columns = "part", "key", "side", "node", "keys", "copies", "size", "members"
    found = common.written(filled.select(*columns).repartition("part").sortWithinPartitions("part", "node").mapInArrow(_by_part(_verified), "node long, links long, root long"), "links")
    common.discard(likely, wanted)
    return found


def _leaves(nodes: DataFrame) -> DataFrame:
    """(part, key, side, node): buckets to compare, in parts of at most BLOCK sets a side."""
    runs = runs_needed()
    #: rows that go on: bucket, coordinates used on its path, sets in the parent
    open_ = nodes.select("node", "sketch", F.explode(F.array(*[F.lit(r + 1).cast("long") for r in range(runs)])).alias("key"), F.lit(0).cast("long").alias("used"), F.lit(-1).cast("long").alias("parent"))
    done: list[DataFrame] = []
    used_up: list[DataFrame] = []
    for depth in range(MOST_SPLITS):
        children = common.written(common.map_arrow(open_, _split, "node long, key long, used long, parent long"), "buckets")
        sizes = children.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        sized = common.written(common.join_counted(children, sizes, "key", "n", children.count()), "sized")
        common.discard(children)
        used_up.append(sized)
        end = (F.col("n") <= LEAF) | ((F.col("parent") > 0) & (F.col("n") > DENSE * F.col("parent"))) | F.lit(depth == MOST_SPLITS - 1)
        done.append(sized.where(end).select("node", "key", "n"))
        rest = sized.where(~end)
        if rest.isEmpty():
            break
        open_ = rest.select("node", "key", "used", F.col("n").alias("parent")).join(nodes.select("node", "sketch"), "node").select("node", "sketch", "key", "used", "parent")
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.unionByName(more)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = leaves.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    part = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high))
    #: side 0 and 1 of a part of two blocks are compared with each other only, side 2 with itself
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") == high).cast("int"))
    out = common.written(spread.select(part.alias("part"), "key", side.cast("int").alias("side"), "node"), "leaves")
    common.discard(*used_up)
    return out


def _split():
    """Deals each row to BRANCH children of its bucket, by coordinates that the bucket's path chooses."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, key, used, parent = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "key", "used", "parent"))
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
        taken = (used.view(np.uint64)[:, None] >> np.arange(COORDINATES, dtype=np.uint64)[None, :]) & np.uint64(1)
        with np.errstate(over="ignore"):
            order = shingles.mixed(key.view(np.uint64)[:, None] + np.arange(1, COORDINATES + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
        order = np.where(taken == 1, np.uint64(2**64 - 1), order)
        chosen = np.argsort(order, axis=1, kind="stable")[:, :BRANCH]
        rows = []
        for b in range(BRANCH):
            c = chosen[:, b]
            value = sketch[np.arange(len(c)), c].astype(np.uint64)
            with np.errstate(over="ignore"):
                child = shingles.mixed(key.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + shingles.mixed((c.astype(np.uint64) + np.uint64(1)) << np.uint64(32) | value))
            rows.append((node, child.view(np.int64), (used.view(np.uint64) | (np.uint64(1) << c.astype(np.uint64))).view(np.int64), parent))
        return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["node", "key", "used", "parent"])

    return work


def _by_part(compare):
    """Runs `compare` on the rows of each part; rows come by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").to_numpy(zero_copy_only=False)
            last = int((part == part[-1]).argmax())  # where the last part begins; it may go on in the next batch
            if held and (last or part[0] != held[-1].column("part")[0].as_py()):
                yield from compare(_whole([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            elif last:
                yield from compare(_whole([batch.slice(0, last)]))
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield from compare(_whole(held))

    return run


def _whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of all; columns of bytes may exceed 2 GiB together."""
    table = pa.Table.from_batches(batches)
    fields = [pa.field(f.name, pa.large_binary() if pa.types.is_binary(f.type) else f.type) for f in table.schema]
    (whole,) = table.cast(pa.schema(fields)).combine_chunks().to_batches()
    return whole


def _groups(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Row numbers of each part, a node once."""
    part, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "node"))
    first = np.ones(len(part), dtype=bool)
    first[1:] = (part[1:] != part[:-1]) | (node[1:] != node[:-1])
    rows = np.flatnonzero(first)
    cuts = np.flatnonzero(part[rows][1:] != part[rows][:-1]) + 1
    for group in np.split(rows, cuts):
        if len(group) > 1:
            yield group


class _Rows:
    """Columns of a batch that all comparisons need."""

    def __init__(self, batch: pa.RecordBatch):
        self.key, self.side, self.node, self.copies, self.size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "side", "node", "copies", "size"))
        keys = batch.column("keys")
        self.starts, self.keys = keys.offsets.to_numpy(), keys.values.to_numpy(zero_copy_only=False)

    def open_pairs(self, g: np.ndarray) -> np.ndarray:
        """Pairs of the group that count here: sizes allow the threshold, sides differ, and no lesser bucket has both."""
        a, b = THRESHOLD
        size = self.size[g].astype(np.int64)
        pairs = (size[:, None] * b >= size[None, :] * a) & (size[None, :] * b >= size[:, None] * a)
        side = self.side[g]
        if side[0] != 2:
            pairs &= side[:, None] != side[None, :]
        np.fill_diagonal(pairs, False)
        lesser = [self.keys[self.starts[i] : self.starts[i + 1]] for i in g]
        lesser = [k[k < self.key[g[0]]] for k in lesser]
        flat = np.concatenate(lesser)
        if len(flat):
            distinct, at = np.unique(flat, return_inverse=True)
            rows = np.repeat(np.arange(len(g)), [len(k) for k in lesser])
            shared = np.bincount(at, minlength=len(distinct)) > 1
            for low in range(0, len(distinct), 4096):
                here = (at >= low) & (at < low + 4096) & shared[at]
                if here.any():
                    table = np.zeros((len(g), 4096), dtype=np.float32)
                    table[rows[here], at[here] - low] = 1
                    pairs &= (table @ table.T) == 0
        return pairs


def _likely(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows whose tokens agree with another's often enough."""
    rows = _Rows(batch)
    sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
    keep: list[np.ndarray] = []
    for g in _groups(batch):
        own = sketch[g]
        agree = np.zeros((len(g), len(g)), dtype=np.uint8)
        for c in range(COORDINATES):
            agree += own[:, None, c] == own[None, :, c]
        near = agree >= AGREE
        np.fill_diagonal(near, False)
        if near.any():
            keep.append(g[(near & rows.open_pairs(g)).any(axis=1)])
    if keep and len(taken := np.concatenate(keep)):
        yield batch.take(pa.array(taken)).select(["part", "key", "side", "node", "keys", "copies", "size"])


def _sets():
    """Members of the sets that are asked for; a name may stand for other texts, too."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, offsets = shingles.shingle_hashes(batch.column("text").to_pylist())
        sets = [np.unique(hashes[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        own = np.array(list(map(_node, sets)), dtype=np.int64) == batch.column("node").to_numpy()
        return pa.record_batch([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "members"]).filter(pa.array(own))

    return work


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    if len(sets) <= 3:
        out = np.zeros((len(sets), len(sets)), dtype=np.int64)
        for i, a in enumerate(sets):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(a, sets[j], assume_unique=True))
        return out
    sizes = [len(s) for s in sets]
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(often > 1) - 1  # members of one set only are never shared
    rows, shared = np.repeat(np.arange(len(sets)), sizes), (often > 1)[at]
    rows, at = rows[shared], column[at[shared]]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        a, b = np.searchsorted(at, [low, low + 4096])
        table = np.zeros((len(sets), 4096), dtype=np.float32)
        table[rows[a:b], at[a:b] - low] = 1
        out += table @ table.T
    return out.astype(np.int64)


def _verified(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Counts of verified links and a tree that connects them, one row for each linked set of a part."""
    rows = _Rows(batch)
    members = batch.column("members")
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    a, b = THRESHOLD
    for g in _groups(batch):
        sets = [np.frombuffer(members[int(i)].as_py(), dtype=np.uint64) for i in g]
        both = overlaps(sets)
        size = rows.size[g].astype(np.int64)
        linked = b * both >= a * (size[:, None] + size[None, :] - both)
        linked &= rows.open_pairs(g)
        if not linked.any():
            continue
        count = linked @ rows.copies[g]
        here = np.flatnonzero(linked.any(axis=1))
        out.append((rows.node[g][here], count[here], _roots(linked, rows.node[g])[here]))
    if out:
        yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "links", "root"])


def _roots(linked: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each row the smallest node that its links reach within the group."""
    root = node.copy()
    highest = np.iinfo(node.dtype).max
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], highest).min(axis=1))
        if (least == root).all():
            return root
        root = least
