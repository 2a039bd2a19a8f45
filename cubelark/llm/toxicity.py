"""Toxicity by class-conditional Kneser-Ney models.

Two models of words, one of toxic and one of ordinary documents, give every word
two log-likelihoods.  The contexts of a word are the documents it stands in.  A
class's own counts are discounted, and what that frees is dealt out by counts
that both classes share: in how many documents a word occurs, whatever their
class (the continuation counts), and below that evenly.  A word that is rare in
both classes so rests on common ground and counts for neither.

    P(w | class) = max(n(w) - D, 0) / n + g * Q(w),   g = sum of min(n(v), D) over all v / n
    Q(w) = max(c(w) - d, 0) / c + h / (V + 1),        h = d V / c

n(w) is how often the class has the word, c(w) how many documents of both have it,
n and c their sums, V the number of distinct words; d is smaller than 1.

Of a document the difference of its length-normalised log-likelihoods counts, as
a whole and over its most telling words, put on a 0 to 1 scale by a logistic
calibration on labelled documents that the models have not seen.

Counts come from all labelled documents of the training folds, keyed by the words
themselves: a table of one row per distinct word that grows with the input.  To
count, texts move to their labels; a Bloom filter of the labelled identifiers
keeps the rest where it is.  To score, workers get the TABLE_WORDS most frequent
words at most, all other words are joined, so what is broadcast is bounded and
the scores do not depend on the bound.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Taken off the classes' counts and off the shared ones.  What one class has seen once or twice counts for neither.
CLASS_DISCOUNT = 2.5
SHARED_DISCOUNT = 0.75
#: Words whose scores are broadcast at most.
TABLE_WORDS = 1 << 18
#: Distinct words that a task counts before it passes them on.
COUNTED_WORDS = 200_000
#: Bits of the Bloom filter for each label.
BITS_PER_LABEL = 10
#: Scores of words are whole numbers of this part, so sums do not depend on their order.
UNIT = 1e-9
#: Labelled documents that the calibration is fitted on at most.
CALIBRATION_DOCUMENTS = 6_000

WORD = re.compile(r"\w+")
FEATURES = ("bias", "mean", "first", "second", "third", "telling", "length")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Model:
    """Log ratios of the words that either class has seen more than CLASS_DISCOUNT times, those of all other words, and the calibration's weights.

    `words` has word, n (occurrences in training) and for each name in MODELS ratio_*: what the
    word's log ratio has over that of any other word (`rest`), in UNIT.
    """

    words: DataFrame
    rest: dict[str, int]
    weights: np.ndarray = field(default_factory=lambda: np.array([-1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0]))

    def discard(self) -> None:
        common.discard(self.words)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Logistic regression with a small quadratic penalty, by Newton's method."""
    if not len(y) or y.min() == y.max():
        return start
    w, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(30):
        p = logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fold(column: str = "doc_id"):
    """crc32 of the identifier as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


#: Toxic and ordinary occurrences of a word and the documents that have it, for either half of the training folds.
COUNTS = ("toxic_1", "ordinary_1", "documents_1", "toxic_2", "ordinary_2", "documents_2")
#: Models by name and the halves they are counted on: for the calibration the other half, and both.
MODELS = {"1": (2,), "2": (1,), "all": (1, 2)}


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of all labelled documents of folds 1 to 4.

    For the calibration each half of these folds is scored by a model of the other half, on a
    bounded sample.  Identifiers only select rows.  Rows without identifier or label are not
    learnt from; rows that repeat an identifier are all learnt from.
    """
    marks = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("label IN (0, 1) AND doc_id IS NOT NULL")
        .withColumn("fold", fold())
        .where("fold > 0")
        .select("doc_id", "label", F.when(F.col("fold") <= 2, 1).otherwise(2).alias("half"))
    )
    docs = common.documents(df, id_col, text_col)
    asked = common.may_have(docs.where("doc_id IS NOT NULL"), "doc_id", common.bloom_filter(marks.select("doc_id"), BITS_PER_LABEL))
    # words travel compressed to the labels, and the hint keeps one plan at every size
    marked = common.map_arrow(asked, _packed_words, "doc_id long, words binary").join(marks.hint("shuffle_hash"), "doc_id").select("words", "label", "half")
    counts = common.written(marked.mapInArrow(_count_words, "word string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS]), "counts")
    model = kneser_ney(counts)
    common.discard(counts)

    draw = F.broadcast(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_DOCUMENTS))
    sample = common.written(docs.join(draw, "doc_id").select("text", "label", "half"), "sample")
    x, y = [], []
    for half in (1, 2):
        frame, base = _scored(sample.where(F.col("half") == half), model, str(half), ["label"])
        drawn = frame.select("features", "label").orderBy(F.xxhash64("features"), "features", "label").limit(CALIBRATION_DOCUMENTS)  # identifiers may repeat
        for row in sorted([*map(float, r.features), r.label] for r in drawn.collect()):
            x.append(row[:-1])
            y.append(row[-1])
        common.discard(base)
    common.discard(sample)
    model.weights = calibrate(np.array(x).reshape(len(y), len(FEATURES)), np.array(y, dtype=float), model.weights)
    return model


def _packed_words():
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [zlib.compress(" ".join(words_of(t)).encode("utf-8", "surrogatepass"), 1) for t in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "words"])

    return work


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the documents by half and label, counted before they are shuffled."""
    counts: list[Counter[str]] = [Counter() for _ in COUNTS]

    def take() -> pa.RecordBatch:
        every = list(set().union(*counts))
        out = pa.record_batch([pa.array(every, pa.string()), *[pa.array([c[w] for w in every], pa.int64()) for c in counts]], ["word", *COUNTS])
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for packed, label, half in zip(*(batch.column(c) for c in ("words", "label", "half")), strict=True):
            words = zlib.decompress(packed.as_py()).decode("utf-8", "surrogatepass").split()
            first = 3 * (half.as_py() - 1)
            counts[first + 1 - label.as_py()].update(words)
            counts[first + 2].update(set(words))
            if sum(map(len, counts)) > COUNTED_WORDS:
                yield take()
    yield take()


def kneser_ney(counts: DataFrame) -> Model:
    """The models of a table of word and COUNTS."""
    own = {f"{c}_{name}": sum((F.col(f"{kind}_{h}") for h in halves), F.lit(0)) for name, halves in MODELS.items() for c, kind in (("t", "toxic"), ("o", "ordinary"), ("d", "documents"))}
    counts = counts.select("word", *[v.cast("double").alias(c) for c, v in own.items()])
    off = {c: SHARED_DISCOUNT if c.startswith("d") else CLASS_DISCOUNT for c in own}
    sums = counts.agg(*[F.coalesce(f(v), F.lit(0.0)).alias(f"{s}_{c}") for c in own for s, f, v in (("all", F.sum, F.col(c)), ("off", F.sum, F.least(F.col(c), F.lit(off[c]))), ("seen", F.sum, (F.col(c) > 0).cast("double")))]).first()
    ratios, rest = [], {}
    for name in MODELS:
        share = {c: (sums[f"off_{c}_{name}"] / sums[f"all_{c}_{name}"] if sums[f"all_{c}_{name}"] else 1.0) for c in "tod"}
        kept = {c: F.greatest(F.col(f"{c}_{name}") - off[f"{c}_{name}"], F.lit(0.0)) / max(sums[f"all_{c}_{name}"], 1.0) for c in "tod"}
        base = kept["d"] + share["d"] / (sums[f"seen_d_{name}"] + 1)
        rest[name] = round((math.log(share["t"]) - math.log(share["o"])) / UNIT)
        ratio = F.log(kept["t"] + share["t"] * base) - F.log(kept["o"] + share["o"] * base)
        ratios.append((F.round(ratio / UNIT).cast("long") - rest[name]).alias(f"ratio_{name}"))
    told = counts.where((F.col("t_all") > CLASS_DISCOUNT) | (F.col("o_all") > CLASS_DISCOUNT))  # all others have the ratio `rest`
    return Model(common.written(told.select("word", (F.col("t_all") + F.col("o_all")).cast("long").alias("n"), *ratios), "model"), rest)


def _frequent(words: DataFrame, name: str, most: int) -> tuple[dict[str, int], bool]:
    """Ratios of at most `most` words, all that are more frequent than some number; and whether that is all words."""
    steps = F.when(F.col("n") < 64, F.col("n")).otherwise((F.log2("n") * 11).cast("long"))
    ranks = words.groupBy(steps.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()  # some hundred rows at most
    total, least = 0, None
    for row in ranks:
        total += row.words
        if total > most:
            break
        least = row.step
    if least is None:
        return {}, not ranks
    table = words.where(steps >= least).select("word", F.col(f"ratio_{name}").alias("ratio")).toArrow()
    return dict(zip(table.column("word").to_pylist(), table.column("ratio").to_pylist(), strict=True)), total <= most


#: What a worker knows of a document, and the words whose scores are joined.
_PARTIAL = "words long, sum long, telling long, top array<long>, rest array<struct<word:string,n:long>>"


def _scored(rows: DataFrame, model: Model, name: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """`rows` with features instead of text, and the written table they are read from.

    Features are what the calibration sees of a document: never its label, language, source or identifier.
    """
    frequent, complete = _frequent(model.words, name, TABLE_WORDS)
    shared = rows.sparkSession.sparkContext.broadcast(frequent)
    over = round(2.0 / UNIT)

    def make():
        table = shared.value

        def partial(text: str) -> tuple:
            words = words_of(text)
            total = telling = 0
            top, rest = [], []
            for word, n in Counter(words).items():
                ratio = table.get(word)
                if ratio is None:
                    if not complete:
                        rest.append({"word": word, "n": n})
                    continue
                total += n * ratio
                top.append(ratio)
                if ratio > over:
                    telling += n * ratio
            return len(words), total, telling, sorted(top, reverse=True)[:3], rest

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(zip(*map(partial, batch.column("text").to_pylist()), strict=True))
            types = [*[pa.int64()] * 3, pa.list_(pa.int64()), pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))]
            return pa.record_batch([*[batch.column(c) for c in keep], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [*keep, "words", "sum", "telling", "top", "rest"])

        return work

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", " + _PARTIAL
    base = common.written(common.map_arrow(rows, make, schema).withColumn("row", F.monotonically_increasing_id()), "documents")
    value = F.col("n") * F.col("ratio")
    ratios = model.words.select("word", F.col(f"ratio_{name}").alias("ratio"))
    joined = base.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n").join(ratios, "word")
    found = joined.groupBy("row").agg(F.sum(value).alias("more"), F.sum(F.when(F.col("ratio") > over, value).otherwise(0)).alias("more_telling"), F.slice(F.sort_array(F.collect_list("ratio"), False), 1, 3).alias("more_top"))
    whole = base.join(found, "row", "left")
    total, telling = F.col("sum") + F.coalesce("more", F.lit(0)), F.col("telling") + F.coalesce("more_telling", F.lit(0))
    top = F.sort_array(F.concat("top", F.coalesce("more_top", F.array().cast("array<long>"))), False)
    best = [F.coalesce(F.greatest(F.lit(-4.0), F.least(F.get(top, F.lit(i)) * F.lit(UNIT), F.lit(12.0))), F.lit(0.0)) for i in range(3)]
    known = F.array(F.lit(1.0), (total / F.col("words") + F.lit(model.rest[name])) * F.lit(UNIT), *best, F.log1p(telling * F.lit(UNIT)), F.log1p(F.col("words").cast("double")))
    none = F.array(F.lit(1.0), *[F.lit(0.0)] * (len(FEATURES) - 1))
    return whole.select(*keep, F.when(F.col("words") > 0, known).otherwise(none).alias("features")), base


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 from 0.5 on), log_ratio.

    A null or empty text has no words and gets the score of no evidence.  `log_ratio` is
    the difference of the log-likelihoods per word, in nats.  Repeated rows are each scored.
    """
    x, _ = _scored(common.documents(df, id_col, text_col), model, "all", ["doc_id"])
    z = sum((F.col("features")[i] * F.lit(float(w)) for i, w in enumerate(model.weights)), F.lit(0.0))
    value = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return x.select("doc_id", value.alias("score"), F.col("features")[1].alias("log_ratio")).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "log_ratio")
