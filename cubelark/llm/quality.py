"""Quality rules: a linear-chain CRF labels lines, content share decides.

Each line of a document is content or boilerplate.  A linear-chain conditional
random field over simple line features is trained here on documents labelled
good or bad; Viterbi decoding labels the lines of all documents.  A document
stays if the lines labelled content hold at least CONTENT_SHARE of its characters
and no base rule rejects it.

Nobody labels lines, so these are latent (hard expectation maximisation under the
documents' labels): the field is fitted to line labels, lines then get the label
that is likelier under it and their document's label together, and a good document
must hold at least CONTENT_SHARE of content, a bad one less.  The first field knows
no neighbours, so that lines of one document can part; the later ones learn from
sequences that mix both labels.  Documents that a base rule rejects are bad
whatever their lines are like, so nothing is learnt from these.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed: what separates words, and the characters that count as symbols.
WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = "#*$%&|<>"
#: Fixed base rule: fewest words, and the largest share (in hundredths) of words in repeated 3-word windows.
LEAST_WORDS = 50
MOST_REPEATED = 50

#: Documents that the CRF is fitted on at most, all their lines; steps of one fit, and how often lines are labelled anew.
FIT_DOCUMENTS = 4_000
EPOCHS = 60
ROUNDS = 4
#: Lines of one training sequence; longer documents are several sequences.
SEQUENCE_LINES = 64
#: What a document's label adds to the log odds of its lines in training.
DOCUMENT_ODDS = 1.0
#: Share of a document's non-space characters that must be in content lines.
CONTENT_SHARE = 0.5

FEATURES = (
    "bias", "few_words", "many_words", "short_words", "long_words", "symbols", "many_symbols", "upper", "digits",
    "marks", "repeats", "all_repeats", "bars", "seen_line", "stop_end", "starts_upper", "first_line", "last_line",
)


def line_features(words: list[str], text: str, seen: bool, first: bool, last: bool) -> tuple[float, ...]:
    """Features of one line with at least one word."""
    n, chars = len(words), sum(map(len, words))
    letters = sum(map(str.isalpha, text))
    symbols = chars - len("".join(words).translate(_NO_SYMBOLS))
    distinct = len(set(words))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    marked = sum(not w[-1].isalnum() and not w[-1] in ".,;:?" for w in words)
    mean = chars / n
    return (
        1.0,
        float(n < 5),
        float(n > 12),
        float(mean < 3),
        float(mean > 9),
        float(symbols > 0.02 * chars),
        float(symbols > 0.1 * chars),
        float(upper > 0.5 * n),
        float(letters < 0.6 * chars),
        float(marked > 0.3 * n),
        float(n >= 6 and distinct < 0.6 * n),
        float(n >= 6 and distinct < 0.3 * n),
        float("|" in text),
        float(seen),
        float(text.rstrip()[-1:] in (".", "!", "?")),
        float(words[0][0].isupper()),
        float(first),
        float(last),
    )


_NO_SYMBOLS = {ord(c): None for c in SYMBOLS}


def statistics(text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
    """([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words], line features, characters of these lines)."""
    lines = text.split("\n")
    seen: set[str] = set()
    features: list[tuple[float, ...]] = []
    sizes: list[int] = []
    words: list[str] = []
    duplicates = 0
    for line in lines:
        own = WORD.findall(line)
        if not own:
            continue
        again = line in seen
        duplicates += again
        seen.add(line)
        features.append(line_features(own, line, again, not sizes, False))
        sizes.append(sum(map(len, own)))
        words += own
    if features:
        features[-1] = (*features[-1][:-1], 1.0)
    symbols = len(text) - len(text.translate(_NO_SYMBOLS))
    counts = [len(words), sum(sizes), symbols, duplicates, repeated_words(words)]
    return counts, np.array(features, dtype=np.float32).reshape(len(sizes), len(FEATURES)), np.array(sizes, dtype=np.int64)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more in the text, the first occurrence included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0  # covered: the first word not counted yet
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(covered, i)
            covered = i + 3
    return total


class Crf:
    """Two labels, 0 boilerplate and 1 content; emission weights per label and a transition matrix."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray):
        self.emission, self.transition = emission, transition

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The likeliest labels of a line sequence; of equal ones, content."""
        scores = (features @ self.emission.T).tolist()
        (t00, t01), (t10, t11) = self.transition.tolist()
        bad, good = scores[0]
        back: list[tuple[bool, bool]] = []
        for a, b in scores[1:]:
            from0, from1 = good + t10 >= bad + t00, good + t11 >= bad + t01
            bad, good = (good + t10 if from0 else bad + t00) + a, (good + t11 if from1 else bad + t01) + b
            back.append((from0, from1))
        labels = [good >= bad]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return np.array(labels[::-1], dtype=bool)


def fit(documents: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rounds: int = ROUNDS) -> Crf:
    """The field after `rounds` of labelling lines; `documents`: line features, characters of the lines, and label of each."""
    documents = [d for d in documents if len(d[0])]
    if len({y for _, _, y in documents}) < 2:
        emission = np.zeros((2, len(FEATURES)))
        emission[1, 0] = 1.0  # nothing to tell the labels apart: all lines are content
        return Crf(emission, np.zeros((2, 2)))
    x, sizes = np.concatenate([f for f, _, _ in documents]).astype(float), np.concatenate([s for _, s, _ in documents])
    lengths, y = np.array([len(f) for f, _, _ in documents]), np.array([v for _, _, v in documents])
    of = np.repeat(np.arange(len(y)), lengths)
    weight = (0.5 / np.array([np.mean(y == v) for v in (0, 1)]))[y][of]
    sequences = _Sequences(lengths)
    labels = y[of]
    crf = sequences.fit(x, labels, weight, epochs, chained=False)
    for _ in range(rounds):
        labels = constrained(sequences.odds(crf, x) + DOCUMENT_ODDS * (2 * y[of] - 1), sizes, of, y)
        crf = sequences.fit(x, labels, weight, epochs, chained=True)
    return crf


def constrained(odds: np.ndarray, sizes: np.ndarray, of: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The likelier label of each line, but a good document has at least CONTENT_SHARE of its characters in content, a bad one less.

    Where that fails, the lines that are nearest to the other label change over.
    """
    labels = (odds >= 0).astype(int)
    total = np.bincount(of, sizes, len(y))
    short = np.bincount(of, sizes * labels, len(y)) >= CONTENT_SHARE * total
    for d in np.flatnonzero(short != (y == 1)):
        lines = np.flatnonzero(of == d)
        for i in lines[np.argsort(-odds[lines] * (2 * y[d] - 1), kind="stable")]:
            labels[i] = y[d]
            if (sizes[lines] @ labels[lines] >= CONTENT_SHARE * total[d]) == (y[d] == 1):
                break
    return labels


class _Sequences:
    """Line sequences of at most SEQUENCE_LINES, longest first.

    Lines are named by their place in the list of all lines; `steps[i]` are the i-th lines of the
    sequences that have one, and as sequences are sorted, steps[i + 1][j] follows steps[i][j].
    """

    def __init__(self, lengths: np.ndarray):
        starts = np.cumsum(lengths) - lengths
        parts = [(s + k, min(SEQUENCE_LINES, n - k)) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True) for k in range(0, n, SEQUENCE_LINES)]
        parts.sort(key=lambda part: -part[1])
        first, size = np.array(parts).T
        self.steps = [first[size > i] + i for i in range(size[0])]
        self.after = np.concatenate(self.steps[1:]) if len(self.steps) > 1 else np.zeros(0, dtype=int)
        self.before, self.last = self.after - 1, first + size - 1
        self.of = np.repeat(np.arange(len(size)), size)[np.argsort(np.concatenate([np.arange(f, f + n) for f, n in parts]))]

    def expected(self, crf: Crf, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over all sequences in step: log probabilities of each line's labels, and of those of neighbours."""
        s = x @ crf.emission.T
        alpha, beta = s.copy(), np.zeros_like(s)
        for now in self.steps[1:]:
            alpha[now] += np.logaddexp.reduce(alpha[now - 1][:, :, None] + crf.transition, axis=1)
        log_z = np.logaddexp.reduce(alpha[self.last], axis=1)[self.of]
        for now in self.steps[:0:-1]:
            beta[now - 1] = np.logaddexp.reduce(crf.transition + (s[now] + beta[now])[:, None, :], axis=2)
        pair = alpha[self.before][:, :, None] + crf.transition + (s + beta)[self.after][:, None, :] - log_z[self.after][:, None, None]
        return alpha + beta - log_z[:, None], pair

    def odds(self, crf: Crf, x: np.ndarray) -> np.ndarray:
        """Log odds of content of each line."""
        single, _ = self.expected(crf, x)
        return single[:, 1] - single[:, 0]

    def fit(self, x: np.ndarray, labels: np.ndarray, weight: np.ndarray, epochs: int, chained: bool) -> Crf:
        """Maximum likelihood with a quadratic penalty, by Adam on all sequences at once; unless `chained` without transitions."""
        k = x.shape[1]
        crf = Crf(np.zeros((2, k)), np.zeros((2, 2)))
        own = np.eye(2)[labels]
        seen_e = (own * weight[:, None]).T @ x
        inner = weight[self.after][:, None, None]
        seen_t = (own[self.before][:, :, None] * own[self.after][:, None, :] * inner).sum(0)
        m, v = [np.zeros((2, k)), np.zeros((2, 2))], [np.zeros((2, k)), np.zeros((2, 2))]
        for t in range(1, epochs + 1):
            single, pair = self.expected(crf, x)
            grads = [((np.exp(single) * weight[:, None]).T @ x - seen_e) / weight.sum() + 1e-3 * crf.emission, ((np.exp(pair) * inner).sum(0) - seen_t) / weight.sum() + 1e-3 * crf.transition]
            for j, (param, g) in enumerate(list(zip((crf.emission, crf.transition), grads, strict=True))[: 1 + chained]):
                m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.99 * v[j] + 0.01 * g * g
                param -= 0.2 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-8)
        return crf


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Crf:
    """Fits the CRF on at most FIT_DOCUMENTS labelled documents, drawn by a hash of the identifier.

    The sample is bounded whatever the input; it is all that reaches the driver.  Rows that repeat an
    identifier count as so many documents; without labels of both kinds all lines are content.
    """
    docs = common.documents(df, id_col, text_col)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IS NOT NULL AND doc_id IS NOT NULL")
    draw = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCUMENTS)
    sample = common.map_arrow(docs.join(F.broadcast(draw), "doc_id"), _featured, "label int, features binary, sizes binary")
    rows = sample.orderBy(F.xxhash64("features"), "features", "label").limit(FIT_DOCUMENTS).collect()  # identifiers may repeat
    return fit([(np.frombuffer(r.features, dtype=np.float32).reshape(-1, len(FEATURES)), np.frombuffer(r.sizes, dtype=np.int64), r.label) for r in rows])


def _featured():
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(t) for t in batch.column("text").to_pylist()]
        judged = pa.array([not base_failed(counts) for counts, _, _ in found])
        columns = [batch.column("label"), pa.array([f.tobytes() for _, f, _ in found], pa.binary()), pa.array([s.tobytes() for _, _, s in found], pa.binary())]
        return pa.record_batch(columns, ["label", "features", "sizes"]).filter(judged)

    return work


def base_failed(counts: list[int]) -> bool:
    return counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]


def assess(df: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the counts, base_failed, content_share, line_labels and kept.

    A null or empty text has no words, fails the base rule and is not kept.
    `line_labels` has one character per line with a word, C for content, B for boilerplate.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, line_labels string, kept boolean"

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in range(9)]
            for text in batch.column("text").to_pylist():
                row = judge(text, crf)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            names = [c.split()[0] for c in schema.split(", ")]
            return pa.record_batch([batch.column("doc_id"), *map(pa.array, columns)], names)

        return work

    return common.map_arrow(common.documents(df, id_col, text_col), make, schema)


def judge(text: str, crf: Crf) -> tuple:
    counts, features, sizes = statistics(text)
    failed = base_failed(counts)
    if len(sizes):
        labels = crf.viterbi(features)
        share = float(sizes[labels].sum() / sizes.sum())
    else:
        labels, share = np.zeros(0, dtype=bool), 0.0
    return (*counts, failed, round(share, 6), "".join("BC"[v] for v in labels.astype(int)), not failed and share >= CONTENT_SHARE)


def keep_good(df: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` without the rows that `assess` rejects; judged where they are read, nothing is shuffled."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                keep = [judge(t or "", crf)[-1] for t in part.column(text_col).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
