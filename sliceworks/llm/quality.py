"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio between a trusted target and
the raw corpus.

Words and pairs of neighbouring words are hashed into two groups of buckets. The raw corpus'
multinomial counts every text; the target's counts the texts of trusted ids. Each bucket's weight is
the log of the target's smoothed probability over the raw one, and a text's score is the mean weight
of its n-grams, which does not depend on its length. A text is kept if its score is at least the
threshold, which is the same for every text.

All labelled rows count: the trusted ones for the target, those of either kind for the threshold. The
counts of the raw corpus cover all texts, added up within tasks before the shuffle. Up to ``LABELS``
labels are sent to every task; more meet their texts in a shuffled join, whose rows are written once
for the target and the threshold. Only the weights, a fixed number of buckets, reach the driver.

A null or empty text has no words: its counts are 0, its score is 0 and the base rules reject it.
Without trusted rows all weights are 0; without labels of both kinds the threshold is minus
infinity, so that the base rules decide alone. Repeated rows are judged each on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceworks.llm.common import WORD, add_columns, column, slices, word_finder
from sliceworks.session import written

SYMBOLS = "#*$%&|<>"
#: Words of which a task remembers the hash; the memory starts anew after a text that passes this.
VOCABULARY = 300_000
#: Labels that are sent to every task of a join, at most.
LABELS = 500_000
#: Bins of scores for the calibration, and the range that they divide.
BINS, RANGE = 4000, 4.0
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class WordIds:
    """Numbers words, and knows the hash of each number."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.hashes = np.zeros(1024, dtype=np.uint32)
        self.find = word_finder()

    def of(self, text: str) -> tuple[list[str], np.ndarray]:
        """The words of a text and their numbers; equal numbers are equal words."""

        import xxhash

        if len(self.numbers) > VOCABULARY:
            self.numbers.clear()
        words, numbers = self.find(text), self.numbers
        for word in set(words).difference(numbers):
            n = numbers[word] = len(numbers)
            if n >= len(self.hashes):
                self.hashes = np.append(self.hashes, np.zeros_like(self.hashes))
            self.hashes[n] = xxhash.xxh32_intdigest(word)
        return words, np.fromiter(map(numbers.__getitem__, words), dtype=np.int64,
                                  count=len(words))

    def buckets(self, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words and of the pairs of words; a power of two of each."""

        h = self.hashes[ids].astype(np.uint64)
        shift = np.uint64(64 - (buckets.bit_length() - 1))
        factor = np.uint64(0x9E3779B97F4A7C15)
        pairs = (h[:-1] * np.uint64(0x100000001B3)) ^ h[1:]
        return ((h * factor) >> shift).astype(np.int64), \
            ((pairs * factor) >> shift).astype(np.int64) + buckets


def repeated_words(ids: np.ndarray, window: int = 3) -> int:
    """Words that lie in windows found twice or more, the first time included."""

    n = len(ids) - window + 1
    if n < 2:
        return 0
    code = ids[:n]
    for k in range(1, window):  # numbers of the windows seen so far, then the next word
        code = np.unique(code, return_inverse=True)[1]
        code = code * (int(ids.max()) + 1) + ids[k:k + n]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    marks = np.zeros(len(ids) + 1, dtype=np.int64)
    twice = np.flatnonzero(counts[inverse] > 1)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + window, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def base_counts(text: str, words: list[str], ids: np.ndarray, has_word) -> tuple[int, ...]:
    """The five counts of the base rules."""

    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line in seen:
            repeated += 1
        elif has_word(line):
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated,
            repeated_words(ids))


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # of the words' buckets, then of the pairs' buckets
    threshold: float

    @property
    def buckets(self) -> int:
        return len(self.weights) // 2

    def score(self, words: WordIds, ids: np.ndarray) -> float:
        if not len(ids):
            return 0.0
        one, two = words.buckets(ids, self.buckets)
        return float((self.weights[one].sum() + self.weights[two].sum()) / (len(one) + len(two)))


def count_ngrams(df: DataFrame, text: str, corpus: str, trusted: str, buckets: int) -> np.ndarray:
    """Counts of all buckets in the rows whose ``corpus`` is true and in those whose ``trusted`` is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds()
        sums = np.zeros((2, 2 * buckets), dtype=np.int64)
        for batch in slices(batches):
            for t, *marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not t:
                    continue
                for b in words.buckets(words.of(t)[1], buckets):
                    for k in np.flatnonzero(marks):
                        np.add.at(sums[k], b, 1)
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(sums[0][at]), pa.array(sums[1][at])],
            names=["b", "raw", "target"])

    counts = df.select(column(text).alias("t"), column(corpus).alias("c"), column(trusted).alias("g")).mapInArrow(
        count, "b int, raw long, target long").groupBy("b").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    sums = np.zeros((2, 2 * buckets))
    for b, raw, target in counts.toLocalIterator():
        sums[:, b] = raw, target
    return sums


def log_ratios(sums: np.ndarray) -> np.ndarray:
    """Log of the target's probability over the raw one; the target leans on the raw counts as if it
    had seen each bucket once more, so that what it never saw stays finite."""

    weights, half = np.zeros(sums.shape[1]), sums.shape[1] // 2
    for part in (slice(0, half), slice(half, None)):
        raw, target = sums[0, part], sums[1, part]
        if target.sum():
            p = (raw + 1) / (raw.sum() + half)
            q = (target + half * p) / (target.sum() + half)
            weights[part] = np.log(q / p)
    return weights


def best_threshold(good: np.ndarray, bad: np.ndarray, edges: np.ndarray, cost: float) -> float:
    """The lowest edge with the least share of bad texts kept plus ``cost`` times that of good
    texts rejected; counts are per bin of scores."""

    if not good.sum() or not bad.sum():
        return float("-inf")
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    kept = 1 - np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    return float(edges[np.argmin(cost * lost + kept)])


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                label: str = "quality", buckets: int = 1 << 16, cost: float = 5.0,
                min_words: int = 50, repeat_percent: int = 50) -> QualityModel:
    """Weights and threshold from all labelled rows; of several labels of an id the least holds. Texts
    that the base rules reject do not calibrate."""

    known = labels.filter(column(label).isin(0, 1) & column(key).isNotNull()).groupBy(
        column(key).alias("k")).agg(F.min(column(label)).cast("int").alias("y"))
    texts = docs.select(column(key).alias("k"), column(text).alias("t"))
    if known.limit(LABELS + 1).count() <= LABELS:
        marked = texts.join(F.broadcast(known), "k", "left")
        counted = marked.select("t", F.lit(True).alias("c"), F.coalesce(F.col("y") == 1, F.lit(False)).alias("g"))
        labelled = marked.filter("y is not null")
    else:
        labelled = written(texts.join(known, "k"), "labelled")
        counted = texts.select("t", F.lit(True).alias("c"), F.lit(False).alias("g")).unionByName(
            labelled.filter("y = 1").select("t", F.lit(False).alias("c"), F.lit(True).alias("g")))
    weights = log_ratios(count_ngrams(counted, "t", "c", "g", buckets))
    scored = quality_columns(labelled, QualityModel(weights, float("-inf")), "t", min_words, repeat_percent)
    bins = scored.filter("not base_failed").select("y", F.least(F.greatest(F.floor(
        (F.col("quality_score") + RANGE) * (BINS / (2 * RANGE))), F.lit(0)), F.lit(BINS - 1)).alias("b"))
    counts = np.zeros((2, BINS))
    for y, b, n in bins.groupBy("y", "b").count().collect():
        counts[y, b] = n
    edges = np.linspace(-RANGE, RANGE, BINS + 1)
    return QualityModel(weights, best_threshold(counts[1], counts[0], edges, cost))


def quality_columns(df: DataFrame, model: QualityModel, text: str = "text", min_words: int = 50,
                    repeat_percent: int = 50) -> DataFrame:
    """Adds the five counts, ``base_failed``, ``quality_score`` and ``kept``."""

    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.threshold))

    def start():
        fitted, words, has_word = QualityModel(*sent.value), WordIds(), re.compile(WORD).search

        def judge(texts: list[str | None]):
            out = []
            for t in texts:
                t = t or ""
                found, ids = words.of(t)
                counts = base_counts(t, found, ids, has_word)
                failed = counts[0] < min_words or 100 * counts[4] > repeat_percent * counts[0]
                score = fitted.score(words, ids)
                out.append((*counts, failed, score, not failed and score >= fitted.threshold))
            return list(zip(*out, strict=True))

        return judge

    return add_columns(df, [text], [*((name, "bigint") for name in BASE),
                                    ("base_failed", "boolean"), ("quality_score", "double"),
                                    ("kept", "boolean")], None, start=start)
