"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of all labelled texts: a task adds them up per language and sends one
row per language and non-empty bucket, which are summed before and after the shuffle. The matrix of
log probabilities has as many numbers as languages times buckets; its size is checked before it is
broadcast. Scoring gathers the rows of a batch's n-grams and sums them per text.

Texts are lower-cased. A null text, and one without any letter, is ``und`` with score 0. Texts are
processed whole, long ones piece by piece. With nothing to learn from, every text is ``und``.
Equal scores go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceworks.llm.common import add_columns, column, slices

UNKNOWN = "und"
#: Code points of a text that are handled at a time, and n-grams scored at a time.
PIECE, BATCH = 1 << 20, 1 << 20
#: Numbers of the matrix at most (256 MB); more languages or buckets than that raise an error.
MATRIX = 1 << 25
#: Odd factors by which the code points of an n-gram are mixed.
MIX = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393))


def ngrams(text: str, sizes: Sequence[int], buckets: int) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in pieces."""

    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for start in range(0, len(codes), PIECE):
        for n in sizes:
            part = codes[start:start + PIECE + n - 1]
            if len(part) < n:
                continue
            count = len(part) - n + 1
            mixed = np.full(count, n, dtype=np.uint32)
            for k in range(n):
                mixed = (mixed ^ part[k:k + count]) * MIX[k]
            mixed ^= mixed >> np.uint32(15)
            yield ((mixed * MIX[0]) >> shift).astype(np.int32)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    matrix: np.ndarray  # buckets by languages, log probabilities
    prior: np.ndarray
    sizes: tuple[int, ...]


def fit_languages(df: DataFrame, text: str = "text", lang: str = "lang",
                  sizes: Sequence[int] = (1, 2, 3), buckets: int = 1 << 15,
                  smoothing: float = 0.1) -> LanguageModel:
    """Counts of all rows with text and language; ``buckets`` is a power of two."""

    sizes = tuple(sizes)
    rows = df.filter(column(lang).isNotNull() & column(text).isNotNull()).select(
        column(text).alias("t"), column(lang).cast("string").alias("l"))
    total = F.sum("c").cast("long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}

        def rows_of(language: str) -> pa.RecordBatch:
            found, where = sums.pop(language), np.flatnonzero
            at = where(found)
            return pa.RecordBatch.from_arrays([
                pa.array([language] * (len(at) + 1), pa.string()),
                pa.array(np.append(at, -1).astype(np.int32)),
                pa.array(np.append(found[at], texts.pop(language)).astype(np.int64))],
                names=["l", "b", "c"])

        for batch in slices(batches):
            for t, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                   strict=True):
                if language not in sums:
                    sums[language] = np.zeros(buckets, dtype=np.int64)
                    texts[language] = 0
                texts[language] += 1
                for b in ngrams(t, sizes, buckets):
                    if len(b) < 4096:
                        np.add.at(sums[language], b, 1)
                    else:
                        sums[language] += np.bincount(b, minlength=buckets)
            while len(sums) > 64:  # what a task holds stays bounded, however many languages
                yield rows_of(next(iter(sums)))
        for language in list(sums):
            yield rows_of(language)

    counts = rows.mapInArrow(count, "l string, b int, c long").groupBy("l", "b").agg(total.alias("c"))
    languages = sorted(r[0] for r in rows.select("l").distinct().limit(
        MATRIX // buckets + 1).collect())
    if len(languages) * buckets > MATRIX:
        raise ValueError(f"More than {MATRIX // buckets} languages; use fewer buckets.")
    place = {language: k for k, language in enumerate(languages)}
    sums = np.zeros((buckets, len(languages)))
    texts = np.zeros(len(languages))
    for language, b, c in counts.toLocalIterator() if languages else ():
        if b < 0:
            texts[place[language]] = c
        else:
            sums[b, place[language]] = c
    matrix = np.log((sums + smoothing) / (sums.sum(0) + smoothing * buckets))
    prior = np.log((texts + 1) / (texts.sum() + len(languages))) if languages else texts
    return LanguageModel(languages, matrix.astype(np.float32), prior, sizes)


def predict_languages(df: DataFrame, model: LanguageModel, text: str = "text",
                      out: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the likeliest language and its posterior probability."""

    sent = df.sparkSession.sparkContext.broadcast(
        (model.languages, model.matrix, model.prior, model.sizes))

    def start():
        import regex

        fitted, letter = LanguageModel(*sent.value), regex.compile(r"\p{L}").search
        buckets = len(fitted.matrix)

        def predict(texts: list[str | None]):
            sums = np.zeros((len(texts), len(fitted.languages)))
            known = [bool(fitted.languages and t and letter(t)) for t in texts]
            held: list[np.ndarray] = []
            owners: list[int] = []
            size = 0

            def score_batch() -> None:
                if held:
                    at = np.cumsum([0, *map(len, held)])[:-1]
                    found = np.add.reduceat(fitted.matrix[np.concatenate(held)], at, axis=0,
                                            dtype=np.float64)
                    np.add.at(sums, owners, found)
                held.clear()
                owners.clear()

            for k, t in enumerate(texts):
                for b in ngrams(t, fitted.sizes, buckets) if known[k] else ():
                    held.append(b)
                    owners.append(k)
                    size += len(b)
                    if size > BATCH:
                        score_batch()
                        size = 0
            score_batch()
            if not fitted.languages:
                return [UNKNOWN] * len(texts), [0.0] * len(texts)
            sums += fitted.prior
            best = sums.argmax(1)
            share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            return ([fitted.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)],
                    [float(s) if ok else 0.0 for s, ok in zip(share, known, strict=True)])

        return predict

    return add_columns(df, [text], [(out, "string"), (score, "double")], None, start=start)


def learnable(df: DataFrame, held_out: Column, lang: str = "lang") -> DataFrame:
    """Rows that may be learnt from: those with a language that are not held out."""

    return df.filter(~held_out & column(lang).isNotNull())
