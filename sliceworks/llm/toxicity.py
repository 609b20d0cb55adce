"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

The ordinary dictionary holds words of ordinary texts. The toxic one holds, in front of the same
words, a dictionary trained on toxic text: on the words whose smoothed share of the toxic texts is,
beyond chance, a multiple of that of the ordinary ones. It grows with these words, and holds them all;
they are left out of the ordinary words. Every window of a text is compressed with either; the bytes that the toxic
dictionary saves are the window's margin. As both dictionaries end alike, a window without toxic
words compresses alike. A logistic regression on the margins of held-back labelled texts calibrates
the score, weighted to the labels' frequencies.

The labelled rows used are a bounded sample of either class, those whose ids hash lowest; one half
trains the dictionaries, the other calibrates. Texts are scored whole. Null and empty texts are one
empty window and get the score of a text without margins. Without labels of both classes every score
is 0. Repeated rows are scored each on its own.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceworks.llm.common import add_columns, column, int_lists

#: Words of a window, and bytes after which a longer one is cut.
WINDOW, WINDOW_BYTES = 16, 1024
#: Bytes of the trained dictionary, at least, and of the ordinary words.
TOXIC_BYTES, ORDINARY_BYTES = 1024, 65536
#: How many times as frequent in toxic texts a word to be learnt is, at the lower bound of its
#: smoothed ratio by so many standard errors, and what is added to its counts.
RATIO, ERRORS, SMOOTH = 2.0, 1.96, 0.5
#: Words taken from one ordinary text for the ordinary dictionary.
WORDS_A_TEXT = 40
STEPS = (2, 4, 6, 8)


def windows(text: str | None) -> list[bytes]:
    """Lower-cased windows of a text, each word after a blank; an empty text has one, empty."""

    words = (text or "").lower().encode("utf-8", "replace").split()
    out = []
    for k in range(0, max(1, len(words)), WINDOW):
        part = b"".join(b" " + w for w in words[k:k + WINDOW])
        out.extend(part[i:i + WINDOW_BYTES] for i in range(0, max(1, len(part)), WINDOW_BYTES))
    return out


def compressor(content: bytes):
    """Compresses with these bytes as what came before; frames carry nothing but the data."""

    import zstandard as zstd

    bits = len(content).bit_length()  # reach and tables cover all of it
    settings = zstd.ZstdCompressionParameters(
        compression_level=3, strategy=zstd.STRATEGY_LAZY2, min_match=5, window_log=max(18, bits + 1),
        chain_log=max(17, bits), hash_log=max(17, bits), search_log=6, target_length=0, write_content_size=False,
        write_checksum=False, write_dict_id=False)
    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return zstd.ZstdCompressor(compression_params=settings, dict_data=dictionary)


def margin_function(toxic: bytes, ordinary: bytes) -> Callable[[str | None], np.ndarray]:
    """Bytes that the toxic dictionary saves in each window of a text."""

    if not toxic:
        return lambda text: np.zeros(len(windows(text)), dtype=np.int64)
    with_toxic, without = compressor(toxic + ordinary).compress, compressor(ordinary).compress

    def margins(text: str | None) -> np.ndarray:
        return np.array([len(without(w)) - len(with_toxic(w)) for w in windows(text)])

    return margins


def features(margins: np.ndarray) -> list[float]:
    """What the score is calibrated on: largest and mean margins, and shares of large ones."""

    top, n = np.sort(margins)[::-1], len(margins)
    return [float(top[0]), float(top[:3].mean()), float(top.mean()),
            *(float((top >= s).mean()) for s in STEPS), float(np.log1p(n)),
            float(top[0] - 2 * np.log1p(n))]


def train_dictionary(words: Sequence[tuple[str, int]], least: int, seed: int = 0) -> bytes:
    """A dictionary of words that occur in so many texts each, at least so many bytes, or twice the
    words; those that training leaves out come behind it."""

    import zstandard as zstd

    many = [b" " + w.encode() for w, n in sorted(words) for _ in range(n)]
    random.Random(seed).shuffle(many)
    samples = [b"".join(many[k:k + 4]) for k in range(0, len(many), 4)]
    often = [b" " + w.encode() for w, _ in sorted(words, key=lambda x: (-x[1], x[0]))]
    try:
        trained = zstd.train_dictionary(max(least, 2 * sum(map(len, often))), samples, k=16, d=6).as_bytes()
    except zstd.ZstdError:  # too few to train
        trained = b""
    return trained + b"".join(w for w in often if w not in trained)


@dataclass(frozen=True)
class ToxicModel:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features, then the intercept

    def score(self, found: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(found))
        z = (found - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3):
    """Mean, scale and weights of a ridge-penalised logistic regression, by Newton's method."""

    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), ridge * weight.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + penalty * w
        w = w - np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z
                                + penalty * np.eye(len(w)), gradient)
    return mean, scale, w


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                 label: str = "toxic", sample: int = 3000) -> ToxicModel:
    """Dictionaries and calibration from at most ``sample`` toxic and twice as many ordinary rows."""

    known = labels.filter(column(label).isin(0, 1) & column(key).isNotNull()).groupBy(
        column(key).alias("k")).agg(F.max(column(label)).cast("int").alias("y"))
    order = F.xxhash64("k")
    chosen = known.filter("y = 1").orderBy(order, "k").limit(sample).unionByName(
        known.filter("y = 0").orderBy(order, "k").limit(2 * sample))  # at most thrice the sample
    rows = docs.select(column(key).alias("k"), column(text).alias("t")).filter("t is not null").join(
        F.broadcast(chosen), "k").withColumn("train", F.pmod(F.xxhash64("k", F.lit(1)), F.lit(2)) == 0)

    def distinct_words(texts: list[str]):
        found = [sorted(set(t.lower().split())) for t in texts]
        kept = []
        for t in texts:
            words = t.lower().split()
            kept.append(random.Random(len(t)).sample(words, min(WORDS_A_TEXT, len(words))))
        return found, kept

    # copies of a text count once; the sample is bounded, so dealing it by text is small
    train = rows.filter("train").groupBy(F.xxhash64("t").alias("h"), "y").agg(
        F.min(F.struct("k", "t")).alias("r")).select("r.k", "y", "r.t")
    worded = add_columns(train, ["t"],
                         [("words", "array<string>"), ("some", "array<string>")], distinct_words,
                         drop=["t"])
    texts = {y: n for y, n in train.groupBy("y").count().collect()}
    if not texts.get(0) or not texts.get(1):
        return no_model()
    a, b = F.col("toxic") + SMOOTH, F.col("ordinary") + SMOOTH
    ratio = F.log(a / (texts[1] + 2 * SMOOTH)) - F.log(b / (texts[0] + 2 * SMOOTH))
    learnt = worded.select("y", F.explode("words").alias("w")).groupBy("w").agg(
        F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("ordinary")).filter(
        ratio - ERRORS * F.sqrt(1 / a + 1 / b) >= float(np.log(RATIO)))
    words = [(w, n) for w, n in learnt.select("w", "toxic").collect()]  # of the bounded sample
    known_words = {w for w, _ in words}
    some = worded.filter("y = 0").orderBy(F.xxhash64("k", F.lit(2)), "k").limit(
        2 * ORDINARY_BYTES // WORDS_A_TEXT).select("some").collect()
    ordinary = " ".join(w for row in some for w in row[0] if w not in known_words).encode()[:ORDINARY_BYTES]
    toxic = train_dictionary(words, TOXIC_BYTES) if words else b""
    measured = margin_columns(rows.filter("not train").select("y", "t"), toxic, ordinary, "t")
    found = measured.select("y", "features").collect()  # bounded by the sample
    y = np.array([r[0] for r in found])
    if not toxic or len(set(y.tolist())) < 2:
        return no_model()
    share = {y: n for y, n in known.groupBy("y").count().collect()}
    weight = np.where(y == 1, share[1] / max(1, (y == 1).sum()), share[0] / max(1, (y == 0).sum()))
    weight *= len(y) / weight.sum()
    return ToxicModel(toxic, ordinary, *fit_logistic(np.array([r[1] for r in found]), y, weight))


def no_model() -> ToxicModel:
    return ToxicModel(b"", b"", np.zeros(0), np.zeros(0), np.zeros(0))


def margin_columns(df: DataFrame, toxic: bytes, ordinary: bytes, text: str) -> DataFrame:
    """The features of each row's text in place of the text."""

    def start():
        margins = margin_function(toxic, ordinary)
        return lambda texts: [int_lists([features(margins(t)) for t in texts], pa.float64())]

    return add_columns(df, [text], [("features", "array<double>")], None, start=start, drop=[text])


def score_toxicity(df: DataFrame, model: ToxicModel, text: str = "text", score: str = "score",
                   predicted: str = "predicted") -> DataFrame:
    """Adds the calibrated score and whether it is at least one half."""

    sent = df.sparkSession.sparkContext.broadcast(
        (model.toxic, model.ordinary, model.mean, model.scale, model.weights))

    def start():
        fitted = ToxicModel(*sent.value)
        margins = margin_function(fitted.toxic, fitted.ordinary)

        def judge(texts: list[str | None]):
            scores = fitted.score(np.array([features(margins(t)) for t in texts]))
            return scores, (scores >= 0.5).astype(np.int32)

        return judge

    return add_columns(df, [text], [(score, "double"), (predicted, "int")], None, start=start)
