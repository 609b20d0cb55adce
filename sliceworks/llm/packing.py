"""Packing of documents into windows of a fixed number of tokens.

The documents of a partition, in their order, are one stream of tokens, an end token after each.
Windows are cut from it by dynamic programming: a window may end after a document, after a
sentence or, where a stretch without either is long, every so many tokens. A window costs its
padding, a cut inside a document a penalty, which is larger where no sentence ends. The best cost
up to a boundary j is

    cost(j) = penalty(j) + length - place(j) + min(cost(i) + place(i))

over the boundaries i at most a window before j; the minimum over this sliding range comes from a
monotone queue, so the work is in proportion to the number of boundaries.

The stream is worked off in stretches of some windows; what follows a stretch's last cut goes to the
next one. What remains at the end of a partition is cut into windows whose lengths are powers of two,
which need no padding.

No rows are shuffled. A task packs its own partition, so a retry gives the same windows, and memory
is bounded by a stretch and the longest document. Null and empty texts are documents of the end
token alone; repeated rows are documents each on its own; empty tables give no pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sliceworks.llm.byte_bpe import encoder_of
from sliceworks.llm.common import column, int_lists, slices, word_finder

#: Tokens with which sentences end, without the mark of a word's end.
SENTENCE_ENDS = (".", "!", "?", "...", "!!", "??", "!?", ".\"", ".)")
WORD_END = "</w>"
#: Words that a worker keeps with their ids, of each of two ages: at most 200 MB in all.
KEPT_WORDS = 500_000


def word_runs() -> Callable[[str], list[str]]:
    """Cuts a text at white space, which no token holds, with ASCII letters in lower case, as the
    tokenizer has them; texts with control strings or separators that Python alone takes for white
    space are cut at ASCII white space as they are."""

    find = word_finder()

    def runs(text: str) -> list[str]:
        if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return find(text)
        return text.encode().lower().decode().split()

    return runs


def boundaries(ids: np.ndarray, ends: np.ndarray, stride: int, cut: float, hard: float):
    """Places at which a document may be cut, every sentence's end among them, and their penalties;
    its end comes last, at none."""

    n = len(ids)
    places = np.flatnonzero(ends[ids[:n - 1]]) + 1
    places = np.append(places[places < n - 1], n)  # the end token stays with the last sentence
    gaps = np.diff(places, prepend=0)
    if gaps.max() <= stride:
        penalty = np.full(len(places), cut)
        penalty[-1] = 0.0
        return places, penalty
    starts = places - gaps
    extra = np.concatenate([np.arange(s + stride, e, stride) for s, e in
                            zip(starts[gaps > stride], places[gaps > stride], strict=True)])
    order = np.argsort(both := np.concatenate([places, extra]), kind="stable")
    penalty = np.concatenate([np.full(len(places), cut), np.full(len(extra), hard)])[order]
    penalty[-1] = 0.0
    return both[order], penalty


def best_cuts(places: Sequence[int], penalties: Sequence[float], length: int,
              rest: bool = False) -> list[int]:
    """Ends of the windows that cover the stream up to the last place at the least cost.

    With ``rest``, what follows the last cut, at most a window, stays uncovered and costs nothing.
    """

    n = len(places)
    cost, came = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, -1)])  # cost + place, place, index
    for j in range(n):
        place = places[j]
        while queue[0][1] < place - length:
            queue.popleft()
        best, _, i = queue[0]
        cost[j] = value = penalties[j] + length - place + best
        came[j] = i
        value += place
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, place, j))
    cuts, j = [], n - 1
    if rest:
        least = 0.0 if places[-1] <= length else float("inf")
        j = -1
        for k in range(n - 1, -1, -1):
            if places[k] < places[-1] - length:
                break
            if cost[k] < least:
                least, j = cost[k], k
    while j >= 0:
        cuts.append(places[j])
        j = came[j]
    return cuts[::-1]


def powers_of_two(total: int) -> list[int]:
    """A length as a sum of powers of two, the largest first."""

    return [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]


class Packer:
    """Cuts the stream of one partition; holds the documents that are not yet in windows."""

    def __init__(self, length: int, ends: np.ndarray, stretch: int, stride: int, cut: float,
                 hard: float) -> None:
        self.length, self.ends, self.stretch = length, ends, stretch
        self.stride, self.cut, self.hard = stride, cut, hard
        self.held: list[tuple] = []  # key, ids, first id in the stream, places, penalties
        self.size, self.window = 0, 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        places, penalties = boundaries(ids, self.ends, self.stride, self.cut, self.hard)
        self.held.append((key, ids, 0, places, penalties))
        self.size += len(ids)
        if self.size >= self.stretch:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        """Pieces (key, start, ids, document's tokens, window, offset) of finished windows."""

        if not self.size:
            return
        places, penalties, at = [], [], 0
        for _, ids, first, where, cost in self.held:
            inside = where > first
            places.append(where[inside] - first + at)
            penalties.append(cost[inside])
            at += len(ids) - first
        cuts = best_cuts(np.concatenate(places).tolist(), np.concatenate(penalties).tolist(),
                         self.length, True)
        if last:
            done = cuts[-1] if cuts else 0
            cuts += (done + np.cumsum(powers_of_two(self.size - done))).tolist()
        begin = 0
        for end in cuts:
            yield from self.window_pieces(end - begin)
            begin = end

    def window_pieces(self, size: int) -> Iterator[tuple]:
        offset = 0
        while offset < size:
            key, ids, first, places, penalties = self.held[0]
            taken = min(len(ids) - first, size - offset)
            yield key, first, ids[first:first + taken], len(ids), self.window, offset
            offset += taken
            if first + taken == len(ids):
                self.held.pop(0)
            else:
                self.held[0] = (key, ids, first + taken, places, penalties)
        self.size -= size
        self.window += 1


def pack(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text",
         length: int = 4096, end_id: int = 2, stretch: int = 64, stride: int = 32,
         cut: float = 2.0, hard: float = 6.0, as_bytes: bool = False) -> DataFrame:
    """The pieces of the windows: key, ``start`` in the document, ``length``, ``ids``,
    ``doc_tokens``, ``sequence_id`` and ``offset`` in the window.

    ``stretch`` windows are worked off at a time; ``stride`` is the most tokens without a
    boundary; ``cut`` and ``hard`` are the penalties, in tokens of padding. ``as_bytes`` gives the
    ids as little-endian unsigned 32-bit integers in one binary value in place of an array.
    """

    with open(tokenizer_path, encoding="utf-8") as file:
        description = file.read()
    make = encoder_of(df.sparkSession, description, word_runs, True, KEPT_WORDS)
    kind = df.schema[key].dataType
    ids_field = T.StructField("ids", T.BinaryType() if as_bytes else T.ArrayType(T.IntegerType()))
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), ids_field,
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType())])
    arrow_key = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        vocabulary = encoder.tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        ends[[vocabulary[t] for e in SENTENCE_ENDS for t in (e, e + WORD_END)
              if t in vocabulary]] = True
        packer = Packer(length, ends, stretch * length, min(stride, length), cut, hard)
        end = np.array([end_id], dtype="<i4").tobytes()
        first = TaskContext.get().partitionId() << 40
        pieces: list[tuple] = []

        def batch() -> pa.RecordBatch:
            keys, starts, ids, total, windows, offsets = zip(*pieces, strict=True)
            return pa.RecordBatch.from_arrays([
                pa.array(keys, arrow_key), pa.array(starts, pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([x.tobytes() for x in ids], pa.binary()) if as_bytes else int_lists(ids),
                pa.array(total, pa.int64()), pa.array([first + w for w in windows], pa.int64()),
                pa.array(offsets, pa.int64())], names=schema.names)

        for rows in slices(batches, 64):
            for k, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(encoder.encode(t) + end, dtype="<i4")
                pieces += packer.add(k, ids)
            if len(pieces) > 1000:
                yield batch()
                pieces.clear()
        pieces += packer.flush(True)
        if pieces:
            yield batch()

    return df.select(column(key).alias("k"), column(text).alias("t")).mapInArrow(run, schema)
