"""Exact top-k search by inner product with the threshold algorithm over sorted lists.

A block of candidates keeps one list per dimension, sorted by the component. A query walks all
lists at once, each from the end where its own component makes products large, scores every vector
it meets in full, and stops when the sum of the products at the depth reached, which no vector unseen
can exceed, is below its k-th best score so far. Lists are walked in steps that double. The best of
the blocks are ranked together; as each block's answer is exact, so is the whole.

Queries meet the candidates in rounds: a round's queries, a bounded number, are broadcast, and every
task answers them on its blocks. The rounds' number grows with the queries, and no pair of rows is
ever built.

Components are turned into floor(1024 * x) as integers. Vectors that are null, empty, or hold a null,
an infinite component or a NaN take no part, nor do rows without id. Vectors with large components form
blocks of their own and are scored in integers of any size; they are ranked by these, while a score that
does not fit a long is shown as the largest or smallest long. (A component whose product with the scale
is no finite double counts as infinite.) A query meets only candidates of its own number of components. If
an id repeats, each row is a candidate of its own, and the query of that id is the greatest of its vectors. A
query without candidates has no rows. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceworks.llm.common import column

#: Integer components below this are held as 32-bit integers, larger ones as integers of any size.
LARGEST = 1 << 28
#: Sums below these are exact in double precision, which is fastest, and in 64-bit integers.
EXACT, LONG = 1 << 53, (1 << 63) - 1
#: Candidates of a block, queries of a round, and the depth of the first step.
BLOCK, ROUND, STEP = 16_384, 4_096, 32


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """Ids and integer vectors of the rows that take part."""

    scaled = F.transform(column(vector).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    whole = F.transform("v", lambda x: F.when(F.abs(x) < float(EXACT), F.floor(x).cast("double")).otherwise(x))
    fine = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return df.select(column(key).cast("long").alias("id"), scaled.alias("v")).filter(fine).select(
        "id", whole.alias("v"))


def integers(vectors: np.ndarray) -> np.ndarray:
    """Whole numbers given as doubles, as integers that hold them."""

    if np.abs(vectors).max(initial=0.0) < LARGEST:
        return vectors.astype(np.int32)
    return np.array([[int(x) for x in row] for row in vectors.tolist()], dtype=object).reshape(vectors.shape)


class Block:
    """Candidates of one number of components, with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids = ids
        self.vectors = vectors if vectors.dtype == object else vectors.astype(np.float64)
        self.largest = int(np.abs(vectors).max(initial=0))
        self.lists = np.ascontiguousarray(np.argsort(self.vectors, axis=0, kind="stable").T)
        self.values = np.take_along_axis(self.vectors.T, self.lists, axis=1)

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates, and of all ties with the last of them that come
        before it by id."""

        n, vectors, values = len(self.ids), self.vectors, self.values
        most = self.largest * int(np.abs(query).max()) * len(query)
        if most < EXACT:
            query, vectors, values = (x.astype(np.float64) for x in (query, vectors, values))
        elif most <= LONG:
            query, vectors, values = (x.astype(np.int64) for x in (query, vectors, values))
        else:
            query, vectors, values = (x if x.dtype == object else x.astype(np.int64).astype(object)
                                      for x in (query, vectors, values))
        used = np.flatnonzero(query)
        down = query[used] > 0
        seen = np.zeros(n, dtype=bool)
        ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=query.dtype)
        start, step = 0, STEP
        while start < n:
            stop = min(n, start + step)
            if len(used):
                at = np.where(down[:, None], np.arange(n - stop, n - start)[None, :],
                              np.arange(start, stop)[None, :])
                fresh = np.zeros(n, dtype=bool)
                fresh[self.lists[used[:, None], at].ravel()] = True
                met = np.flatnonzero(fresh & ~seen)
                seen[met] = True
            else:
                met = np.arange(n)  # all products are zero
                stop = n
            other = met[self.ids[met] != own]
            ids = np.append(ids, self.ids[other])
            scores = np.append(scores, vectors[other] @ query)
            if len(ids) > k:
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
            start, step = stop, 2 * step
            if start < n and len(ids) == k:
                edge = np.where(down, n - start - 1, start)
                bound = values[used, edge] @ query[used]
                if bound < scores.min():
                    break
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order] if scores.dtype == object else scores[order].astype(np.int64)


def ranked_scores(scores: list[int]) -> list[pa.Array]:
    """Columns that order scores of any size: which side of the longs, a text that sorts, the long."""

    side = [int(s > LONG) - int(s < -LONG) for s in scores]
    digits = [f"{len(str(abs(s))):05d}{abs(s)}" if x else None for s, x in zip(scores, side, strict=True)]
    turned = str.maketrans("0123456789", "9876543210")  # of two negative ones the longer is the smaller
    text = [d if x >= 0 else d.translate(turned) for d, x in zip(digits, side, strict=True)]
    return [pa.array(side, pa.int32()), pa.array(text, pa.string()),
            pa.array([max(-LONG, min(LONG, s)) for s in scores], pa.int64())]


def answers(candidates: DataFrame, queries: list[tuple[int, list[int]]], k: int) -> DataFrame:
    """The k best candidates of every query in every block."""

    arrays = [(q, integers(np.array([v], dtype=np.float64))[0]) for q, v in queries]
    sent = candidates.sparkSession.sparkContext.broadcast(arrays)

    def answer(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        block = Block(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]))
        width = block.vectors.shape[1]
        found = [(q, *block.best(q, v, k)) for q, v in sent.value if len(v) == width]
        if found:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]), pa.int64()),
                pa.array(np.concatenate([i for _, i, _ in found]), pa.int64()),
                *ranked_scores([x for _, _, s in found for x in s.tolist()])],
                names=["query_id", "vec_id", "side", "digits", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            widths = lists.value_lengths().to_numpy()
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                taken = lists.take(pa.array(own)).flatten().to_numpy().reshape(len(own), width)
                large = np.abs(taken).max(1) >= LARGEST
                for wide in np.unique(large):
                    rows, vectors = ids[own[large == wide]], integers(taken[large == wide])
                    for a in range(0, len(rows), BLOCK):
                        parts = held.setdefault((int(width), bool(wide)), [])
                        parts.append((rows[a:a + BLOCK], vectors[a:a + BLOCK]))
                        if sum(len(i) for i, _ in parts) >= BLOCK:
                            yield from answer(held.pop((int(width), bool(wide))))
        for kind in list(held):
            yield from answer(held.pop(kind))

    return candidates.mapInArrow(run, "query_id long, vec_id long, side int, digits string, score long")


def top_k(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding",
          k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id``, ``rank`` from 1, the candidate's id and ``score`` for every query's k best."""

    rows = integer_vectors(df, key, vector, scale)
    queries = integer_vectors(df.filter(is_query), key, vector, scale).groupBy("id").agg(
        F.max("v").alias("v"))
    rounds = max(1, -(-queries.count() // ROUND))
    found = None
    for r in range(rounds):
        # a hash share of the queries: about ROUND of them, whatever their total
        own = queries.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r).orderBy("id").collect()
        part = answers(rows, [(q, v) for q, v in own], k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("digits"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("vec_id").alias(key), "score")
