"""How the sources of a language differ in the terms they use, from hash-consed segment trees.

Terms are runs of letters of any script (bytes that are no ASCII sign, digit, control or blank), with only
A-Z lower-cased. A language keeps the terms that stand in at least ``least`` of its documents, ``V`` in all.
A (language, source) group with ``N`` occurrences of kept terms gives a term with ``count`` of them the
price ``1 + floor(SCALE * (count + 5) / (N + 5 * V))``; the whole language likewise. All sums are integers.

Terms are numbered within their language and cut into blocks. In a block each group has a segment tree over
the term ids: a leaf is a count, an inner node a pair of nodes, and equal subtrees of any groups, zeros
above all, are one node, found by consing the nodes of a level together. Two groups are compared by
walking both trees at once from their roots, level by level: equal pairs of nodes are merged with the number
of times they stand there, so that each is priced once. All pairs of groups of a block share the walk. The
blocks' sums are added up by Spark; a block holds a bounded number of counts, however the rows fall.

Null text, language and source are ''. A text without terms still makes its group occur. A language
without kept terms has pairs of value 0 and no terms. Repeated rows count as often as they stand there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sliceworks.llm.common import ROWS, column, slices
from sliceworks.operators.ordering import if_small
from sliceworks.session import written

SCALE, PRIOR = 1_000_000_000, 5
#: Bytes of a text split at a time, counts that a task gathers before it sends them on, counts and
#: terms of a block, and leaves of the pairs of groups that walk together.
PIECE, GATHERED, BLOCK_COUNTS, BLOCK_TERMS, LEAVES = 1 << 20, 400_000, 1 << 18, 2048, 1 << 19

#: What each byte of UTF-8 becomes: a blank between terms, or itself with A-Z lower-cased.
TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
                   else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size; a cut waits until no term goes on."""

    start = 0
    while start < len(text):
        stop = start + PIECE
        while stop < len(text) and TERM_BYTES[text[stop]] != 32:
            stop += 1
        yield text[start:stop].translate(TERM_BYTES).split()
        start = stop


def summed(table: pa.Table) -> pa.Table:
    """Counts added up by group and term."""

    found = table.group_by(["g", "term"], use_threads=False).aggregate([("n", "sum"), ("d", "sum")])
    return found.select(["g", "term", "n_sum", "d_sum"]).rename_columns(["g", "term", "n", "d"])


def counted(texts: list[bytes], groups: np.ndarray) -> pa.Table:
    """Occurrences ``n`` of each ``term`` in each group ``g`` of these texts, and the texts ``d`` with it."""

    parts = [(k, pa.array(terms, pa.binary())) for k, text in enumerate(texts)
             for terms in pieces(text)]
    terms = pa.concat_arrays([pa.array([], pa.binary()), *(p for _, p in parts)]).dictionary_encode()
    size = len(terms.dictionary) + 1
    text = np.repeat([k for k, _ in parts], [len(p) for _, p in parts]).astype(np.int64)
    found, often = np.unique(text * size + terms.indices.to_numpy(), return_counts=True)
    found, same = np.unique(groups[found // size] * size + found % size, return_inverse=True)
    total = np.bincount(same, often, len(found)).astype(np.int64)
    return pa.table({"g": found // size, "term": terms.dictionary.take(pa.array(found % size)),
                     "n": total, "d": np.bincount(same, minlength=len(found))})


def term_counts(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """Occurrences ``n`` of each ``term`` in each (``lang``, ``source``) and the documents ``d`` with it;
    a row with a null term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}
        waiting, rows = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            n = len(names)
            empty = pa.table({"g": np.arange(n), "term": pa.nulls(n, pa.binary()),
                              "n": np.zeros(n, np.int64), "d": np.zeros(n, np.int64)})
            found = summed(pa.concat_tables([empty, *waiting]))
            langs, sources = (pa.array([k[x] for k in names], pa.string()) for x in range(2))
            yield from pa.table({"lang": langs.take(found["g"].combine_chunks()),
                                 "source": sources.take(found["g"].combine_chunks()),
                                 **{c: found[c] for c in ("term", "n", "d")}}).to_batches()

        for batch in slices(batches, ROWS):
            values, *group = (c.to_pylist() for c in batch.columns)
            ids = [names.setdefault(key, len(names)) for key in zip(*group, strict=True)]
            waiting.append(counted(values, np.array(ids, dtype=np.int64)))
            rows += waiting[-1].num_rows
            if rows > GATHERED:
                waiting = [summed(pa.concat_tables(waiting))]
                rows = waiting[0].num_rows
            if rows > GATHERED // 2:
                yield from flush()
                waiting, rows = [], 0
                names.clear()
        if names:
            yield from flush()

    name = lambda c: F.coalesce(column(c).cast("string"), F.lit(""))
    found = df.select(name(text).cast("binary").alias("t"), name(lang).alias("lang"),
                      name(source).alias("source")).mapInArrow(
        run, "lang string, source string, term binary, n long, d long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("d").alias("d"))


def price(count: str, total: str, terms: str) -> str:
    """SQL of the price of a count among ``total`` occurrences of a language's kept ``terms``."""

    return (f"1 + CAST({SCALE} AS DECIMAL(38,0)) * CAST({count} + {PRIOR} AS DECIMAL(20,0)) "
            f"DIV CAST({total} + {PRIOR} * {terms} AS DECIMAL(20,0))")


def prices(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """Prices of counts of groups with these totals, exact however large."""

    if counts.max(initial=0) + PRIOR > (1 << 62) // SCALE:
        counts = counts.astype(object)
    return (1 + SCALE * (counts + PRIOR) // (totals + PRIOR * terms)).astype(np.int64)


def consed(counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Segment trees over the columns of counts by group and term, with equal nodes shared.

    The node of each group's root, and for every level from the root down the two children (nodes
    of the next level) of each node; the nodes of the last level are counts.
    """

    nodes, levels = counts, []
    while nodes.shape[1] > 1:
        left, right = nodes[:, ::2], nodes[:, 1::2]
        base = int(nodes.max()) + 1 if nodes.size else 1
        if base < 1 << 31:
            found, name = np.unique(left * base + right, return_inverse=True)
            children = np.stack([found // base, found % base], 1)
        else:
            children, name = np.unique(np.stack([left.ravel(), right.ravel()], 1), axis=0,
                                       return_inverse=True)
        levels.append(children)
        nodes = name.reshape(left.shape)
    return nodes[:, 0], levels[::-1]


def merged(keys: tuple[np.ndarray, ...], times: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct keys, in order, and how often each stands there."""

    sizes = [int(k.max(initial=0)) + 1 for k in keys]
    if math.prod(sizes) < 1 << 62:
        joint = np.ravel_multi_index(keys, sizes)
        order = np.argsort(joint)
        joint = joint[order]
        new = joint[1:] != joint[:-1]
    else:
        order = np.lexsort(keys[::-1])
        new = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    at = np.flatnonzero(np.append(True, new))
    first = order[at]
    return tuple(k[first] for k in keys), np.add.reduceat(times[order], at)


def walk(roots: np.ndarray, levels: list[np.ndarray], one: np.ndarray, two: np.ndarray,
         priced) -> np.ndarray:
    """For each pair of groups the summed difference of their prices, walking their trees together.

    ``priced(groups, counts)`` gives prices. Equal pairs of nodes of a pair of groups are followed
    once, with their number.
    """

    pair = np.arange(len(one))
    a, b, times = roots[one], roots[two], np.ones(len(one), dtype=np.int64)
    for children in levels:
        keys = (np.repeat(pair, 2), children[a].ravel(), children[b].ravel())
        (pair, a, b), times = merged(keys, np.repeat(times, 2))
    value = np.abs(priced(one[pair], a) - priced(two[pair], b)) * times
    out = np.zeros(len(one), dtype=np.int64)
    np.add.at(out, pair, value)
    return out


def block_sums(counts: np.ndarray, totals: np.ndarray, terms: int) -> Iterator[tuple]:
    """(groups, other groups, sums of price differences) of all pairs of the groups of a block.

    ``counts`` is by group and term, ``totals`` the groups' occurrences, ``terms`` the language's.
    """

    n, width = counts.shape
    distinct, at = np.unique(counts, return_inverse=True)
    leaves = 1 << max(0, width - 1).bit_length()
    # what stands behind the last term is a node of its own, which costs nothing
    whole = np.full((n, leaves), len(distinct), dtype=np.int64)
    whole[:, :width] = at.reshape(counts.shape)
    values = np.append(distinct, 0)
    roots, levels = consed(whole)

    def priced(group: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        return np.where(leaf == len(distinct), 0, prices(values[leaf], totals[group], terms))

    together = max(1, LEAVES // leaves)
    for first in range(n - 1):  # a group with the later ones, so that no list of all pairs is held
        for start in range(first + 1, n, together):
            two = np.arange(start, min(start + together, n))
            one = np.full(len(two), first)
            yield one, two, walk(roots, levels, one, two, priced)


def numbered(kept: DataFrame) -> DataFrame:
    """Kept terms with ``block`` and ``place`` in their language, ``size`` terms in all.

    Blocks have about equally many terms, by hash of the term, so no task orders a whole language.
    """

    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("groups").alias("cells"))
    sizes = sizes.withColumn("blocks", F.greatest(
        F.ceil(F.col("size") / BLOCK_TERMS), F.ceil(F.col("cells") / BLOCK_COUNTS)).cast("int"))
    # broadcast if few, so that a language with most of the terms is not one task of the window
    spread = kept.join(if_small(sizes), "lang").withColumn("block", F.pmod(
        F.xxhash64("term"), F.col("blocks")).cast("int"))
    return spread.withColumn("place", F.row_number().over(
        Window.partitionBy("lang", "block").orderBy("term")) - 1)


def divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
               least: int = 30, top: int = 50) -> DataFrame:
    """Part ``pair``: each group's other sources of its language, by summed difference; part ``term``:
    the group's ``top`` terms that it uses more than its language. Ranks from 1, equal values by item."""

    counts = written(term_counts(df, text, lang, source), "term-counts")
    groups = counts.filter("term IS NULL").select("lang", "source")
    counts = counts.filter("term IS NOT NULL")
    often = written(counts.groupBy("lang", "term").agg(
        F.sum("d").alias("d"), F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("groups")).filter(
        F.col("d") >= least), "often")
    kept = written(numbered(often).select("lang", "term", "lang_n", "size", "blocks", "block", "place"), "terms")
    cells = written(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("whole"), F.max("size").alias("size"),
                                     F.max("blocks").alias("blocks"))
    groups = written(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(
        0, ["own", "whole", "size", "blocks"]), "groups")

    terms = cells.join(groups.select("lang", "source", "own", "whole"), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        (F.expr(price("n", "own", "size")) - F.expr(price("lang_n", "whole", "size"))).alias("value")).filter(
        "value > 0")
    terms = ranked(terms).filter(F.col("rank") <= top)

    pairs = ranked(pair_sums(groups, cells))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(
        terms.withColumn("part", F.lit("term")).select(*out))


def ranked(values: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return values.withColumn("value", F.col("value").cast("long")).withColumn(
        "rank", F.row_number().over(order))


def pair_sums(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """``value`` of each ``source`` and other source (``item``) of a language."""

    # every block hears of all groups of its language: those without its terms have prices too
    heads = groups.filter("size > 0").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source",
        F.lit(None).cast("int").alias("place"), F.col("own").alias("n"), F.col("size").alias("terms"))
    rows = heads.unionByName(cells.select("lang", "block", "source", "place", "n", F.col("size").alias("terms")))

    def sums(key: tuple, table: pa.Table) -> pa.Table:
        place = table["place"].to_numpy()
        head = np.isnan(place) if place.dtype.kind == "f" else np.zeros(len(place), dtype=bool)
        names = table["source"].combine_chunks().dictionary_encode()
        index = names.indices.to_numpy()
        n = table["n"].to_numpy()
        total = np.zeros(len(names.dictionary), dtype=np.int64)
        total[index[head]] = n[head]
        at = place[~head].astype(np.int64)
        dense = np.zeros((len(total), int(at.max(initial=-1)) + 1), dtype=np.int64)
        dense[index[~head], at] = n[~head]
        parts = list(block_sums(dense, total, table["terms"][0].as_py()))
        one, two, value = (np.concatenate(x) if parts else np.zeros(0, dtype=np.int64)
                           for x in (zip(*parts, strict=True) if parts else ((), (), ())))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(one), pa.string()),
                         "a": names.dictionary.take(pa.array(one)),
                         "b": names.dictionary.take(pa.array(two)), "value": pa.array(value)})

    # rows of a block come in any order, so blocks may name the two groups of a pair either way round
    found = rows.groupBy("lang", "block").applyInArrow(
        sums, "lang string, a string, b string, value long").groupBy(
        "lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.sum("value").alias("value"))
    both = found.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        found.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    empty = groups.filter("size = 0").select("lang", "source")
    none = empty.join(empty.withColumnRenamed("source", "item"), "lang").filter("source <> item")
    return both.unionByName(none.withColumn("value", F.lit(0).cast("long")))
