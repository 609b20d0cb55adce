"""Embedding near-duplicates: cross-polytope hashing, multiprobe buckets, verified links, components.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the signed axis that
lies nearest is its hash. A table joins ``k`` such hashes into a code (the last may look at fewer axes, so
that codes are about ``SPREAD`` times as many as vectors). A vector's own code and the next likely
ones are its probes: two vectors meet in a table if the own code of one is a probe of the other. How many
tables it takes is computed from pairs made at exactly the threshold: such a pair is missed with a
probability of ``miss`` at most, closer ones with less.

First only ids and codes are shuffled; the buckets that hold an own code and another vector are
counted, and only their members are joined with their vectors. A bucket is cut into chunks of bounded
size that are compared two at a time as matrix products in double precision. A pair counts in the first
table, and there in the lower code, in which it meets, so each link is counted once although no pair is
ever sent on: a comparison returns sums by member and one row that ties it to its group. Equal vectors
are one node with a count throughout, so copies cost nothing.

A vector that is null, empty or zero, or holds a null or a number that is not finite, links with nothing;
vectors of unlike length do not link. Every row counts as a vector of its own, with null or repeated ids
too: the smallest id of a component leaves nulls out, and a null id is kept where no other id is there.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceworks.llm.common import column
from sliceworks.llm.simhash import components
from sliceworks.session import written

#: Codes for each vector, axes tried for each hash, and the largest number of probes in a table.
SPREAD, AXES, PROBES = 32, 3, 8
#: Numbers and members that a chunk of a bucket holds at most.
CHUNK_NUMBERS, CHUNK_MEMBERS = 1 << 17, 1024
#: Members of small buckets that are handled together.
TOGETHER = 4096
#: Vectors handled at a time, and pairs and tables from which a table's chance is estimated.
ROWS, PAIRS, TRIALS = 512, 1000, 8


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, by additions only, the same in batches of any size."""

    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, width // (2 * half), 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        x = np.stack((low + high, low - high), 2).reshape(n, width)
        half *= 2
    return x


@dataclass(frozen=True)
class Tables:
    """Hash tables of vectors padded to ``width``, a power of two."""

    width: int
    hashes: int
    last: int  # axes that the last hash of a code looks at
    tables: int
    probes: int
    seed: int = 11

    def signs(self, table: int) -> np.ndarray:
        dice = np.random.RandomState([self.seed, self.width, table])
        return dice.randint(0, 2, (self.hashes, 3, self.width)) * 2.0 - 1.0

    def choices(self) -> list[tuple[int, ...]]:
        """Which axis each hash of a probe takes; at most two differ from the nearest."""

        return [c for c in itertools.product(range(AXES), repeat=self.hashes)
                if sum(map(bool, c)) <= 2]

    def codes(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """A table's codes by vector and probe; the own code first, then the next likely ones."""

        choices = self.choices()
        cost = np.zeros((len(choices), len(vectors)))
        code = np.zeros((len(choices), len(vectors)), dtype=np.int64)
        for number, rounds in enumerate(self.signs(table)):
            turned = vectors
            for signs in rounds:
                turned = hadamard(turned * signs)
            size = self.last if number == self.hashes - 1 else self.width
            turned = turned[:, :size]
            left, rows = np.abs(turned), np.arange(len(vectors))
            axes, sizes = [], []
            for _ in range(AXES):
                at = left.argmax(1)
                sizes.append(left[rows, at])
                axes.append(2 * at + (turned[rows, at] < 0))
                left[rows, at] = -1.0
            for k, choice in enumerate(choices):
                cost[k] += (sizes[0] - sizes[choice[number]]) ** 2
                code[k] = code[k] * (2 * size) + axes[choice[number]]
        first = np.argsort(cost, axis=0, kind="stable")[:self.probes]
        return np.take_along_axis(code, first, 0).T


def meet(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether the own code of either is a probe of the other; codes by pair and probe."""

    return (one[:, :1] == two).any(1) | (two[:, :1] == one).any(1)


def plan_tables(length: int, n: int, threshold: float, miss: float) -> Tables:
    """Tables for ``n`` vectors of a length that miss a pair at the threshold with ``miss`` at most."""

    width = max(16, 1 << (length - 1).bit_length())
    need = SPREAD * max(n, 64)
    hashes = 1
    while (2 * width) ** hashes < need:
        hashes += 1
    last = 4
    while (2 * width) ** (hashes - 1) * 2 * last < need:
        last *= 2
    trial = Tables(width, hashes, min(last, width), TRIALS, min(PROBES, len(Tables(
        width, hashes, last, 1, 1).choices())))
    dice = np.random.RandomState([trial.seed, length])
    one, other = dice.normal(size=(2, PAIRS, length))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (one * other).sum(1, keepdims=True) * one
    norm = np.linalg.norm(other, axis=1, keepdims=True)
    other = np.divide(other, norm, out=np.zeros_like(other), where=norm > 1e-12)
    close = threshold * one + math.sqrt(max(0.0, 1 - threshold ** 2)) * other
    a, b = (np.concatenate([trial.codes(padded(v, width), t) for t in range(TRIALS)])
            for v in (one, close))
    plans = []
    for probes in range(1, trial.probes + 1):
        chance = min(meet(a[:, :probes], b[:, :probes]).mean(), 1 - 1e-9)
        tables = math.ceil(math.log(miss) / math.log1p(-max(chance, 1e-4)))
        plans.append(Tables(width, hashes, trial.last, max(1, tables), probes))
    # as few rows as can be, but always some probes beside the own code
    return min(plans[1:] or plans, key=lambda p: p.tables * p.probes)


def padded(vectors: np.ndarray, width: int) -> np.ndarray:
    """Vectors with zeros behind, scaled by powers of two so that no sum overflows."""

    _, exponent = np.frexp(np.abs(vectors).max(1, initial=0.0))
    out = np.zeros((len(vectors), width))
    out[:, :vectors.shape[1]] = np.ldexp(vectors, -exponent[:, None])
    return out


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of list values and their matrix, one for each length among them."""

    ends = np.asarray(lists.offsets)
    flat = np.asarray(lists.values, dtype=np.float64)
    lengths = np.diff(ends)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, flat[ends[:-1][rows][:, None] + np.arange(length)]


def hashed(nodes: DataFrame, plans: dict[int, Tables]) -> DataFrame:
    """Every node's codes: ``node``, ``length`` and one row for each ``t``, ``code`` and whether it is
    the node's ``own`` code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                for rows, vectors in matrices(part.column(1)):
                    plan = plans[vectors.shape[1]]
                    ready = padded(vectors, plan.width)
                    codes = np.concatenate([plan.codes(ready, t) for t in range(plan.tables)], axis=1)
                    flat = pa.array(codes.ravel())
                    ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * codes.shape[1])
                    fill = lambda x: pa.array(np.full(len(rows), x, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(rows)), fill(vectors.shape[1]),
                         fill(plan.probes), pa.ListArray.from_arrays(ends, flat)],
                        names=["node", "length", "probes", "codes"])

    found = written(nodes.select("node", "v").mapInArrow(
        run, "node long, length int, probes int, codes array<long>"), "codes")
    return found.select("node", "length", "probes", F.posexplode("codes").alias("at", "code")).select(
        "node", "length", F.expr("at div probes").cast("int").alias("t"), "code",
        (F.col("at") % F.col("probes") == 0).alias("own"))


def near_pairs(vectors: np.ndarray, own: np.ndarray, split: int,
               threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with one own code at least whose cosine reaches the threshold; where ``split`` is given,
    of a member before it and one from there on."""

    norms = np.sqrt((vectors * vectors).sum(1))
    left, right = [], []
    stop = split or len(vectors)
    for start in range(0, stop, ROWS):
        rows, base = slice(start, min(start + ROWS, stop)), split or start
        cosine = vectors[rows] @ vectors[base:].T / (norms[rows, None] * norms[None, base:])
        a, b = np.nonzero((cosine >= threshold - 1e-9) & (own[rows, None] | own[None, base:]))
        sure = cosine[a, b] >= threshold + 1e-9
        a, b = a + start, b + base
        # next to the threshold the order of summation would tell: the plain sum decides
        x, y = a[~sure], b[~sure]
        sure[~sure] = (vectors[x] * vectors[y]).sum(1) / (norms[x] * norms[y]) >= threshold
        sure &= a < b
        left.append(a[sure])
        right.append(b[sure])
    return np.concatenate(left), np.concatenate(right)


def first_met(plan: Tables, vectors: np.ndarray, a: np.ndarray, b: np.ndarray, tables: np.ndarray,
              codes: np.ndarray) -> np.ndarray:
    """Which pairs (a, b), each found in a bucket of a table, meet in no earlier table and in no lower
    code of that one. Codes are computed again, for the vectors of pairs still in doubt only."""

    kept = np.ones(len(a), dtype=bool)
    for table in range(int(tables.max(initial=-1)) + 1):
        doubt = np.flatnonzero(kept & (tables >= table))
        if not len(doubt):
            continue
        members, at = np.unique(np.concatenate([a[doubt], b[doubt]]), return_inverse=True)
        found = plan.codes(vectors[members], table)
        for start in range(0, len(doubt), 1 << 16):
            part = doubt[start:start + (1 << 16)]
            one = found[at[start:start + len(part)]]
            two = found[at[len(doubt) + start:len(doubt) + start + len(part)]]
            here, code = tables[part] == table, codes[part]
            lower = ((one[:, :1] == two).any(1) & (one[:, 0] < code)) | (
                (two[:, :1] == one).any(1) & (two[:, 0] < code))
            kept[part] = ~np.where(here, lower, meet(one, two))
    return kept


def groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member that each of ``n`` members is joined to by the pairs."""

    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def links(nodes: DataFrame, plans: dict[int, Tables], threshold: float) -> DataFrame:
    """By ``node`` and comparison: the ``links`` counted there (a linked node counts with its copies)
    and a node that joins it to its group."""

    entries = hashed(nodes, plans)
    key = ["length", "t", "code"]
    # written, so that the join reads both sides from a shuffle and can split a hot bucket
    buckets = written(entries.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).filter("n > 1 and own").select(
        *key, F.ceil(F.col("n") / F.least(F.lit(CHUNK_MEMBERS), F.greatest(
            F.lit(16), F.floor(F.lit(CHUNK_NUMBERS) / F.col("length"))))).cast("int").alias("chunks")),
        "buckets")
    chosen = entries.join(buckets, key).withColumn(
        "c", F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).cast("int"))
    members = chosen.join(nodes.select("node", "copies", "v"), "node")
    packed = members.groupBy(*key, "chunks", "c").agg(F.collect_list(
        F.struct("node", "own", "copies", "v")).alias("m"))
    alone = packed.filter("chunks = 1").select(*key, F.col("m").alias("one"), F.lit(None).cast(
        packed.schema["m"].dataType).alias("two"))
    # a chunk goes to its meeting with each chunk of the bucket, once as the first of the two
    split = packed.filter("chunks > 1").withColumn("o", F.explode(
        F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = split.select(*key, F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"),
                       (F.col("c") <= F.col("o")).alias("first"), "m").groupBy(*key, "a", "b").agg(
        F.max(F.when(F.col("first"), F.struct("m"))).getField("m").alias("one"),
        F.max(F.when(~F.col("first"), F.struct("m"))).getField("m").alias("two")).select(
        *key, "one", "two")

    def counted(length: int, buckets: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Links of some buckets (table, code, members, start of the second chunk)."""

        plan, offsets = plans[length], np.cumsum([0, *(len(x[2]) for x in buckets)])
        members = pa.concat_arrays([x[2] for x in buckets])
        node, own, copies = (members.field(f).to_numpy(zero_copy_only=False)
                             for f in ("node", "own", "copies"))
        (_, vectors), = matrices(members.field("v"))
        vectors = padded(vectors, plan.width)
        pairs, tables, codes = [], [], []
        for (table, code, _, split), start, stop in zip(buckets, offsets, offsets[1:], strict=False):
            found = near_pairs(vectors[start:stop], own[start:stop], split, threshold)
            pairs.append(np.stack(found) + start)
            tables.append(np.full(len(found[0]), table))
            codes.append(np.full(len(found[0]), code))
        (a, b), tables, codes = np.concatenate(pairs, axis=1), *map(np.concatenate, (tables, codes))
        if not len(a):
            return
        # a vector may be in many of the buckets
        _, first, same = np.unique(node, return_index=True, return_inverse=True)
        kept = first_met(plan, vectors[first], same[a], same[b], tables, codes)
        a, b = same[a[kept]], same[b[kept]]
        node, copies = node[first], copies[first]
        total = np.zeros(len(node), dtype=np.int64)
        np.add.at(total, a, copies[b])
        np.add.at(total, b, copies[a])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[some]) for x in (node, total, node[groups(len(node), a, b)])],
            names=["node", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, last = [], 0, None
        for batch in batches:
            lengths, tables, codes = (batch.column(c).to_pylist() for c in range(3))
            for k, (length, table, code) in enumerate(zip(lengths, tables, codes, strict=True)):
                parts = [batch.column(c)[k].values for c in (3, 4) if batch.column(c)[k].is_valid]
                if not parts:
                    continue
                if waiting and (length != last or size >= TOGETHER):
                    yield from counted(last, waiting)
                    waiting, size = [], 0
                last = length
                waiting.append((table, code, pa.concat_arrays(parts),
                                len(parts[0]) if len(parts) > 1 else 0))
                size += sum(map(len, parts))
        if waiting:
            yield from counted(last, waiting)

    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return alone.unionByName(met).repartition(tasks).mapInArrow(run, "node long, links long, other long")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding",
                 threshold: float = 0.9, miss: float = 1e-4) -> DataFrame:
    """By row: the key, ``n_links`` (other vectors with a cosine of the threshold or more),
    ``component_id`` (the smallest key reachable) and ``kept`` (the key is that one)."""

    kind = "float" if df.schema[vector].dataType.elementType.typeName() == "float" else "double"
    numbers = F.transform(column(vector), lambda x: x.cast(kind) + F.lit(0).cast(kind))  # no -0.0
    usable = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = df.select(column(key).alias("k"), numbers.alias("v")).select(
        "k", "v", usable.alias("ok"), F.xxhash64("v").alias("h"), F.xxhash64(F.lit(5), "v").alias("g"))
    nodes = written(rows.filter("ok").groupBy("h", "g", "v").agg(
        F.count(F.lit(1)).alias("copies"), F.min("k").alias("low")).withColumn(
        "node", F.monotonically_increasing_id()), "vectors")
    sizes = nodes.groupBy(F.size("v").alias("length")).count().collect()
    plans = {r["length"]: plan_tables(r["length"], r["count"], threshold, miss) for r in sizes}
    found = written(links(nodes, plans, threshold), "links")
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "h", "g", "copies", "low").join(counts, "node", "left").join(
        roots.withColumnRenamed("v", "node"), "node", "left").select(
        "h", "g", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("root"))
    named = written(named, "components")
    lowest = written(named.groupBy("root").agg(F.min("low").alias("component_id")), "smallest")
    labels = written(named.join(lowest, "root").select("h", "g", "n_links", "component_id"), "labels")
    labelled = rows.select("k", "ok", "h", "g").join(
        labels.withColumn("ok", F.lit(True)), ["h", "g", "ok"], "left")
    lone = F.when(F.col("n_links").isNull(), F.col("k")).otherwise(F.col("component_id"))
    return labelled.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias(
        "n_links"), lone.alias("component_id"), F.col("k").eqNullSafe(lone).alias("kept"))
