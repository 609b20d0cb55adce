"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components.

A fingerprint bit is set if it is set in over half of the hashes of a text's shingles. Two
fingerprints at most ``radius`` bits apart are linked. With the 64 bits in ``radius + 2`` bands, linked
fingerprints agree in at least two bands, so distinct fingerprints meet in one bucket for each pair of
bands. A bucket is cut into chunks of bounded size by hash; the chunks of a bucket are packed and
compared two at a time. A comparison holds the members as 64 bit planes: one bit operation on a plane
updates the distances of 64 members, counted by carry-save addition in a few bit counters, and
blocks of 64 in which all have passed the radius are left out of the planes that follow.

Only links that join what is not yet joined within a comparison are sent on, at most one less than its
members, so equal and dense groups cause no square of links. Components come from star contraction
with a fixed number of rows per link; copies of one fingerprint are one node throughout.

A null or empty text has fingerprint 0, linked like any other. Repeated rows share a fingerprint.
Null ids take part; the smallest id of a component leaves nulls out where there are others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceworks.llm.common import add_columns, column, word_finder
from sliceworks.session import written

#: Members of a chunk of a bucket, and shingles whose hashes are added up at a time.
CHUNK, SHINGLES = 512, 1 << 16
WIDTH = 64


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, the lowest bit first."""

    total = np.zeros(WIDTH, dtype=np.int64)
    for k in range(0, len(hashes), SHINGLES):
        part = np.ascontiguousarray(hashes[k:k + SHINGLES], dtype="<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprint(words: list[str], size: int, seed: int) -> int:
    """The fingerprint of a text's words, as an unsigned number."""

    import xxhash

    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - size + 1)
    hashes = np.fromiter((digest(" ".join(words[k:k + size]), seed) for k in range(n)),
                         dtype=np.uint64, count=n)
    bits = set_bits(hashes) * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def add_fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint_bits", size: int = 3,
                     seed: int = 42) -> DataFrame:
    """Adds fingerprints as signed 64-bit numbers."""

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
    find = word_finder()

    def prints(texts: list[str | None]):
        values = np.array([fingerprint(find(t.translate(lower)), size, seed) if t else 0
                           for t in texts], dtype=np.uint64)
        return [values.astype(np.int64)]

    return add_columns(df, [text], [(out, "bigint")], prints)


class BitSlices:
    """Fingerprints as bit planes; 64 of them to a block."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        blocks = -(-self.n // 64)
        padded = np.zeros(blocks * 64, dtype=np.uint64)
        padded[:self.n] = values
        bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        self.planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")
        self.real = np.full(blocks, ~np.uint64(0))
        if self.n % 64:
            self.real[-1] = np.uint64((1 << self.n % 64) - 1)

    def within(self, value: int, radius: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """Members at most so many bits from the value, among those wanted (a mask of blocks)."""

        dead = ~(self.real if wanted is None else self.real & wanted)
        full = ~np.uint64(0)
        at = np.flatnonzero(dead != full)
        counters = np.zeros(((radius + 1).bit_length(), len(at)), dtype=np.uint64)
        dead = dead[at]
        limit = radius + 1
        for plane in range(WIDTH):
            carry = self.planes[plane, at] ^ (full if value >> plane & 1 else np.uint64(0))
            for counter in counters:  # carry-save addition of one bit to 64 counters at once
                carry, counter[:] = counter & carry, counter ^ carry
            reached = np.full(len(at), full)
            for k, counter in enumerate(counters):
                reached &= counter if limit >> k & 1 else ~counter
            dead |= reached | carry
            if plane % 8 == 7 and (dead == full).any():  # abandon blocks that are all too far
                keep = dead != full
                at, dead, counters = at[keep], dead[keep], counters[:, keep]
                if not len(at):
                    break
        alive = np.zeros(len(self.real), dtype="<u8")
        alive[at] = ~dead
        return np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little")[:self.n])

    def all_blocks(self) -> np.ndarray:
        return self.real.copy()


def joining_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within ``radius`` that join the members as all such links would, without a cycle."""

    slices, links = BitSlices(values), []
    left = slices.all_blocks()  # members not yet reached

    def take(k: int) -> None:
        left[k >> 6] &= ~(np.uint64(1) << np.uint64(k & 63))

    for first in range(len(values)):
        if not int(left[first >> 6]) >> (first & 63) & 1:
            continue
        take(first)
        reached = [first]
        while reached:
            k = reached.pop()
            for other in slices.within(int(values[k]), radius, left).tolist():
                take(other)
                links.append((k, other))
                reached.append(other)
    return links


def bands(radius: int) -> list[int]:
    """Masks of the pairs of bands, at least one of which linked fingerprints share."""

    cuts = [WIDTH * k // (radius + 2) for k in range(radius + 3)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m | o for m, o in combinations(masks, 2)]


def signed(value: int) -> int:
    return value - (1 << WIDTH) if value >> (WIDTH - 1) else value


def links(prints: DataFrame, radius: int = 3, value: str = "f") -> DataFrame:
    """Links (a, b) between distinct fingerprints that give the components of all links."""

    keyed = prints.select(F.col(value).alias("f"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("t"), F.col(value).bitwiseAND(F.lit(signed(m))).alias("m"))
        for k, m in enumerate(bands(radius))])).alias("key")).select("f", "key.t", "key.m")
    # written, so that the join reads both sides from a shuffle and can split a hot bucket
    sizes = written(keyed.groupBy("t", "m").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
                    "buckets")
    members = keyed.join(sizes, ["t", "m"]).withColumn(
        "chunks", F.ceil(F.col("n") / CHUNK).cast("int")).withColumn(
        "c", F.pmod(F.xxhash64("f"), F.col("chunks")).cast("int"))
    packed = members.groupBy("t", "m", "c", "chunks").agg(F.collect_list("f").alias("fs"))
    alone = packed.filter("chunks = 1").select(F.col("fs").alias("one"),
                                               F.lit(None).cast("array<bigint>").alias("two"))
    # a chunk goes to its meeting with each chunk of the bucket, once as the first of the two
    split = packed.filter("chunks > 1").withColumn("o", F.explode(
        F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = split.select("t", "m", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"),
                        (F.col("c") <= F.col("o")).alias("first"), "fs")
    met = pair.groupBy("t", "m", "a", "b").agg(
        F.max(F.when(F.col("first"), F.col("fs"))).alias("one"),
        F.max(F.when(~F.col("first"), F.col("fs"))).alias("two")).select("one", "two")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                members = np.array((one or []) + (two or []), dtype=np.int64)
                for a, b in joining_links(members.view(np.uint64), radius):
                    left.append(members[a])
                    right.append(members[b])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())],
                                             names=["a", "b"])

    # few bytes but much work: as many tasks as the session deals a shuffle into
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return alone.unionByName(met).repartition(tasks).mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Nodes (v) of the edges (a, b) and the smallest node (root) that each can reach.

    Large and small star contraction in turn: every node's neighbours are joined to the smallest
    node near, until nothing changes. Each round's edges are written to the shared folder.
    """

    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast(
        "decimal(38,0)"))).first())
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"),
                                                  F.least("a", "b").alias("b")).distinct(), "links")
    last = state(edges)
    for _ in range(rounds):
        near = both(edges)
        small = written(near.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m")), "smallest")  # see links()
        large = near.filter("b > a").join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct(), "links")
        lowest = written(large.groupBy("a").agg(F.min("b").alias("m")), "smallest")
        star = large.join(lowest, "a")
        edges = written(star.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            star.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "links")
        now = state(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"Components did not settle in {rounds} rounds.")
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "v").unionByName(
        edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def rooted(rows: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint ``f`` once, with its least ``k`` and the root of its component."""

    distinct = rows.groupBy("f").agg(F.min("k").alias("k"))
    roots = components(links(distinct.select("f"), radius))
    return written(distinct.join(roots, F.col("f") == F.col("v"), "left").select(
        "f", "k", F.coalesce("root", "f").alias("root")), "components")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3,
                radius: int = 3, seed: int = 42) -> DataFrame:
    """One row of each component: that of the smallest key, a null key only where there is no other;
    of rows that share the key, that of the lowest hash of the text, then of the whole row.

    A row is known by the two hashes, 128 bits, so null and repeated keys stay apart; copies of a row
    are one. Choice and removal of copies combine on the map side.
    """

    columns = [column(c) for c in df.columns]
    hashes = F.xxhash64(column(text)), F.xxhash64(F.lit(7), column(key).isNull(), *columns)
    rows = written(add_fingerprints(
        df.select(F.struct(column(key).isNull().alias("none"), column(key).alias("key"),
                           hashes[0].alias("h"), hashes[1].alias("g")).alias("k"),
                  column(text).alias("t")), "t", "f", size, seed).drop("t"), "fingerprints")
    first = rooted(rows, radius).groupBy("root").agg(F.min("k").alias("k")).select("k.h", "k.g")
    once = df.select(F.struct(*columns).alias("r"), hashes[0].alias("h"), hashes[1].alias("g")).groupBy(
        "h", "g").agg(F.min("r").alias("r"))
    return once.join(first, ["h", "g"], "left_semi").select("r.*")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3,
                    radius: int = 3, seed: int = 42) -> DataFrame:
    """Key, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key reachable."""

    rows = written(add_fingerprints(df.select(column(key).alias("k"), column(text).alias("t")), "t",
                                    "f", size, seed).drop("t"), "fingerprints")
    grouped = rooted(rows, radius)
    lowest = written(grouped.groupBy("root").agg(F.min("k").alias("component_id")), "smallest")
    named = grouped.select("f", "root").join(lowest, "root").select("f", "component_id")
    return rows.join(named, "f").select(
        F.col("k").alias(key), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
