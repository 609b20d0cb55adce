"""Removal of repeated word sequences with prefix-partitioned suffix trees.

A suffix is a word position of a document with the 20 words from there on, spelt in two numbers of 64
bits: the hash of its first five words and one of all twenty. Suffixes whose prefixes fall into one
group are sorted by both; where neighbours agree in both is a node as deep as a window, and its leaves
are a repeat. Windows that differ in one word differ in a number unless the 64-bit hashes of the two
words are equal; other different windows are taken for equal with a chance of 2^-64 a pair at most.
Groups are of bounded size: counts by the first five words are taken over all documents, rare prefixes
share a group, and a frequent prefix is split by all twenty words.

Only suffixes that can repeat enter the trees. Each window has an anchor, the least of the hashes of
its five-word sequences, so that equal windows have equal anchors; a first pass finds the anchors that
occur at two or more places. Documents are dealt to blocks of bounded size by a hash of id and text. A
block finds its own earlier occurrences, and sends each distinct window once to the trees, which answer
with one bit: whether an earlier document, in the order of id, has it. A sequence that is everywhere
so sends one entry from each block, and no group grows with its occurrences.

Null and empty texts have no words. Null ids come first in the order. Rows that share an id are ordered
by a hash of the text; identical rows are copies, of which one counts as the first. Texts shorter than
a window stay. A block holds its longest document whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceworks.llm.common import column, slices, word_finder
from sliceworks.session import written

WINDOW, SYMBOL = 20, 5
#: Characters of a block, characters whose anchors make a group, and suffixes of a tree group.
BLOCK_CHARS, ANCHOR_CHARS, GROUP_SUFFIXES = 4_000_000, 20_000_000, 1_000_000
#: Bins of first symbols that are counted, and rows in which a task sends their counts.
BINS, BIN_ROWS = 4096, 64
#: Anchors that a task gathers before it sends them, and words whose hashes it remembers.
GATHERED, VOCABULARY = 1_000_000, 300_000
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                    0xA0761D6478BD642F], dtype=np.uint64)
ADDED = (("n_words", "bigint"), ("n_removed", "bigint"), ("kept", "string"))
PACKED = "g long, b long, anchors binary, blocks binary, many binary, counts binary"
CONTROL = "b long, g long, anchors binary, bits binary"
ENTRIES = "g long, b long, high binary, low binary, owner binary, ids binary, ties binary"


class WordHashes:
    """64-bit hashes of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.find = word_finder()

    def of(self, words: list[str]) -> np.ndarray:
        import xxhash

        if len(self.known) > VOCABULARY:
            self.known = {}
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def symbols(hashes: np.ndarray) -> np.ndarray:
    """Hash of the five words from each position."""

    n = len(hashes) - SYMBOL + 1
    mixed = hashes[:n] * FACTORS[0]
    for k in range(1, SYMBOL):
        mixed += (hashes[k:k + n] ^ (hashes[k:k + n] >> np.uint64(29))) * FACTORS[k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= FACTORS[1]
    return mixed ^ (mixed >> np.uint64(29))


def whole_windows(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of all 20 words from each of these places, out of the 64 bits of its four symbols."""

    mixed = found[at] * FACTORS[0]
    for k in range(1, WINDOW // SYMBOL):
        symbol = found[at + k * SYMBOL]
        mixed += (symbol ^ (symbol >> np.uint64(31))) * FACTORS[k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= FACTORS[4]
    return mixed ^ (mixed >> np.uint64(29))


def sliding(values: np.ndarray, size: int, function) -> np.ndarray:
    """Least or greatest of each ``size`` values in a row; ``size`` is a power of two."""

    step = 1
    while step < size:
        values = function(values[:-step], values[step:])
        step *= 2
    return values


REACH = WINDOW - SYMBOL + 1  # five-word sequences in a window, 16


def anchors_of(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the anchors' values with one entry for each place."""

    least = sliding(found, REACH, np.minimum)
    edge = np.zeros(REACH - 1, dtype=np.uint64)
    greatest = sliding(np.concatenate([edge, least, edge]), REACH, np.maximum)
    return least, found[greatest == found]


def pack_anchors(anchors: list[np.ndarray], blocks: list[int], bins: np.ndarray,
                 groups: int) -> pa.RecordBatch:
    """One row for each group: distinct pairs of anchor and block and whether a pair came twice;
    then the counts of first symbols."""

    empty = np.zeros(0, dtype=np.uint64)
    values = np.concatenate([empty, *anchors])
    owner = np.repeat(np.array(blocks, dtype=np.uint32), [len(a) for a in anchors])
    group = (values % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((owner, values, group))
    values, owner, group = values[order], owner[order], group[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    many = (np.diff(np.append(at, len(values))) > 1).astype(np.uint8)
    values, owner, group = values[at], owner[at], group[at]
    present, starts = np.unique(group, return_index=True)
    spans = list(zip(starts, [*starts[1:], len(group)], strict=True)) if len(group) else []
    size = BINS // BIN_ROWS
    none = [None] * BIN_ROWS
    return pa.RecordBatch.from_arrays([
        pa.array([*present.tolist(), *range(groups, groups + BIN_ROWS)], pa.int64()),
        pa.array([0] * (len(spans) + BIN_ROWS), pa.int64()),
        pa.array([values[a:z].tobytes() for a, z in spans] + none, pa.binary()),
        pa.array([owner[a:z].tobytes() for a, z in spans] + none, pa.binary()),
        pa.array([many[a:z].tobytes() for a, z in spans] + none, pa.binary()),
        pa.array([None] * len(spans) + [bins[k * size:(k + 1) * size].tobytes()
                                        for k in range(BIN_ROWS)], pa.binary())],
        names=["g", "b", "anchors", "blocks", "many", "counts"])


def joined(column_: pa.ChunkedArray, kind) -> np.ndarray:
    """The numbers of all rows of a packed column."""

    return np.concatenate([np.zeros(0, dtype=kind)] + [
        np.frombuffer(x, dtype=kind) for x in column_.to_pylist() if x])


def repeated_anchors(table: pa.Table, groups: int) -> pa.Table:
    """For each block, the anchors of one group that occur at two places or more; for the rows of
    counts, their sum."""

    g = table["g"][0].as_py()
    if g >= groups:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in table["counts"].to_pylist())
        return pa.table([pa.array([-1], pa.int64()), pa.array([g - groups], pa.int64()),
                         pa.array([total.tobytes()], pa.binary()), pa.array([None], pa.binary())],
                        names=["b", "g", "anchors", "bits"])
    values, owner = joined(table["anchors"], np.uint64), joined(table["blocks"], np.uint32)
    many = joined(table["many"], np.uint8)
    order = np.argsort(values, kind="stable")
    values, owner, many = values[order], owner[order], many[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    counts = np.diff(np.append(starts, len(values)))
    repeats = np.repeat((counts > 1) | (np.add.reduceat(many, starts) > 0), counts)
    values, owner = values[repeats], owner[repeats]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    blocks, starts = np.unique(owner, return_index=True)
    ends = [*starts[1:], len(owner)]
    return pa.table([pa.array(blocks.astype(np.int64)), pa.array(np.full(len(blocks), g, np.int64)),
                     pa.array([np.unique(values[a:z]).tobytes()
                               for a, z in zip(starts, ends, strict=True)], pa.binary()),
                     pa.array([None] * len(blocks), pa.binary())], names=["b", "g", "anchors", "bits"])


def prefix_groups(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each bin of first symbols."""

    base, split, group, filled = np.zeros(BINS, np.int64), np.ones(BINS, np.int64), 0, 0
    for k, count in enumerate(counts.tolist()):
        if filled and filled + count > GROUP_SUFFIXES:
            group, filled = group + 1, 0
        base[k] = group
        if count > GROUP_SUFFIXES:
            split[k] = -(-count // GROUP_SUFFIXES)
            group, filled = group + int(split[k]), 0
        else:
            filled += count
    return base, split


class BlockWindows:
    """The windows of a block's documents that may repeat, each distinct one once."""

    def __init__(self, table: pa.Table, key: str, text: str, tie: str, anchors: np.ndarray,
                 base: np.ndarray, split: np.ndarray) -> None:
        ids = table[key].to_pylist()
        self.ids = np.array([-(1 << 63) if i is None else i for i in ids], dtype=np.int64)
        self.ties = np.array(table[tie].to_pylist(), dtype=np.int64)
        self.order = np.lexsort((self.ties, self.ids))
        hashes = WordHashes()
        self.words: list[list[str]] = []
        high, low, owner, place = [], [], [], []
        texts = table[text].to_pylist()
        for rank, row in enumerate(self.order.tolist()):
            words = hashes.find(texts[row] or "")
            self.words.append(words)
            if len(words) < WINDOW:
                continue
            found = symbols(hashes.of(words))
            least = sliding(found, REACH, np.minimum)
            spot = np.searchsorted(anchors, least)
            at = np.flatnonzero(anchors[np.minimum(spot, len(anchors) - 1)] == least
                                if len(anchors) else np.zeros(len(least), bool))
            high.append(found[at])
            low.append(whole_windows(found, at))
            owner.append(np.full(len(at), rank, dtype=np.uint32))
            place.append(at)
        none = np.zeros(0, dtype=np.uint64)
        self.high, self.low = np.concatenate([none, *high]), np.concatenate([none, *low])
        self.owner = np.concatenate([none.astype(np.uint32), *owner])
        self.place = np.concatenate([none.astype(np.int64), *place])
        first = (self.high >> np.uint64(52)).astype(np.int64)  # 12 bits of the first symbol
        self.group = base[first] + ((self.low >> np.uint64(33)).astype(np.int64) % split[first])
        self.sorted = np.lexsort((self.low, self.high, self.group))  # stable: earlier ones first
        h, lo, g = self.high[self.sorted], self.low[self.sorted], self.group[self.sorted]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]) | (g[1:] != g[:-1])
        self.fresh = fresh
        self.distinct = self.sorted[fresh]  # the first occurrence of each window, by group and key

    def spans(self) -> Iterator[tuple[int, int, int]]:
        """Group and range of its distinct windows."""

        groups, starts = np.unique(self.group[self.distinct], return_index=True)
        yield from zip(groups.tolist(), starts.tolist(),
                       [*starts[1:].tolist(), len(self.distinct)], strict=True)

    def entries(self, block: int) -> pa.Table:
        """What is sent to the trees: a row for each group, with windows and first documents."""

        rows = []
        for group, a, z in self.spans():
            at = self.distinct[a:z]
            owners, owner = np.unique(self.owner[at], return_inverse=True)
            row = self.order[owners]
            rows.append((group, block, self.high[at].tobytes(), self.low[at].tobytes(),
                         owner.astype(np.uint32).tobytes(), self.ids[row].tobytes(),
                         self.ties[row].tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.table([pa.array(c, t) for c, t in zip(
            columns, (pa.int64(), pa.int64(), *[pa.binary()] * 5), strict=True)],
            names=["g", "b", "high", "low", "owner", "ids", "ties"])

    def repeats(self, bits: dict[int, bytes]) -> np.ndarray:
        """Which of the windows that may repeat start earlier too."""

        known = np.zeros(len(self.distinct), dtype=bool)
        for group, a, z in self.spans():
            if group in bits:
                known[a:z] = np.unpackbits(np.frombuffer(bits[group], np.uint8), count=z - a)
        out = np.ones(len(self.high), dtype=bool)
        out[self.distinct] = known
        return out


def subtree(table: pa.Table) -> pa.Table:
    """Sorts a group's suffixes and answers, for each entry, whether it is not the first leaf of its
    node at the depth of a window."""

    columns = {c: table[c].to_pylist() for c in table.column_names}
    high, low, ids, ties, sizes = [], [], [], [], []
    for h, lo, o, i, t in zip(columns["high"], columns["low"], columns["owner"], columns["ids"],
                              columns["ties"], strict=True):
        owner = np.frombuffer(o, dtype=np.uint32)
        high.append(np.frombuffer(h, dtype=np.uint64))
        low.append(np.frombuffer(lo, dtype=np.uint64))
        ids.append(np.frombuffer(i, dtype=np.int64)[owner])
        ties.append(np.frombuffer(t, dtype=np.int64)[owner])
        sizes.append(len(owner))
    high, low = np.concatenate(high), np.concatenate(low)
    order = np.lexsort((np.concatenate(ties), np.concatenate(ids), low, high))
    high, low = high[order], low[order]
    later = np.zeros(len(order), dtype=bool)
    later[order[1:]] = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
    cuts = np.cumsum(sizes)[:-1]
    return pa.table([table["b"].combine_chunks(), table["g"].combine_chunks(),
                     pa.array([None] * len(sizes), pa.binary()),
                     pa.array([np.packbits(x).tobytes() for x in np.split(later, cuts)], pa.binary())],
                    names=["b", "g", "anchors", "bits"])


def covered(places: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in windows that start at these places."""

    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, places, 1)
    np.add.at(marks, places + WINDOW, -1)
    return np.cumsum(marks[:n]) > 0


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``n_removed`` and ``kept``, the words left, joined by blanks.

    A word goes if it lies in a window of 20 words that also starts earlier: in a document of a
    smaller id, or earlier in its own. Ids are integers. The new columns take the place of input
    columns of their names.
    """

    fields = [f for f in df.schema.fields if f.name not in {n for n, _ in ADDED}]
    chars = df.select(F.sum(F.length(column(text)))).first()[0] or 0
    blocks, groups = (max(1, -(-chars // size)) for size in (BLOCK_CHARS, ANCHOR_CHARS))
    tie = F.xxhash64(column(text), F.lit(7))
    block = F.pmod(F.xxhash64(column(key), column(text)), F.lit(blocks))
    plain = df.select(*[column(f.name) for f in fields])
    # block and tie take names that no input column has
    names = {f.name for f in fields}
    b, t = ("_" * k + n for k, n in zip(
        [next(k for k in range(1, 99) if "_" * k + n not in names) for n in ("block", "tie")],
        ("block", "tie"), strict=True))
    rows = plain.withColumn(b, block).withColumn(t, tie)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held, owners, size, bins = [], [], 0, np.zeros(BINS, dtype=np.int64)
        for batch in slices(batches):
            for owner, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = hashes.find(value or "")
                if len(words) < WINDOW:
                    continue
                found = symbols(hashes.of(words))
                bins += np.bincount((found[:len(words) - WINDOW + 1] >> np.uint64(52)).astype(np.int64),
                                    minlength=BINS)
                held.append(anchors_of(found)[1])
                owners.append(owner)
                size += len(held[-1])
                if size >= GATHERED:
                    yield pack_anchors(held, owners, bins, groups)
                    held, owners, size, bins = [], [], 0, np.zeros(BINS, dtype=np.int64)
        if held:
            yield pack_anchors(held, owners, bins, groups)

    packed = rows.select(b, column(text)).mapInArrow(gather, PACKED)
    control = written(packed.groupBy("g").applyInArrow(
        lambda table: repeated_anchors(table, groups), CONTROL), "anchors")
    counts = np.zeros(BINS, dtype=np.int64)
    for part, values in control.filter("b = -1").select("g", "anchors").collect():  # BIN_ROWS rows
        counts.reshape(BIN_ROWS, -1)[part] = np.frombuffer(values, dtype=np.int64)
    base, split = prefix_groups(counts)
    anchors = control.filter("b >= 0")

    def windows(left: pa.Table, right: pa.Table) -> BlockWindows:
        return BlockWindows(left, key, text, t, np.sort(joined(right["anchors"], np.uint64)), base, split)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), *[pa.binary()] * 5)],
                            names=["g", "b", "high", "low", "owner", "ids", "ties"])
        return windows(left, right).entries(left[b][0].as_py())

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        found = windows(left, right)
        bits = {g: x for g, x in zip(right["g"].to_pylist(), right["bits"].to_pylist(), strict=True)
                if x is not None}
        gone = found.repeats(bits)
        places, owner = found.place[gone], found.owner[gone]
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(found.words) + 1))
        out: list[tuple] = [()] * len(found.words)
        for rank, words in enumerate(found.words):
            own = places[order[cuts[rank]:cuts[rank + 1]]]
            if len(own):
                lost = covered(own, len(words))
                kept = " ".join(w for w, x in zip(words, lost.tolist(), strict=True) if not x)
                out[found.order[rank]] = (len(words), int(lost.sum()), kept)
            else:
                out[found.order[rank]] = (len(words), 0, " ".join(words))
        columns = zip(*out, strict=True) if out else ([], [], [])
        new = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]
        return pa.table([left[f.name].combine_chunks() for f in fields] + new,
                        names=[f.name for f in fields] + [n for n, _ in ADDED])

    dealt = rows.groupBy(b)
    entries = dealt.cogroup(anchors.groupBy("b")).applyInArrow(send, ENTRIES)
    answers = entries.groupBy("g").applyInArrow(subtree, CONTROL)
    schema = T.StructType([*fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in ADDED)])
    return dealt.cogroup(anchors.unionByName(answers).groupBy("b")).applyInArrow(remove, schema)
