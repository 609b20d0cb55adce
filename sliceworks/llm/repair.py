"""Repair of conversation structure: least-cost edits, and of these the least audit text.

A conversation's roles should read, by initials, ``(s?(ua)+)?``. Its rows come by turn (nulls first), then by
role and by a hash of the text; equal rows are one with a count. The first fault of a row counts: blank (no
character but ASCII white space), duplicate (role and text seen earlier), truncated (the last such
character is none of ``.!?``). Edits are Keep (0), Rerole to user or assistant (2), Delete (3; a must for blank
and duplicate rows) and Insert of an empty user or assistant text anywhere (2); a truncated row that stays adds
1. The audit is the initials of the cheapest edits in order; of several the least in ASCII.

Rows without their texts are ordered across tasks and cut into chunks of bounded length. The costs from every
(row, state) node to the end come from dynamic programming over the four states of the pattern; chunks of a
long conversation hand them on as least-cost matrices. Then the arcs that a cheapest way can take are
ranked by prefix doubling: each node gets the rank of its audit of one letter, then of two, four and so on,
from its own rank and that of the node that many letters on; ranks choose the arc and doubled pointers mark the
nodes of the path with their places. A chunk is solved for each state it may be entered in, and one scan
over the chunks of a conversation picks the state. At last texts meet their edits, sorted within tasks by
conversation, and are hashed as they stream by: a conversation is one task there, as a digest cannot be
split, but is never held but for its audit.

Null roles and texts are one space; a null key is a conversation of its own. A role that starts with none
of s, u, a (an empty one too) cannot be kept as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sliceworks.llm.common import column, slices
from sliceworks.session import written

#: Rows of a chunk at most, and chunks' rows that are ranked together.
CHUNK, TOGETHER = 4096, 8192
BLANKS = " \t\n\x0b\x0c\r"
FAR = 1 << 60

#: States: nothing yet, after system, after user, after assistant. Where another turn (of user or
#: assistant) leads, and where a kept row of each initial leads (-1: nowhere).
NEXT = np.array([2, 2, 3, 2])
KEPT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1), "": (-1, -1, -1, -1)}
INITIALS = ("s", "u", "a", "")
#: Cost from each state at the end of a conversation.
FINAL = (0, 4, 2, 0)
LETTERS = "DIKR"
LEGAL_PAIRS = ("su", "ua", "au")


def costs(rows: list[tuple[int, bool, bool, int]], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least cost from each state before each row, and at the end, to the end of the conversation.

    A row is the number of its initial, whether it must go, whether it is truncated, and how many
    more copies (all of them duplicates) follow it.
    """

    out = [end]
    a, b, c, d = end
    for initial, gone, truncated, copies in reversed(rows):
        more = 3 * copies
        w, x, y, z = a + 3 + more, b + 3 + more, c + 3 + more, d + 3 + more
        if not gone:
            more += truncated
            user, assistant = c + 2 + more, d + 2 + more
            w, x, y, z = min(w, user), min(x, user), min(y, assistant), min(z, user)
            if initial == 0:
                w = min(w, b + more)
            elif initial == 1:
                w, x, z = min(w, c + more), min(x, c + more), min(z, c + more)
            elif initial == 2:
                y = min(y, d + more)
        c, d = min(y, z + 2), min(z, y + 2)
        a, b = min(w, c + 2), min(x, c + 2)
        out.append((a, b, c, d))
    return out[::-1]


class Ranking:
    """Optimal arcs of some chunks together, ranked by prefix doubling.

    ``chunks`` are (rows, cost at the end, whether the conversation ends there). Node ``4 * k + q`` is
    state ``q`` before row ``k`` of all rows, each chunk followed by a row for its end.
    """

    def __init__(self, chunks: list[tuple[list, tuple, bool]]) -> None:
        tables = [costs(rows, end) for rows, end, _ in chunks]
        self.starts = np.cumsum([0, *map(len, tables)])
        cost = np.array([c for t in tables for c in t], dtype=np.int64)
        self.costs = cost[self.starts[:-1]]
        filler = (3, True, False, 0)
        initial, gone, truncated, copies = (np.array(x, dtype=np.int64) for x in zip(
            *(r for rows, _, _ in chunks for r in [*rows, filler]), strict=True))
        ends = self.starts[1:] - 1
        last = np.zeros(len(cost), dtype=bool)
        last[ends] = True
        open_end = np.ones(len(cost), dtype=bool)  # whether a turn may be put in before this row
        open_end[ends] = [final for _, _, final in chunks]

        n, node = len(cost), np.arange(len(cost))
        after = cost[np.minimum(node + 1, n - 1)]
        kept = np.array([KEPT[i] for i in INITIALS])[initial]
        more = (truncated + 3 * copies)[:, None]
        free = ~last & ~gone.astype(bool)
        across = lambda q: 4 * (node + 1)[:, None] + q
        take = lambda q: np.take_along_axis(after, np.maximum(q, 0), 1)
        other = np.broadcast_to(NEXT, (n, 4))
        states = np.broadcast_to(np.arange(4), (n, 4))
        good = np.stack([
            (after + 3 + 3 * copies[:, None] == cost) & ~last[:, None],
            (cost[:, NEXT] + 2 == cost) & open_end[:, None],
            (take(kept) + more == cost) & (kept >= 0) & free[:, None],
            (take(other) + 2 + more == cost) & free[:, None]], 2).reshape(-1, 4)
        target = np.stack([across(states), 4 * node[:, None] + other, across(np.maximum(kept, 0)),
                           across(other)], 2).reshape(-1, 4)
        self.rank(good, np.where(good, target, 0))

    def rank(self, good: np.ndarray, target: np.ndarray) -> None:
        """Ranks by audits of 1, 2, 4 and so on letters; stops when all ways have come to an end."""

        n = len(good)
        end = ~good.any(1)
        names = np.arange(1, 5)

        def choose(ranks: np.ndarray) -> np.ndarray:
            """The arc of each node whose letter, then the rank of where it leads, is least."""

            return np.where(good, names * (n + 5) + ranks[target], FAR).argmin(1)

        arc = choose(np.zeros(n, dtype=np.int64))
        ranks = np.where(end, 0, names[arc])
        self.arcs = arc
        pointer = np.where(end, np.arange(n), target[np.arange(n), arc])
        self.pointers = [pointer]
        while (pointer != pointer[pointer]).any():
            # an audit of twice as many letters: its first half's rank, then that of the second
            _, ranks = np.unique(ranks * (n + 5) + ranks[pointer], return_inverse=True)
            pointer = pointer[pointer]
            self.pointers.append(pointer)
        # the letters of a node's arcs differ, so longer audits never change a choice
        assert (choose(ranks)[~end] == arc[~end]).all()
        self.end = end

    def paths(self, state: int) -> tuple[list[list[tuple[int, str]]], list[int]]:
        """For each chunk, entered in a state, (row, letter) along its least path, and where it ends."""

        start = 4 * self.starts[:-1] + state
        place = np.full(len(self.end), -1, dtype=np.int64)
        place[start] = 0
        for k, pointer in enumerate(self.pointers):  # nodes up to twice as far, by one jump of each
            known = np.flatnonzero(place >= 0)
            known = known[~self.end[known] & ~self.end[pointer[known]] & (place[pointer[known]] < 0)]
            place[pointer[known]] = place[known] + (1 << k)
        on = np.flatnonzero((place >= 0) & ~self.end)
        chunk = np.searchsorted(self.starts, on // 4, side="right") - 1
        order = np.lexsort([place[on], chunk])
        on, chunk = on[order], chunk[order]
        out: list[list[tuple[int, str]]] = [[] for _ in start]
        rows = on // 4 - self.starts[chunk]
        for c, row, arc in zip(chunk.tolist(), rows.tolist(), self.arcs[on].tolist(), strict=True):
            out[c].append((row, LETTERS[arc]))
        return out, (self.pointers[-1][start] % 4).tolist()


def letters(rows: list[tuple], path: list[tuple[int, str]]) -> list[str]:
    """Letters of each row: turns put in before it, its own edit, its copies that go; those at the
    end stay with the last row."""

    out = [""] * len(rows)
    for row, letter in path if rows else ():  # a chunk without rows comes first and is entered in state 0
        at = min(row, len(rows) - 1)
        out[at] += letter if letter == "I" else letter + "D" * rows[row][3]
    return out


def faulty(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it is cut off."""

    stripped = F.rtrim(text, F.lit(BLANKS))
    return stripped == "", ~F.substring(stripped, -1, 1).isin(".", "!", "?") & (stripped != "")


def spine(df: DataFrame) -> DataFrame:
    """Each different row once, without its text: its copies and faults."""

    blank, truncated = faulty(F.col("text"))
    found = written(df.select("conv", "turn", "role", "h1", "h2", blank.alias("blank"),
                              truncated.alias("truncated"), "copies").groupBy(
        "conv", "turn", "role", "h1", "h2").agg(
        F.max("blank").alias("blank"), F.max("truncated").alias("truncated"),
        F.sum("copies").alias("copies")), "rows")
    seen = written(found.filter("copies > 0").groupBy("conv", "role", "h1", "h2").agg(
        F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("unturned"),
        F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated")
    left, right = found.alias("l"), seen.alias("r")
    same = F.col("l.conv").eqNullSafe(F.col("r.conv")) & (F.col("l.role") == F.col("r.role")) & (
        F.col("l.h1") == F.col("r.h1")) & (F.col("l.h2") == F.col("r.h2"))
    later = F.when(F.col("r.unturned"), F.col("l.turn").isNotNull()).otherwise(
        F.col("l.turn") > F.col("r.first"))
    return left.join(right, same, "left").select("l.*", F.coalesce(later, F.lit(False)).alias("later"))


ORDER = ("conv", "turn", "role", "h1", "h2")


def cut(rows: DataFrame) -> DataFrame:
    """Chunks of conversations: their rows as arrays, and figures of the rows.

    ``whole`` chunks are all of their conversation; the others go in order of ``part`` and ``number``.
    """

    kind = rows.schema["conv"].dataType
    schema = T.StructType([
        T.StructField("conv", kind), T.StructField("part", T.IntegerType()),
        T.StructField("number", T.IntegerType()), T.StructField("whole", T.BooleanType()),
        *[T.StructField(c, T.ArrayType(t)) for c, t in (
            ("turns", T.LongType()), ("roles", T.StringType()), ("h1s", T.LongType()),
            ("h2s", T.LongType()), ("initials", T.IntegerType()), ("gone", T.BooleanType()),
            ("cut", T.BooleanType()), ("extra", T.LongType()))],
        *[T.StructField(c, T.LongType()) for c in (
            "blank", "duplicate", "truncated", "illegal", "low", "high", "turns_n", "first_turn",
            "last_turn")],
        T.StructField("first_role", T.StringType()), T.StructField("last_role", T.StringType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def chunk(key, part: int, number: int, whole: bool, rows: list[tuple]) -> tuple:
        rows = [r for r in rows if r[7]]
        blank = sum(r[7] for r in rows if r[4])
        duplicate = sum(r[7] if r[6] else r[7] - 1 for r in rows if not r[4])
        cut_off = [bool(r[5] and not r[4] and not r[6]) for r in rows]
        first = [r[1][:1] for r in rows]
        illegal = sum(r[7] - 1 for r in rows) + sum(
            a + b not in LEGAL_PAIRS for a, b in zip(first, first[1:], strict=False))
        turns = [r[0] for r in rows if r[0] is not None]
        return (key, part, number, whole, [r[0] for r in rows], [r[1] for r in rows],
                [r[2] for r in rows], [r[3] for r in rows],
                [INITIALS.index(x) if x in KEPT else 3 for x in first],
                [bool(r[4] or r[6]) for r in rows], cut_off, [r[7] - 1 for r in rows],
                blank, duplicate, sum(cut_off), illegal, min(turns, default=None),
                max(turns, default=None), len(set(turns)), rows[0][0] if rows else None,
                rows[-1][0] if rows else None, first[0] if rows else None, first[-1] if rows else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, done = TaskContext.get().partitionId(), 0, []
        key, rows, inside = None, None, True

        def close(whole: bool) -> None:
            nonlocal number
            done.append(chunk(key, part, number, whole, rows))
            number += 1

        for batch in slices(batches, CHUNK):
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows is None:
                    key, rows = conv, []
                elif conv != key:
                    close(not inside)
                    key, rows, inside = conv, [], False
                elif len(rows) == CHUNK:
                    close(False)
                    rows, inside = [], True
                rows.append(tuple(row))
            if done:
                yield packed(done)
                done.clear()
        if rows is not None:  # may go on in the next partition
            close(False)
            yield packed(done)

    def packed(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)],
            names=schema.names)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(tasks, *ORDER).sortWithinPartitions(*ORDER)
    return ordered.select(*ORDER, "blank", "truncated", "later", "copies").mapInArrow(run, schema)


ROWS_OF = ("initials", "gone", "cut", "extra")


def chunk_rows(batch: pa.RecordBatch, k: int) -> list[tuple]:
    return list(zip(*(batch.column(c)[k].as_py() for c in ROWS_OF), strict=True))


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[pa.RecordBatch, int, list]]]:
    """Chunks in lists with a bounded number of rows."""

    waiting, size = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            rows = chunk_rows(batch, k)
            waiting.append((batch, k, rows))
            size += len(rows) + 1
            if size >= TOGETHER:
                yield waiting
                waiting, size = [], 0
    if waiting:
        yield waiting


def solved(chunks: DataFrame, states: int) -> DataFrame:
    """``cost``, ``exits`` and ``letters`` of each chunk by the state (of the first so many) it is entered in.

    ``end`` is the cost at the chunk's end, ``final`` whether its conversation ends there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in together(batches):
            ranking = Ranking([(rows, tuple(b.column("end")[k].as_py()), b.column("final")[k].as_py())
                               for b, k, rows in some])
            ways = [ranking.paths(q) for q in range(states)]
            found = [[letters(rows, paths[c]) for paths, _ in ways]
                     for c, (_, _, rows) in enumerate(some)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.column(name)[k].as_py() for b, k, _ in some], pa.int32())
                 for name in ("part", "number")]
                + [pa.array(ranking.costs.tolist(), pa.list_(pa.int64())),
                   pa.array([[ends[c] for _, ends in ways] for c in range(len(some))], pa.list_(pa.int32())),
                   pa.array(found, pa.list_(pa.list_(pa.string())))],
                names=["part", "number", "cost", "exits", "letters"])

    return chunks.select("part", "number", *ROWS_OF, "end", "final").mapInArrow(
        run, "part int, number int, cost array<long>, exits array<int>, letters array<array<string>>")


def matrices(chunks: DataFrame) -> DataFrame:
    """Least costs through each chunk from each state (rows) to each state (columns), as one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in together(batches):
            found = []
            for _, _, rows in some:
                ways = [costs(rows, tuple(0 if q == to else FAR for q in range(4)))[0] for to in range(4)]
                found.append([min(ways[to][q], FAR) for q in range(4) for to in range(4)])
            keys = [pa.concat_arrays([b.column(c).slice(k, 1) for b, k, _ in some])
                    for c in ("conv", "part", "number")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(found, pa.list_(pa.int64()))],
                                             names=["conv", "part", "number", "matrix"])

    schema = T.StructType([chunks.schema[c] for c in ("conv", "part", "number")]
                          + [T.StructField("matrix", T.ArrayType(T.LongType()))])
    return chunks.select("conv", "part", "number", *ROWS_OF).mapInArrow(run, schema)


def in_order(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: (r["part"], r["number"]))


def ends_of(key: tuple, table: pa.Table) -> pa.Table:
    """The cost at the end of every chunk of a conversation."""

    cost, out = FINAL, []
    for n, row in enumerate(reversed(in_order(table))):
        out.append({"part": row["part"], "number": row["number"], "end": list(cost), "final": n == 0})
        m = row["matrix"]
        cost = tuple(min(m[4 * q + to] + cost[to] for to in range(4)) for q in range(4))
    return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), ("number", pa.int32()),
                                                ("end", pa.list_(pa.int64())), ("final", pa.bool_())]))


STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def entries_of(key: tuple, table: pa.Table) -> pa.Table:
    """The state in which each chunk of a conversation is entered; its figures with the first chunk."""

    rows, state, out = in_order(table), 0, []
    total = dict.fromkeys(STATS, 0) | {"cost": rows[0]["cost"][0]}
    low, high, different, turn, role = None, None, 0, None, None
    for row in rows:
        out.append({"part": row["part"], "number": row["number"], "entry": state})
        state = row["exits"][state]
        for name in ("blank", "duplicate", "truncated", "illegal"):
            total[name] += row[name]
        if row["first_role"] is None:
            continue
        total["illegal"] += role is not None and role + row["first_role"] not in LEGAL_PAIRS
        different += row["turns_n"] - (turn is not None and turn == row["first_turn"])
        if row["low"] is not None:
            low = row["low"] if low is None else min(low, row["low"])
            high = row["high"] if high is None else max(high, row["high"])
        turn, role = row["last_turn"], row["last_role"]
    total["gaps"] = high - low + 1 - different if different else 0
    out[0] |= total
    return pa.Table.from_pylist(out, pa.schema([
        ("part", pa.int32()), ("number", pa.int32()), ("entry", pa.int32()),
        *[(name, pa.int64()) for name in STATS]]))


def digests(rows: DataFrame) -> DataFrame:
    """``audit`` and ``repaired_sha256`` of conversations whose edits and texts come in order."""

    kind = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), T.StructField("audit", T.StringType()),
                           T.StructField("repaired_sha256", T.StringType())])

    class Repaired:
        def __init__(self, key) -> None:
            self.key, self.audit, self.digest = key, [], hashlib.sha256()
            self.state, self.before, self.role, self.left = 0, "", None, ""

        def turn(self, role: str, text: str) -> None:
            self.digest.update(f"{self.before}{role}:{text}".encode())
            self.before = "\n"

        def edits(self, found: str, role: str) -> None:
            """Follow the letters until one needs its row's text."""

            for k, letter in enumerate(found):
                if letter == "D":
                    continue
                name = "assistant" if self.state == 2 else "user"
                if letter == "K":
                    self.state = KEPT[role[:1]][self.state]
                    name = role
                else:
                    self.state = int(NEXT[self.state])
                if letter == "I":
                    self.turn(name, "")
                else:
                    self.role, self.left = name, found[k + 1:]
                    return

        def feed(self, role: str, found: str | None, text: str | None) -> None:
            if found is not None:
                self.audit.append(found)
                self.edits(found, role)
            elif self.role is not None:
                self.turn(self.role, text)
                self.role = None
                self.edits(self.left, role)

        def row(self) -> tuple:
            return self.key, "".join(self.audit), self.digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in slices(batches):
            out = []
            for key, role, found, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or current.key != key:
                    out += [current.row()] if current else []
                    current = Repaired(key)
                current.feed(role, found, text)
            if out:
                yield batch_of(out)
        if current:
            yield batch_of([current.row()])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*out, strict=True), schema,
                                                                  strict=True)], names=schema.names)

    return rows.select("conv", "role", "letters", "text").mapInArrow(run, schema)


def repair(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", copies: str | None = None) -> DataFrame:
    """By conversation: gaps, faults, illegal neighbours, cost, audit and digest of the repaired turns.

    ``copies`` names a column with the times a row stands there; a row with none only makes its
    conversation known.
    """

    times = column(copies).cast("long") if copies else F.lit(1).cast("long")
    word = lambda c: F.coalesce(column(c), F.lit(" "))
    rows = df.select(column(key).alias("conv"), column(turn).cast("long").alias("turn"),
                     word(role).alias("role"), word(text).alias("text"), times.alias("copies"))
    there = F.col("copies") > 0
    rows = rows.select(
        "conv", *[F.when(there, F.col(c)).alias(c) for c in ("turn", "role")],  # else nulls, which come first
        F.when(there, F.col("text")).otherwise("").alias("text"), "copies").select(
        "*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(5), "text").alias("h2"))
    chunks = written(cut(spine(rows)), "chunks")
    whole = chunks.filter("whole").withColumn("end", F.array(*[F.lit(x).cast("long") for x in FINAL])
                                              ).withColumn("final", F.lit(True))
    simple = solved(whole, 1)
    ends = matrices(chunks.filter("not whole")).groupBy("conv").applyInArrow(
        ends_of, "part int, number int, end array<long>, final boolean")
    split = written(chunks.filter("not whole").join(ends, ["part", "number"]), "parts")
    ways = written(solved(split, 4), "ways")
    figures = ["conv", "part", "number", "cost", "exits", "blank", "duplicate", "truncated", "illegal",
               "low", "high", "turns_n", "first_turn", "last_turn", "first_role", "last_role"]
    entries = written(ways.join(split, ["part", "number"]).select(*figures).groupBy("conv").applyInArrow(
        entries_of, "part int, number int, entry int, " + ", ".join(f"{c} long" for c in STATS)), "entries")
    found = written(simple.select("part", "number", F.col("cost")[0].alias("cost"), F.col("letters")[0].alias(
        "letters")).unionByName(ways.join(entries.select("part", "number", "entry"), ["part", "number"]).select(
            "part", "number", F.lit(None).cast("long").alias("cost"),
            F.col("letters")[F.col("entry")].alias("letters"))), "edits")
    placed = chunks.join(found, ["part", "number"])

    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns_n"), F.lit(0)).alias("gaps")
    stats = placed.filter("whole").select("conv", gaps, *STATS[1:]).unionByName(
        entries.filter("cost is not null").join(chunks.select("conv", "part", "number"), ["part", "number"])
        .select("conv", *STATS))
    edits = placed.select("conv", F.explode(F.when(F.size("turns") > 0, F.arrays_zip(
        "turns", "roles", "h1s", "h2s", "letters")).otherwise(F.array(F.struct(
            F.lit(None).cast("long").alias("turns"), F.lit(None).cast("string").alias("roles"), F.lit(0).cast("long").alias("h1s"),
            F.lit(0).cast("long").alias("h2s"), F.lit("").alias("letters"))))).alias("e")).select(
        "conv", F.col("e.turns").alias("turn"), F.col("e.roles").alias("role"), F.col("e.h1s").alias("h1"),
        F.col("e.h2s").alias("h2"), F.lit(0).alias("kind"), F.col("e.letters").alias("letters"),
        F.lit(None).cast("string").alias("text"))
    texts = rows.filter(there & ~faulty(F.col("text"))[0]).select(
        *ORDER, F.lit(1).alias("kind"), F.lit(None).cast("string").alias("letters"), "text")
    done = digests(edits.unionByName(texts).repartition("conv").sortWithinPartitions(*ORDER, "kind"))
    left, right = stats.alias("l"), done.alias("r")
    return left.join(right, F.col("l.conv").eqNullSafe(F.col("r.conv"))).select(
        F.col("l.conv").alias(key), *[F.col(f"l.{c}") for c in STATS], "r.audit", "r.repaired_sha256")


def damage(df: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by crc32 of ``conv_id:turn``; ``copies`` tells how often a
    row stands there."""

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    return df.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"),
                     kind.alias("kind")).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(
            F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
