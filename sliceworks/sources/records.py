"""Records of comma-separated text whose quoted fields may hold line breaks, from files split anywhere.

Spark cuts large files into splits at line ends, which may lie inside a quoted field. Whether a line starts
inside one depends on all lines before it. So every line is first reduced to two bits: is a quoted field
open after it, if none was open before, and if one was. These maps are composed within each split and the
splits' maps in order of the file, one row for each split; then each split knows how it starts, and the lines
of a record are joined where they are read. Only records that cross a split are gathered by key.

A quote opens a field only at its start, as in other readers, so stray quotes inside plain fields change
nothing. Lines end with a line feed, with or without a carriage return; breaks inside fields stay as
they are. A field still open at the end of its file ends there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# the functions travel whole, so that workers need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A quoted field after its comma, up to its closing quote or, still open, to the end of the text. The
# quantifiers never give back, so the length of a field costs no stack.
QUOTED = r',"[^"]*+(?:""[^"]*+)*+("|\z)'
# One field after its comma: quoted, quotes doubled, or plain.
FIELD = r',(?:"([^"]*+(?:""[^"]*+)*+)"[^,]*+|([^,]*+))'

WHOLE, OPENED, CONTINUED = 0, 1, 2


def fields(record: Column) -> Column:
    """The fields of a record in their places, however many; an empty one that is not quoted is null."""

    quoted, plain = (F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELD), F.lit(k))
                     for k in (1, 2))
    text = lambda q, p: F.when(q != "", F.replace(q, F.lit('""'), F.lit('"'))).when(p != "", p)
    return F.zip_with(quoted, plain, text)


def _left_open(text: Column) -> Column:
    ends = F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1))
    return F.coalesce(F.try_element_at(ends, F.lit(-1)) == "", F.lit(False))


def read_lines(spark: SparkSession, pattern: str) -> DataFrame | None:
    """Lines with their file, split and map: bit 0 is the state after the line when outside before
    it, bit 1 when inside. Null when there is no file."""

    try:
        lines = spark.read.text(pattern, lineSep="\n")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    value, comma = F.col("value"), F.lit(",")
    plain = F.instr(value, '"') == 0
    outside = F.when(plain, False).otherwise(_left_open(F.concat(comma, value)))
    inside = F.when(plain, True).otherwise(_left_open(F.concat(comma, F.lit('"'), value)))
    return lines.select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
        (outside.cast("int") + 2 * inside.cast("int")).cast("byte").alias("kind"), "value").withColumn(
        "file", F.xxhash64("file_path"))


def has_quoted_breaks(lines: DataFrame) -> bool:
    """Whether any line leaves a quoted field open."""

    return bool(lines.agg(F.max(F.col("kind").bitwiseAND(1))).first()[0])


def states_after(kinds: np.ndarray, start: int) -> np.ndarray:
    """Inside (1) or outside (0) after each line, from the lines' maps and the state before the first."""

    outside, inside = kinds & 1, kinds >> 1
    at = np.maximum.accumulate(np.where(outside == inside, np.arange(len(kinds)), -1))
    turns = np.cumsum((outside == 1) & (inside == 0))
    known = at >= 0  # a line after which the state is known, whatever it was before
    base = np.where(known, outside[at], start)
    return base ^ ((turns - np.where(known, turns[at], 0)) & 1)


def _runs(file: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of lines of one split."""

    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    ends = [0, *cuts.tolist(), len(file)]
    return ((a, b) for a, b in zip(ends, ends[1:], strict=False) if a < b)


def split_starts(lines: DataFrame) -> dict[tuple[int, int], int]:
    """State at the start of each split of each file: one entry for each task's share of a file."""

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, (0, 1)
        for batch in batches:
            file, block, kind = (c.to_numpy() for c in batch.columns)
            for a, b in _runs(file, block):
                here = int(file[a]), int(block[a])
                if here != key:
                    if key:
                        yield one(key, state)
                    key, state = here, (0, 1)
                state = tuple(int(states_after(kind[a:b], s)[-1]) for s in state)
        if key:
            yield one(key, state)

    def one(key: tuple[int, int], state: tuple[int, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "outside": [state[0]],
                                           "inside": [state[1]]})

    rows = lines.select("file", "block", "kind").mapInArrow(
        composed, "file long, block long, outside long, inside long").collect()
    starts, state, last = {}, 0, None
    for row in sorted(rows, key=lambda r: (r["file"], r["block"])):
        state = state if row["file"] == last else 0
        starts[row["file"], row["block"]] = state
        state, last = row["inside"] if state else row["outside"], row["file"]
    return starts


def records(lines: DataFrame) -> DataFrame:
    """``file_path``, ``block`` and ``at`` (places in order of the file) and the ``record``, its lines joined."""

    starts = split_starts(lines)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = path = None
        state, count, waiting, opened = 0, 0, [], False

        def rest() -> Iterator[pa.RecordBatch]:
            if waiting:  # open at the end of the split
                yield rows(path, key, [count - 1 if opened else -1], OPENED if opened else CONTINUED,
                           pa.array(["\n".join(waiting)]))

        for batch in batches:
            file, block, kind = (batch.column(c).to_numpy() for c in ("file", "block", "kind"))
            for a, b in _runs(file, block):
                here = int(file[a]), int(block[a])
                if here != key:
                    yield from rest()
                    key, path = here, batch.column("file_path")[a].as_py()
                    # splits that differ from those whose maps were composed must not pass unseen
                    state, count, waiting, opened = starts[here], 0, [], False
                after = states_after(kind[a:b], state)
                first = np.flatnonzero(np.append(state, after[:-1]) == 0)  # lines that begin a record
                state = int(after[-1])
                values = batch.column("value").slice(a, b - a)
                head = int(first[0]) if len(first) else b - a
                waiting += values.slice(0, head).to_pylist()
                if waiting and (len(first) or not state):
                    yield rows(path, key, [count - 1 if opened else -1], WHOLE if opened else CONTINUED,
                               pa.array(["\n".join(waiting)]))
                    waiting = []
                if not len(first):
                    continue
                if state:  # the last record goes on
                    waiting, done = values.slice(int(first[-1])).to_pylist(), first[:-1]
                    stop = int(first[-1])
                else:
                    done, stop = first, b - a
                opened = True
                if len(done):
                    ends = pa.array(np.append(done, stop).astype(np.int32))
                    text = pc.binary_join(pa.ListArray.from_arrays(ends, values.cast(pa.string())), "\n")
                    yield rows(path, key, range(count, count + len(done)), WHOLE, text)
                count += len(first)
        yield from rest()

    def rows(path: str, key: tuple[int, int], at, piece: int, text: pa.Array) -> pa.RecordBatch:
        n = len(text)
        return pa.RecordBatch.from_arrays(
            [pa.repeat(path, n), pa.repeat(key[0], n), pa.repeat(key[1], n), pa.array(list(at), pa.int64()),
             pa.repeat(pa.scalar(piece, pa.int32()), n), text],
            names=["file_path", "file", "block", "at", "piece", "record"])

    found = lines.select("file_path", "file", "block", "kind", "value").mapInArrow(
        joined, "file_path string, file long, block long, at long, piece int, record string")
    # a record that crosses splits: what begins it, and all that follows until the next beginning
    pieces = found.filter(F.col("piece") != WHOLE).withColumn("from", F.max(F.when(
        F.col("piece") == OPENED, F.col("block"))).over(Window.partitionBy("file").orderBy("block", "at")))
    crossing = pieces.groupBy("file_path", "from").agg(
        F.max(F.when(F.col("piece") == OPENED, F.col("at"))).alias("at"),
        F.array_sort(F.collect_list(F.struct("block", F.col("at").alias("p"), "record"))).alias("parts"))
    both = found.filter(F.col("piece") == WHOLE).select("file_path", "block", "at", "record").unionByName(
        crossing.select("file_path", F.col("from").alias("block"), "at", F.array_join(
            F.transform("parts", lambda p: p["record"]), "\n").alias("record")))
    cut = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)"))
    return both.withColumn("record", F.coalesce(cut, F.col("record")))
