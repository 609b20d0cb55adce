"""Helpers of the text operators: words, Arrow batches, state that workers keep between tasks."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Words are runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a record batch that a Python function handles at a time.
ROWS = 256


def word_finder() -> Callable[[str], list[str]]:
    """Finds all words of a text."""

    return re.compile(WORD).findall


def _task() -> int | None:
    context = TaskContext.get()
    return context.taskAttemptId() if context else None


def _states() -> dict[str, tuple[object, int | None]]:
    """What this worker keeps, with the task that last used it."""

    module = sys.modules.setdefault("_text_worker_state", types.ModuleType("_text_worker_state"))
    return module.__dict__.setdefault("states", {})


def worker_state(name: str, make: Callable[[], object]) -> object:
    """An object that a Python worker makes once and keeps for its later tasks.

    It goes as soon as the worker gets a task that does not ask for it (see ``slices``), so that
    workers, which Spark uses again for other stages, do not carry it through them.
    """

    states = _states()
    made = states[name][0] if name in states else make()
    states[name] = (made, _task())
    return made


def drop_stale_states() -> None:
    """Forget what this task has not asked for."""

    states, task = _states(), _task()
    for name in [name for name, (_, used) in states.items() if used != task]:
        del states[name]


def column(name: str) -> Column:
    """The column of exactly this name, dots included."""

    return F.col("`" + name.replace("`", "``") + "`")


def crc_of(name: str) -> Column:
    """CRC32 of an id written as text; a null id counts as the text "null"."""

    return F.crc32(F.coalesce(column(name).cast("string"), F.lit("null")).cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in shorter pieces, so that few texts are Python objects at a time.

    A task asks for its kept state before; what earlier tasks left goes here.
    """

    drop_stale_states()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def arrow_array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


def add_columns(df: DataFrame, inputs: Sequence[str], fields: Sequence[tuple[str, str]],
                make: Callable[..., Sequence], rows: int = ROWS,
                start: Callable[[], Callable[..., Sequence]] | None = None,
                drop: Sequence[str] = (), arrow: bool = False) -> DataFrame:
    """``df`` with columns that ``make`` computes from lists (``arrow``: arrays) of the input columns.

    A new column takes the place of an input column of the same name. ``start``, if given, is
    called once in each task and returns the function to use in place of ``make``.
    """

    added = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in fields]
    names = {f.name for f in added} | set(drop)
    kept = [f for f in df.schema.fields if f.name not in names]
    values = [f"_in{k}_" for k in range(len(inputs))]
    source = df.select(*[column(f.name) for f in kept],
                       *[column(name).alias(v) for name, v in zip(inputs, values, strict=True)])
    kinds = [to_arrow_type(f.dataType) for f in added]
    labels, n = [f.name for f in kept] + [f.name for f in added], len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start() if start else make
        for batch in slices(batches, rows):
            given = [batch.column(n + k) for k in range(len(values))]
            found = function(*(given if arrow else [c.to_pylist() for c in given]))
            yield pa.RecordBatch.from_arrays(
                batch.columns[:n] + [arrow_array(x, t) for x, t in zip(found, kinds, strict=True)],
                names=labels)

    return source.mapInArrow(run, T.StructType([*kept, *added]))


def int_lists(arrays: Sequence, kind=pa.int32()) -> pa.Array:
    """A list column out of numpy arrays, without a Python object for each number."""

    import numpy as np

    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if len(arrays) else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                    pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))
