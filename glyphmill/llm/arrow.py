"""Row-preserving Arrow operators: new columns from a text column, all others passed through.

A Python worker outlives its tasks and goes on to those of other operators. What one keeps between its tasks is `held`;
the others `let_go` of it, and of memory that is free but not given back, so that a worker holds one operator at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


_held: list = []


def held(make: Callable) -> Callable:
    """make with its last two results kept in the worker, until `let_go`; what making them took is given back."""

    @lru_cache(2)
    @wraps(make)
    def kept(*args):
        out = make(*args)
        give_back()
        return out

    _held.append(kept)
    return kept


def let_go() -> None:
    """Drop what is held in this worker, and give free memory back."""
    for kept in _held:
        kept.cache_clear()
    give_back()


def give_back() -> None:
    """Give memory of this worker that is free back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def alone(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for tasks that hold nothing: nothing held is there when one begins, and its memory is given back when it ends."""

    def task(batches):
        let_go()
        try:
            yield from run(batches)
        finally:
            let_go()

    return task


def parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, for what makes Python objects of long texts."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def with_columns(df: DataFrame, text: str, fields: list[tuple[str, str]], make: Callable[[], Callable[[pa.Array], Iterator[tuple[int, int, list]]]]) -> DataFrame:
    """df with the given (name, type) columns added; an input column of the same name is replaced.

    make() runs once in each task and gives a function of a text column that yields (first, last, arrays).
    """
    names = [n for n, _ in fields]
    kept = [c for c in df.columns if c not in names]
    # columns go by number, the text last: it may itself be replaced, and any name may be taken
    source = df.select(*[df[f"`{c}`"] for c in kept], df[f"`{text}`"]).toDF(*map(str, range(len(kept) + 1)))
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            carried = batch.columns[:-1]
            for first, last, arrays in slices(batch.column(batch.num_columns - 1)):
                columns = [c.slice(first, last - first) for c in carried] + list(arrays)
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])
        give_back()

    return source.mapInArrow(run, schema)
