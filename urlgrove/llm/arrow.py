"""Work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows, and bytes of Arrow data, that a task turns into Python objects at once. One longer row is a slice of its own.
ROWS, BYTES = 400, 2 << 20


def tidy() -> None:
    """Give freed memory back: workers are reused, and an executor holds several."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def slices(batch: pa.RecordBatch, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of few rows and few bytes of its widest string or binary column."""
    wide = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    at = 0
    ends = [np.frombuffer(c.buffers()[1], np.int32)[c.offset + 1 : c.offset + 1 + batch.num_rows].astype(np.int64) - np.frombuffer(c.buffers()[1], np.int32)[c.offset] for c in wide] if batch.num_rows else []
    while at < batch.num_rows:
        stop = min(at + rows, batch.num_rows)
        for e in ends:
            stop = min(stop, max(at + 1, int(np.searchsorted(e, (e[at - 1] if at else 0) + size, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """``fn`` turns a bounded slice of an Arrow batch into output columns (lists, numpy or Arrow arrays); slices never meet."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows, size):
                out = fn(part)
                arrays = [(v if v.type == f.type else v.cast(f.type)) if isinstance(v := out[f.name], pa.Array) else pa.array(v, type=f.type) for f in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)
        tidy()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = ROWS) -> DataFrame:
    """``fn`` turns the columns of a bounded slice (as lists) into output columns; slices never meet."""
    return map_slices(df, lambda part: fn({c: part.column(i).to_pylist() for i, c in enumerate(part.schema.names)}), schema, rows)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[list[dict]], list[dict]], schema: str, order: list[str] | None = None) -> DataFrame:
    """``fn`` sees the rows of one group of ``keys`` at a time. For groups that are bounded by construction only."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []
        for batch in batches:
            for part in slices(batch, 2000, 4 * BYTES):
                for row in part.to_pylist():
                    now = tuple(row[k] for k in keys)
                    if now != key:
                        if held:
                            out += fn(held)
                        held, key = [], now
                    held.append(row)
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, schema=target)
                    out = []
        if held:
            out += fn(held)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=target)
        tidy()

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)


def bounds(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the number of rows."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.append(np.flatnonzero(new), n)


def map_runs(df: DataFrame, keys: list[str], fn: Callable[[pa.RecordBatch], list[dict]], schema: str, order: list[str] | None = None) -> DataFrame:
    """``fn`` sees the rows of some whole groups of ``keys`` (numbers) at a time, sorted by keys and ``order``. For groups that are bounded by construction only."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held and (out := fn(pa.concat_batches(held))):
            for at in range(0, len(out), 2000):
                yield pa.RecordBatch.from_pylist(out[at : at + 2000], schema=target)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for part in slices(batch, 2000, 4 * BYTES):
                cols = [part.column(part.schema.get_field_index(k)) for k in keys]
                now, at = tuple(c[-1].as_py() for c in cols), 0
                if tuple(c[0].as_py() for c in cols) != last:
                    yield from made(held)
                    held = []
                if now != last:
                    at = int(bounds(*(c.to_numpy(zero_copy_only=False) for c in cols))[-2])
                    if at:
                        yield from made([*held, part.slice(0, at)])
                        held = []
                held.append(part.slice(at))
                last = now
        yield from made(held)
        tidy()

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)
