"""Groups of rows out of sorted Arrow batches, whatever the number of rows in a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _starts(table: pa.RecordBatch, keys: int) -> np.ndarray:
    """Rows that differ from the one before in any of the first `keys` columns; nulls are equal."""
    n = table.num_rows
    changes = np.zeros(n, bool)
    changes[:1] = True
    for i in range(keys):
        column = table.column(i)
        codes = np.asarray(pc.fill_null(column.dictionary_encode().indices, -1))
        changes[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(changes)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group, by the first `keys` columns of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys)
        first = [batch.column(i)[0].as_py() for i in range(keys)]
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield pa.Table.from_batches([*held, batch.slice(begin, end - begin)])
            held = []
        held.append(batch.slice(int(starts[-1])))
        last = [batch.column(i)[-1].as_py() for i in range(keys)]
    if held:
        yield pa.Table.from_batches(held)


def map_sorted(
    df: DataFrame,
    by: list[str],
    within: list[str],
    run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """`run` over whole groups of `by`, each in order of `within`: one shuffle, one Python call a partition."""
    return df.repartition(*by).sortWithinPartitions(*by, *within).mapInArrow(run, schema)


def flat(column: pa.ChunkedArray) -> pa.Array:
    made = column.combine_chunks()
    return made if isinstance(made, pa.Array) else pa.concat_arrays(made.chunks)
