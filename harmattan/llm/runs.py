"""Streams over partitions sorted by a 64-bit key: runs of equal keys without holding a run in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def shared_runs(rows: DataFrame, key: str, owner: str, *extra: str) -> DataFrame:
    """The rows whose key occurs under two or more owners; each (key, owner) at least once.

    All columns are numbers without nulls. A run is passed on as soon as a second owner shows, so
    that memory does not depend on its length. ``extra`` columns must depend on key and owner alone.
    """
    columns = [key, owner, *extra]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # first row of the open run
        passed = False  # whether that row went out already
        for b in batches:
            if not b.num_rows:
                continue
            data = [c.to_numpy() for c in b.columns]
            carried = held is not None and data[0][0] == held[0]
            if carried:
                data = [np.concatenate([np.array([h], d.dtype), d]) for h, d in zip(held, data)]
            keys, owners = data[0], data[1]
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(begin, len(keys)))
            several = np.maximum.reduceat(owners != np.repeat(owners[begin], size), begin)
            open_before = carried and passed
            several[0] |= open_before
            keep = np.repeat(several, size)
            held, passed = [d[begin[-1]] for d in data], bool(several[-1])
            if open_before:
                keep[0] = False
            yield pa.record_batch([pa.array(d[keep]) for d in data], columns)

    return rows.select(*columns).repartition(key).sortWithinPartitions(key).mapInArrow(run, ", ".join(f"{c} {fields[c]}" for c in columns))


def later_owners(rows: DataFrame, key: str, owner: str, *extra: str) -> DataFrame:
    """owner and extra columns of the rows whose key also occurs under a smaller owner."""
    columns = [key, owner, *extra]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            keys, owners = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(keys):
                continue
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            least = owners[begin]
            if held is not None and keys[0] == held[0]:
                least[0] = held[1]
            held = (keys[-1], least[-1])
            keep = owners > np.repeat(least, np.diff(np.append(begin, len(keys))))
            yield pa.RecordBatch.from_arrays(b.columns[1:], names=columns[1:]).filter(pa.array(keep))

    schema = ", ".join(f"{c} {fields[c]}" for c in columns[1:])
    return rows.select(*columns).repartition(key).sortWithinPartitions(key, owner).mapInArrow(run, schema)
