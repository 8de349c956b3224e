"""Runs of equal keys in batches of sorted rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def runs(batches, keys: list[str]):
    """Yield one record batch for each run of rows with equal ``keys`` (integer columns without nulls).

    Rows of a key must be neighbours in the stream; one run at a time is held.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = last is None or any(c[0] != x for c, x in zip(columns, last))
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change).tolist()
        last = [c[-1] for c in columns]
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield _joined(held)
                held = []
            at = cut
        held.append(batch.slice(at))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
