"""Sums of fixed-size count vectors over all partitions, by key and block, without any large row."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .tokens import pack, unpack

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "key string, block int, data binary"
ARROW = pa.schema([("key", pa.string()), ("block", pa.int32()), ("data", pa.binary())])
BLOCKS = 16


def emit(totals: dict) -> pa.RecordBatch:
    """One row for each key and block of a task's count vectors."""
    keys, blocks, data = [], [], []
    for key, counts in totals.items():
        for b, part in enumerate(np.split(counts, BLOCKS)):
            if part.any():
                keys.append(key)
                blocks.append(b)
                data.append(pack(part.astype(np.int64).view(np.uint64)))
    return pa.record_batch([pa.array(keys, pa.string()), pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], schema=ARROW)


def _add(size: int):
    def add(it):
        sums: dict = {}
        for batch in it:
            for key, block, data in zip(*(c.to_pylist() for c in batch.columns)):
                part = unpack(data, size).view(np.int64)
                at = (key, block)
                sums[at] = sums[at] + part if at in sums else part.copy()
        rows = [(k, b, pack(v.view(np.uint64))) for (k, b), v in sums.items()]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))], schema=ARROW)

    return add


def collect(parts: DataFrame, size: int) -> dict:
    """key -> count vector of length `size`.  What reaches the driver is bounded by keys times size, whatever the input."""
    n = size // BLOCKS
    out: dict = {}
    for r in parts.repartition(BLOCKS, "block").mapInArrow(_add(n), SCHEMA).collect():
        v = out.setdefault(r["key"], np.zeros(size, np.int64))
        v[r["block"] * n : (r["block"] + 1) * n] += unpack(bytes(r["data"]), n).view(np.int64)
    return out
