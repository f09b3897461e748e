"""A Bloom filter of bounded size, built by the executors.

It only spares work: what it lets through by chance is sorted out by an exact join
behind it, so a filter that is too small for its keys costs time, never results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Greatest filter: 16 MB, whatever the number of keys.
MOST_BITS = 1 << 27
BITS_PER_KEY = 16
PROBES = 3
_SEGMENT = 1 << 16  # bits that one group of the build sets
#: Up to so many keys the driver sets the bits; the executors do beyond, with the same result.
FEW_KEYS = 1 << 16


class Bloom:
    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which of the 64-bit keys may be members."""
        out = np.ones(len(keys), dtype=bool)
        if not len(keys):
            return out
        for place in positions(keys.astype(np.uint64, copy=False), self.size):
            out &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def positions(keys: np.ndarray, size: int):
    """Where a key's bits are: the size is a power of two."""
    mask = np.uint64(size - 1)
    step = (keys >> np.uint64(32)) * np.uint64(2) + np.uint64(1)
    for k in range(PROBES):
        yield (keys + np.uint64(k) * step) & mask


def build(keys: DataFrame, n: int, most_bits: int = MOST_BITS, few: int = FEW_KEYS) -> Bloom:
    """A filter over the one column of well mixed 64-bit keys, n at most; nulls are left out."""
    name = keys.columns[0]
    keys = keys.where(F.col(name).isNotNull())
    size = _SEGMENT
    while size < min(n * BITS_PER_KEY, most_bits):
        size *= 2

    bits = np.zeros(size // 8, dtype=np.uint8)
    if n <= few:
        on = np.zeros(size, dtype=np.uint8)
        for places in positions(np.array([r[0] for r in keys.collect()], dtype=np.int64).view(np.uint64), size):
            on[places] = 1
        return Bloom(np.packbits(on, bitorder="little"), size)

    def place(batches):
        from squall.llm.bloom import positions

        for batch in batches:
            k = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            bits = np.unique(np.concatenate(list(positions(k, size)))).astype(np.int64) if len(k) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bits // _SEGMENT), pa.array(bits % _SEGMENT)], ["segment", "bit"])

    def segment(table_: pa.Table) -> pa.Table:
        on = np.zeros(_SEGMENT, dtype=np.uint8)
        on[table_["bit"].to_numpy()] = 1
        return pa.table({"segment": table_["segment"][:1], "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    found = keys.mapInArrow(place, "segment long, bit long").groupBy("segment").applyInArrow(segment, "segment long, bits binary")
    for row in found.collect():  # at most MOST_BITS / 8 bytes in all
        at = row["segment"] * (_SEGMENT // 8)
        bits[at : at + _SEGMENT // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return Bloom(bits, size)
