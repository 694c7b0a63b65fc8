"""A membership bitmap of bounded size over 64-bit values (false positives, never false negatives)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import mix

#: Bits: never more than this in all (32 MB), whatever the number of values.
MAX_BITS = 1 << 28
_CHUNK = 16  # log2 of the bits that one group builds


@dataclass
class Bitmap:
    bits: np.ndarray
    log_bits: int

    def _hit(self, place: np.ndarray) -> np.ndarray:
        return (self.bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1

    def places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self.log_bits)
        first = mix(values)
        return (first >> shift).astype(np.int64), (mix(first) >> shift).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Indices of the values (uint64) that may be members."""
        first, second = self.places(values)
        at = np.flatnonzero(self._hit(first))
        return at[self._hit(second[at])]


def build_bitmap(values: DataFrame, count: int, bits_each: int = 64, max_bits: int = MAX_BITS) -> Bitmap:
    """The bitmap of a one-column DataFrame of longs.

    Spark builds it in chunks of 64 Ki bits; the driver gathers ``max_bits`` at
    most, never the values.
    """
    log_bits = _CHUNK
    while (1 << log_bits) < min(max_bits, count * bits_each):
        log_bits += 1
    empty = Bitmap(np.zeros((1 << log_bits) // 8, np.uint8), log_bits)

    def places(batches):
        for batch in batches:
            found = batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
            spots = np.unique(np.concatenate(empty.places(found)))
            yield pa.RecordBatch.from_arrays([pa.array(spots >> _CHUNK), pa.array(spots)], names=["chunk", "spot"])

    def chunk(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _CHUNK, dtype=bool)
        bits[table.column("spot").to_numpy() & ((1 << _CHUNK) - 1)] = True
        packed = pa.array([np.packbits(bits).tobytes()], pa.binary())
        return pa.table({"chunk": table.column("chunk")[:1], "bits": packed})

    rows = (
        values.mapInArrow(places, "chunk long, spot long")
        .distinct()
        .groupBy("chunk")
        .applyInArrow(chunk, "chunk long, bits binary")
        .collect()
    )
    for row in rows:
        at = row.chunk << (_CHUNK - 3)
        empty.bits[at : at + (1 << (_CHUNK - 3))] = np.frombuffer(row.bits, np.uint8)
    return empty
