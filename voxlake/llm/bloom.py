"""A Bloom filter of bounded size that spares shuffles: rows that it rules out need no join, and the others still get an exact one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS, PROBES, BLOCK = 1 << 26, 4, 1 << 16  # at most 8 MB; a fuller filter rules out less, never wrongly


def places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)], 1).astype(np.int64)


def build(ids: DataFrame) -> np.ndarray:
    """Packed bits of a one-column DataFrame of longs; tasks' filters are joined block by block before they reach the driver."""
    n = ids.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (12 * max(1, n)).bit_length()))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, bool)
        for b in batches:
            flags[places(b.column(0).to_numpy(zero_copy_only=False), bits)] = True
        packed = np.packbits(flags)
        rows = [(i, packed[i : i + BLOCK].tobytes()) for i in range(0, len(packed), BLOCK) if packed[i : i + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["i", "bits"])

    def either(t: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()])
        return t.slice(0, 1).set_column(1, "bits", pa.array([whole.tobytes()], pa.binary()))

    out = np.zeros(bits // 8, np.uint8)
    if n:
        parts = ids.mapInArrow(own, "i long, bits binary").groupBy("i").applyInArrow(either, "i long, bits binary")
        for r in parts.toLocalIterator():
            block = np.frombuffer(r["bits"], np.uint8)
            out[r["i"] : r["i"] + len(block)] = block
    return out


def keep(rows: DataFrame, column: str, packed: np.ndarray, *, inside: bool) -> DataFrame:
    """Rows whose id the filter may hold (inside), or certainly does not hold; null ids count as not held."""
    where, bits = rows.columns.index(column), 8 * len(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(where).cast(pa.int64())
            at = places(pc.fill_null(c, 0).to_numpy(zero_copy_only=False), bits)
            held = ((packed[at >> 3] >> (7 - (at & 7))) & 1).all(axis=1) & c.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(held if inside else ~held))

    return rows.mapInArrow(run, rows.schema)


def anti_join(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """rows without those whose id is in ids (one long column, distinct): only rows that the filter cannot clear are shuffled."""
    packed = build(ids)
    other = ids.toDF("__bloom")
    unsure = keep(rows, column, packed, inside=True)
    return keep(rows, column, packed, inside=False).unionByName(unsure.join(other, F.col(f"`{column}`").cast("long") == F.col("__bloom"), "left_anti"))
