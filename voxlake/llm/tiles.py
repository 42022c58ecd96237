"""Groups that meet in tiles of bounded size, and streams of groups inside a sorted partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deal_tiles(rows: DataFrame, key: list[str], chunks: str, id_: str, carry: list[str | Column]) -> DataFrame:
    """rows know how many chunks their group has. A row goes to every tile (u, v), u <= v, of its chunk: tile (c, c) holds the pairs
    inside a chunk, tile (u, v) those between two. Partitioned and sorted by key and tile."""
    own = rows.withColumn("__c", F.pmod(F.xxhash64(id_), F.col(chunks)))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col(chunks).cast("long") - 1), lambda o: F.struct(F.least("__c", o).alias("u"), F.greatest("__c", o).alias("v")))
    side = F.when(F.col("__c") == F.col("__m.u"), 0).otherwise(1).cast("int")
    out = own.withColumn("__m", F.explode(meets)).select(*key, F.col("__m.u").alias("u"), F.col("__m.v").alias("v"), side.alias("side"), id_, *carry)
    return out.repartition(*key, "u", "v").sortWithinPartitions(*key, "u", "v")


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Runs of equal integer keys over the batches of a sorted partition."""
    last, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c).to_numpy() for c in key]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        edges = [0, *map(int, change), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            k = tuple(int(c[lo]) for c in keys)
            if k != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = k
            held.append(b.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held)


def longs(rows: Iterator[tuple], names: list[str], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of nullable 64-bit columns."""
    held: list[tuple] = []

    def ready() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield ready()
            held.clear()
    yield ready()


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each row's component among the links (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while not (new == (hop := new[new])).all():
            new = hop
        new = new[root]
        if (new == root).all():
            break
        root = new
    return root


Runner = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
