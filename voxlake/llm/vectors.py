"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe and verification.

Equal vectors of one label are one class with a count, so copies are never expanded. A class is hashed in several tables: a table's hash
is the nearest signed axis after three rounds of random sign flips and fast Hadamard transforms, for ``parts`` such rotations; it is filed under its own bucket and under
its next best ones (multiprobe). The number of parts grows with the number of vectors, and the number of tables follows from the
chance, simulated on random pairs at exactly the threshold, that one table finds such a pair, so that the target recall holds at every size.

Buckets hold ids and a sketch of SKETCH sign bits, never vectors. A member without any other whose sketch is within the bits that a pair at the threshold differs in, and five standard
deviations more, leaves its bucket (buckets of more than TILE members skip this); vectors are joined to what is left.
Bucket members meet in tiles of bounded size: a bucket of more than TILE members is cut into chunks, and every two chunks meet in a task of their own.
A tile is verified by matrix products in double precision; it returns a count per member and a spanning forest of its links, never the
links themselves. A pair that meets in several places counts where it meets first, which both ends can tell from their hashes.

Defined results: vectors that are null, zero, of another length than the rest's 64-padded width allows, or with null or non-finite components, and
rows with null label or id, link with nothing and stand alone; repeated rows are copies of each other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.tiles import deal_tiles, forest, groups, longs
from voxlake.operators.components import connected_components
from voxlake.session import stash

THRESHOLD, RECALL, PROBES, TILE, PER_BUCKET, SKETCH = 0.93, 0.9995, 2, 1024, 64, 128


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, normalised."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def hashes(x: np.ndarray, tables: int, parts: int, probes: int, seed: int = 11) -> np.ndarray:
    """(rows, tables, probes) bucket numbers: the own bucket first, then those reached by the cheapest change of one part."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - d)))
    rng = np.random.default_rng(seed)
    out = np.zeros((n, tables, probes), np.int64)
    for t in range(tables):
        signed, order, loss = [], [], []
        for _ in range(parts):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            both = np.concatenate([y, -y], axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :probes]
            value = np.take_along_axis(both, best, 1)
            order.append(best)
            loss.append(value[:, :1] - value)
        base = 2 * width
        for p in order:
            signed.append(p[:, 0])
        own = np.zeros(n, np.int64)
        for s in signed:
            own = own * base + s
        out[:, t, 0] = own
        # other buckets: one part takes its k-th best axis
        options, costs = [], []
        for i, p in enumerate(order):
            scale = base ** (parts - 1 - i)
            for k in range(1, probes):
                options.append(own + (p[:, k] - p[:, 0]) * scale)
                costs.append(loss[i][:, k])
        if options:
            pick = np.argsort(np.stack(costs, 1), axis=1, kind="stable")[:, : probes - 1]
            out[:, t, 1:] = np.take_along_axis(np.stack(options, 1), pick, 1)
    return out


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per pair and table the bucket in which two rows of hashes meet first (-1: none): one must be in its own bucket."""
    into_b = (a[:, :, :1] == b).any(2)
    into_a = (b[:, :, :1] == a).any(2)
    own_a, own_b = a[:, :, 0], b[:, :, 0]
    both = np.where(into_a & into_b, np.minimum(own_a, own_b), np.where(into_b, own_a, own_b))
    return np.where(into_a | into_b, both, -1)


def tables_needed(d: int, parts: int, probes: int, threshold: float, recall: float, trials: int = 4000) -> int:
    rng = np.random.default_rng(7)
    x, y = rng.standard_normal((2, trials, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = threshold * x + math.sqrt(1 - threshold**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    p = (meet(hashes(x, 4, parts, probes), hashes(y, 4, parts, probes)) >= 0).mean()
    p = min(max(float(p), 1e-6), 1 - 1e-6)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def sketches(x: np.ndarray, seed: int = 13) -> np.ndarray:
    """(rows, SKETCH / 64) bits: on which side of random planes a vector lies."""
    planes = np.random.default_rng(seed).standard_normal((SKETCH, x.shape[1]))
    return np.packbits(x @ planes.T >= 0, axis=1).view(np.int64)


def most_bits(threshold: float) -> int:
    """Sketch bits in which a pair at the threshold differs at most, but for chances of five standard deviations."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * p + 5 * math.sqrt(SKETCH * p * (1 - p)))


def likely_members(tile: int, most: int) -> object:
    """Rows (label, table, bucket, id, probe, s0, s1) in order of their buckets: those with a likely partner in their bucket, one of the two being in its own. The stream holds at most
    a tile's rows of one bucket; beyond that all go on."""
    key = ["label", "table", "bucket"]
    carry = [*key, "id", "probe"]

    def some(t: pa.Table) -> pa.RecordBatch | pa.Table:
        k = np.stack([t.column(c).to_numpy() for c in key])
        bits = np.stack([t.column(c).to_numpy() for c in ("s0", "s1")])
        own = t.column("probe").to_numpy() == 0
        fresh = np.append(True, (k[:, 1:] != k[:, :-1]).any(0))
        group = np.cumsum(fresh) - 1
        size = np.bincount(group)
        stays = size[group] > tile
        for step in range(1, min(tile, int(size.max()))):
            i = np.flatnonzero(group[:-step] == group[step:])
            i = i[~(stays[i] & stays[i + step])]
            if not len(i):
                if not (group[:-step] == group[step:]).any():
                    break
                continue
            j = i + step
            near = np.bitwise_count((bits[:, i] ^ bits[:, j]).view(np.uint64)).sum(0) <= most
            near &= own[i] | own[j]
            stays[i[near]] = stays[j[near]] = True
        return t.select(carry).filter(pa.array(stays))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        crowded = None  # the bucket that has passed a tile's rows
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t]).combine_chunks()
            k = np.stack([t.column(c).to_numpy() for c in key])
            if crowded is not None:
                through = int((k == np.array(crowded)[:, None]).all(0).sum())  # they come first
                yield from t.slice(0, through).select(carry).to_batches()
                if through == t.num_rows:
                    held = None
                    continue
                t, k, crowded = t.slice(through), k[:, through:], None
            last = int(np.flatnonzero((k != k[:, -1:]).any(0))[-1]) + 1 if (k != k[:, -1:]).any() else 0
            if last:
                yield from some(t.slice(0, last)).to_batches(max_chunksize=50_000)
            held = t.slice(last)
            if held.num_rows > tile:
                crowded = [held.column(c)[0].as_py() for c in key]
                yield from held.select(carry).to_batches(max_chunksize=50_000)
                held = None
        if held is not None and held.num_rows:
            yield from some(held).to_batches(max_chunksize=50_000)

    return run


def _verify(tile: dict[str, np.ndarray], table_: int, bucket: int, threshold: float) -> tuple[list, list]:
    """Counts (id, partners) and forest links (id, id) of one tile: side 0 within itself (lone) or side 0 against side 1."""
    side, x, sig, own = tile["side"], tile["x"], tile["sig"], tile["n"]
    ids = tile["id"]
    a = np.flatnonzero(side == 0)
    lone = not (side == 1).any() and not tile["crossed"]
    b = a if lone else np.flatnonzero(side == 1)
    count = np.zeros(len(ids), np.int64)
    links_i, links_j = [], []
    for lo in range(0, len(a), 512):
        rows = a[lo : lo + 512]
        hit = x[rows] @ x[b].T >= threshold
        if lone:
            hit &= np.arange(lo, lo + len(rows))[:, None] < np.arange(len(b))[None, :]
        p, q = np.nonzero(hit)
        for k in range(0, len(p), 100_000):
            i, j = rows[p[k : k + 100_000]], b[q[k : k + 100_000]]
            where = meet(sig[i], sig[j])
            first = (where >= 0).argmax(1)
            here = (first == table_) & (where[np.arange(len(i)), first] == bucket)
            i, j = i[here], j[here]
            np.add.at(count, i, own[j])
            np.add.at(count, j, own[i])
            root = forest(len(ids), i, j)
            child = np.flatnonzero(root != np.arange(len(ids)))
            links_i.append(child)
            links_j.append(root[child])
    if not links_i:
        return [], []
    i, j = np.concatenate(links_i), np.concatenate(links_j)
    root = forest(len(ids), i, j)
    child = np.flatnonzero(root != np.arange(len(ids)))
    some = np.flatnonzero(count)
    return list(zip(ids[some].tolist(), count[some].tolist(), strict=True)), list(zip(ids[child].tolist(), ids[root[child]].tolist(), strict=True))


def link_classes(classes: DataFrame, total: int, d: int, threshold: float, recall: float, probes: int, tile: int) -> DataFrame:
    """classes: id, label, n, x (the vector, binary). (id, partners, other): counts where other is null, else forest links."""
    width = 1 << max(1, (d - 1).bit_length())
    parts = max(1, math.ceil(math.log(max(2, total / PER_BUCKET)) / math.log(2 * width)))
    tables = tables_needed(d, parts, probes, threshold, recall)

    def vectors_of(b: pa.RecordBatch) -> np.ndarray:
        """Unit vectors in double precision: values arrive in single precision where that loses nothing."""
        x = np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * d else "<f8") for r in b.column("x").to_pylist()]).astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    small = "<i4" if (2 * width) ** parts < 1 << 31 else "<i8"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                sig = hashes(vectors_of(b), tables, parts, probes).astype(small)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in sig], pa.binary())], [*b.schema.names, "sig"])

    def sig_of(b: pa.RecordBatch | pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(b.column("sig").to_pylist()), small).reshape(-1, tables, probes).astype(np.int64)

    classes = stash(classes.select("id", "label", "n", "x").mapInArrow(hashed, "id long, label long, n long, x binary, sig binary"), "vectors-hashed")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                sig, sketch = sig_of(b), sketches(vectors_of(b))
                n = len(sig)
                for t in range(tables):
                    for k in range(probes):
                        columns = [b.column("label"), pa.array(np.full(n, t, np.int16)), pa.array(sig[:, t, k]), b.column("id"), pa.array(np.full(n, k, np.int16)), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])]
                        yield pa.RecordBatch.from_arrays(columns, ["label", "table", "bucket", "id", "probe", "s0", "s1"])

    key = ["label", "table", "bucket"]
    filed = classes.select("id", "label", "x", "sig").mapInArrow(file, "label long, table short, bucket long, id long, probe short, s0 long, s1 long")
    filed = filed.repartition(*key).sortWithinPartitions(*key)
    members = stash(filed.mapInArrow(likely_members(tile, most_bits(threshold)), "label long, table short, bucket long, id long, probe short"), "vectors-members")
    sizes = members.groupBy(*key).agg(F.count("*").alias("members"), F.min("probe").alias("least")).filter("members > 1 and least = 0").select(*key, F.ceil(F.col("members") / tile).alias("chunks"))
    rows = members.drop("probe").join(sizes, key).join(classes.select("id", "n", "x", "sig"), "id")
    rows = deal_tiles(rows.withColumn("table", F.col("table").cast("long")), key, "chunks", "id", ["n", "x", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for k, t in groups(batches, [*key, "u", "v"]):
                if t.num_rows < 2:
                    continue
                data = {"side": t.column("side").to_numpy(), "id": t.column("id").to_numpy(), "n": t.column("n").to_numpy(), "crossed": k[3] != k[4], "x": vectors_of(t), "sig": sig_of(t)}
                counts, links = _verify(data, k[1], k[2], threshold)
                yield from ((i, c, None) for i, c in counts)
                yield from ((i, None, j) for i, j in links)

        return longs(out(), ["id", "partners", "other"])

    return rows.mapInArrow(run, "id long, partners long, other long")


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, probes: int = PROBES, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    v = F.col("embedding")
    rows = rows.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`embedding`").cast("array<double>").alias("embedding"), F.col("`label`").cast("long").alias("label"))
    most = F.array_max(F.transform(v, F.abs))
    extreme = ((most > 0) & (most < 1e-100)) | ((most > 1e100) & (most < float("inf")))  # squares of their components would be 0 or infinite
    shift = F.floor(-F.log2(most))
    half = F.floor(shift / 2)
    rows = rows.withColumn("embedding", F.when(extreme, F.transform(v, lambda x: x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), shift - half))).otherwise(v))  # by powers of two: angles stay as they are
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm > 0), F.lit(False))
    sound = sound & F.coalesce(F.abs(norm) < float("inf"), F.lit(False))
    marked = stash(rows.withColumn("sound", sound).withColumn("class", F.when(F.col("sound"), F.xxhash64("label", v))), "vectors")
    classes = marked.filter("sound").groupBy("label", "embedding", "class").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    shape = classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("classes")).collect()  # one row per vector length
    classes = stash(classes, "vector-classes")
    found = None
    for s in shape:
        d = s["d"]

        def unit(batches: Iterator[pa.RecordBatch], d: int = d) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column("embedding").values.to_numpy(zero_copy_only=False)[b.column("embedding").offsets[0].as_py() : b.column("embedding").offsets[-1].as_py()].reshape(-1, d)
                with np.errstate(over="ignore"):
                    single = x.astype("<f4")
                exact = (single == x).all(1)
                packed = [a.tobytes() if e else r.astype("<f8").tobytes() for a, r, e in zip(single, x, exact, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("n"), pa.array(packed, pa.binary())], ["id", "label", "n", "x"])

        ready = classes.filter(F.size("embedding") == d).select("id", "label", "n", "embedding").mapInArrow(unit, "id long, label long, n long, x binary")
        part = link_classes(ready, s["classes"], d, threshold, recall, probes, tile)
        found = part if found is None else found.unionByName(part)
    none = marked.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if found is None:
        return none
    found = stash(found, "vector-links")
    comp = connected_components(found.filter("other is not null"), "id", "other")
    partners = found.filter("partners is not null").groupBy("id").agg(F.sum("partners").alias("partners"))
    info = classes.join(partners, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    info = info.select("label", "embedding", (F.coalesce("partners", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    out = marked.filter("sound").join(info, ["label", "embedding"]).select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
    alone = marked.filter("not sound")
    return out.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")))
