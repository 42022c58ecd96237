"""Family C: vectors, k-nearest-neighbour graphs, densities, forests and clusterings, all recordings in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions.vectors import dot, l2_normalize, temporal_weight
from voxlake.session import stash

DIGITS = 6


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths, without a Python object for any value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


#: Rows and columns of one tile of a recording's pairs, about.
TILE = 1024


def _unit(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, short ones filled up with zeros, and their lengths: -1 for those without a direction (null, holding a null, zero)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(-1).to_numpy().astype(int)
    flat = column.flatten()
    v = np.zeros((len(size), max(size.max(initial=0), 0)))
    inside = np.arange(v.shape[1]) < size[:, None]
    v[inside] = flat.to_numpy(zero_copy_only=False)
    if flat.null_count:
        gone = np.zeros(v.shape, bool)
        gone[inside] = flat.is_null().to_numpy(zero_copy_only=False)
        gone = gone.any(1)
        v[gone], size[gone] = 0.0, -1
    norm = np.sqrt((v * v).sum(1))
    size[norm == 0] = -1
    return v / np.where(norm == 0, 1.0, norm)[:, None], size


#: Tiles of either side that a task gets at most, tasks that a side is dealt to where it has fewer tiles than that, and rows that leave a task at a time.
WIDE, SIDES, BATCH = 16, 4, 65_536


def meet_in_tiles(rows: DataFrame, meet: Callable[[pa.Table, pa.Table], dict], schema: str, group: str, tile: int = TILE, by: str = "node") -> DataFrame:
    """The group and the columns that meet makes of the rows and columns of each tile of a group's pairs, tables in order of node. rows: (group, node, ..), dealt into tiles of about `tile` by a hash of `by`. A task has all pairs
    of up to WIDE tiles of rows with as many of columns and hands them on tile by tile: a row is copied once for WIDE tiles of its group, not for each, and memory is that of the tiles' rows and of one tile's pairs."""
    kind = dict(rows.dtypes)[group]
    blocks = rows.groupBy(group).agg(F.ceil(F.count("*") / tile).cast("int").alias("__n"))
    dealt = rows.join(blocks, group).withColumns({"__own": F.pmod(F.xxhash64(by), F.col("__n")).cast("int"), "__wide": F.least(F.lit(WIDE), F.ceil(F.col("__n") / SIDES)).cast("int")})
    own, last = F.floor(F.col("__own") / F.col("__wide")).cast("int"), F.floor((F.col("__n") - 1) / F.col("__wide")).cast("int")
    place = lambda side, a, b: F.struct(F.lit(side).alias("__side"), a.alias("__a"), b.alias("__b"))
    met = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda other: F.array(place(0, own, other), place(1, other, own))))
    dealt = dealt.withColumn("__at", F.explode(met)).select(*rows.columns, "__own", "__at.*")

    def cut(t: pa.Table) -> list[pa.Table]:
        t = t.sort_by([("__own", "ascending"), ("node", "ascending")])
        ends = [0, *(np.flatnonzero(np.diff(t.column("__own").to_numpy())) + 1).tolist(), t.num_rows]
        t = t.drop_columns([group, "__own", "__side", "__a", "__b"])
        return [t.slice(lo, hi - lo).combine_chunks() for lo, hi in zip(ends, ends[1:]) if hi > lo]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        key, side = t.column(group)[0], t.column("__side").to_numpy()
        left, right = (cut(t.filter(pa.array(side == k))) for k in (0, 1))
        del t
        for p in left:
            for q in right:
                found = meet(p, q)
                yield from pa.table({group: pa.repeat(key, len(next(iter(found.values())))), **found}).combine_chunks().to_batches(max_chunksize=BATCH)

    return dealt.groupBy(group, "__a", "__b").applyInArrow(run, f"{group} {kind}, {schema}")


def cosine_tiles(x: DataFrame, fold: Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], dict], schema: str, group: str = "reco", node: str = "node", carry: tuple[str, ...] = (), by: str | None = None, tile: int = TILE) -> DataFrame:
    """What fold makes of each tile of a group's pairs: rows and columns (tables of node and the carried columns, in order of node), the rounded cosines of all their pairs and where these are null. Rows are dealt into tiles of
    about `tile` by a hash of the node, or of column `by`, rows of equal values then sharing a tile; so memory is that of a tile, and a group of any size is many tasks. fold returns columns without the group."""
    kinds = dict(x.dtypes)
    vector = F.col("embedding") if kinds["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    rows = x.filter(F.col(group).isNotNull()).select(F.col(group), F.col(node).alias("node"), *carry, vector.alias("__v"))
    names = [c.split()[0] for c in schema.split(", ")]

    def meet(p: pa.Table, q: pa.Table) -> dict:
        (u, m), (w, n) = _unit(p.column("__v")), _unit(q.column("__v"))
        wide = max(u.shape[1], w.shape[1])
        u, w = (np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in (u, w))
        null = (m[:, None] != n[None, :]) | (m[:, None] < 0)
        found = fold(p, q, np.round(u @ w.T, DIGITS) + 0.0, null)
        return {c: found[c] for c in names}

    return meet_in_tiles(rows, meet, schema, group, tile, by or "node")


def _pairs_of(p: pa.Table, q: pa.Table, sim: np.ndarray, null: np.ndarray, carry: tuple[str, ...], where: tuple[np.ndarray, np.ndarray] | None = None) -> dict:
    """Columns i, j, sim and the carried ones of both ends (c_i, c_j) of all pairs of a tile, or of those where says."""
    r, c = where or (np.repeat(np.arange(p.num_rows), q.num_rows), np.tile(np.arange(q.num_rows), p.num_rows))
    sim, null = (sim.reshape(-1), null.reshape(-1)) if where is None else (sim[r, c], null[r, c])
    out = {"i": p.column("node").take(pa.array(r)), "j": q.column("node").take(pa.array(c)), "sim": pa.array(sim, mask=null)}
    for name in carry:
        out |= {f"{name}_i": p.column(name).take(pa.array(r)), f"{name}_j": q.column(name).take(pa.array(c))}
    return out


def cosine_pairs(x: DataFrame, group: str = "reco", node: str = "node", carry: tuple[str, ...] = (), above: float | None = None, tile: int = TILE) -> DataFrame:
    """(group, i, j, sim) for all pairs of a group, itself included, rounded, with the carried columns of both ends as c_i and c_j. With above: only pairs of i < j and a greater cosine."""
    kinds = dict(x.dtypes)

    def fold(p: pa.Table, q: pa.Table, sim: np.ndarray, null: np.ndarray) -> dict:
        if above is None:
            return _pairs_of(p, q, sim, null, carry)
        i, j = p.column("node").to_numpy(), q.column("node").to_numpy()
        return _pairs_of(p, q, sim, null, carry, np.nonzero((sim > above) & ~null & (i[:, None] < j[None, :])))

    ends = "".join(f", {c}_{e} {kinds[c]}" for c in carry for e in "ij")
    return cosine_tiles(x, fold, f"i {kinds[node]}, j {kinds[node]}, sim double{ends}", group, node, carry, tile=tile)


def cosine_extremes(x: DataFrame, group: str = "reco", node: str = "node", tile: int = TILE) -> DataFrame:
    """(group, lo, hi): least and greatest cosine of a group's pairs, taken in each tile first."""

    def fold(p: pa.Table, q: pa.Table, sim: np.ndarray, null: np.ndarray) -> dict:
        known = sim[~null]
        return {"lo": known.min(keepdims=True), "hi": known.max(keepdims=True)} if len(known) else {"lo": np.empty(0), "hi": np.empty(0)}

    return cosine_tiles(x, fold, "lo double, hi double", group, node, tile=tile).groupBy(group).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def nearest_pairs(x: DataFrame, k: int, group: str = "reco", node: str = "node", tile: int = TILE) -> DataFrame:
    """(group, node, rank, nbr, dist) as by knn, from all pairs: each tile gives a row's k nearest of its columns, which are ranked over the tiles. Pairs without a cosine come last."""
    kinds = dict(x.dtypes)

    def fold(p: pa.Table, q: pa.Table, sim: np.ndarray, null: np.ndarray) -> dict:
        same = p.column("node").to_numpy()[:, None] == q.column("node").to_numpy()[None, :]
        dist = np.where(same, 0.0, np.round(1 - sim, DIGITS) + 0.0)
        null = (null | np.isnan(dist)) & ~same
        r, c = _nearest(np.where(null, 3.0, dist), k)
        pairs = _pairs_of(p, q, dist, null, (), (r, c))
        return {"i": pairs["i"], "j": pairs["j"], "dist": pairs["sim"]}

    near = cosine_tiles(x, fold, f"i {kinds[node]}, j {kinds[node]}, dist double", group, node, tile=tile)
    rank = (F.row_number().over(Window.partitionBy("i").orderBy(F.asc_nulls_last("dist"), "j")) - 1).cast("long")
    return near.withColumn("rank", rank).filter(F.col("rank") < k).select(group, F.col("i").alias("node"), "rank", F.col("j").alias("nbr"), "dist")


def _nearest(dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k least rounded values of each row, least first, ties to the lesser column."""
    n, m = dist.shape
    k = min(k, m)
    key = np.rint(np.nan_to_num(dist * 10**DIGITS, copy=False, nan=1e9)).astype(np.int64) * m + np.arange(m)
    if k < m:
        key = np.partition(key, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(n), k), (np.sort(key, axis=1) % m).reshape(-1)


#: Products that one step of a search for neighbours holds.
PRODUCTS = 4_000_000
#: Columns of a part of a row, of which the greatest product bounds the search.
PART = 32


def _neighbours(u: np.ndarray, k: int, block: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """From each row on, for blocks of rows of unit vectors: the places of their k nearest, themselves first at distance 0, ties to the lesser place, and the distances. A block is of fewer rows where these meet many.
    Of many columns only those are rounded and ranked that reach the k-th of the maxima of parts of the row: k columns do, so no other can be nearer."""
    block = max(1, min(block, PRODUCTS // max(1, len(u))))
    parts = len(u) // PART
    some = parts >= 4 * k and bool(np.isfinite(u).all())
    for lo in range(0, len(u), block):
        sim = u[lo : lo + block] @ u.T
        rows = np.arange(len(sim))
        if some:
            sim[rows, lo + rows] = 1.0
            top = sim[:, :parts].copy()
            for at in range(parts, parts * PART, parts):
                np.maximum(top, sim[:, at : at + parts], out=top)
            least = np.partition(top, parts - k, axis=1)[:, parts - k] - 2 * 10.0**-DIGITS  # rounding moves by less
            r, c = np.nonzero(sim >= least[:, None])
            d = np.round(1 - np.round(sim[r, c], DIGITS), DIGITS) + 0.0
            order = np.lexsort((c, np.rint(d * 10**DIGITS), r))
            first = np.searchsorted(r, rows)
            at = order[(first[:, None] + np.arange(k)).reshape(-1)]
            yield lo, c[at].reshape(len(sim), k), d[at].reshape(len(sim), k)
            continue
        d = np.round(1 - np.round(sim, DIGITS), DIGITS)
        d[rows, lo + rows] = 0.0
        near = _nearest(d, k)[1].reshape(len(d), -1)
        yield lo, near, np.take_along_axis(d, near, 1)


def halve_affinity(x: DataFrame, place: str, group: str = "reco", node: str = "node", tile: int = TILE) -> DataFrame:
    """(group, a, b, micro_sum, n): sum of rounded cosines, in millionths, and number of the pairs of each two places. Rows of a place share a tile, so a cell is one tile's."""
    kind = dict(x.dtypes)[place]

    def fold(p: pa.Table, q: pa.Table, sim: np.ndarray, null: np.ndarray) -> dict:
        cuts = []
        micro, known = np.where(null, 0, np.rint(np.where(null, 0, sim) * 10**DIGITS)).astype(np.int64), (~null).astype(np.int64)
        for axis, t in enumerate((p, q)):
            at = t.column(place).to_numpy()
            order = np.argsort(at, kind="stable")
            value, first, n = np.unique(at[order], return_index=True, return_counts=True)
            if not len(first):
                return {"a": pa.array([], p.schema.field(place).type), "b": pa.array([], p.schema.field(place).type), "micro_sum": np.empty(0, np.int64), "n": np.empty(0, np.int64)}
            micro, known = (np.add.reduceat(np.take(m, order, axis), first, axis) for m in (micro, known))
            cuts.append((value, n))
        (a, n), (b, m) = cuts
        return {"a": np.repeat(a, len(b)), "b": np.tile(b, len(a)), "micro_sum": pa.array(micro.reshape(-1), mask=known.reshape(-1) == 0), "n": np.outer(n, m).reshape(-1)}

    return cosine_tiles(x, fold, f"a {kind}, b {kind}, micro_sum long, n long", group, node, (place,), place, tile)


def knn(x: DataFrame, k: int, group: str = "reco", node: str = "node", block: int = 512) -> DataFrame:
    """Exact neighbours by cosine: (group, node, rank, nbr, dist), rank 0 being the node itself at distance 0, ties to the lesser
    neighbour. A group is multiplied in blocks of rows, and only k columns of a block are ever returned."""
    kind = dict(x.dtypes)[group]

    def run(t: pa.Table) -> pa.Table:
        nodes = t.column("node").to_numpy()
        order = np.argsort(nodes, kind="stable")
        nodes = nodes[order]
        v = matrix(t.column("embedding"))[order]
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        out = []
        for lo, first, far in _neighbours(v, k, block):
            m, kk = first.shape
            out.append((np.repeat(nodes[lo : lo + m], kk), np.tile(np.arange(kk), m), nodes[first].reshape(-1), far.reshape(-1)))
        node_, rank, nbr, dist = (np.concatenate(c) for c in zip(*out, strict=True))
        key = t.column(group).slice(0, 1).to_pylist() * len(node_)
        return pa.table({group: pa.array(key, t.schema.field(group).type), "node": node_, "rank": rank, "nbr": nbr, "dist": dist})

    rows = x.select(group, F.col(node).cast("long").alias("node"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.groupBy(group).applyInArrow(run, f"{group} {kind}, node long, rank long, nbr long, dist double")


def rerank(candidates: DataFrame, x: DataFrame, k: int) -> DataFrame:
    """Exact distances for candidate pairs (node, nbr), clamped to [0, 1] and ranked again. Vectors are normalised before they meet their pairs."""
    unit = x.select("node", l2_normalize(F.col("embedding")).alias("u"))
    a, b = unit, unit.toDF("nbr", "w")
    sim = dot(F.col("u"), F.col("w"))
    c = candidates.select("node", "nbr").distinct().join(a, "node").join(b, "nbr")
    d = c.select("node", "nbr", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - sim)), DIGITS).alias("dist"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("dist", "nbr")) - 1
    return d.withColumn("rank", rank.cast("long")).filter(F.col("rank") < k).select("node", "rank", "nbr", "dist")


def sparse_similarity(neighbours: DataFrame, least: float = 0.0) -> DataFrame:
    """(.., src, dst, sim): edges from neighbour to node, self loops dropped."""
    sim = F.round(1 - F.col("dist"), DIGITS)
    return neighbours.filter((F.col("node") != F.col("nbr")) & (sim >= least)).select("reco", F.col("nbr").alias("src"), F.col("node").alias("dst"), sim.alias("sim"))


def row_normalize(edges: DataFrame) -> DataFrame:
    """sim / (sum over the destination's edges), a sum of 0 or less counting as 1; norm is its inverse."""
    s = F.sum("sim").over(Window.partitionBy("dst"))
    s = F.when(s <= 0, 1.0).otherwise(s)
    return edges.withColumns({"norm": 1 / s, "affine": F.col("sim") / s})


def density(neighbours: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(node, density): similarity to neighbours of the node's label less that to others, over k - 1."""
    a, b = labels.select("node", F.col("label").alias("la")), labels.select(F.col("node").alias("nbr"), F.col("label").alias("lb"))
    t = neighbours.filter("rank > 0").join(a, "node").join(b, "nbr")
    sim = 1 - F.col("dist")
    return t.groupBy("reco", "node").agg(F.round(F.sum(F.when(F.col("la") == F.col("lb"), sim).otherwise(-sim)) / (k - 1), DIGITS).alias("density"))


def overlap_density(neighbours: DataFrame, labels: DataFrame, k: int, *, halve: bool = True) -> DataFrame:
    """Density where labels are arrays: neighbours that share any label count; nodes of several labels count half."""
    a, b = labels.select("node", F.col("labels").alias("la")), labels.select(F.col("node").alias("nbr"), F.col("labels").alias("lb"))
    t = neighbours.filter("rank > 0").join(a, "node").join(b, "nbr")
    sim = 1 - F.col("dist")
    d = F.sum(F.when(F.arrays_overlap("la", "lb"), sim).otherwise(-sim)) / (k - 1)
    half = F.when(F.max(F.size("la")) > 1, 0.5).otherwise(1.0) if halve else F.lit(1.0)
    return t.groupBy("node").agg(F.round(d * half, DIGITS).alias("density"))


def label_pairs(x: DataFrame, tile: int = TILE) -> DataFrame:
    """(i, j): pairs i < j of a recording's nodes that share a label; x: (reco, node, labels). The nodes of a label meet in tiles of about `tile` by `tile`, each pair in one of them, so a frequent label is many tasks; a pair of
    several common labels is kept under the least one, so pairs are not brought together again."""
    own = x.select("reco", "node", F.explode("labels").alias("l")).filter("l is not null and node is not null and reco is not null").groupBy("reco", "node").agg(F.collect_set("l").alias("labels"))
    e = own.select("reco", "node", "labels", F.explode("labels").alias("l"))
    blocks = e.groupBy("reco", "l").agg(F.ceil(F.count("*") / tile).cast("int").alias("n"))
    dealt = e.join(blocks, ["reco", "l"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    many = F.when(F.size("labels") > 1, F.col("labels"))
    left = dealt.select("reco", "l", F.col("own").alias("a"), F.explode(F.sequence("own", F.col("n") - 1)).alias("b"), F.col("node").alias("u"), many.alias("lu"))
    right = dealt.select("reco", "l", F.explode(F.sequence(F.lit(0), "own")).alias("a"), F.col("own").alias("b"), F.col("node").alias("w"), many.alias("lw"))
    key = ["reco", "l", "a", "b"]
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: tiles are small and their pairs many, so tasks should not be merged by size
    both = left.repartition(parts, *key).join(right.repartition(parts, *key).hint("shuffle_hash"), key)
    once = F.col("lu").isNull() | F.col("lw").isNull() | (F.col("l") == F.array_min(F.array_intersect("lu", "lw")))
    return both.filter(((F.col("a") < F.col("b")) | (F.col("u") < F.col("w"))) & (F.col("u") != F.col("w")) & once).select(F.least("u", "w").alias("i"), F.greatest("u", "w").alias("j"))


def cluster_density(neighbours: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """(node, cluster, density): similarity to the neighbours of each cluster over k - 1."""
    t = neighbours.filter("rank > 0").join(clusters.select(F.col("node").alias("nbr"), "cluster"), "nbr")
    return t.groupBy("node", "cluster").agg(F.round(F.sum(1 - F.col("dist")) / (k - 1), DIGITS).alias("density"))


def decode(neighbours: DataFrame, dens: DataFrame, tau: float) -> DataFrame:
    """Edges to neighbours of higher density nearer than 1 - tau."""
    a, b = dens.select("node", F.col("density").alias("da")), dens.select(F.col("node").alias("nbr"), F.col("density").alias("db"))
    t = neighbours.filter("rank > 0").join(a, "node").join(b, "nbr")
    return t.filter((F.col("db") > F.col("da")) & (F.col("dist") < 1 - tau)).select("reco", "node", "nbr", "dist")


def forest(edges: DataFrame) -> DataFrame:
    """(node, parent): the nearest of the decoded edges, ties to the lesser neighbour."""
    return edges.groupBy("reco", "node").agg(F.min_by("nbr", F.struct("dist", "nbr")).alias("parent"))


def roots(nodes: DataFrame, parents: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) by pointer jumping: each round doubles the distance that pointers span."""
    t = stash(nodes.select("node").join(parents.select("node", "parent"), "node", "left").select("node", F.coalesce("parent", "node").alias("root")), "roots")
    for _ in range(rounds):
        up = t.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stash(t.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        t = new.select("node", "root")
        if not new.filter("moved").limit(1).count():
            return t
    raise RuntimeError("parents do not form a forest")


def numbered(rooted: DataFrame, group: DataFrame) -> DataFrame:
    """Adds label: roots of a group numbered from 0 by node."""
    r = rooted.join(group.select("node", "reco"), "node")
    n = r.select("reco", "root").distinct().withColumn("label", (F.row_number().over(Window.partitionBy("reco").orderBy("root")) - 1).cast("long"))
    return r.join(n, ["reco", "root"]).select("reco", "node", "root", "label")


def cluster_means(x: DataFrame, rooted: DataFrame) -> DataFrame:
    """(root, dim, mean): features of the next level."""
    t = x.select("node", F.posexplode("embedding").alias("dim", "v")).join(rooted.select("node", "root"), "node")
    return t.groupBy("root", "dim").agg(F.round(F.avg(F.col("v").cast("double")), DIGITS).alias("mean"))


def next_features(means: DataFrame) -> DataFrame:
    return means.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("embedding"))


def adaptive_k(sizes: DataFrame, k: int, *, must_run: bool = False, hierarchical: bool = False) -> DataFrame:
    """(reco, k): the graph's k, null where the level loop stops for the recording. sizes: (reco, n)."""
    n = F.col("n")
    if hierarchical:
        rule = F.when(n >= 10, F.ceil(n * 0.3))
    else:
        rule = F.when(n > k, F.lit(k)).when((n > 20) | F.lit(must_run), n)
    return sizes.select("reco", "n", rule.cast("long").alias("k"))


def propagate(edges: DataFrame, x: DataFrame, times: int = 1) -> DataFrame:
    """(node, dim, value) after value <- sum of affine * neighbour's value, so many times. x: (node, dim, value)."""
    for _ in range(times):
        x = edges.select("src", "dst", "affine").join(x.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node"), "dim").agg(F.sum(F.col("affine") * F.col("value")).alias("value"))
    return x


def symmetric_normalize(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries of D^-1/2 (A + I) D^-1/2."""
    a = edges.select("src", "dst", "sim").unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("sim")))
    deg = a.groupBy(F.col("dst").alias("n")).agg(F.sum("sim").alias("deg"))
    r = lambda c: F.when(F.col(c) > 0, 1 / F.sqrt(F.col(c))).otherwise(0.0)
    t = a.join(deg.select(F.col("n").alias("dst"), F.col("deg").alias("dd")), "dst").join(deg.select(F.col("n").alias("src"), F.col("deg").alias("ds")), "src", "left")
    return t.select("src", "dst", F.round(F.col("sim") * r("dd") * F.coalesce(r("ds"), F.lit(0.0)), DIGITS).alias("value"))


def linear(x: DataFrame, weights: list[list[float]], bias: list[float] | None = None, *, relu: bool = False) -> DataFrame:
    """(node, embedding) through one dense layer, inside JVM code; weights: a small list of output rows."""
    out = []
    for i, row in enumerate(weights):
        v = dot(F.col("embedding"), F.array(*[F.lit(float(w)) for w in row])) + F.lit(float(bias[i]) if bias else 0.0)
        out.append(F.greatest(F.lit(0.0), v) if relu else v)
    return x.select("node", F.array(*out).alias("embedding"))


def graph_conv(edges: DataFrame, x: DataFrame, weights: list[list[float]]) -> DataFrame:
    """concat(self, sum of affine * neighbour) through a dense layer and ReLU. x: (node, embedding)."""
    flat = x.select("node", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))
    msg = propagate(edges, flat).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("m"))
    width = len(weights[0]) // 2
    both = x.join(msg, "node", "left").select("node", F.concat(F.transform("embedding", lambda v: v.cast("double")), F.coalesce("m", F.array_repeat(F.lit(0.0), width))).alias("embedding"))
    return linear(both, weights, relu=True)


def edge_softmax(edges: DataFrame, score: str = "sim") -> DataFrame:
    """Attention: exp of the score over its sum by destination, computed against the destination's greatest score."""
    w = Window.partitionBy("dst")
    e = F.exp(F.col(score) - F.max(score).over(w))
    return edges.withColumn("attention", F.round(e / F.sum(e).over(w), DIGITS))


def edge_probabilities(edges: DataFrame, x: DataFrame, w: list[float], slope: float = 0.25) -> DataFrame:
    """Two-class edge classifier: PReLU of projections of source plus destination, then softmax: adds p0, p1."""
    p = linear(x, [w]).select("node", F.col("embedding")[0].alias("h"))
    t = edges.join(p.select(F.col("node").alias("src"), F.col("h").alias("hs")), "src").join(p.select(F.col("node").alias("dst"), F.col("h").alias("hd")), "dst")
    z = F.col("hs") + F.col("hd")
    z = F.when(z > 0, z).otherwise(slope * z)
    p1 = 1 / (1 + F.exp(-z))
    return t.withColumns({"p1": p1, "p0": 1 - p1}).drop("hs", "hd")


def predicted_density(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.col("dst").alias("node")).agg(F.round(F.avg(F.col("sim") * (F.col("p1") - F.col("p0"))), DIGITS).alias("density"))


def average_linkage(v: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster (the place of its first member) of each row of v when, time and again, the two clusters of the greatest mean product have been joined while that is not below the threshold. The mean product of two clusters
    is that of their means, so no matrix of pairs is held; chains of nearest clusters find the same joins in another order, since a join never brings a cluster nearer to the others than its parts were."""
    n = len(v)
    own, at = np.arange(n), np.arange(n)  # join of each row; first member by place
    total, size, final, chain, start = v.copy(), np.ones(n), np.zeros(n, bool), [], 0  # final: joined into another, or no nearer to any than the threshold
    while True:
        if not chain:
            while start < len(at) and final[start]:
                start += 1
            if start == len(at):
                break
            chain = [start]
        a = chain[-1]
        near = (total @ total[a]) / (size * size[a])
        near[final] = -np.inf
        near[a] = -np.inf
        b = int(np.argmax(near))
        if len(chain) > 1 and near[chain[-2]] >= near[b] - 1e-12:
            b = chain[-2]
        if not near[b] >= threshold:
            final[chain] = True
            chain = []
        elif len(chain) > 1 and b == chain[-2]:
            chain = chain[:-2]
            a, b = (a, b) if at[a] < at[b] else (b, a)
            total[a] += total[b]
            size[a] += size[b]
            final[b], own[at[b]] = True, at[a]
        else:
            chain.append(b)
        if not chain and final.sum() * 2 > len(final):
            keep = ~final
            at, total, size, final, start = at[keep], total[keep], size[keep], final[keep], 0
    while not (own == (up := own[own])).all():
        own = up
    return own


def join_small(v: np.ndarray, own: np.ndarray, least: int) -> np.ndarray:
    """Clusters below least members, in order, join the one of the greatest mean product of those that have as many. Clusters are known by their first members."""
    name, to, size = np.unique(own, return_inverse=True, return_counts=True)
    total = np.zeros((len(name), v.shape[1]))
    np.add.at(total, to, v)
    into = np.arange(len(name))
    for c in np.flatnonzero(size < least):
        others = np.flatnonzero(size >= least)
        if not len(others):
            break
        o = others[np.argmax(total[others] @ total[c] / size[others])]
        total[o] += total[c]
        size[o] += size[c]
        size[c], into[c] = 0, o
    first = np.full(len(name), len(v))
    np.minimum.at(first, into[to], np.arange(len(v)))
    return first[into[to]]


def agglomerate(x: DataFrame, threshold: float, group: str = "reco", least: int = 1) -> DataFrame:
    """Average-linkage clustering of each recording on cosine similarity until no two clusters are nearer than the threshold;
    clusters below least members then join their nearest. (group, node, cluster): the cluster's least node."""

    def run(t: pa.Table) -> pa.Table:
        nodes = t.column("node").to_numpy()
        order = np.argsort(nodes)
        nodes = nodes[order]
        v = matrix(t.column("embedding"))[order]
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        own = join_small(v, average_linkage(v, threshold), least)
        key = pa.array(t.column(group).slice(0, 1).to_pylist() * len(nodes), t.schema.field(group).type)
        return pa.table({group: key, "node": nodes, "cluster": nodes[own].astype(np.int64)})

    kind = dict(x.dtypes)[group]
    rows = x.select(group, F.col("node").cast("long").alias("node"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.groupBy(group).applyInArrow(run, f"{group} {kind}, node long, cluster long")


# --- training ----------------------------------------------------------------------------------------------------------


def training_edges(x: DataFrame, ks: tuple[int, ...], nearest: DataFrame | None = None) -> DataFrame:
    """(k, reco, src, dst, sim, affine, same, mask): edges of the graph of each k, whether their ends share the label, and whether they lead from the denser end.
    nearest: knn of x of the greatest k; the neighbours of a lesser one are its first ranks, so they are searched for once."""
    out, nearest = None, stash(knn(x, max(ks)), "nearest") if nearest is None else nearest
    for k in ks:
        n = nearest.filter(F.col("rank") < k)
        v = density(n, x, k).select("node", "density").join(x.select("node", "label"), "node")
        ends = lambda end, d, l: v.select(F.col("node").alias(end), F.col("density").alias(d), F.col("label").alias(l))  # noqa: B023, E731, E741
        e = row_normalize(sparse_similarity(n, 0.0)).join(ends("src", "ds", "ls"), "src").join(ends("dst", "dd", "ld"), "dst")
        e = e.select(F.lit(k).alias("k"), "reco", "src", "dst", "sim", "affine", (F.col("ls") == F.col("ld")).alias("same"), (F.col("ds") > F.col("dd")).alias("mask"))
        out = e if out is None else out.unionByName(e)
    return out


def training_levels(x: DataFrame, ks: tuple[int, ...], levels: int) -> DataFrame:
    """training_edges of every level, the nodes of a level being the clusters of the one before under the true densities at the least k."""
    out, level = None, x.select("reco", "node", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    for number in range(levels):
        nearest = stash(knn(level, max(ks)), "nearest")
        t = training_edges(level, ks, nearest).withColumn("level", F.lit(number))
        out = t if out is None else out.unionByName(t)
        if number == levels - 1:
            break
        n = nearest.filter(F.col("rank") < min(ks))
        rooted = roots(level, forest(decode(n, density(n, level, min(ks)), 0.0)))
        means = next_features(cluster_means(level, rooted)).withColumnRenamed("root", "node")
        level = stash(level.drop("embedding").join(means, "node").select("reco", "node", "label", "embedding"), "level")
    return out


def joint_loss(scored: DataFrame, truth: DataFrame, labelled: DataFrame, *, beta: float, gamma: float, alpha: float) -> DataFrame:
    """One row: mse of predicted densities, ce and focal loss over masked edges, and their sums weighed 1 - beta and beta (1 and beta from beta 1 on). Without masked edges only densities count.
    scored: (dst, sim, p0, p1); truth: (node, density); labelled: (p1, same, mask)."""
    den = scored.groupBy(F.col("dst").alias("node")).agg(F.avg(F.col("sim") * (F.col("p1") - F.col("p0"))).alias("p")).join(truth, "node")
    mse = den.agg(F.avg(F.pow(F.col("p") - F.col("density"), 2)).alias("mse"))
    p = F.when(F.col("same"), F.col("p1")).otherwise(1 - F.col("p1"))
    edge = labelled.filter("mask").agg(F.avg(-F.log(p)).alias("ce"), F.avg(-alpha * F.pow(1 - p, gamma) * F.log(p)).alias("focal"))
    weigh = lambda c: F.when(F.col(c).isNull(), F.col("mse")).otherwise((1 - beta if beta < 1 else 1.0) * F.col("mse") + beta * F.col(c))
    return mse.join(edge).select(*[F.round(c, 6).alias(n) for c, n in ((F.col("mse"), "mse"), (F.col("ce"), "ce"), (F.col("focal"), "focal"), (weigh("ce"), "loss"), (weigh("focal"), "focal_loss"))])


def cluster_recording(nodes: np.ndarray, v: np.ndarray, k: int, tau: float, levels: int, density: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], early_stop: bool = False) -> np.ndarray:
    """Cluster (its peak's node) of each node of one recording. A level links every node to its nearest denser neighbour, if nearer than 1 - tau; the peaks, with the means of their clusters, are
    the next level. density(unit vectors, neighbours, similarities) of a level's nodes is predicted. The last level is that without a new link, the last of `levels` or, with early_stop, one that the level before exceeds
    less than k - 1 times in links."""
    before = np.inf
    own, at = np.arange(len(nodes)), np.arange(len(nodes))  # peak of each node; the level's nodes
    for number in range(levels):
        n = len(at)
        kk = k if n > k else n if n > 20 or number == 0 else 0
        if kk < 2:
            break
        u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        near, far = np.empty((n, kk), np.int64), np.empty((n, kk))
        for lo, first, dist in _neighbours(u, kk):
            near[lo : lo + len(first)], far[lo : lo + len(first)] = first, dist
        dens = density(u, near[:, 1:], 1 - far[:, 1:])
        fits = (dens[near[:, 1:]] > dens[:, None]) & (far[:, 1:] < 1 - tau)
        up = np.where(fits.any(1), near[np.arange(n), 1 + fits.argmax(1)], np.arange(n))
        added = int((up != np.arange(n)).sum())
        if not added:
            break
        while not (up == (hop := up[up])).all():
            up = hop
        peaks, to = np.unique(up, return_inverse=True)
        own = to[own]
        v = np.round(np.stack([np.bincount(to, c, len(peaks)) for c in v.T], 1) / np.bincount(to)[:, None], DIGITS)
        at = at[peaks]
        if early_stop and before / added < k - 1:
            break
        before = added
    return nodes[at[own]]


def logistic_density(slope: float, bias: float) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Mean over a node's edges of sim * (p1 - p0), p1 the logistic of slope * sim + bias."""
    return lambda u, near, sim: np.round((sim * (2 / (1 + np.exp(-(slope * sim + bias))) - 1)).mean(1), DIGITS)


def model_density(model) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:  # noqa: ANN001
    """The same with the probabilities of an edge model (edge_model.EdgeModel)."""

    def density(u: np.ndarray, near: np.ndarray, sim: np.ndarray) -> np.ndarray:
        w = np.maximum(0.0, sim)
        total = w.sum(1, keepdims=True)
        w = w / np.where(total > 0, total, 1.0)
        out = np.empty(len(u))
        f = np.concatenate([u, np.stack([(w * c[near]).sum(1) for c in u.T], 1)], 1)
        for lo in range(0, len(u), 512):
            out[lo : lo + 512] = model.densities(f[lo : lo + 512], f[near[lo : lo + 512]], sim[lo : lo + 512])
        return out

    return density


#: Nodes of the largest recording that one task clusters by itself; larger ones go by tables (plans.diarization.cluster_levels).
KERNEL_NODES = 20_000


def predicted_clusters(x: DataFrame, k: int = 10, tau: float = 0.0, levels: int = 15, slope: float = 20.0, bias: float = -5.0, model=None, early_stop: bool = False) -> DataFrame:  # noqa: ANN001
    """(reco, node, cluster) by cluster_recording; a recording is one task's call, all recordings run side by side in one stage. Densities are the model's, or the logistic's without one. Labels are not read."""
    kind = dict(x.dtypes)["reco"]
    density = model_density(model) if model is not None else logistic_density(slope, bias)

    def run(t: pa.Table) -> pa.Table:
        nodes = t.column("node").to_numpy()
        order = np.argsort(nodes, kind="stable")
        nodes, v = nodes[order], matrix(t.column("embedding"))[order]
        return pa.table({"reco": pa.array(t.column("reco").slice(0, 1).to_pylist() * len(nodes), t.schema.field("reco").type), "node": nodes, "cluster": cluster_recording(nodes, v, k, tau, levels, density, early_stop)})

    rows = x.select("reco", F.col("node").cast("long").alias("node"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.groupBy("reco").applyInArrow(run, f"reco {kind}, node long, cluster long")
