"""A learnt model of edges: are a node and its neighbour one speaker?

A node's features are its unit vector and the mean of its neighbours', weighed by similarity. One hidden layer (ReLU) turns them into a node state; an edge is scored from the states of both ends and their
similarity (PReLU), and a softmax of two gives the probability. Training minimises (1 - beta) times the squared error of predicted densities plus beta times the cross entropy of edges to denser nodes, both classes weighed
alike. One row is a node with its edges, so a density is complete in its row; each task adds up the gradients of its rows, tasks' sums are added in the order of their numbers, group by group,
and only sums reach the driver: weights are a function of the table and its split, bit for bit. A state table holds weights, momentum and average of every epoch, from which training goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.vectors import l2_normalize
from voxlake.operators import graph as G
from voxlake.session import stash

#: Tasks whose sums are added up together.
FAN_IN = 32
DIGITS = G.DIGITS


def _sizes(dims: int, hidden: int, edge: int) -> dict[str, tuple[int, ...]]:
    return {"w1": (2 * dims, hidden), "b1": (hidden,), "ws": (hidden, edge), "wd": (hidden, edge), "wsim": (edge,), "b2": (edge,), "slope": (1,), "w3": (edge, 2), "b3": (2,)}


@dataclass
class EdgeModel:
    dims: int
    hidden: int = 16
    edge: int = 8
    flat: np.ndarray = field(default_factory=lambda: np.empty(0))

    def __post_init__(self) -> None:
        sizes = _sizes(self.dims, self.hidden, self.edge)
        if not self.flat.size:  # the same start everywhere
            rng, parts = np.random.default_rng(11), []
            for name, shape in sizes.items():
                parts.append(np.full(1, 0.25) if name == "slope" else np.zeros(shape).reshape(-1) if name[0] == "b" else rng.standard_normal(shape).reshape(-1) / np.sqrt(shape[0]))
            self.flat = np.concatenate(parts)
        at = 0
        for name, shape in sizes.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    def with_weights(self, flat: np.ndarray) -> EdgeModel:
        return EdgeModel(self.dims, self.hidden, self.edge, flat)

    def states(self, f: np.ndarray) -> np.ndarray:
        """Node states of features scaled to a mean square of one."""
        return np.maximum(0.0, np.sqrt(self.dims) * f @ self.w1 + self.b1)

    def probability(self, src: np.ndarray, dst: np.ndarray, sim: np.ndarray) -> np.ndarray:
        """That the ends of edges are one speaker, from the ends' states."""
        z = src @ self.ws + dst @ self.wd + sim[:, None] * self.wsim + self.b2
        z = np.where(z > 0, z, self.slope * z) @ self.w3 + self.b3
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -500, 500)))

    def densities(self, f: np.ndarray, fs: np.ndarray, sim: np.ndarray) -> np.ndarray:
        """Predicted density of nodes with features f and, for all alike, neighbours (n, k, features) and similarities (n, k)."""
        n, k = sim.shape
        h = np.repeat(self.states(f), k, axis=0)
        p = self.probability(self.states(fs.reshape(n * k, -1)), h, sim.reshape(-1)).reshape(n, k)
        return np.round((sim * (2 * p - 1)).mean(1), DIGITS)

    def gradient(self, f: np.ndarray, fs: np.ndarray, node: np.ndarray, sim: np.ndarray, same: np.ndarray, weight: np.ndarray, density: np.ndarray, beta: float) -> np.ndarray:
        """Loss and its gradient, summed over nodes (f, density) and their edges: (node, fs, sim, same, weight); an edge of weight 0 has no cross entropy."""
        scale = np.sqrt(self.dims)
        ad, as_ = scale * f @ self.w1 + self.b1, scale * fs @ self.w1 + self.b1
        hd, hs = np.maximum(0, ad), np.maximum(0, as_)
        z = hs @ self.ws + hd[node] @ self.wd + sim[:, None] * self.wsim + self.b2
        a = np.where(z > 0, z, self.slope * z)
        o = a @ self.w3 + self.b3
        p = 1 / (1 + np.exp(np.clip(o[:, 0] - o[:, 1], -500, 500)))
        count = np.bincount(node, minlength=len(f))
        own = np.bincount(node, sim * (2 * p - 1), len(f)) / np.maximum(count, 1)
        off = np.where(count > 0, own - density, 0.0)
        q = np.clip(np.where(same, p, 1 - p), 1e-12, 1.0)
        loss = (1 - beta) * (off**2).sum() - beta * (weight * np.log(q)).sum()
        dp = (1 - beta) * 2 * off[node] / np.maximum(count[node], 1) * 2 * sim
        do = dp * p * (1 - p) + beta * weight * (p - same)  # by the second less the first output
        do = np.stack([-do, do], 1)
        da = do @ self.w3.T
        dz = da * np.where(z > 0, 1.0, self.slope)
        dhs, dhd = dz @ self.ws.T * (as_ > 0), dz @ self.wd.T
        dhd = np.stack([np.bincount(node, c, len(f)) for c in dhd.T], 1) * (ad > 0) if len(node) else np.zeros_like(hd)
        parts = [scale * (fs.T @ dhs + f.T @ dhd), dhs.sum(0) + dhd.sum(0), hs.T @ dz, hd[node].T @ dz, sim @ dz, dz.sum(0), np.array([(da * np.where(z > 0, 0.0, z)).sum()]), a.T @ do, do.sum(0)]
        return np.concatenate([[loss], *(np.asarray(g).reshape(-1) for g in parts)])


# --- rows --------------------------------------------------------------------------------------------------------------


def _grid(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def features(neighbours: DataFrame, x: DataFrame) -> DataFrame:
    """(node, f): unit vector, and the mean of the neighbours' weighed by similarity (those below 0 not at all)."""
    u = x.select("node", F.transform(l2_normalize(F.col("embedding")), lambda v: F.coalesce(v, F.lit(0.0))).alias("u"))
    near = neighbours.filter("rank > 0").select("node", "nbr", F.greatest(F.lit(0.0), 1 - F.col("dist")).alias("w")).join(u.select(F.col("node").alias("nbr"), F.col("u").alias("v")), "nbr")
    held = near.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("nbr", "w", "v"))).alias("near"))
    rows = u.join(held, "node", "left").select("node", "u", F.transform(F.coalesce("near", F.array()), lambda s: s["w"]).alias("w"), F.flatten(F.transform(F.coalesce("near", F.array()), lambda s: s["v"])).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = len(b.column("u")[0])
            own, v = _grid(b.column("u"), d), _grid(b.column("v"), d)
            n = np.diff(b.column("w").offsets.to_numpy())
            w, of = b.column("w").flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
            total = np.bincount(of, w, len(n))
            w = w / np.where(total > 0, total, 1.0)[of]
            mean = np.stack([np.bincount(of, w * c, len(n)) for c in v.T], 1) if len(v) else np.zeros_like(own)
            both = np.concatenate([own, mean], 1)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(pa.array(np.arange(len(both) + 1) * 2 * d, pa.int32()), pa.array(both.reshape(-1)))], ["node", "f"])

    return rows.mapInArrow(run, "node long, f array<double>")


def node_rows(neighbours: DataFrame, x: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, f, sim, fs) of each node with its edges in order of rank; with labels (node, label, density) also density, same and mask (whether the neighbour is denser)."""
    f = stash(features(neighbours, x), "edge-features")
    of = f if labels is None else f.join(labels.select("node", "label", "density"), "node")
    end = of.select(F.col("node").alias("nbr"), *(F.col(c).alias(f"{c}_n") for c in of.columns[1:]))
    e = neighbours.filter("rank > 0").select("node", "rank", "nbr", (1 - F.col("dist")).alias("sim")).join(end, "nbr")
    held = e.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in e.columns if c not in ("node", "rank")]))).alias("e"))
    t = of.join(held, "node", "left").withColumn("e", F.coalesce("e", F.array()))
    pick = lambda c: F.transform("e", lambda s: s[c])
    own = [pick("sim").alias("sim"), F.flatten(pick("f_n")).alias("fs")]
    if labels is not None:
        own += ["density", F.transform("e", lambda s: s["label_n"] == F.col("label")).alias("same"), F.transform("e", lambda s: s["density_n"] > F.col("density")).alias("mask")]
    return t.select("node", "f", *own)


def predicted_density(rows: DataFrame, model: EdgeModel) -> DataFrame:
    """(node, density) of node_rows; a node without edges has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.diff(b.column("sim").offsets.to_numpy()) if b.num_rows else np.empty(0, int)
            out = np.zeros(len(n))
            f, fs, sim = (_grid(b.column(c), w) for c, w in (("f", 2 * model.dims), ("fs", 2 * model.dims), ("sim", 1)))
            at = np.cumsum(n) - n
            for k in np.unique(n[n > 0]):
                of = np.flatnonzero(n == k)
                edges = (at[of][:, None] + np.arange(k)).reshape(-1)
                out[of] = model.densities(f[of], fs[edges].reshape(len(of), k, -1), sim[edges, 0].reshape(len(of), k))
            got = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(got)), pa.array(out[got])], ["node", "density"])

    return rows.mapInArrow(run, "node long, density double")


# --- training ----------------------------------------------------------------------------------------------------------


def training_rows(x: DataFrame, k: int = 10) -> DataFrame:
    """Written node_rows of labelled nodes: (node, f, sim, fs, density, same, mask)."""
    x = x.filter("label is not null and embedding is not null")
    nbr = stash(G.knn(x, k), "edge-knn")
    labels = G.density(nbr, x, k).select("node", "density").join(x.select("node", "label"), "node")
    return stash(node_rows(nbr, x, labels), "edge-rows")


def gradient_sum(rows: DataFrame, model: EdgeModel, weights: tuple[float, float], beta: float) -> np.ndarray:
    """Loss and gradient over all rows. weights: of an edge between different and of one between equal labels."""
    width = 2 * model.dims

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            f, fs = _grid(b.column("f"), width), _grid(b.column("fs"), width)
            n = np.diff(b.column("sim").offsets.to_numpy())
            sim, same, mask = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("sim", "same", "mask"))
            g = model.gradient(f, fs, np.repeat(np.arange(len(n)), n), sim, same > 0, mask * np.where(same > 0, weights[1], weights[0]), b.column("density").to_numpy(), beta)
            total = g if total is None else total + g
        if total is not None:
            number = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([number // FAN_IN]), pa.array([total.tolist()])], ["task", "group", "g"])

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("task")
        g = _grid(t.column("g"), len(t.column("g")[0]))
        total = g[0].copy()
        for row in g[1:]:
            total += row
        return pa.table({"group": t.column("group").slice(0, 1), "g": pa.array([total.tolist()])})

    found = rows.mapInArrow(part, "task long, group long, g array<double>").groupBy("group").applyInArrow(add, "group long, g array<double>").collect()
    total = np.zeros(1 + model.flat.size)
    for r in sorted(found, key=lambda r: r["group"]):
        total += np.array(r["g"])
    return total


@dataclass
class State:
    """After `epoch` epochs: weights, momentum, sum of the weights that count for the average and their number, losses are not kept."""

    epoch: int
    weights: np.ndarray
    velocity: np.ndarray
    summed: np.ndarray
    counted: int

    @property
    def average(self) -> np.ndarray:
        return self.summed / self.counted if self.counted else self.weights


def save_state(spark: SparkSession, path: str, s: State) -> None:
    """One folder an epoch. Saving an epoch again replaces it."""
    rows = [(i, float(w), float(v), float(a), s.counted, len(s.weights)) for i, (w, v, a) in enumerate(zip(s.weights, s.velocity, s.summed, strict=True))]
    spark.createDataFrame(rows, "place int, weight double, velocity double, summed double, counted int, of int").coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={s.epoch}")


def load_state(spark: SparkSession, path: str, epoch: int | None = None) -> State | None:
    """The latest whole state (or that of an epoch); None where there is none. Rows are as many as the model has weights."""
    from pyspark.errors import AnalysisException

    try:
        t = spark.read.parquet(path)
    except AnalysisException:
        return None
    whole = t.groupBy("epoch").agg(F.count("*").alias("n"), F.max("of").alias("of")).filter("n = of").select("epoch")
    last = whole.filter(F.lit(True) if epoch is None else F.col("epoch") == epoch).agg(F.max("epoch")).first()[0]
    if last is None:
        return None
    rows = sorted(t.filter(F.col("epoch") == last).collect(), key=lambda r: r["place"])
    return State(int(last), *(np.array([r[c] for r in rows]) for c in ("weight", "velocity", "summed")), rows[0]["counted"])


def fit(rows: DataFrame, dims: int, *, hidden: int = 16, epochs: int = 12, batches: int = 1, rate: float = 0.5, momentum: float = 0.9, average_from: int | None = None, beta: float = 0.8, state: str | None = None, until: int | None = None) -> State:
    """Descent with momentum, a cosine rate and the average of the weights from epoch average_from on. An epoch takes `batches` steps, on rows dealt by a hash of their node. With a state path every epoch is saved,
    and training goes on from the last one saved there; it stops after `until` epochs, if given."""
    spark, model = rows.sparkSession, EdgeModel(dims, hidden)
    n = model.flat.size
    at = State(0, model.flat, np.zeros(n), np.zeros(n), 0)
    if state and (found := load_state(spark, state)):
        if len(found.weights) != n:
            raise ValueError(f"the state in {state} is of a model of {len(found.weights)} weights, not {n}")
        at = found
    edges = rows.select(F.explode(F.arrays_zip("same", "mask")).alias("e")).filter("e.mask").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("e.same").cast("int")), F.lit(0)).alias("same")).first()
    nodes = rows.count()
    alike = tuple(0.5 / c if c else 0.0 for c in (edges["n"] - edges["same"], edges["same"]))
    last = epochs - max(1, epochs // 4) if average_from is None else average_from
    for epoch in range(at.epoch, epochs if until is None else min(epochs, until)):
        w, v = at.weights, at.velocity
        for k in range(batches):
            some = rows if batches == 1 else rows.filter(F.pmod(F.xxhash64("node", F.lit(epoch)), F.lit(batches)) == k)
            # Sums are over a batch; the losses are means over all nodes and edges.
            g = gradient_sum(some, model.with_weights(w), tuple(a * nodes for a in alike), beta)[1:] * batches / max(1, nodes)
            v = momentum * v - rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) * g
            w = w + v
        counts = epoch >= last
        at = State(epoch + 1, w, v, at.summed + w if counts else at.summed, at.counted + counts)
        if state:
            save_state(spark, state, at)
    return at


def fit_edge_model(x: DataFrame, k: int = 10, **settings) -> EdgeModel:
    """The averaged model of a table (reco, node, label, embedding)."""
    dims = x.filter("embedding is not null").select(F.size("embedding")).first()
    if dims is None:
        raise ValueError("no vectors")
    return EdgeModel(dims[0], settings.get("hidden", 16), flat=fit(training_rows(x, k), dims[0], **settings).average)
