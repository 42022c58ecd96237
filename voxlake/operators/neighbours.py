"""Approximate nearest neighbours of each recording by an inverted file over product codes, with all work dealt by (recording, list).

1. `train` fits a recording's list centres (k-means on the sphere) on a drawn sample of at most SAMPLE_PER_LIST rows a list, and codebooks for the residuals of each
   sub-space on a sample of all recordings. Both samples are bounded; every row is indexed.
2. `file_rows` assigns each row to its nearest centre, writes its residual as one byte per sub-space and finds the lists that it probes. A recording's rows are dealt in blocks; each block gets the recording's centres.
3. `visit` compares queries with the members of one list through tables of the products of a query's parts with all code words. Members and queries of a list meet in tiles of bounded size, so a list
   that holds most of a recording is many tasks. The nearest lists are visited first; what they give bounds what the others need to return.
4. The best `refine * k` candidates are ranked by exact distance (`graph.rerank`).
5. With `exact`, tiles of the recording's pairs give what lists and codes overlooked: pairs that are no farther than a row's last candidate (`overlooked`).

Rows without a vector have no neighbours and are nobody's; ties go to the lesser neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators.graph import TILE, _nearest, cosine_tiles, rerank
from voxlake.session import stash

#: Lists of a recording of n rows: min(MOST_LISTS, 16 * sqrt(n)), but ROWS_PER_LIST rows a list at least.
MOST_LISTS, ROWS_PER_LIST, SAMPLE_PER_LIST = 8192, 4, 32
#: Code words of a sub-space (one byte), and rows that codebooks are fitted on.
WORDS, CODE_SAMPLE = 256, 32_768
#: Rows of one side of a tile or of a block of a recording.
BLOCK = 4096


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, without a Python object for any value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def lists_of(v: np.ndarray) -> pa.Array:
    width = v.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, width), pa.int32()), pa.array(v.reshape(-1), pa.float32()))


def nearest(v: np.ndarray, centres: np.ndarray, *, sphere: bool, block: int = 1024) -> np.ndarray:
    """The centre of greatest product (sphere) or least distance of each row."""
    half = 0 if sphere else 0.5 * (centres**2).sum(1)
    return np.concatenate([(v[lo : lo + block] @ centres.T - half).argmax(1) for lo in range(0, len(v), block)]) if len(v) else np.empty(0, np.int64)


def k_means(v: np.ndarray, m: int, *, sphere: bool, passes: int = 8, seed: int = 3) -> np.ndarray:
    c = v[np.random.default_rng(seed).choice(len(v), min(m, len(v)), replace=False)].copy()
    for _ in range(passes):
        own = nearest(v, c, sphere=sphere)
        order = np.argsort(own, kind="stable")
        held, first = np.unique(own[order], return_index=True)
        c[held] = np.add.reduceat(v[order], first, axis=0) / np.diff([*first, len(v)])[:, None]
        if sphere:
            c = unit(c)
    return c


@dataclass
class Index:
    """sizes: reco, n, lists, blocks. centres: reco, list, centre. books: (sub-spaces, words, width). rows: reco, node, list, code, probes (list, product), v."""

    sizes: DataFrame
    centres: DataFrame
    books: np.ndarray
    rows: DataFrame


def plain_rows(x: DataFrame) -> DataFrame:
    return x.filter("embedding is not null").select("reco", F.col("node").cast("long").alias("node"), F.col("embedding").cast("array<float>").alias("v"))


def sizes_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    n = F.col("n")
    lists = F.greatest(F.lit(1), F.least(F.lit(MOST_LISTS), F.floor(16 * F.sqrt(n)), F.floor(n / ROWS_PER_LIST))).cast("int")
    return rows.groupBy("reco").agg(F.count("*").alias("n")).select("reco", "n", lists.alias("lists"), F.ceil(n / block).cast("int").alias("blocks"))


def _drawn(salt: int):
    """A number in [0, 1) from the node."""
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def train(rows: DataFrame, sizes: DataFrame, parts: int) -> tuple[DataFrame, np.ndarray]:
    """(reco, list, centre) and the codebooks."""
    kind = dict(rows.dtypes)["reco"]
    total = sizes.agg(F.sum("n")).first()[0] or 0

    def fit(t: pa.Table) -> pa.Table:
        v = unit(matrix(t.column("v")))
        c = k_means(v, t.column("lists")[0].as_py(), sphere=True)
        taught = np.flatnonzero(t.column("draw").to_numpy() < CODE_SAMPLE / max(1, total))
        rest = v[taught] - c[nearest(v[taught], c, sphere=True)]
        both = np.concatenate([c, rest])
        number = np.concatenate([np.arange(len(c)), np.full(len(rest), -1)]).astype(np.int32)
        return pa.table({"reco": pa.array(t.column("reco").slice(0, 1).to_pylist() * len(both), t.schema.field("reco").type), "list": number, "centre": lists_of(both)})

    some = rows.join(sizes, "reco").filter(_drawn(1) < F.col("lists") * SAMPLE_PER_LIST / F.col("n"))
    share = F.least(F.lit(1.0), F.col("lists") * SAMPLE_PER_LIST / F.col("n"))
    fitted = stash(some.select("reco", "lists", "v", (_drawn(2) * share).alias("draw")).groupBy("reco").applyInArrow(fit, f"reco {kind}, list int, centre array<float>"), "ivf-centres")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, part in enumerate(np.split(matrix(b.column(0)), parts, axis=1) if b.num_rows else []):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), s), pa.int32()), lists_of(part)], ["part", "v"])

    def book(t: pa.Table) -> pa.Table:
        words = k_means(matrix(t.column("v")), WORDS, sphere=False)
        return pa.table({"part": t.column("part").slice(0, 1), "words": lists_of(words.reshape(1, -1))})

    residuals = fitted.filter("list < 0").select("centre")
    found = residuals.mapInArrow(cut, "part int, v array<float>").groupBy("part").applyInArrow(book, "part int, words array<float>").collect()  # WORDS * dimensions numbers
    words = [np.array(r["words"], np.float32) for r in sorted(found, key=lambda r: r["part"])]
    width = fitted.select(F.size("centre")).first()
    return fitted.filter("list >= 0"), np.stack(words).reshape(parts, -1, width[0] // parts) if words else np.zeros((parts, 1, (width[0] if width else parts) // parts), np.float32)


def file_rows(rows: DataFrame, sizes: DataFrame, centres: DataFrame, books: np.ndarray, probes: int) -> DataFrame:
    kind = dict(rows.dtypes)["reco"]
    parts, _, width = books.shape

    def one(t: pa.Table, c: pa.Table) -> pa.Table:
        c = c.sort_by("list")
        v, centre = unit(matrix(t.column("v"))), matrix(c.column("centre"))
        own, lists, dots = np.empty(len(v), np.int32), [], []
        p = min(probes, len(centre))
        for lo in range(0, len(v), 512):
            s = v[lo : lo + 512] @ centre.T
            near = np.argpartition(-s, p - 1, axis=1)[:, :p] if p < s.shape[1] else np.tile(np.arange(p), (len(s), 1))
            near = np.take_along_axis(near, np.lexsort((near, -np.take_along_axis(s, near, 1)), axis=1), 1)
            own[lo : lo + 512] = near[:, 0]
            lists.append(near)
            dots.append(np.take_along_axis(s, near, 1))
        near, dot = np.concatenate(lists), np.concatenate(dots)
        rest = v - centre[own]
        code = np.stack([nearest(rest[:, s * width : (s + 1) * width], books[s], sphere=False) for s in range(parts)], 1).astype(np.uint8)
        pairs = pa.StructArray.from_arrays([pa.array(near.reshape(-1), pa.int32()), pa.array(dot.reshape(-1), pa.float32())], ["list", "dot"])
        return pa.table({
            "reco": t.column("reco"), "node": t.column("node"), "list": own, "code": pa.array([r.tobytes() for r in code], pa.binary()),
            "probes": pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) * p + 1, p), pa.int32()), pairs), "v": lists_of(v),
        })

    dealt = rows.join(sizes.select("reco", "blocks"), "reco").select("reco", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int").alias("block"), "node", "v")
    sent = centres.join(sizes.select("reco", "blocks"), "reco").select("reco", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "list", "centre")
    out = dealt.groupBy("reco", "block").cogroup(sent.groupBy("reco", "block")).applyInArrow(lambda t, c: one(t, c) if t.num_rows else _nothing(t, c, kind), f"reco {kind}, node long, list int, code binary, probes array<struct<list:int,dot:float>>, v array<float>")
    return stash(out, "ivf-rows")


def _nothing(t: pa.Table, c: pa.Table, kind: str) -> pa.Table:
    """A block that the hash left empty."""
    of = c.schema.field("reco").type
    probe = pa.list_(pa.struct([("list", pa.int32()), ("dot", pa.float32())]))
    names = {"reco": of, "node": pa.int64(), "list": pa.int32(), "code": pa.binary(), "probes": probe, "v": pa.list_(pa.float32())}
    return pa.table({n: pa.array([], k) for n, k in names.items()})


def build(x: DataFrame, *, probes: int = 128, parts: int = 32, block: int = BLOCK) -> Index:
    rows = plain_rows(x)
    sizes = stash(sizes_of(rows, block), "ivf-sizes")
    centres, books = train(rows, sizes, parts)
    return Index(sizes, centres, books, file_rows(rows, sizes, centres, books, probes))


def scores(v: np.ndarray, dot: np.ndarray, codes: np.ndarray, books: np.ndarray, batch: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """Approximate products of queries with members, some queries at a time: the product with the list's centre and, for each sub-space, the table's entry at the member's code."""
    parts, _, width = books.shape
    for lo in range(0, len(v), batch):
        q = v[lo : lo + batch]
        out = np.repeat(dot[lo : lo + batch, None], len(codes), axis=1)
        for s in range(parts):
            out += (q[:, s * width : (s + 1) * width] @ books[s].T)[:, codes[:, s]]
        yield lo, out


def visit(index: Index, queries: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """(reco, node, nbr, score): for each query and list the best `most` members above the query's bound. queries: reco, list, node, v, dot, bound."""
    kind, books = dict(index.rows.dtypes)["reco"], index.books
    key = ["reco", "list"]
    members = index.rows.select("reco", "list", "node", "code")
    tiles = members.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("mb")).join(queries.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("qb")), key)
    own = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(tiles, key).withColumn("m", own(11, "mb")).withColumn("q", every("qb")).select(*key, "m", "q", "node", "code")
    right = queries.join(tiles, key).withColumn("q", own(13, "qb")).withColumn("m", every("mb")).select(*key, "m", "q", "node", "v", "dot", "bound")
    right = right.toDF(*right.columns)  # both sides come from the index's rows
    empty = lambda t: pa.table({"reco": pa.array([], t.schema.field("reco").type), "node": pa.array([], pa.int64()), "nbr": pa.array([], pa.int64()), "score": pa.array([], pa.float32())})

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return empty(a if a.num_rows else b)
        a = a.sort_by("node")
        ids, nodes, bound = a.column("node").to_numpy(), b.column("node").to_numpy(), b.column("bound").to_numpy()
        codes = np.frombuffer(b"".join(a.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        out = []
        for lo, s in scores(matrix(b.column("v")), b.column("dot").to_numpy(), codes, books):
            of = nodes[lo : lo + len(s)]
            s[of[:, None] == ids[None, :]] = -np.inf
            s[s < bound[lo : lo + len(s), None]] = -np.inf
            best = np.argpartition(-s, most - 1, axis=1)[:, :most] if s.shape[1] > most else np.tile(np.arange(s.shape[1]), (len(s), 1))
            got = np.take_along_axis(s, best, 1)
            r, c = np.nonzero(got > -np.inf)
            out.append((of[r], ids[best[r, c]], got[r, c]))
        node, nbr, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"reco": pa.array(b.column("reco").slice(0, 1).to_pylist() * len(node), b.schema.field("reco").type), "node": node, "nbr": nbr, "score": score.astype(np.float32)})

    by = [*key, "m", "q"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, f"reco {kind}, node long, nbr long, score float")


def best_of(found: DataFrame, most: int) -> DataFrame:
    """(reco, node, best): the best `most` (score, nbr) of each node; a node has at most probes * most of them."""
    order = F.sort_array(F.collect_list(F.struct("score", "nbr")), asc=False)
    return found.groupBy("reco", "node").agg(F.slice(order, 1, most).alias("best"))


def candidates(index: Index, most: int, *, first: int = 8, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(reco, node, nbr): for each node its best `most` by code. The `first` nearest lists give a bound for the others."""
    probed = index.rows.select("reco", "node", "v", F.posexplode(F.slice("probes", 1, probes) if probes else F.col("probes")).alias("at", "p")).select("reco", F.col("p.list").alias("list"), "node", "v", F.col("p.dot").alias("dot"), "at")
    lowest = F.lit(float("-inf")).cast("float")
    near = stash(best_of(visit(index, probed.filter(F.col("at") < first).withColumn("bound", lowest), most, block), most), "ivf-near")
    bounds = near.select("reco", "node", F.when(F.size("best") == most, F.element_at("best", -1)["score"]).otherwise(lowest).alias("bound"))
    rest = probed.filter(F.col("at") >= first).join(bounds, ["reco", "node"], "left").withColumn("bound", F.coalesce("bound", lowest))
    more = visit(index, rest, most, block)
    both = near.select("reco", "node", F.explode("best").alias("b")).select("reco", "node", "b.nbr", "b.score").unionByName(more)
    return best_of(both, most).select("reco", "node", F.explode("best").alias("b")).select("reco", "node", "b.nbr")


def overlooked(x: DataFrame, ranked: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    """(node, nbr): pairs of a recording that are not ranked though no farther than the last of the node's k ranked neighbours, or any where it has fewer; of each tile the k nearest at most. Bounds
    come from what is ranked, so little is returned where that is nearly right; the pairs that are multiplied are all of a recording."""
    own = ranked.groupBy("node").agg(F.sort_array(F.collect_list("nbr")).alias("known"), F.max("dist").alias("bound"))
    own = own.withColumn("bound", F.when(F.size("known") >= k, F.col("bound")).otherwise(1.0))
    rows = x.filter("embedding is not null").join(own, "node", "left").withColumns({"bound": F.coalesce("bound", F.lit(1.0)), "known": F.coalesce("known", F.array().cast("array<long>"))})

    def fold(p: pa.Table, q: pa.Table, sim: np.ndarray, null: np.ndarray) -> dict:
        i, j = p.column("node").to_numpy(), q.column("node").to_numpy()
        known = p.column("known").combine_chunks()
        row, nbr = np.repeat(np.arange(len(i)), known.value_lengths().to_numpy()), known.flatten().to_numpy()
        at = np.searchsorted(j, nbr)
        here = at < len(j)
        here[here] = j[at[here]] == nbr[here]
        shut = null | (i[:, None] == j[None, :])
        shut[row[here], at[here]] = True
        dist = np.clip(1 - sim, 0.0, 1.0)
        shut |= dist > p.column("bound").to_numpy()[:, None] + 1.5e-6
        r, c = _nearest(np.where(shut, 3.0, dist), k)
        left = ~shut[r, c]
        return {"node": i[r[left]], "nbr": j[c[left]]}

    return cosine_tiles(rows, fold, "node long, nbr long", carry=("known", "bound"), tile=tile).select("node", "nbr")


def approximate_knn(x: DataFrame, k: int, *, probes: int = 128, parts: int = 32, refine: int = 2, block: int = BLOCK, index: Index | None = None, exact: bool = False) -> DataFrame:
    """(reco, node, rank, nbr, dist): rank 0 is the node itself at distance 0, then up to k - 1 neighbours of its recording by exact distance, clamped to [0, 1]. With exact, pairs that the lists missed are
    added, at the cost of all products of a recording."""
    index = index or build(x, probes=probes, parts=parts, block=block)
    found = stash(candidates(index, refine * max(1, k - 1), probes=probes, block=block), "ivf-candidates")
    ranked = rerank(found, x, k - 1)
    if exact and k > 1:
        ranked = stash(ranked, "ivf-ranked")
        both = ranked.select("node", "nbr", "dist").unionByName(rerank(overlooked(x, ranked, k - 1), x, k - 1).select("node", "nbr", "dist"))
        rank = (F.row_number().over(Window.partitionBy("node").orderBy("dist", "nbr")) - 1).cast("long")
        ranked = both.withColumn("rank", rank).filter(F.col("rank") < k - 1).select("node", "rank", "nbr", "dist")
    of = index.rows.select("reco", "node")
    others = of.join(ranked, "node").select("reco", "node", (F.col("rank") + 1).alias("rank"), "nbr", "dist")
    return of.select("reco", "node", F.lit(0).cast("long").alias("rank"), F.col("node").alias("nbr"), F.lit(0.0).alias("dist")).unionByName(others)


def probes_for(x: DataFrame, index: Index, k: int, recall: float = 0.95, queries: int = 256, block: int = BLOCK) -> int:
    """The least number of probes with which the lists visited hold that share of the true neighbours of about `queries` drawn nodes, each compared with all rows of its recording in blocks. If
    the index's probes are too few, one more than it has: the index is to be built with more."""
    kind = dict(index.rows.dtypes)["reco"]
    total = index.sizes.agg(F.sum("n")).first()[0] or 1
    asked = stash(index.rows.filter(_drawn(17) < queries / total).select("reco", "node", "v", F.col("probes.list").alias("lists")), "ivf-asked")
    sent = asked.join(index.sizes.select("reco", "blocks"), "reco").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("reco", "block", "node", "v").toDF("reco", "block", "node", "v")
    dealt = index.rows.join(index.sizes.select("reco", "blocks"), "reco").select("reco", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int").alias("block"), "node", "list", "v")

    def exact(a: pa.Table, q: pa.Table) -> pa.Table:
        of = (a if a.num_rows else q).schema.field("reco").type
        if not a.num_rows or not q.num_rows:
            return pa.table({"reco": pa.array([], of), "node": pa.array([], pa.int64()), "nbr": pa.array([], pa.int64()), "list": pa.array([], pa.int32()), "score": pa.array([], pa.float32())})
        ids, nodes, own = a.column("node").to_numpy(), q.column("node").to_numpy(), a.column("list").to_numpy()
        s = matrix(q.column("v")) @ matrix(a.column("v")).T
        s[nodes[:, None] == ids[None, :]] = -np.inf
        best = np.argsort(-s, axis=1)[:, : k - 1]
        r, c = np.nonzero(np.take_along_axis(s, best, 1) > -np.inf)
        at = best[r, c]
        return pa.table({"reco": pa.array(q.column("reco").slice(0, 1).to_pylist() * len(r), of), "node": nodes[r], "nbr": ids[at], "list": own[at].astype(np.int32), "score": s[r, at].astype(np.float32)})

    met = dealt.groupBy("reco", "block").cogroup(sent.groupBy("reco", "block")).applyInArrow(exact, f"reco {kind}, node long, nbr long, list int, score float")
    order = F.sort_array(F.collect_list(F.struct("score", "nbr", "list")), asc=False)
    true = met.groupBy("reco", "node").agg(F.slice(order, 1, k - 1).alias("best")).select("reco", "node", F.explode("best").alias("b"))
    at = F.array_position("lists", F.col("b.list"))
    seen = true.join(asked.select("reco", "node", "lists"), ["reco", "node"]).groupBy(at.alias("at")).count().collect()  # one row for each number of probes
    want, held, all_ = recall * sum(r["count"] for r in seen), 0, max((r["at"] for r in seen), default=0)
    for r in sorted((r for r in seen if r["at"]), key=lambda r: r["at"]):
        held += r["count"]
        if held >= want:
            return int(r["at"])
    return int(all_) + 1
