"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents with the same set of shingles (SHINGLE words; a shorter text is one shingle of all its words) are one class with a count, so
exact copies never meet each other. Each class has ``trees`` signatures of ``depth`` MinHash values, its paths in as many prefix tries. Tries are sorted lists: the paths of a tree, dealt by
their first LEAST values and sorted, where neighbours' common prefixes tell the nodes.

Matching starts at whole paths and shortens the prefix by one value a round, so a round compares only classes that part at this node. After each round the recall so far is measured on the
links found: a link whose values agree in a share s is found in some tree at prefix k with chance 1 - (1 - s**k)**trees, and stands for as many links as the inverse. Rounds stop when the
links found are the target share of those that they stand for, or at LEAST values (where a pair at the threshold is found with chance 0.99999). Inside a node a pair is dropped only if the agreement of all
their MinHash values is more than five standard deviations below the threshold. Surviving pairs give candidate groups (connected components), and inside
those every pair is verified exactly on its shingle sets.

Nodes and candidate groups of more than TILE members meet in tiles, two chunks at a time, and a tile returns counts and a spanning
forest only, never its pairs. Classes are known by a 64-bit hash of their shingles.

Defined results: null or wordless texts link with nothing; a null id links with nothing and has no class; rows that repeat an id are
separate copies; ties go to the smaller id; a very long text is one set of shingles, held by one task at a time; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from voxlake.llm import bloom
from voxlake.llm.tiles import deal_tiles, forest, groups, longs
from voxlake.operators.components import connected_components
from voxlake.session import stash, text_batches

SHINGLE, THRESHOLD, RECALL, TREES, DEPTH, LEAST, NODE_TILE, TILE = 5, 0.8, 0.9999, 16, 6, 3, 8192, 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def shingles(text: str | None, known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    own = min(size, n)
    out = h[: n - own + 1].copy()
    for k in range(1, own):
        out = mixed(out * _ODD + h[k : n - own + 1 + k])
    return np.unique(out + np.uint64(own))


def class_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(low), 1024):
        part = low[lo : lo + 1024, None] * a
        part += b
        np.minimum(out, part.min(axis=0), out=out)
    return out


def sketch(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """doc_id, class (16 bytes; null without words or id), sig (trees * depth values of 4 bytes)."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 32, (2, trees * depth), dtype=np.uint64).astype(np.uint32)
    a |= np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                part = whole.slice(lo, 2000)
                keys, sigs = [], []
                for x, i in zip(part.column("text"), part.column("doc_id").is_valid().to_pylist(), strict=True):
                    s = shingles(x.as_py(), known) if i else ()
                    keys.append(class_of(s) if len(s) else None)
                    sigs.append(signature(s, a, b).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "class", "sig"])

    return docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text")).mapInArrow(run, "doc_id long, class binary, sig binary")


def tree_paths(trees: int, depth: int) -> object:
    """(id, sig) to (tree, path, id): the low 16 bits of a tree's values, big end first, so that bytes sort as values do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(-1, trees, depth).astype(">u2")
            ids = b.column("id").to_numpy()
            for t in range(trees):
                flat = pa.py_buffer(np.ascontiguousarray(sig[:, t]).tobytes())
                path = pa.Array.from_buffers(pa.binary(2 * depth), len(ids), [None, flat]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int16)), path, pa.array(ids)], ["tree", "path", "id"])

    return run


def trie_nodes(depth: int, least: int) -> object:
    """Sorted (tree, path, id) to (depth, node, child, id): members of nodes that have more than one, at every depth from least on. child tells the members of a node apart by their next value.
    Only the row before is remembered, however many members a node has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple | None = None  # the last row, whose common prefix with the next is not known yet
        shared = 0  # values that the first row at hand has in common with the row before it

        def emit(tree: np.ndarray, path: np.ndarray, ids: np.ndarray, common: np.ndarray) -> Iterator[pa.RecordBatch]:
            """common[i]: of rows i - 1 and i; one more than rows."""
            h = tree.astype(np.uint64) + np.uint64(1)
            prefix = []
            for k in range(depth):
                h = mixed(h * _ODD + path[:, k].astype(np.uint64) + np.uint64(1))
                prefix.append(h.view(np.int64))
            most = np.maximum(common[:-1], common[1:])
            for k in range(least, depth + 1):
                i = np.flatnonzero(most >= k)
                if len(i):
                    child = prefix[k][i] if k < depth else ids[i]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int16)), pa.array(prefix[k - 1][i]), pa.array(child), pa.array(ids[i])], ["depth", "node", "child", "id"])

        for b in batches:
            if not b.num_rows:
                continue
            tree, ids = b.column("tree").to_numpy(), b.column("id").to_numpy()
            path = np.frombuffer(b"".join(b.column("path").to_pylist()), ">u2").reshape(-1, depth)
            if tail is not None:
                tree, path, ids = (np.concatenate([x, y]) for x, y in zip(tail, (tree, path, ids), strict=True))
            same = ((path[1:] == path[:-1]) & (tree[1:] == tree[:-1])[:, None]).cumprod(1).sum(1)
            if len(ids) > 1:
                yield from emit(tree[:-1], path[:-1], ids[:-1], np.concatenate([[shared], same]))
                shared = int(same[-1])
            tail = tree[-1:], path[-1:], ids[-1:]
        if tail is not None:
            yield from emit(*tail, np.array([shared, 0]))

    return run


def found_share(links: DataFrame, width: int, trees: int, prefix: int, threshold: float) -> float:
    """Links (agreeing values of width) over the links that they stand for at a prefix; of those at the threshold at least."""
    s = F.col("agree") / width
    chance = 1 - F.pow(1 - F.pow(s, prefix), trees)
    r = links.filter(s >= threshold).agg(F.count("*").alias("n"), F.sum(1 / chance).alias("all")).first()  # one row
    return r["n"] / r["all"] if r["n"] else 0.0


def node_links(least: int, width: int) -> object:
    """Tiles of trie nodes to links between candidates and the number of their agreeing values: each row is compared with the rows of other children that are not yet in its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for (_, u, v), t in groups(batches, ["node", "u", "v"]):
                ids, side, child = (t.column(c).to_numpy() for c in ("id", "side", "child"))
                sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, width)
                root = np.arange(len(ids))
                for x in range(len(ids)):
                    if u != v and side[x]:
                        continue
                    others = np.flatnonzero((root != root[x]) & (side == 1) & (child != child[x])) if u != v else x + 1 + np.flatnonzero((root[x + 1 :] != root[x]) & (child[x + 1 :] != child[x]))
                    for lo in range(0, len(others), 4096):
                        agree = (sig[others[lo : lo + 4096]] == sig[x]).sum(axis=-1)
                        for y, n in zip(others[lo : lo + 4096][agree >= least], agree[agree >= least], strict=True):
                            if root[y] != root[x]:
                                yield int(ids[x]), int(ids[y]), int(n)
                                old = root[y]
                                root[root == old] = root[x]

        return longs(out(), ["a", "b", "agree"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of the incidence matrix over values that more than one set holds."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    some = count[column] > 1
    owner, column = owner[some], shared[column[some]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, total, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((n, min(4096, total - lo)), np.float32)
        part[owner[i:j], column[i:j] - lo] = 1
        out += part @ part.T
    return out


def verify(threshold: float) -> object:
    """Tiles of candidate groups to (id, partners, other): counts, or links of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()

        def out() -> Iterator[tuple]:
            for (_, u, v), t in groups(batches, ["component", "u", "v"]):
                if t.num_rows < 2:
                    continue
                whole = {}  # a class whose first id is repeated brings other texts too
                for k, (i, x, c) in enumerate(zip(t.column("id").to_pylist(), t.column("text"), t.column("class").to_pylist(), strict=True)):
                    s = shingles(x.as_py(), known)
                    if class_of(s) == c:
                        whole.setdefault(i, (k, s))
                rows, sets = [k for k, _ in whole.values()], [s for _, s in whole.values()]
                if len(rows) < 2:
                    continue
                ids, own, side = (t.column(c).to_numpy()[rows] for c in ("id", "n", "side"))
                size = np.array([len(s) for s in sets], np.float64)
                both = intersections(sets)
                hit = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
                hit &= (side[:, None] == 0) & (side[None, :] == 1) if u != v else np.arange(len(ids))[:, None] < np.arange(len(ids))[None, :]
                i, j = np.nonzero(hit)
                count = np.zeros(len(ids), np.int64)
                np.add.at(count, i, own[j])
                np.add.at(count, j, own[i])
                root = forest(len(ids), i, j)
                for k in np.flatnonzero(count):
                    yield int(ids[k]), int(count[k]), None
                for k in np.flatnonzero(root != np.arange(len(ids))):
                    yield int(ids[k]), None, int(ids[root[k]])

        return longs(out(), ["id", "partners", "other"])

    return run


def jaccard_join(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, class_id (the least id that links reach), rep_id (the least id with the same shingles),
    n_copies (others with the same shingles), n_links (other documents of similarity >= threshold, copies included)."""
    return linked(docs, threshold, recall, trees, depth).drop("class", "first")


def forest_links(sigs: DataFrame, threshold: float, recall: float, trees: int, depth: int) -> DataFrame:
    """(a, b, agree) between candidates: links that connect what matches in the tries down to the prefix at which the target recall is measured."""
    width = trees * depth
    shortest = min(LEAST, depth)
    paths = sigs.mapInArrow(tree_paths(trees, depth), "tree short, path binary, id long")
    top = F.substring("path", 1, 2 * shortest)
    tries = paths.repartition("tree", top).sortWithinPartitions("tree", "path")
    nodes = stash(tries.mapInArrow(trie_nodes(depth, shortest), "depth short, node long, child long, id long"), "jaccard-nodes", by="depth")
    least = math.ceil(width * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / width)))
    low_bytes = F.concat(*[F.substring("sig", 4 * k + 1, 1) for k in range(width)])
    found = None
    for prefix in range(depth, shortest - 1, -1):
        here = nodes.filter(F.col("depth") == prefix)
        sizes = here.groupBy("node").agg(F.count("*").alias("n"), F.min("child").alias("x"), F.max("child").alias("y")).filter("n > 1 and x <> y")  # others have the members of their one child
        members = here.join(sizes.select("node", F.ceil(F.col("n") / NODE_TILE).alias("chunks")), "node").select("node", "child", "id", "chunks")
        few = sigs.join(members.select("id").distinct(), "id", "left_semi").select("id", low_bytes.alias("sig"))
        dealt = deal_tiles(members.join(few, "id"), ["node"], "chunks", "id", ["child", "sig"])
        links = stash(dealt.mapInArrow(node_links(least, width), "a long, b long, agree long"), "jaccard-matches")
        found = links if found is None else found.unionByName(links)
        if found_share(found, width, trees, prefix, threshold) >= recall:
            break
    return found


def linked(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """What jaccard_join gives, with the row's class (null without words or id) and whether it is its group's first: of the classes that have the least id, the least."""
    text_batches(docs.sparkSession)
    sketched = stash(sketch(docs, trees, depth), "jaccard-sketch")
    classes = sketched.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    classes = stash(classes.withColumn("id", F.xxhash64("class")), "jaccard-classes")
    first = sketched.join(classes.select("class", F.col("rep").alias("doc_id")), ["class", "doc_id"], "left_semi").dropDuplicates(["class"])
    sigs = stash(first.select(F.xxhash64("class").alias("id"), "sig"), "jaccard-signatures")

    candidates = stash(connected_components(forest_links(sigs, threshold, recall, trees, depth).select("a", "b")), "jaccard-candidates")

    sizes = candidates.groupBy("component").agg(F.ceil(F.count("*") / TILE).alias("chunks"))
    grouped = stash(candidates.withColumnRenamed("node", "id").join(sizes, "component").join(classes, "id"), "jaccard-candidates")
    texts = docs.select(F.col("`doc_id`").cast("long").alias("rep"), F.col("`text`").alias("text"))
    texts = bloom.keep(texts, "rep", bloom.build(grouped.select("rep")), inside=True).join(grouped, "rep")
    found = stash(deal_tiles(texts, ["component"], "chunks", "id", ["class", "n", "text"]).mapInArrow(verify(threshold), "id long, partners long, other long"), "jaccard-links")
    reach = connected_components(found.filter("other is not null"), "id", "other").withColumnRenamed("node", "id")
    partners = found.filter("partners is not null").groupBy("id").agg(F.sum("partners").alias("partners"))
    info = stash(classes.join(partners, "id", "left").join(reach, "id", "left").withColumn("component", F.coalesce("component", "id")), "jaccard-classes")
    names = info.groupBy("component").agg(F.min(F.struct("rep", "class")).alias("least")).select("component", F.col("least.rep").alias("class_id"), F.col("least.class").alias("least"))
    info = info.join(names, "component").select("class", F.col("rep").alias("rep_id"), (F.col("n") - 1).alias("n_copies"), (F.coalesce("partners", F.lit(0)) + F.col("n") - 1).alias("n_links"), "class_id", (F.col("class") == F.col("least")).alias("first"))
    zero = F.lit(0).cast("long")
    out = sketched.filter("class is not null").select("doc_id", "class").join(info, "class").select("doc_id", "class_id", "rep_id", "n_copies", "n_links", "class", "first")
    alone = sketched.filter("class is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), zero.alias("n_copies"), zero.alias("n_links"), "class", F.lit(True).alias("first"))
    return out.unionByName(alone)


def with_class(rows: DataFrame) -> DataFrame:
    """rows with __class, the class of the text (null without words)."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            sets = [shingles(x.as_py(), known) for x in b.column(names.index("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([class_of(s) if len(s) else None for s in sets], pa.binary())], [*names, "__class"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("__class", BinaryType())]))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs' rows (all columns), one row of each linked group: one with the least id. Rows without an id or without words stay, and so do
    rows of one id that are not linked: where an id is repeated, each row is decided by the class of its own text."""
    found = linked(docs, **options).filter("doc_id is not null").withColumn("__stays", F.col("first") & (F.col("doc_id") == F.col("class_id")))
    kept = found.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n"), F.max(F.col("__stays").cast("int")).alias("__kept"))
    kept = stash(kept, "jaccard-kept")
    out = bloom.anti_join(docs, "doc_id", kept.filter("__kept = 0").select("__id"))
    repeated = kept.filter("__kept = 1 and __n > 1").select("__id")
    if not repeated.limit(1).count():
        return out
    packed = bloom.build(repeated)  # ids that it only seems to hold pass as well: their one row is of a class that stays
    unsure = stash(with_class(bloom.keep(out, "doc_id", packed, inside=True)), "jaccard-repeated")
    stays = bloom.keep(found.filter("__stays and class is not null").select("doc_id", "class"), "doc_id", packed, inside=True).distinct().toDF("__id", "__of")
    own = unsure.filter("__class is not null").join(stays, (F.col("`doc_id`").cast("long") == F.col("__id")) & (F.col("__class") == F.col("__of")), "left_semi").dropDuplicates(["doc_id", "__class"])
    wordless = unsure.filter("__class is null")
    return bloom.keep(out, "doc_id", packed, inside=False).unionByName(own.drop("__class")).unionByName(wordless.drop("__class"))
