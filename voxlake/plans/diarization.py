"""From embeddings to an error rate: neighbour graph, densities, forest, levels, turns, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.fixtures import view
from voxlake.operators import graph as G
from voxlake.operators import intervals as I
from voxlake.operators import metrics as M
from voxlake.operators.edge_model import EdgeModel, fit_edge_model, node_rows, predicted_density
from voxlake.operators.graph import predicted_clusters
from voxlake.session import stash


def cluster_levels(x: DataFrame, k: int = 10, tau: float = 0.0, levels: int = 15, model: EdgeModel | None = None, early_stop: bool = False) -> DataFrame:
    """(reco, node, cluster): densities are those of the labels, or predicted by an edge model, which reads no labels. Each level links the peaks of the one before; all recordings advance together, and those whose graph has become too
    small for k neighbours drop out, with early_stop also those whose level before has less than k - 1 times as many new links. One row per node is carried, whatever the level."""
    before = None
    own = stash(x.select("reco", "node", F.col("node").alias("cluster")), "levels")
    kept = ["reco", "node"] if model else ["reco", "node", "label"]
    level = x.select(*kept, F.col("embedding").cast("array<double>").alias("embedding"))
    for number in range(levels):
        sizes = level.groupBy("reco").agg(F.count("*").alias("n"))
        active = G.adaptive_k(sizes, k, must_run=number == 0).filter("k is not null").select("reco")
        level = stash(level.join(active, "reco", "left_semi"), "level")
        nbr = stash(G.knn(level, k), "level-knn")
        parents = stash(G.forest(G.decode(nbr, predicted_density(node_rows(nbr, level), model) if model else G.density(nbr, level, k), tau)), "level-forest")
        if not parents.limit(1).count():
            break
        rooted = G.roots(level, parents)
        own = stash(own.join(rooted.select(F.col("node").alias("cluster"), "root"), "cluster", "left").select("reco", "node", F.coalesce("root", "cluster").alias("cluster")), "levels")
        means = G.next_features(G.cluster_means(level, rooted)).withColumnRenamed("root", "node")
        level = level.drop("embedding").join(means, "node").select(*kept, "embedding")
        if early_stop:
            added = stash(parents.groupBy("reco").agg(F.count("*").alias("added")), "level-links")  # one row a recording
            if before is not None:
                go = added.join(before.withColumnRenamed("added", "before"), "reco").filter(F.col("before") / F.col("added") >= k - 1)
                level = level.join(go, "reco", "left_semi")
            before = added
    return own


def turns_of(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """Windows flattened at the middle of their overlaps, neighbours of one cluster merged. segments: (reco, seq, start_ms, end_ms)."""
    t = I.flatten_midpoint(segments, "reco", "seq").join(labels, ["reco", "seq"])
    t = t.select("reco", F.col("cluster").cast("string").alias("speaker_id"), F.col("flat_begin").cast("long").alias("onset_ms"), F.col("flat_end").cast("long").alias("offset_ms"))
    return I.merge_labels(t, "reco", "speaker_id", "onset_ms", "offset_ms").withColumnRenamed("reco", "file_id")


def error_rates(ref: DataFrame, sys: DataFrame, uem: DataFrame | None = None) -> DataFrame:
    uem = I.extent(ref, sys, keys=["file_id"]) if uem is None else uem
    ref, sys = (I.merge(I.clip(t, uem, ["file_id"]), ["file_id", "speaker_id"]) for t in (ref, sys))
    mapped = M.best_mapping(M.overlap_matrix(ref, sys, ["file_id"]), "file_id", "ms").groupBy("file_id").agg(F.sum("ms").alias("ms"))
    return M.der(I.atoms({"ref": ref, "sys": sys}, uem, ["file_id"]), mapped, uem)


def cluster(x: DataFrame, model: EdgeModel, most: int = G.KERNEL_NODES) -> DataFrame:
    """(reco, node, cluster) by a model: recordings of up to `most` nodes one task each, larger ones by tables, with the same result."""
    sizes = x.groupBy("reco").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > most).select("reco")
    if not large.limit(1).count():
        return predicted_clusters(x, model=model)
    few = predicted_clusters(x.join(large, "reco", "left_anti"), model=model)
    return few.unionByName(cluster_levels(x.join(large, "reco", "left_semi"), model=model).select("reco", "node", F.col("cluster").cast("long").alias("cluster")))


def diarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate per recording of the embeddings table. An edge model is learnt from the labels of every second recording (by number); all are clustered by it without labels, which then score them."""
    x = view(spark, sf_dir, "xvec")
    segments = view(spark, sf_dir, "segments")
    taught = x.filter(F.substring("reco", 4, 9).cast("int") % 2 == 0)
    found = cluster(x, fit_edge_model(taught, epochs=8))
    where = x.select("node", "seq")
    sys = turns_of(segments, found.join(where, "node").select("reco", "seq", "cluster"))
    ref = turns_of(segments, x.select("reco", "seq", F.col("label").alias("cluster")))
    return error_rates(ref, sys)
