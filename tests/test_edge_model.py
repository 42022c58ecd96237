import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import edge_model as E
from voxlake.operators import graph as G
from voxlake.plans.diarization import cluster, cluster_levels


def vectors(spark, n=160, labels=6, dims=8, spread=0.8, seed=3):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, labels, n)
    v = rng.standard_normal((labels, dims))[label] + spread * rng.standard_normal((n, dims))
    rows = [(f"rec{i % 2}", i, int(label[i]), [float(a) for a in v[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "reco string, node long, label int, embedding array<double>").repartition(3)


@pytest.mark.parametrize("beta", [0.0, 0.3, 1.0])
def test_gradient_equals_differences(beta):
    rng = np.random.default_rng(1)
    model = E.EdgeModel(3, 5, 4)
    n, node = 6, np.array([0, 0, 1, 2, 2, 2, 5])
    f, fs, sim = rng.standard_normal((n, 6)), rng.standard_normal((7, 6)), rng.standard_normal(7)
    same, weight, density = rng.random(7) < 0.5, rng.random(7), rng.standard_normal(n)
    loss = lambda w: model.with_weights(w).gradient(f, fs, node, sim, same, weight, density, beta)[0]
    start = model.flat + 0.1 * rng.standard_normal(model.flat.size)
    got = model.with_weights(start).gradient(f, fs, node, sim, same, weight, density, beta)[1:]
    for i in range(0, len(start), 3):
        e = np.zeros_like(start)
        e[i] = 1e-6
        assert abs((loss(start + e) - loss(start - e)) / 2e-6 - got[i]) < 1e-4


def test_rows_equal_dense(spark):
    x = vectors(spark)
    data = {r["node"]: r for r in x.collect()}
    nbr = {}
    for r in G.knn(x, 5).collect():
        if r["rank"]:
            nbr.setdefault(r["node"], {})[r["rank"]] = (r["nbr"], 1 - r["dist"])
    unit = {n: np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) for n, r in data.items()}
    weigh = {n: [max(0.0, e[k][1]) for k in sorted(e)] for n, e in nbr.items()}
    feat = {n: np.concatenate([unit[n], sum(w * unit[e[k][0]] for w, k in zip(weigh[n], sorted(e), strict=True)) / (sum(weigh[n]) or 1.0)]) for n, e in nbr.items()}
    for r in E.training_rows(x, 5).collect():
        e = nbr[r["node"]]
        assert np.allclose(r["f"], feat[r["node"]]) and np.allclose(np.reshape(r["fs"], (4, -1)), [feat[e[k][0]] for k in sorted(e)]) and np.allclose(r["sim"], [e[k][1] for k in sorted(e)])
        assert r["same"] == [data[e[k][0]]["label"] == data[r["node"]]["label"] for k in sorted(e)]


def test_training_learns_and_resumes_bit_for_bit(spark, tmp_path):
    x = vectors(spark)
    rows = E.training_rows(x, 6)
    whole = E.fit(rows, 8, epochs=8, batches=2)
    path = "file://" + str(tmp_path / "state")
    E.fit(rows, 8, epochs=8, batches=2, state=path, until=5)
    assert E.load_state(spark, path).epoch == 5
    again = E.fit(rows, 8, epochs=8, batches=2, state=path)
    assert (again.weights == whole.weights).all() and (again.average == whole.average).all() and again.counted == 2
    assert E.load_state(spark, path, 3).epoch == 3 and E.load_state(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        E.fit(rows, 8, hidden=4, state=path)
    model = E.EdgeModel(8, flat=E.fit(rows, 8, epochs=40).average)
    p, same = [], []
    for r in rows.collect():
        k = len(r["sim"])
        s = model.states(np.reshape(r["fs"], (k, -1)))
        p += model.probability(s, np.repeat(model.states(np.array([r["f"]])), k, 0), np.array(r["sim"])).tolist()
        same += r["same"]
    p, same = np.array(p), np.array(same)
    assert p[same].mean() > p[~same].mean() + 0.25


def test_tables_and_one_task_give_the_same_clusters(spark):
    x = vectors(spark, spread=0.5)
    model = E.fit_edge_model(x, 8, epochs=6)
    plain = lambda t: sorted((r["reco"], r["node"], r["cluster"]) for r in t.collect())
    one = plain(G.predicted_clusters(x.drop("label"), model=model))
    assert one == plain(cluster_levels(x.drop("label"), model=model)) and len({c for _, _, c in one}) < 100
    both = x.unionByName(vectors(spark, 40, seed=5).select(F.lit("big").alias("reco"), (F.col("node") + 1000).alias("node"), "label", "embedding"))
    assert plain(cluster(both, model, most=60)) == plain(G.predicted_clusters(both, model=model))


def test_levels_stop_early(spark):
    """The recordings' levels end at the second, whose links are more than a (k - 1)th of the first's, or later; tables and tasks agree."""
    x = vectors(spark, 300, labels=12, spread=0.6)
    model = E.fit_edge_model(x, 8, epochs=4)
    plain = lambda t: sorted((r["reco"], r["node"], r["cluster"]) for r in t.collect())
    early = plain(G.predicted_clusters(x, k=4, model=model, early_stop=True))
    assert early == plain(cluster_levels(x, k=4, model=model, early_stop=True))
    two = plain(G.predicted_clusters(x, k=4, model=model, levels=2))
    first = plain(G.predicted_clusters(x, k=4, model=model, levels=1))
    count = lambda t, reco: len({c for r, _, c in t if r == reco})
    for reco in ("rec0", "rec1"):
        n = sum(r == reco for r, _, _ in first)
        links = n - count(first, reco), count(first, reco) - count(two, reco)
        if links[1] and links[0] / links[1] < 3:
            assert [r for r in early if r[0] == reco] == [r for r in two if r[0] == reco]
        else:
            assert count(early, reco) <= count(two, reco)


def test_no_rows(spark):
    x = vectors(spark).limit(0)
    with pytest.raises(ValueError):
        E.fit_edge_model(x)
    assert G.predicted_clusters(x, model=E.EdgeModel(8)).count() == 0
