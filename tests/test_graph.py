import numpy as np
from pyspark.sql import functions as F

from voxlake.operators import graph as G
from voxlake.operators.components import connected_components


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(2)
    names = rng.permutation(400).tolist()
    edges = [(names[i], names[i + 1]) for i in range(199)] + [(names[200], names[i]) for i in range(201, 300)] + [(names[0], names[0])]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[n] for n in names[:200]} == {min(names[:200])} and {got[n] for n in names[200:300]} == {min(names[200:300])}
    assert len(got) == 300


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_roots_follow_parents(spark):
    nodes = spark.range(20).withColumnRenamed("id", "node")
    parents = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(15, 12)], "node long, parent long")
    got = {r["node"]: r["root"] for r in G.roots(nodes, parents).collect()}
    assert all(got[i] == 9 for i in range(10)) and got[15] == 12 and got[19] == 19


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((40, 8))
    x = spark.createDataFrame([("r", i, [float(a) for a in v[i]]) for i in range(40)], "reco string, node long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in G.knn(x, 5, block=7).collect():
        got.setdefault(r["node"], []).append((r["rank"], r["nbr"]))
    for i in range(40):
        d = np.round(1 - u @ u[i], 6)
        d[i] = 0
        assert [n for _, n in sorted(got[i])] == np.argsort(d, kind="stable")[:5].tolist()


def test_agglomeration_joins_copies(spark):
    x = spark.createDataFrame([("r", 0, [1.0, 0.0]), ("r", 1, [0.99, 0.01]), ("r", 2, [0.0, 1.0])], "reco string, node long, embedding array<double>")
    assert {r["node"]: r["cluster"] for r in G.agglomerate(x, 0.9).collect()} == {0: 0, 1: 0, 2: 2}


def vectors(spark, n=240, seed=2, spread=0.35):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((8, 16))
    label = rng.integers(0, 8, n)
    v = centre[label] + spread * rng.standard_normal((n, 16))
    rows = [(f"r{i % 2}", i, int(label[i]), [float(x) for x in v[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "reco string, node long, label int, embedding array<double>")


def test_predicted_clusters_follow_the_levels(spark):
    """The kernel of one recording against the same steps on tables."""
    from pyspark.sql import functions as F

    x = vectors(spark)
    got = {r["node"]: r["cluster"] for r in G.predicted_clusters(x.drop("label"), k=8, slope=10.0, bias=-6.0, levels=3).collect()}
    own, level = {i: i for i in got}, x.select("reco", "node", "embedding")
    for number in range(3):
        sizes = level.groupBy("reco").agg(F.count("*").alias("n"))
        ks = {r["reco"]: r["k"] for r in G.adaptive_k(sizes, 8, must_run=number == 0).collect() if r["k"]}
        parts = [(G.knn(level.filter(F.col("reco") == r), k), k) for r, k in ks.items()]
        if not parts:
            break
        up = {}
        for nbr, _ in parts:
            sim = 1 - F.col("dist")
            den = nbr.filter("rank > 0").groupBy("node").agg(F.round(F.avg(sim * (2 / (1 + F.exp(-(10.0 * sim - 6.0))) - 1)), 6).alias("density"))
            up |= {r["node"]: r["parent"] for r in G.forest(G.decode(nbr, den, 0.0)).collect()}
        if not up:
            break

        def root(i):
            while i in up:
                i = up[i]
            return i

        own = {i: root(c) for i, c in own.items()}
        rooted = spark.createDataFrame([(r["node"], root(r["node"])) for r in level.select("node").collect()], "node long, root long")
        means = G.next_features(G.cluster_means(level, rooted)).withColumnRenamed("root", "node")
        level = level.select("reco", "node").join(means, "node")
    assert own == got and 2 <= len(set(got.values())) < 60


def test_edge_model_against_arrays(spark):
    from voxlake.operators import kernels as N

    rng = np.random.default_rng(4)
    a = rng.standard_normal((300, 2))
    y = a @ [1.5, -2.0] + 0.3 > rng.standard_normal(300)
    w, v, seen = np.zeros(3), np.zeros(3), []
    b = np.column_stack([a, np.ones(300)])
    for e in range(12):
        v = 0.9 * v - 0.5 * (1 + np.cos(np.pi * e / 12)) * b.T @ (1 / (1 + np.exp(-b @ w)) - y) / 300
        w = w + v
        seen.append(w)
    rows = spark.createDataFrame([(float(p), float(q), bool(t)) for (p, q), t in zip(a, y, strict=True)], "p double, q double, same boolean")
    last, mean = N.fit_logistic(rows, ["p", "q"], "same", epochs=12, average_from=8)
    assert np.allclose(last, w) and np.allclose(mean, np.mean(seen[8:], axis=0))


def test_pairs_of_tiles_are_all_pairs(spark):
    rng = np.random.default_rng(5)
    v = [[float(a) for a in r] for r in rng.standard_normal((37, 6))]
    v[3], v[4], v[5] = None, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0]
    x = spark.createDataFrame([(f"r{i % 2}", i, i // 6, v[i]) for i in range(37)], "reco string, node long, place long, embedding array<double>")
    known = [i for i in range(37) if i not in (3, 4, 5)]
    u = {i: np.array(v[i]) / np.linalg.norm(v[i]) for i in known}
    sim = {(i, j): round(float(u[i] @ u[j]), 6) if i in u and j in u else None for i in range(37) for j in range(37) if i % 2 == j % 2}
    got = [((r["i"], r["j"]), r["sim"], r["place_i"], r["place_j"]) for r in G.cosine_pairs(x, carry=("place",), tile=4).collect()]
    assert len(got) == len(sim) and {p: s for p, s, *_ in got} == sim and all((a, b) == (i // 6, j // 6) for (i, j), _, a, b in got)
    above = {(r["i"], r["j"]) for r in G.cosine_pairs(x, above=0.3, tile=4).collect()}
    assert above == {(i, j) for (i, j), s in sim.items() if i < j and s is not None and s > 0.3}
    for r in G.cosine_extremes(x, tile=4).collect():
        own = [s for (i, _), s in sim.items() if f"r{i % 2}" == r["reco"] and s is not None]
        assert (r["lo"], r["hi"]) == (min(own), max(own))
    cells = {}
    for (i, j), s in sim.items():
        key = (f"r{i % 2}", i // 6, j // 6)
        total, n = cells.get(key, (None, 0))
        cells[key] = (total if s is None else (total or 0) + round(s * 1e6), n + 1)
    assert {(r["reco"], r["a"], r["b"]): (r["micro_sum"], r["n"]) for r in G.halve_affinity(x, "place", tile=4).collect()} == cells
    near = {}
    for r in G.nearest_pairs(x, 4, tile=4).collect():
        near.setdefault(r["node"], {})[r["rank"]] = (r["nbr"], r["dist"])
    for i in range(37):
        dist = {j: 0.0 if i == j else None if s is None else round(1 - s, 6) for (a, j), s in sim.items() if a == i}
        order = sorted(dist, key=lambda j: (dist[j] is None, dist[j] or 0.0, j))[:4]
        assert [near[i][k] for k in range(4)] == [(j, dist[j]) for j in order]


def test_average_linkage_is_that_of_the_matrix_of_pairs():
    rng = np.random.default_rng(9)
    for n in (1, 2, 30, 61):
        v = rng.standard_normal((n, 4))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        for threshold in (0.1, 0.5, 0.9):
            clusters = [[i] for i in range(n)]
            while len(clusters) > 1:
                best, i, j = max((np.mean(v[a] @ v[b].T), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
                if best < threshold:
                    break
                clusters[i] += clusters.pop(j)
            want = {i: min(c) for c in clusters for i in c}
            assert dict(enumerate(G.average_linkage(v, threshold).tolist())) == want


def test_agglomeration_of_many_nodes_holds_no_matrix_of_pairs(monkeypatch):
    rng = np.random.default_rng(10)
    v = np.repeat(np.eye(6), 2000, axis=0) + 0.01 * rng.standard_normal((12_000, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    import tracemalloc

    tracemalloc.start()
    own = G.join_small(v, G.average_linkage(v, 0.9), 3)
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
    assert own.tolist() == np.repeat(np.arange(6) * 2000, 2000).tolist()


def test_neighbours_of_many_nodes_are_found_in_small_blocks():
    import tracemalloc

    u = np.random.default_rng(11).standard_normal((40_000, 2))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    tracemalloc.start()
    lo, near, far = next(G._neighbours(u, 5))
    assert tracemalloc.get_traced_memory()[1] < 300e6 and near[0, 0] == 0 and far[0, 0] == 0
    tracemalloc.stop()


def test_normalising_takes_the_length_once_a_vector(spark):
    """A length taken for each component is quadratic in the dimensions: 4e8 steps here."""
    import time

    x = spark.createDataFrame([([3.0] + [0.0] * 20_000 + [4.0],), ([0.0, 0.0],), (None,)], "v array<double>").coalesce(1)
    began = time.monotonic()
    got = [r["u"] for r in x.select(G.l2_normalize(F.col("v")).alias("u")).collect()]
    assert time.monotonic() - began < 8 and (got[0][0], got[0][1], got[0][-1]) == (0.6, 0.0, 0.8) and got[1:] == [[None, None], None]


def test_neighbours_by_the_bound_are_those_of_all_columns(monkeypatch):
    rng = np.random.default_rng(12)
    for dims, copies in ((16, 1), (2, 30)):
        u = np.repeat(rng.standard_normal((1500 // copies, dims)), copies, axis=0)[rng.permutation(1500)]
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        u[7] = 0.0
        calls = []
        monkeypatch.setattr(G, "_nearest", lambda *a, f=G._nearest: calls.append(1) or f(*a))
        few = list(G._neighbours(u, 7))
        assert not calls
        monkeypatch.undo()
        monkeypatch.setattr(G, "PART", 10_000)
        every = list(G._neighbours(u, 7))
        monkeypatch.undo()
        assert all(a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(few, every, strict=True))


def test_training_levels_search_once_a_level(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = spark.createDataFrame([("r", i, i % 3, rng.standard_normal(4).tolist()) for i in range(60)], "reco string, node long, label long, embedding array<double>")
    calls = []
    monkeypatch.setattr(G, "knn", lambda t, k, f=G.knn: calls.append(k) or f(t, k))
    got = G.training_levels(x, (3, 5), levels=2)
    assert calls == [5, 5]
    monkeypatch.undo()
    first = {(r["k"], r["src"], r["dst"]) for r in got.filter("level = 0").collect()}
    assert first == {(k, r["nbr"], r["node"]) for k in (3, 5) for r in G.knn(x, k).collect() if r["node"] != r["nbr"] and r["dist"] <= 1}


def test_rows_are_copied_once_for_many_tiles(spark, monkeypatch):
    """100 rows in 25 tiles: a side is dealt to four tasks, so a row is copied four times a side and not twenty-five times; all pairs are there."""
    from pyspark.sql import GroupedData

    copies, apply = [], GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, *a: copies.append(self._df.count()) or apply(self, *a))
    rng = np.random.default_rng(6)
    x = spark.createDataFrame([("r", i, [float(a) for a in rng.standard_normal(3)]) for i in range(100)], "reco string, node long, embedding array<double>")
    got = G.cosine_pairs(x, tile=4)
    assert copies == [800] and got.select("i", "j").distinct().count() == got.count() == 10_000


def test_pairs_of_a_label_meet_in_tiles_once(spark):
    rows = [("r" if i % 5 else "s", i, [i % 2, 1] if i % 3 else [i % 2] if i % 7 else [None, 2]) for i in range(120)]
    x = spark.createDataFrame(rows, "reco string, node long, labels array<int>")
    pairs = G.label_pairs(x, tile=8)
    got = sorted(tuple(r) for r in pairs.collect())
    held = lambda labels: {v for v in labels if v is not None}
    assert got == sorted((i, j) for a, i, p in rows for b, j, q in rows if a == b and i < j and held(p) & held(q))
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
