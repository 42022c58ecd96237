import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import graph as G
from voxlake.operators import neighbours as A


def low_dimensional(n, rng, latent=5, dims=64):
    """Vectors near a surface of few dimensions, as those of voices are."""
    return rng.standard_normal((n, latent)) @ rng.standard_normal((latent, dims)) + 0.05 * rng.standard_normal((n, dims))


def frame(spark, recordings):
    rows = [(r, 100_000 * k + i, [float(a) for a in v]) for k, (r, m) in enumerate(recordings.items()) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "reco string, node long, embedding array<float>").repartition(4)


def exact(recordings, k):
    out = {}
    for r, (name, v) in enumerate(recordings.items()):
        u = v.astype(np.float32).astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        d = 1 - u @ u.T
        np.fill_diagonal(d, -1)
        for i, row in enumerate(np.argsort(d, axis=1)[:, :k]):
            out[100_000 * r + i] = {100_000 * r + int(j) for j in row}
    return out


def test_recall_with_few_probes(spark):
    """Probes are under a quarter of the lists of each recording, and tiles smaller than its largest list."""
    rng = np.random.default_rng(4)
    recordings = {"a": low_dimensional(3000, rng), "b": low_dimensional(900, rng)}
    k, probes = 10, 40
    x = frame(spark, recordings)
    index = A.build(x, probes=probes, block=1000)
    lists = {r["reco"]: r["lists"] for r in index.sizes.collect()}
    assert all(4 * probes < n for n in lists.values()) and lists["a"] == 750
    got = A.approximate_knn(x, k, probes=probes, block=7, index=index).collect()
    want, found = exact(recordings, k), {}
    for r in got:
        found.setdefault(r["node"], {})[r["rank"]] = (r["nbr"], r["dist"])
    assert len(found) == 3900 and all(f[0] == (n, 0.0) and sorted(f) == list(range(len(f))) for n, f in found.items())
    recall = np.mean([len({b for b, _ in f.values()} & want[n]) / k for n, f in found.items()])
    assert recall >= 0.9
    assert all(f[i][1] <= f[i + 1][1] for f in found.values() for i in range(1, len(f) - 1))
    need = A.probes_for(x, index, k, recall=0.9, block=1000)
    assert 1 <= need <= probes


def test_codes_are_close(spark):
    rng = np.random.default_rng(5)
    x = frame(spark, {"a": low_dimensional(800, rng)})
    index = A.build(x, probes=8)
    v = A.matrix(index.rows.select("v").toArrow().column("v"))
    t = index.rows.select("list", "code").toArrow()
    centres = {r["list"]: np.array(r["centre"]) for r in index.centres.collect()}
    codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(t), -1)
    back = np.stack([centres[i] for i in t.column("list").to_pylist()]) + np.concatenate([index.books[s][codes[:, s]] for s in range(len(index.books))], 1)
    assert np.linalg.norm(v - back, axis=1).mean() < 0.1
    dot = np.einsum("ij,ij->i", v, np.stack([centres[i] for i in t.column("list").to_pylist()])).astype(np.float32)
    for lo, s in A.scores(v[:50], dot[:50], codes[:1], index.books):
        assert np.allclose(s[0, 0] - dot[lo] + v[lo] @ centres[t.column("list")[0].as_py()], v[lo] @ back[0], atol=1e-4)


@pytest.mark.parametrize("n", [1, 30])
def test_all_lists_probed_is_exact(spark, n):
    """Small recordings, equal vectors, a recording of one and rows without a vector."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((n, 8))
    v[n // 2 :: 3] = v[0]
    x = frame(spark, {"a": v, "b": rng.standard_normal((5, 8))}).unionByName(spark.createDataFrame([("a", -1, None)], "reco string, node long, embedding array<float>"))
    got = A.approximate_knn(x, 4, parts=4, refine=10, block=3)
    want = G.knn(x.filter("embedding is not null"), 4).withColumn("dist", F.least("dist", F.lit(1.0)))
    plain = lambda t: sorted((r["node"], r["rank"], round(r["dist"], 5)) for r in t.collect())
    assert plain(got) == plain(want)


def test_exact_check_finds_what_lists_overlook(spark):
    """One list of many is probed on vectors without structure, with equal vectors and a row without one."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((400, 16))
    v[7::50] = v[7]
    x = frame(spark, {"a": v, "b": rng.standard_normal((5, 16))}).unionByName(spark.createDataFrame([("a", -1, None)], "reco string, node long, embedding array<float>"))
    plain = lambda t: sorted((r["node"], r["nbr"], round(r["dist"], 5)) for r in t.collect())
    want = plain(G.knn(x.filter("embedding is not null"), 10).withColumn("dist", F.least("dist", F.lit(1.0))).filter("reco = 'a'"))
    found = lambda **how: plain(A.approximate_knn(x, 10, probes=1, parts=4, refine=1, **how).filter("reco = 'a'"))
    assert found() != want
    assert found(exact=True) == want


def test_empty(spark):
    x = spark.createDataFrame([], "reco string, node long, embedding array<float>")
    assert A.approximate_knn(x, 4, parts=4).count() == 0
