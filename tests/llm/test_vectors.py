import numpy as np

from voxlake.llm import vectors

KIND = "vec_id long, embedding array<float>, label int, bucket string, x int"


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(25):
        base = rng.standard_normal(64)
        for _ in range(rng.integers(1, 20)):
            rows.append((base + rng.standard_normal(64) * rng.choice([0, 0.2, 0.28, 0.33]), g % 3))
    base = rng.standard_normal(64)
    rows += [(base + rng.standard_normal(64) * 0.22 * (k % 3 > 0), 1) for k in range(200)]
    rows = [(i, [float(np.float32(a)) for a in v], label) for i, (v, label) in enumerate(rows)]
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [float("nan")] + [1.0] * 63, 1), (n + 3, rows[0][1], None), (n + 4, [None] + [1.0] * 63, 1), (n + 5, [1.0, 2.0], 1), (n + 6, [2.0, 4.0], 1), (None, rows[0][1], 0), (n + 7, [float("inf")] * 64, 1)]
    df = spark.createDataFrame([(*r, "b", 7) for r in rows + odd], KIND)
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, tile=64).collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    hit = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    assert sum(got[i]["n_links"] for i in range(n)) == hit.sum() and all(got[i]["n_links"] == hit[i].sum() for i in range(n))
    reach = hit | np.eye(n, dtype=bool)
    for _ in range(8):
        reach = (reach.astype(np.float32) @ reach.astype(np.float32)) > 0
    assert all(got[i]["component_id"] == int(np.argmax(reach[i])) and got[i]["kept"] == (got[i]["component_id"] == i) for i in range(n))
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (n, n + 1, n + 2, n + 3, n + 4, n + 7))
    assert got[n + 5]["n_links"] == 1 and got[n + 6]["component_id"] == n + 5 and got[None]["component_id"] is None
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_recall_of_the_chosen_tables():
    for parts in (1, 2):
        tables = vectors.tables_needed(64, parts, 2, 0.93, 0.999)
        rng = np.random.default_rng(9)
        x, y = rng.standard_normal((2, 3000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(1, keepdims=True) * x
        y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        found = (vectors.meet(vectors.hashes(x, tables, parts, 2), vectors.hashes(y, tables, parts, 2)) >= 0).any(1)
        assert found.mean() > 0.99


def test_very_small_and_very_large_vectors(spark):
    """Only the angle counts, down to the least numbers."""
    rows = [[1e-200, 2e-200], [1e-200, 2.01e-200], [1e200, 2e200], [1e200, 2.01e200], [1.0, 2.0], [5e-324, 1e-323], [1.7e308, 1.7e308 / 2], [0.0, 1e-300], [-1e200, -2e200]]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")).collect()}
    unit = [np.array(v) / np.abs(v).max() for v in rows]
    hit = np.array([[a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93 for b in unit] for a in unit])
    np.fill_diagonal(hit, False)
    assert [got[i]["n_links"] for i in range(len(rows))] == hit.sum(1).tolist()
    assert {got[i]["component_id"] for i in range(6)} == {0}
