import itertools
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
import pytest

from voxlake.operators import intervals as I
from voxlake.operators import metrics as M
from voxlake.plans.diarization import error_rates

TURN = "file_id string, speaker_id string, onset_ms long, offset_ms long"


@pytest.fixture(scope="module")
def table(spark):
    counts = [[106, 114, 117], [110, 130, 105], [92, 118, 108]]
    return spark.createDataFrame([(0, i, j, n) for i, r in enumerate(counts) for j, n in enumerate(r)], "k int, ref int, sys int, n long")


def test_pinned_scores(table):
    b = M.bcubed(table, ["k"]).first()
    assert (round(b["precision"], 4), round(b["recall"], 4), round(b["f"], 4)) == (0.3345, 0.3356, 0.3351)
    t = M.goodman_kruskal(table, ["k"]).first()
    assert round(t["tau_sys_given_ref"], 6) == round(t["tau_ref_given_sys"], 6) == 0.001223 or abs(t["tau_sys_given_ref"] - 0.001223) < 2e-6
    m = M.mutual_information(table, ["k"]).first()
    assert abs(m["mi"] - 0.001767) < 2e-6 and abs(m["nmi_sqrt"] - 0.001116) < 2e-6
    h = M.conditional_entropy(table, ["k"]).first()
    assert abs(h["h_ref_given_sys"] - 1.5824) < 1e-4


def test_assignment_is_optimal():
    rng = random.Random(4)
    for _ in range(50):
        n, m = rng.randint(1, 4), rng.randint(4, 5)
        c = np.array([[rng.randint(0, 20) for _ in range(m)] for _ in range(n)], float)
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        got = M.hungarian(c)
        assert len(set(got)) == n and math.isclose(sum(c[i, got[i]] for i in range(n)), best)


def test_error_rate_of_itself_is_zero(spark):
    t = spark.createDataFrame([("F", "a", 0, 5000), ("F", "b", 4000, 9000)], TURN)
    r = error_rates(t, t).first()
    assert r["der"] == 0 and r["scored"] == 10_000


def test_error_rate_by_hand(spark):
    ref = spark.createDataFrame([("F", "a", 0, 6000), ("F", "b", 6000, 10_000)], TURN)
    sys = spark.createDataFrame([("F", "x", 0, 5000), ("F", "y", 5000, 11_000)], TURN)
    r = error_rates(ref, sys).first()
    assert (r["scored"], r["miss"], r["fa"], r["error"]) == (10_000, 0, 1000, 1000) and r["der"] == 20.0


def test_no_system_turns(spark):
    ref = spark.createDataFrame([("F", "a", 0, 1000)], TURN)
    assert error_rates(ref, ref.limit(0)).first()["der"] == 100.0


def test_wer_roll_up(spark):
    pairs = spark.createDataFrame([("u", "A", "A"), ("u", "<eps>", "A"), ("u", "B", "B"), ("u", "C", "<eps>"), ("u", "D", "D"), ("u", "E", "X")], "utt string, ref string, hyp string")
    ops = M.wer_ops(pairs, ["utt"])
    assert tuple(ops.first())[1:5] == (3, 1, 1, 1)
    assert {r["speaker"]: r["wer"] for r in M.wer_rollup(ops, "utt").collect()} == {"u": 60.0, "SUM": 60.0}


def test_detection_costs_with_no_speech(spark):
    atoms = I.atoms({"ref": spark.createDataFrame([], TURN), "sys": spark.createDataFrame([("F", "x", 0, 500)], TURN)}, spark.createDataFrame([("F", 0, 1000)], "file_id string, onset_ms long, offset_ms long"), ["file_id"])
    r = M.detection_costs(atoms, ["file_id"]).first()
    assert r["miss_rate"] == 0 and r["fa_rate"] == 50.0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 10_000))
def test_sparse_matching_equals_the_dense_solver(n, m, seed):
    rng = np.random.default_rng(seed)
    w = rng.integers(1, 8, (n, m)) * (rng.random((n, m)) < 0.5)
    got = M.sparse_matching([[(j, int(w[i, j])) for j in range(m) if w[i, j]] for i in range(n)])
    used = [j for j in got if j >= 0]
    assert len(used) == len(set(used)) and all(w[i, j] > 0 for i, j in enumerate(got) if j >= 0)
    square = np.zeros((max(n, m), max(n, m)))
    square[:n, :m] = w
    best = square[np.arange(len(square)), M.hungarian(-square)].sum()
    assert sum(w[i, j] for i, j in enumerate(got) if j >= 0) == best


def test_matching_by_component_and_of_very_many(spark):
    rng = np.random.default_rng(5)
    rows = [(f"f{i % 3}", f"r{i % 60}", f"s{int(rng.integers(0, 60))}", int(rng.integers(0, 9))) for i in range(180)]
    pairs = spark.createDataFrame(sorted({r[:3]: r for r in rows}.values()), "file_id string, ref string, sys string, ms long")
    total = lambda t: sorted((r["file_id"], r["ms"]) for r in t.groupBy("file_id").sum("ms").withColumnRenamed("sum(ms)", "ms").collect())
    assert total(M.best_mapping(pairs, "file_id", "ms", by_component=True)) == total(M.best_mapping(pairs, "file_id", "ms"))
    n = 20_000  # a dense matrix would take 3 GB; the best is to take every first pair
    assert M.sparse_matching([[(i, 3), ((i + 1) % n, 2)] for i in range(n)]) == list(range(n))
    assert M.best_mapping(pairs.limit(0), "file_id", "ms", by_component=True).count() == 0


def test_detection_costs_divide_as_sql_does(spark):
    import math

    atoms = spark.createDataFrame([("full", 0, 10, 1, 1), ("mute", 0, 10, 0, 1)], "file_id string, onset_ms long, offset_ms long, n_ref int, n_sys int")
    got = {r["file_id"]: r for r in M.detection_costs(atoms, ["file_id"], ieee=True).collect()}
    assert math.isnan(got["full"]["dcf"]) and math.isnan(got["full"]["fa_rate"]) and got["full"]["miss_rate"] == 0.0
    assert got["mute"]["der"] == math.inf and math.isnan(got["mute"]["miss_rate"]) and got["mute"]["fa_rate"] == 100.0


def test_metadata_scores_shuffle_events_without_their_places(spark):
    from voxlake.plans import PLANS

    plan = PLANS.queries["d32_metadata_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "row_number" not in plan and "Join" in plan


def test_cluster_scores_are_the_scores_side_by_side_in_one_pass(spark):
    """four plans joined held the margins four times, more than the driver's memory."""
    rows = [(f"f{k}", i, j, (i * 7 + j * 3 + k) % 11 + 1) for k in range(4) for i in range(1 + k) for j in range(3 if k != 2 else 1)]
    c = spark.createDataFrame(rows, "file_id string, ref int, sys int, n long")
    k = ["file_id"]
    b3 = M.bcubed(c, k).withColumnsRenamed({"precision": "b3_precision", "recall": "b3_recall", "f": "b3_f"})
    want = b3.join(M.mutual_information(c, k), k).join(M.conditional_entropy(c, k), k).join(M.goodman_kruskal(c, k), k)
    got = M.cluster_scores(c, k)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_turns_are_matched_as_by_their_overlap_matrix_which_is_not_made(spark):
    """pairs of overlapping turns, which grow with the square of their density, are neither written nor shuffled."""
    rng = random.Random(3)
    def turns(n):
        return spark.createDataFrame([(f"f{k}", i, b, b + rng.choice([0, 1, 300, 900, 4000])) for k in range(3) for i in range(n) for b in [rng.randrange(0, 20_000 * (1 + 9 * k), 100)]], "file_id string, turn_id long, onset_ms long, offset_ms long")

    ref, sys = turns(60), turns(70)
    as_speaker = lambda t: t.withColumnRenamed("turn_id", "speaker_id")
    want = M.best_mapping(M.overlap_matrix(as_speaker(ref), as_speaker(sys), ["file_id"]), "file_id", "ms", by_component=True)
    got = M.match_turns(ref, sys, "file_id")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    total = lambda t: sorted(map(tuple, t.groupBy("file_id").agg({"ms": "sum", "ref": "count"}).collect()))
    assert total(got) == total(want) and got.groupBy("file_id", "ref").count().filter("count > 1").count() == 0
    assert M.match_turns(ref.limit(0), sys, "file_id").count() == 0


def test_frames_are_not_broadcast(spark):
    """Two turns are millions of frames to Spark's eyes as few as two rows: they must not go through the driver."""
    turns = spark.createDataFrame([("f", "a", 0, 5000), ("f", "b", 3000, 8000)], "file_id string, speaker_id string, onset_ms long, offset_ms long")
    got = M.frame_contingency(turns, turns, "file_id", "speaker_id", 1000)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["ref"], r["sys"]): r["n"] for r in got.collect()} == {("a", "a"): 5, ("a", "b"): 2, ("b", "a"): 2, ("b", "b"): 5}


def test_edges_of_a_dense_span_are_not_held():
    """Held or made when read, the edges are the same; a span of 4 million pairs takes the memory of its turns."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(3)
    side = lambda n: pd.DataFrame({"turn": rng.permutation(n), "onset_ms": rng.integers(0, 100, n)}).assign(offset_ms=lambda t: t.onset_ms + rng.integers(1, 40, n))
    r, s = side(30), side(20)
    held, made = M.SpanEdges(r, s), M.SpanEdges(r, s, held=0)
    assert list(held) == list(made) and made._kept is None and M.sparse_matching(held) == M.sparse_matching(made)
    assert [{int(held.sys[c]): w for c, w in e} for e in held] == [{int(b.turn): int(ms) for b in s.itertuples() if (ms := min(a.offset_ms, b.offset_ms) - max(a.onset_ms, b.onset_ms)) > 0} for a in r.sort_values("turn").itertuples() if a.turn in held.ref]
    full = [pd.DataFrame({"turn": range(2000), "onset_ms": 0, "offset_ms": range(1, 2001)}) for _ in range(2)]
    tracemalloc.start()
    assert len(M.SpanEdges(*full)) == 2000
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()
