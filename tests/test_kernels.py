"""Folds, dynamic programs and mappings against literal cases and plain versions."""

import itertools
import random

import numpy as np
import pytest

from voxlake.operators import events as V
from voxlake.operators import kernels as N


def groups_of(first):
    return [(k, k + len(list(g))) for k, g in ((k, g) for k, g in itertools.groupby(first))]


@pytest.mark.parametrize(
    ("least", "durations", "want"),
    [(0.1, [5, 6, 7], [0, 1, 2]), (0.5, [0.1, 6, 7], [0, 0, 2]), (0.5, [6, 7, 0.1], [0, 1, 1]), (0.5, [6, 0.1, 7], [0, 0, 2]), (0.5, [7, 0.1, 6], [0, 1, 1]), (1.0, [1, 0.5, 0.1, 6], [0, 0, 2, 2]), (9.0, [1, 2], [0, 0])],
)
def test_short_ones_join(least, durations, want):  # fixed values
    assert N.join_short(durations, least) == want


def test_cutting_between_long_neighbours_changes_nothing():
    rng = random.Random(3)
    for _ in range(200):
        d = [rng.choice([0.01, 0.02, 0.03, 0.05, 0.09]) for _ in range(rng.randint(1, 25))]
        whole, parts, at = N.join_short(d, 0.05), [], 0
        for i in range(1, len(d) + 1):
            if i == len(d) or (d[i] >= 0.05 and d[i - 1] >= 0.05):
                parts += [at + k for k in N.join_short(d[at:i], 0.05)]
                at = i
        assert parts == whole


def test_combining_over_speakers(spark, monkeypatch):
    monkeypatch.setattr(N, "ISLANDS", 2)
    rng = random.Random(4)
    rows = [(s, 100 * s + u, rng.choice([0.2, 0.4, 0.9, 1.5, 3.0])) for s in range(12) for u in range(rng.randint(1, 8))]
    utts, durations, speakers = [r[1] for r in rows], [r[2] for r in rows], [r[0] for r in rows]
    own = []
    for s in range(12):
        some = [i for i, x in enumerate(speakers) if x == s]
        own += [some[0] + k for k in N.join_short([durations[i] for i in some], 1.0)]
    starts = sorted(set(own))
    again = N.join_short([sum(d for d, f in zip(durations, own, strict=True) if f == g) for g in starts], 1.0)
    group = [starts[again[starts.index(f)]] for f in own]
    df = spark.createDataFrame(rows, "spk long, utt long, dur double").repartition(5)
    got = {r["utt"]: r for r in N.combine_short(df, "spk", "utt", "dur", 1.0).collect()}
    for i, u in enumerate(utts):
        mine = [k for k in range(len(rows)) if group[k] == group[i]]
        by = {s: round(sum(durations[k] for k in mine if speakers[k] == s), 6) for s in {speakers[k] for k in mine}}
        assert (got[u]["first"], got[u]["n"], got[u]["speaker"]) == (utts[group[i]], len(mine), min(by, key=lambda s: (-by[s], s)))
    inside = {r["utt"]: r["first"] for r in N.combine_short(df, "spk", "utt", "dur", 1.0, across=False).collect()}
    assert inside == {u: utts[f] for u, f in zip(utts, own, strict=True)}


def test_balanced_split(spark):
    rng = random.Random(5)
    for parts in (1, 3, 7):
        n = [rng.choice([1, 1, 2, 9]) for _ in range(23)]
        lists = [[i for i in range(23) if i * parts // 23 == p] for p in range(parts)]
        size = lambda p: sum(n[i] for i in lists[p])  # noqa: B023, E731
        moved = True
        while moved:
            moved = False
            for p in range(parts):
                for q, at in ((p + 1, -1), (p - 1, 0)):
                    if 0 <= q < parts and lists[p]:
                        c = n[lists[p][at]]
                        if abs(size(q) + c - (size(p) - c)) < abs(size(q) - size(p)):
                            lists[q].insert(0 if at else len(lists[q]), lists[p].pop(at))
                            moved = True
        rows = spark.createDataFrame([(f"s{i:02d}",) for i in range(23) for _ in range(n[i])], "spk string")
        got = {r["spk"]: r["part"] for r in N.balanced_split(rows, "spk", parts, chunk=4).collect()}
        assert got == {f"s{i:02d}": p for p in range(parts) for i in lists[p]}


def grown(a, proportion):
    """Frame by frame, on sets of frames."""
    runs = [list(g) for k, g in itertools.groupby(range(len(a)), key=lambda i: a[i] != 0) if k]
    loud = sum(map(len, runs))
    want = int(loud / (1 - proportion))
    taken = {f for r in runs for f in r}
    before = -1
    while len(taken) < want and len(taken) != before:
        before = len(taken)
        for r in runs:
            for f, right in ((r[0] - 1, False), (r[-1] + 1, True)):
                if len(taken) < want and 0 <= f < len(a) and f not in taken:
                    taken.add(f)
                    r.insert(len(r) if right else 0, f)
    return [(r[0], r[-1] + 1) for r in runs]


def test_frame_segments():
    rng = random.Random(6)
    for _ in range(100):
        a = np.array([rng.choice(k * [0] + [1, 2, 2]) for k in [rng.randint(1, 4)] for _ in range(rng.randint(1, 80))])
        seg = grown(a, 0.3)
        border = sorted((sum(1 for _ in itertools.takewhile(lambda f: a[f] == 0, range(x[1], len(a)))) + sum(1 for _ in itertools.takewhile(lambda f: a[f] == 0, range(x[1] - 1, -1, -1))), x[1]) for x, y in itertools.pairwise(seg) if x[1] == y[0])
        for _, at in border:
            left, right = next(s for s in seg if s[1] == at), next(s for s in seg if s[0] == at)
            if right[1] - left[0] <= 12:
                seg = sorted((set(seg) - {left, right}) | {(left[0], right[1])})
        out = []
        for x, y in seg:
            pieces = -(-(y - x) // 15) if y - x > 15 else 1
            edges = [x + k * ((y - x) // pieces) for k in range(pieces)] + [y]
            out += [e for e in itertools.pairwise(edges) if 2 in a[e[0] : e[1]]]
        assert N.frame_segments(a, proportion=0.3, longest=12, hard=15) == out
    assert N.frame_segments(np.zeros(5, int), proportion=0.2, longest=5, hard=5) == []


def test_alignment_costs_are_least():
    rng = random.Random(7)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        cost = [[max(i, j) if not (i and j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        pairs = N.align_words(a, b, 20)
        assert [i for i, _ in pairs if i >= 0] == list(range(len(a))) and [j for _, j in pairs if j >= 0] == list(range(len(b)))
        assert sum(i < 0 or j < 0 or a[i] != b[j] for i, j in pairs) == cost[-1][-1]


def test_best_mapping_in_order():
    rng = np.random.default_rng(8)
    for _ in range(60):
        n, m = rng.integers(0, 5, 2)
        score = np.where(rng.random((n, m)) < 0.3, np.nan, rng.integers(-3, 6, (n, m)) / 2)
        out, ins = -rng.integers(0, 3, n) / 2, -rng.integers(0, 3, m) / 2

        def total(pick):
            return sum(out[i] if j < 0 else score[i, j] for i, j in enumerate(pick)) + sum(ins[j] for j in range(m) if j not in pick)  # noqa: B023

        legal = [p for p in itertools.product(range(-1, m), repeat=n) if all(j < 0 or not np.isnan(score[i, j]) for i, j in enumerate(p)) and (lambda u: u == sorted(set(u)))([j for j in p if j >= 0])]
        got = N.best_path(score, out, ins)
        assert tuple(got) in legal and np.isclose(total(got), max(map(total, legal)))


def test_pruning_drops_paths_that_fall_behind():
    score = np.array([[1.0, np.nan], [np.nan, np.nan], [5.0, np.nan]])
    assert N.best_path(score, np.full(3, -2.0), np.zeros(2)) == [-1, -1, 0]
    assert N.best_path(score, np.full(3, -2.0), np.zeros(2), beam=1.0) == [0, -1, -1]


def test_times_are_warped(spark):
    anchors = spark.createDataFrame([("f", 10, 20, 110, 130), ("f", 30, 40, 150, 190)], "k string, begin long, end long, ref_begin long, ref_end long")
    points = spark.createDataFrame([("f", t) for t in (5, 10, 15, 20, 25, 35, 40, 50)] + [("g", 7)], "k string, ts long")
    got = {(r["k"], int(r["ts"])): r["tr"] for r in V.warp_times(points, anchors, "k").collect()}
    assert got == {("f", 5): 105, ("f", 10): 110, ("f", 15): 120, ("f", 20): 130, ("f", 25): 140, ("f", 35): 170, ("f", 40): 190, ("f", 50): 200, ("g", 7): 7}


def test_metadata_lines(spark):
    lines = ["; x", "", "SPKR-INFO f 1 <NA> <NA> <NA> child s1 <NA>", "SPEAKER f 1 0.5 2 <NA> <NA> s1 <NA>", "SPEAKER f 1 1* 2 <NA> <NA> s2 <NA>", "lexeme f A 0 1 WORD fp s1 <NA>", "SU f 1 0 1 <NA> nothing s1 <NA>", "SU f 1 0"]
    got = {(r["type"], r["speaker"], r["subtype"], r["kind"], r["fault"], r["onset_ms"]) for r in V.parse_metadata(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert got == {("SPEAKER", "s1", "child", None, None, 500), ("SPEAKER", "s2", "unknown", None, None, 1000), ("LEXEME", "s1", "fp", "fp", None, 0), ("SU", "s1", "nothing", None, "unknown type or subtype", 0), ("SU", None, None, None, "too few fields", 0)}


def test_sparse_paths_are_the_dense_ones():
    rng = np.random.default_rng(8)
    for _ in range(400):
        n, m = (int(x) for x in rng.integers(0, 12, 2))
        i, j = np.nonzero(rng.random((n, m)) < 0.4)
        value = rng.integers(-1, 4, len(i)).astype(float)
        score = np.full((n, m), np.nan)
        score[i, j] = value
        deleted, inserted = (float(x) for x in rng.integers(-2, 1, 2))
        assert N.sparse_path(n, m, i, j, value, deleted, inserted) == N.best_path(score, np.full(n, deleted), np.full(m, inserted))


def test_events_of_a_long_file_are_mapped_without_all_pairs(spark):
    n = 60_000
    ref = spark.range(n).selectExpr("'f' as k", "id as i")
    sys = spark.range(n).selectExpr("'f' as k", "id as j")
    pairs = spark.range(n - 1).selectExpr("'f' as k", "id as i", "id + 1 as j", "1.0D as score").unionByName(spark.range(n).selectExpr("'f' as k", "id as i", "id as j", "0.5D as score"))
    got = {r["i"]: r["j"] for r in V.map_events(ref, sys, "k", pairs).collect()}
    assert len(got) == n + 1 and got[None] == 0 and got[n - 1] is None and all(got[i] == i + 1 for i in range(n - 1))


def test_times_are_warped_without_a_frame_that_each_row_reads_to_its_end(spark):
    points = spark.createDataFrame([("f", 5.0)], "k string, ts double")
    anchors = spark.createDataFrame([("f", 0.0, 1.0, 0.0, 1.0)], "k string, begin double, end double, ref_begin double, ref_end double")
    assert "unboundedfollowing" not in V.warp_times(points, anchors, "k")._jdf.queryExecution().toString().lower()


def test_alignments_leave_in_small_batches():
    """A batch of many rows is not held as one list of aligned words."""
    import pyarrow as pa

    text = [" ".join(f"w{(i * 7 + j) % 50}" for j in range(40)) for i in range(601)]
    rows = pa.RecordBatch.from_pydict({"id": list(range(600)), "ref": text[:-1], "hyp": [None, "", *text[3:]]})
    sizes, ids = [], []
    for b in N.aligned_batches(iter([rows]), ["id"], "ref", "hyp", "<eps>", 5):
        sizes.append(b.num_rows)
        ids += b.column("id").unique().to_pylist()
    assert ids == list(range(600)) and sum(sizes) >= 24_000 and max(sizes) < N.ALIGNED + 100


def test_events_are_mapped_in_time_as_over_written_pairs(spark):
    """Pairs are made by the task that maps a file, with the same scores and the same mapping; only events are shuffled."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(11)
    event = "struct<type:string,begin:long,end:long,subtype:string,last:long>"

    def side(place, e, files):
        rows = []
        for f in files:
            begins = sorted(int(b) for b in rng.integers(0, 300, 40))
            for k, b in enumerate(begins):
                kind = str(rng.choice(["SU", "IP", "EDIT"]))
                rows.append((f, k, (kind, b, b + (0 if kind == "IP" else int(rng.integers(0, 60))), [None, "a", "b"][rng.integers(0, 3)], int(rng.integers(0, 3)))))
        return spark.createDataFrame(rows, f"k string, {place} long, {e} {event}")

    ref, sys = side("i", "r", "fg"), side("j", "s", "fh")
    pairs = V.overlapping_pairs(ref, sys, "k", 5).withColumn("score", V.metadata_score(F.col("r"), F.col("s"), 5.0, 20.0)).filter("score is not null")
    want = {tuple(r) for r in V.map_events(ref, sys, "k", pairs).collect()}
    got = V.map_in_time(ref, sys, "k", 5.0, 20.0)
    assert {tuple(r) for r in got.collect()} == want and sum(None not in r for r in want) > 10
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_scores_in_time_are_those_of_joined_pairs(spark):
    """Cells shorter than events: each pair once, with metadata_score's score, and no join."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(12)
    rows = [[("f" if k % 3 else "g", k, (str(rng.choice(["SU", "CB"])), b, b + int(rng.integers(0, 70)), [None, "a", "b"][k % 3], k % 2)) for k, b in enumerate(int(b) for b in rng.integers(0, 300, 50))] for _ in range(2)]
    ref, sys = (spark.createDataFrame(r, "k string, turn long, e struct<type:string,begin:long,end:long,subtype:string,last:long>") for r in rows)
    met = V.overlapping_pairs(ref.select("k", F.col("turn").alias("a"), F.col("e").alias("r")), sys.select("k", F.col("turn").alias("b"), F.col("e").alias("s")), "k", 5, bucket=40)
    want = {(x["k"], x["a"], x["b"]): x["score"] for x in met.withColumn("score", V.metadata_score(F.col("r"), F.col("s"), 5.0, 20.0)).filter("score is not null").collect()}
    got = V.score_in_time(ref, sys, "k", "turn", 5.0, 20.0, bucket=40)
    found = got.collect()
    assert {(x["k"], x["ref"], x["sys"]): x["score"] for x in found} == want and len(found) == len(want) > 50
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_scores_are_whole(monkeypatch):
    """However few pairs a block has, all of them come once and in order."""
    import pandas as pd

    rng = np.random.default_rng(13)
    r, s = (pd.DataFrame({"type": "SU", "begin": np.sort(rng.integers(0, 300, 60)), "subtype": "a", "last": 0}).assign(end=lambda t: t["begin"] + rng.integers(0, 60, 60)) for _ in range(2))
    joined = lambda: [np.concatenate(x).tolist() for x in zip(*V.scored_blocks(r, s, 5.0, 20.0), strict=True)]
    whole = joined()
    assert len(whole[0]) > 500
    for n in (1, 7, 100):
        monkeypatch.setattr(V, "SCORED", n)
        assert len(list(V.scored_blocks(r, s, 5.0, 20.0))) > 5 and joined() == whole
