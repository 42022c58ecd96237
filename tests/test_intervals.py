from voxlake.operators import intervals as I

TURN = "file_id string, speaker_id string, onset_ms long, offset_ms long"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_merge_per_speaker(spark):
    t = spark.createDataFrame([("F1", "S1", 0, 10), ("F1", "S1", 9, 11), ("F1", "S2", 0, 11), ("F2", "S1", 0, 11)], TURN)
    assert rows(I.merge(t, ["file_id", "speaker_id"]), "file_id", "speaker_id", "onset_ms", "offset_ms") == [("F1", "S1", 0, 11), ("F1", "S2", 0, 11), ("F2", "S1", 0, 11)]


def test_touching_is_a_choice(spark):
    t = spark.createDataFrame([("F", "S", 0, 5), ("F", "S", 5, 9)], TURN)
    assert len(rows(I.merge(t, ["file_id"]), "onset_ms")) == 2
    assert rows(I.merge(t, ["file_id"], touching=True), "onset_ms", "offset_ms") == [(0, 9)]


def test_trim(spark):
    t = spark.createDataFrame([("F1", "S1", 1000, 5000), ("F1", "S1", 6000, 10000), ("F2", "S1", 0, 10000)], TURN)
    u = spark.createDataFrame([("F1", 2000, 6000), ("F1", 5800, 7000), ("F2", 2000, 3000), ("F2", 4000, 5000)], "file_id string, onset_ms long, offset_ms long")
    assert rows(I.clip(t, u, ["file_id"]), "file_id", "onset_ms", "offset_ms") == [("F1", 2000, 5000), ("F1", 6000, 7000), ("F2", 2000, 3000), ("F2", 4000, 5000)]


def test_chop(spark):
    base = spark.createDataFrame([("F", 1, 5), ("F", 7, 10)], "file_id string, onset_ms long, offset_ms long")
    want = {(0, 6): [(7, 10)], (0, 2): [(2, 5), (7, 10)], (9, 11): [(1, 5), (7, 9)], (2, 3): [(1, 2), (3, 5), (7, 10)], (4, 8): [(1, 4), (8, 10)], (0, 1): [(1, 5), (7, 10)], (10, 11): [(1, 5), (7, 10)]}
    for (a, b), left in want.items():
        hole = spark.createDataFrame([("F", a, b)], "file_id string, onset_ms long, offset_ms long")
        assert rows(I.subtract(base, hole, ["file_id"]), "onset_ms", "offset_ms") == left


def test_extent(spark):
    ref = spark.createDataFrame([("F1", 0, 14000), ("F1", 20000, 25000), ("F2", 11000, 45000)], "file_id string, onset_ms long, offset_ms long")
    sys = spark.createDataFrame([("F1", 35000, 46000), ("F2", 2500, 14000)], "file_id string, onset_ms long, offset_ms long")
    assert rows(I.extent(ref, sys, keys=["file_id"]), "file_id", "onset_ms", "offset_ms") == [("F1", 0, 46000), ("F2", 2500, 45000)]


def test_frames(spark):
    t = spark.createDataFrame([("F", "S1", 0, 11000), ("F", "S2", 5000, 11000)], TURN)
    f = I.frame_labels(t, ["file_id", "speaker_id"], 100)
    got = {}
    for r in f.collect():
        got.setdefault(r["speaker_id"], []).append(r["frame"])
    assert sorted(got["S1"]) == list(range(110)) and sorted(got["S2"]) == list(range(50, 110))


def test_long_interval_spans_buckets(spark):
    a = spark.createDataFrame([("F", 0, 5_000_000)], "file_id string, onset_ms long, offset_ms long")
    b = spark.createDataFrame([("F", 10, 4_000_000), ("F", 4_999_999, 6_000_000), ("F", 5_000_000, 6_000_000)], "file_id string, onset_ms long, offset_ms long")
    assert rows(I.overlap_join(a, b, ["file_id"], width=1000), "b_begin") == [(10,), (4_999_999,)]


def test_sliding_windows_end_at_the_end(spark):
    t = spark.createDataFrame([("F", 0, 4000), ("F", 10_000, 10_900)], "file_id string, onset_ms long, offset_ms long")
    got = rows(I.sliding(t, ["file_id", "onset_ms"]), "sub_begin", "sub_end")
    assert (2500, 4000) in got and (10_000, 10_900) in got and all(b - a <= 1500 for a, b in got)
