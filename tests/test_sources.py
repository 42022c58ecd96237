import struct

import numpy as np

from voxlake.sources import ark
from voxlake.sources import formats as S


def test_turns_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("F", "a", 0, 1500), ("G", "b", 250, 9999)], "file_id string, speaker_id string, onset_ms long, offset_ms long")
    S.write_turns(t, str(tmp_path / "turns"))
    back = S.read_turns(spark, str(tmp_path / "turns")).select("file_id", "speaker_id", "onset_ms", "offset_ms")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))


def test_turn_lines_are_checked(spark):
    bad = ["SPEAKER F 1 x 1 <NA> <NA> a <NA>", "SPEAKER F 1 -1 1 <NA> <NA> a <NA>", "SPEAKER F 1 0 0 <NA> <NA> a <NA>", "SPEAKER F 1 0"]
    lines = spark.createDataFrame([(b,) for b in [*bad, "SPEAKER F 1 0 1 <NA> <NA> a <NA>", "SPKR-INFO F 1 0 1 <NA> <NA> a <NA>"]], "line string")
    assert {r["fault"] for r in S.turn_faults(lines).collect()} == {"no number", "negative onset", "no duration", "too few fields"}
    assert S.parse_turns(lines).count() == 1


def test_regions(spark):
    lines = spark.createDataFrame([(x,) for x in ["; note", "a/F1.wav 1 0.0 15.0", "F1 1 25 30.4", "F2 1 4.5 13.24", "F3 1 2 1"]], "line string")
    assert sorted(map(tuple, S.parse_regions(lines).collect())) == [("F1", 0, 15000), ("F1", 25000, 30400), ("F2", 4500, 13240)]


def test_archives(tmp_path, spark):
    path = str(tmp_path / "a.ark")
    offsets = ark.write_archive(path, iter([("u1", np.arange(3.0)), ("u2", np.ones((2, 4)))]))
    got = dict(ark.read_archive(path))
    assert got["u1"].tolist() == [0, 1, 2] and got["u2"].shape == (2, 4)
    assert ark.read_at(f"{path}:{offsets[1][1]}").shape == (2, 4)
    spark.dataSource.register(ark.ArkSource)
    rows = {r["key"]: r for r in spark.read.format("ark").load(path).collect()}
    assert rows["u2"]["rows"] == 2 and rows["u1"]["data"] == [0.0, 1.0, 2.0]


def test_text_and_compressed_values(tmp_path):
    path = tmp_path / "b.ark"
    columns = np.array([[0, 20000, 40000, 65535]], "<u2")
    path.write_bytes(b"t  [ 1 2 3 ]\nc \0BCM " + struct.pack("<ffii", 0.0, 65.535, 4, 1) + columns.tobytes() + bytes([0, 64, 192, 255]))
    got = dict(ark.read_archive(str(path)))
    assert got["t"].tolist() == [1, 2, 3] and np.allclose(got["c"][:, 0], [0, 20, 40, 65.535], atol=1e-3)


def test_language_model_text(spark):
    m = spark.createDataFrame([(1, -1.5, "a", -0.25), (1, -2.0, "b", None), (2, -0.5, "a b", None)], "n int, logp double, ngram string, bow double")
    lines = [r["line"] for r in S.arpa_lines(m).orderBy("n", "place", "line").collect()]
    text = spark.createDataFrame(list(enumerate(["\\data\\", *lines, "\\end\\"])), "number long, line string")
    assert sorted((r["n"], r["logp"], r["ngram"]) for r in S.parse_arpa(text).collect()) == [(1, -2.0, "b"), (1, -1.5, "a"), (2, -0.5, "a b")]


def test_hits_xml(spark, tmp_path):
    h = spark.createDataFrame([("k1", "u", 1.5, 0.2, 0.9)], "kwid string, utt string, tbeg double, dur double, score double")
    S.write_hits(h, str(tmp_path / "x"))
    assert [tuple(r) for r in S.read_hits(spark, str(tmp_path / "x")).collect()] == [("k1", "u", 1.5, 0.2, 0.9)]


def test_models_in_text_form(spark, tmp_path):
    text = "<Plda>  [ 0.5 -1 ]\n [\n  1 2 \n  3 4 ]\n [ 9 8 ]\n</Plda> "
    (tmp_path / "m").write_text(text)
    got = S.model_arrays(S.read_models(spark, str(tmp_path / "m"), ["mean", "transform", "between"]))
    assert {k: v.tolist() for k, v in got.items()} == {"mean": [0.5, -1.0], "transform": [[1.0, 2.0], [3.0, 4.0]], "between": [9.0, 8.0]}
    (tmp_path / "n").write_text(S.model_text("Plda", [got["mean"], got["transform"], got["between"]]))
    again = S.model_arrays(S.read_models(spark, str(tmp_path / "n"), ["mean", "transform", "between"]))
    assert all((again[k] == got[k]).all() for k in got)
    assert S.parse_models(spark.createDataFrame([("a", None), ("b", "none"), ("c", "[ ]")], "model string, text string"), ["mean"]).count() == 0
