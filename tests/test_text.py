from voxlake.operators import kernels as N
from voxlake.operators import tables as T
from voxlake.operators import text as X


def test_merges_rewrite_words(spark):
    rows = spark.createDataFrame([(1, "low low lower newest newest newest")], "id long, text string")
    merges = X.learn_bpe(X.word_vocabulary(rows, "text"), 10)
    assert merges[0] in {("e", "s"), ("w", "e"), ("s", "t</w>"), ("n", "e")}
    out = X.apply_bpe(rows, "id", "text", merges).first()["text"]
    assert out.replace("@@ ", "") == rows.first()["text"]


def test_probabilities_sum_to_one(spark):
    rows = spark.createDataFrame([("a b a c",), ("b a",)], "text string")
    p = X.kn_probabilities(X.ngrams(rows, "text", 2), 2)
    sums = {}
    for r in p.collect():
        key = (r["n"], r["hist"])
        sums[key] = sums.get(key, r["left"]) + r["f"]
    assert all(abs(s - 1) < 1e-4 for s in sums.values())


def test_map_tokens(spark):
    rows = spark.createDataFrame([("u", "A B C")], "id string, text string")
    image = spark.createDataFrame([("A", "a1 a2"), ("B", "b")], "token string, image string")
    assert T.map_tokens(rows, image, "id", "text").first()["text"] == "a1 a2 b C"


def test_alignment(spark):
    rows = spark.createDataFrame([(1, "a b c d", "a c d e")], "id long, ref string, hyp string")
    got = [(r["ref"], r["hyp"]) for r in N.align(rows, ["id"], "ref", "hyp").orderBy("pos").collect()]
    assert got == [("a", "a"), ("b", "<eps>"), ("c", "c"), ("d", "d"), ("<eps>", "e")]


def test_combined_utterances_are_long_enough(spark):
    rows = spark.createDataFrame([("s", i, 0.3) for i in range(10)], "spk string, utt long, dur double")
    n = {}
    for r in N.combine_short(rows, "spk", "utt", "dur", 1.0).collect():
        n[r["first"]] = n.get(r["first"], 0) + 0.3
    assert min(n.values()) >= 1.0


def test_stream_sessions(spark, tmp_path):
    from pyspark.sql import functions as F

    from voxlake.streaming.sessions import sessions

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:03:00", 2.0), (1, "2024-01-01 02:00:00", 4.0), (1, "2024-01-02 00:00:00", 8.0)], "user_id long, ts string, value double")
    e.withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = spark.readStream.schema("user_id long, ts timestamp, value double").parquet(src)
    q = sessions(stream, "user_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_pairs_of_words_are_looked_up_once(spark, monkeypatch):
    """Sentences all begin and end alike; the model is asked by distinct pairs, not by a row for each sentence."""
    seen, ask = [], X.pair_scores
    monkeypatch.setattr(X, "pair_scores", lambda pairs, *m: (seen.append(sorted(map(tuple, pairs.select("hist", "word").collect()))), ask(pairs, *m))[1])
    rows = spark.createDataFrame([(i, "a b" if i % 2 else "a") for i in range(6)], "id int, text string")
    uni = spark.createDataFrame([("a", 0.1), ("</s>", 0.01)], "word string, p double")
    bi = spark.createDataFrame([("<s>", "a", 0.1), ("a", "</s>", 0.01)], "hist string, word string, p double")
    bow = spark.createDataFrame([("a", 0.1)], "hist string, bow double")
    got = {r["id"]: (r["n_tokens"], r["logp"]) for r in X.score_sentences(rows, "id", "text", uni, bi, bow).collect()}
    assert got == {i: (3, -11.0) if i % 2 else (2, -3.0) for i in range(6)}
    assert seen == [[("<s>", "a"), ("a", "</s>"), ("a", "b"), ("b", "</s>")]]


def test_tables_of_ngrams_are_not_broadcast(spark):
    """Spark takes n-grams to be as small as the texts that they come from, so without hints it would send them through the driver."""
    rows = spark.createDataFrame([(1, "a b a c"), (2, "b a")], "id long, text string")
    uni = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "word string, p double")
    bi = spark.createDataFrame([("a", "b", 0.5)], "hist string, word string, p double")
    got = X.score_sentences(rows, "id", "text", uni, bi, spark.createDataFrame([("a", 0.4)], "hist string, bow double"))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["n_tokens"] for r in got.collect()} == {1: 5, 2: 3}
