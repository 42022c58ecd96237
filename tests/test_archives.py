import gzip
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlake.sources import ark

ROWS = "key string, rows int, data array<double>"


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    ark.register(spark)


def many(spark, n):
    t = spark.range(n).select(F.format_string("u%05d", "id").alias("key"), F.when(F.col("id") % 3 == 0, 2).cast("int").alias("rows"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("id") * 10 + i).cast("double")).alias("data"))
    return t.repartition(4)


def plain(t):
    return sorted((r["key"], r["rows"], list(r["data"])) for r in t.collect())


@pytest.mark.parametrize("kind", ["float", "double", "text"])
def test_round_trip_in_splits(spark, tmp_path, kind):
    path = str(tmp_path / "a")
    t = many(spark, 400)
    t.write.format("ark").mode("append").option("kind", kind).save(path)
    back = spark.read.format("ark").option("split_bytes", 700).load(path)
    assert plain(back) == plain(t)
    files = [f for f in os.listdir(path) if f.endswith(".ark")]
    assert back.rdd.getNumPartitions() > 2 * len(files) and not [f for f in os.listdir(path) if f.startswith(".") and not f.endswith(".crc")]
    one = spark.read.format("ark").option("split_bytes", 1 << 20).load(f"{path}/{files[0].replace('.ark', '.scp')}")
    assert one.rdd.getNumPartitions() == 1 and 0 < one.count() < 400


def test_offsets_and_index(spark, tmp_path):
    path = "file://" + str(tmp_path / "a")
    t = many(spark, 300)
    t.write.format("ark").mode("append").save(path)
    index = ark.read_index(spark, path)
    some = index.filter("key >= 'u00100' and key < 'u00150'")
    assert plain(ark.read_at_offsets(some)) == plain(t.filter("key >= 'u00100' and key < 'u00150'"))
    where = index.first()
    assert ark.read_at(where["location"]).size == 8


def test_gzip_is_one_split_and_needs_no_index(spark, tmp_path):
    ark.write_archive(str(tmp_path / "x.ark"), iter([(f"k{i}", np.arange(4.0)) for i in range(50)]))
    with open(tmp_path / "x.ark", "rb") as f, gzip.open(tmp_path / "y.ark.gz", "wb") as g:
        g.write(f.read())
    t = spark.read.format("ark").option("split_bytes", 10).load(str(tmp_path))
    assert t.rdd.getNumPartitions() == 2 and t.count() == 100


def test_only_what_is_committed_is_seen(spark, tmp_path):
    path = str(tmp_path / "a")
    many(spark, 30).write.format("ark").mode("append").save(path)
    before = plain(spark.read.format("ark").load(path))
    bad = spark.createDataFrame([("fine", None, [1.0]), ("two words", None, [1.0])], ROWS)
    with pytest.raises(Exception, match="one word"):
        bad.write.format("ark").mode("append").save(path)
    assert plain(spark.read.format("ark").load(path)) == before and not [f for f in os.listdir(path) if f.startswith(".") and not f.endswith(".crc")]
    spark.createDataFrame([("new", None, [1.0, 2.0]), ("none", None, None)], ROWS).write.format("ark").mode("overwrite").save(path)
    assert plain(spark.read.format("ark").load(path)) == [("new", None, [1.0, 2.0]), ("none", None, [])]
    spark.createDataFrame([], ROWS).write.format("ark").mode("overwrite").save(path)
    assert spark.read.format("ark").load(path).count() == 0
    with pytest.raises(Exception, match="no-such"):
        spark.read.format("ark").load(str(tmp_path / "no-such")).count()


def test_ints(spark, tmp_path):
    path = str(tmp_path / "i")
    t = spark.createDataFrame([("a", None, [1.0, -2.0, 2147483647.0]), ("b", None, [])], ROWS)
    t.write.format("ark").mode("append").option("kind", "int").save(path)
    assert plain(spark.read.format("ark").load(path)) == plain(t)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 5), st.integers(0, 10_000), st.sampled_from(["normal", "constant", "few"]))
def test_compressed_values_are_close(n, m, seed, how):
    rng = np.random.default_rng(seed)
    v = {"normal": rng.standard_normal((n, m)) * 10, "constant": np.full((n, m), 3.25), "few": rng.choice([0.0, 1.0, 100.0], (n, m))}[how]
    back = ark.decode_compressed(*ark.encode_compressed(v))
    span = v.max() - v.min() or 1.0
    assert np.abs(back - v).max() <= span * (1 / 63 * 0.51 + 1e-4)


def test_posteriors_and_bins(spark, tmp_path):
    p, b = str(tmp_path / "p"), str(tmp_path / "b")
    posts = spark.createDataFrame([("u1", 0, 3, 0.5), ("u1", 0, 7, 0.25), ("u1", 2, 1, 1.0), ("u2", 1, 5, 0.75)], "key string, frame int, index int, value float")
    posts.repartition("key").sortWithinPartitions("key", "frame", "index").write.format("ark").mode("append").option("kind", "posterior").save(p)
    assert sorted(map(tuple, spark.read.format("ark").option("type", "posterior").load(p).collect())) == sorted(map(tuple, posts.collect()))
    bins = spark.createDataFrame([("u1", 0, 0.0, 0.5), ("u1", 1, 0.5, 2.0), ("u2", 0, 0.0, 1.0)], "key string, bin int, begin float, end float")
    bins.repartition("key").sortWithinPartitions("key", "bin").write.format("ark").mode("append").option("kind", "bins").save(b)
    assert sorted(map(tuple, spark.read.format("ark").option("type", "bins").load(b).collect())) == sorted(map(tuple, bins.collect()))
    index = ark.read_index(spark, p).filter("key = 'u2'")
    assert [tuple(r) for r in ark.read_at_offsets(index, "posterior").collect()] == [("u2", 1, 5, 0.75)]


def test_short_records_are_not_held_by_the_million():
    import io

    one = np.array([(4, 7, 4, 0.5)], ark._POSTERIOR)
    raw = b"\0B" + ark._sized(4) + b"".join(ark._record_bytes(one["index"], one["value"], ark._POSTERIOR) for _ in range(4))
    sizes = [b.num_rows for b in ark.batches(((f"k{i}", io.BytesIO(raw)) for i in range(20_000)), "posterior")]
    assert sum(sizes) == 80_000 and max(sizes) <= 1 << 16
