"""Archives: tables written as keyed int vectors, float vectors, matrices, posteriors and bin times, and read again whole, in splits and by offset."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.fixtures import cte, view
from voxlake.plans.registry import Registry
from voxlake.session import shared_dir, table
from voxlake.sources import ark

R = Registry()


def write(rows: DataFrame, kind: str) -> str:
    """The folder of new archives."""
    ark.register(rows.sparkSession)
    path = f"{shared_dir(rows.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    rows.write.format("ark").mode("append").option("kind", kind).save(path)
    return path


def read(spark, path: str, **options) -> DataFrame:
    return spark.read.format("ark").options(**options).load(path)


def doubles(c: str):
    return F.transform(c, lambda v: v.cast("double"))


@R.add("SELECT CAST(l_orderkey AS STRING) AS key, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS total, min(l_partkey) AS first FROM lineitem GROUP BY 1")
def s12_int_archives(spark, d):
    """The parts of each order, in order of number."""
    parts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("key")).agg(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda v: v.cast("double")).alias("data"))
    t = read(spark, write(parts, "int"))
    return t.select("key", F.col("cols").cast("long").alias("n"), F.aggregate("data", F.lit(0.0), lambda a, b: a + b).cast("long").alias("total"), F.col("data")[0].cast("long").alias("first"))


@R.add("SELECT CAST(vec_id AS STRING) AS key, unnest(range(0, len(embedding))) AS place, unnest(embedding)::DOUBLE AS value FROM embeddings")
def s13_float_archives(spark, d):
    """Every vector, read in splits of a few records."""
    path = write(table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), doubles("embedding").alias("data")), "float")
    t = read(spark, path, split_bytes=16_384).select("key", F.posexplode("data").alias("place", "value"))
    return t.select("key", F.col("place").cast("long").alias("place"), "value")


@R.add("SELECT CAST(vec_id AS STRING) AS key, CAST(8 AS BIGINT) AS n, CAST(len(embedding) // 8 AS BIGINT) AS cols, TRUE AS equal, TRUE AS near FROM embeddings")
def s14_matrix_archives(spark, d):
    """Vectors as matrices of eight rows, in doubles and compressed to a byte a value: within half a step of the middle range, or equal."""
    m = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.lit(8).alias("rows"), doubles("embedding").alias("data"))
    whole, packed = read(spark, write(m, "double")), read(spark, write(m, "compressed")).select("key", F.col("data").alias("packed"))
    t = whole.join(packed, "key").join(m.select("key", F.col("data").alias("own")), "key")
    span = F.array_max("own") - F.array_min("own")
    worst = F.array_max(F.transform(F.arrays_zip("own", "packed"), lambda p: F.abs(p["own"] - p["packed"])))
    return t.select("key", F.col("rows").cast("long").alias("n"), F.col("cols").cast("long").alias("cols"), (F.col("data") == F.col("own")).alias("equal"), (worst <= span / 100).alias("near"))


@R.add("SELECT CAST(l_orderkey AS STRING) AS key, CAST(l_linenumber - 1 AS BIGINT) AS frame, l_partkey AS idx, round(l_discount, 4) AS value FROM lineitem")
def s15_posterior_archives(spark, d):
    """Line numbers as frames, parts as indexes, discounts as values."""
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), (F.col("l_linenumber") - 1).cast("int").alias("frame"), F.col("l_partkey").cast("int").alias("index"), F.col("l_discount").cast("float").alias("value"))
    back = read(spark, write(t.repartition("key").sortWithinPartitions("key", "frame", "index"), "posterior"), type="posterior")
    return back.select("key", F.col("frame").cast("long").alias("frame"), F.col("index").cast("long").alias("idx"), F.round(F.col("value").cast("double"), 4).alias("value"))


@R.add(cte("turns_ref") + " SELECT file_id AS key, row_number() OVER (PARTITION BY file_id ORDER BY onset_ms, turn_id) - 1 AS bin, CAST(CAST(onset_ms AS FLOAT) AS DOUBLE) AS begin_ms, CAST(CAST(offset_ms AS FLOAT) AS DOUBLE) AS end_ms FROM turns_ref")
def s15_bin_times(spark, d):
    """Turns of a file as the bins of its network."""
    t = view(spark, d, "turns_ref").select(F.col("file_id").alias("key"), "turn_id", F.col("onset_ms").cast("float").alias("begin"), F.col("offset_ms").cast("float").alias("end"), "onset_ms")
    back = read(spark, write(t.repartition("key").sortWithinPartitions("key", "onset_ms", "turn_id").select("key", "begin", "end"), "bins"), type="bins")
    return back.select("key", F.col("bin").cast("long").alias("bin"), F.col("begin").cast("double").alias("begin_ms"), F.col("end").cast("double").alias("end_ms"))


@R.add("SELECT CAST(vec_id AS STRING) AS key, unnest(range(0, len(embedding))) AS place, unnest(embedding)::DOUBLE AS value FROM embeddings")
def s16_offset_reads(spark, d):
    """Every vector fetched by the offset that the index gives for its key."""
    t = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), doubles("embedding").alias("data"))
    index = ark.read_index(spark, write(t, "float"))
    got = ark.read_at_offsets(index.join(t.select("key"), "key", "left_semi")).select("key", F.posexplode("data").alias("place", "value"))
    return got.select("key", F.col("place").cast("long").alias("place"), "value")
