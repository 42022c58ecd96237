import numpy as np

from voxlake.llm import bloom


def test_filter_is_exact_after_its_join(spark):
    rows = spark.createDataFrame([(i if i % 11 else None, f"t{i}") for i in range(3000)], "doc_id long, text string").repartition(3)
    ids = spark.range(0, 3000, 7).withColumnRenamed("id", "x")
    got = sorted(r["text"] for r in bloom.anti_join(rows, "doc_id", ids).collect())
    assert got == sorted(f"t{i}" for i in range(3000) if i % 11 == 0 or i % 7)
    assert bloom.anti_join(rows, "doc_id", ids.limit(0)).count() == 3000


def test_it_never_misses_and_mostly_clears(spark):
    packed = bloom.build(spark.range(0, 20_000, 2).withColumnRenamed("id", "x"))
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    inside = {r["doc_id"] for r in bloom.keep(rows, "doc_id", packed, inside=True).collect()}
    assert set(range(0, 20_000, 2)) <= inside and len(inside) < 10_300
    assert len(packed) * 8 == 1 << int(np.ceil(np.log2(12 * 10_000)))
