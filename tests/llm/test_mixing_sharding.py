import zlib

import pytest

from voxlake.llm import mixing, sharding


def targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full, out = float(sum(size.values())), set(), {}
    while True:
        left = [s for s in names if s not in full]
        rest = total - sum(3 * size[s] for s in full)
        out = {s: 3.0 * size[s] if s in full else rest * w[s] / sum(w[x] for x in left) for s in names}
        over = {s for s in left if out[s] > 3 * size[s] + 1e-9}
        if not over:
            return out
        full |= over


def test_mix_meets_its_targets(make_docs, odd_rows):
    rows = odd_rows + [(1000 + i, "word " * (5 + i % 7), f"s{i % 5}") for i in range(600)] + [(5000 + i, "w " * 6, "s0") for i in range(400)]
    docs = make_docs(rows)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = targets(size)
    by_id = {}
    for i, t, s in rows:
        by_id.setdefault((i, len((t or "").split())), s)
    taken = dict.fromkeys(size, 0)
    for r in got:
        s = by_id[r["doc_id"], r["size"]]
        if r["doc_id"] is not None:
            assert r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    largest = {s: max(len((t or "").split()) for _, t, x in rows if x == s) for s in size}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in size if s != "s1" and s is not None)
    again = {(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix_report(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["size"], r["taken"]) for r in got}


def test_rows_of_the_mix(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = mixing.mix_rows(docs)
    n = sum(r["taken"] for r in mixing.mix_report(docs).collect())
    assert out.columns == docs.columns and sum(len((r["text"] or "").split()) for r in out.collect()) == n
    assert mixing.mix_rows(docs.limit(0)).count() == 0


def test_quotas_are_exact_and_disjoint(spark):
    q = spark.createDataFrame([(False, "a", 37), (False, "b", 5), (True, "", 11)], "__null boolean, __src string, n long")
    got = mixing.split_quotas(q, 6, 3).collect()
    for src, n in (("a", 37), ("b", 5), ("", 11)):
        units = sorted(u for r in got if r["__src"] == src for u in range(r["lo"], r["lo"] + r["n"]))
        assert units == list(range(n))
    sizes = [sum(r["n"] for r in got if r["shard"] == s) for s in range(6)]
    assert sum(sizes) == 53 and max(sizes) - min(sizes) <= 2


@pytest.mark.parametrize("hot", [0, 2000])
def test_shards(make_docs, odd_rows, hot):
    rows = odd_rows[:-3] + [(1000 + i, f"text number {i} " * (1 + i % 9), "s") for i in range(2000)] + [(9000 + i, "the same text again", "s") for i in range(hot)]
    got = sharding.shard_documents(make_docs(rows), shards=8).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)
    size, slots, group = [0] * 8, [[] for _ in range(8)], {}
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        group.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(size) - min(size) <= 0.02 * sum(size) / 8 + 2500
    whole = [g for g in group.values() if len(g) > 1]
    assert len(whole) <= (1 if hot else 0)
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard_documents(make_docs(rows).limit(0)).count() == 0


@pytest.mark.parametrize("partitions", [4, 40])
def test_mixed_rows_are_dealt_by_shard(spark, make_docs, partitions):
    from pyspark.sql import functions as F

    docs = make_docs([(i, f"text {i} " + "w " * (i % 9), f"s{i // 200}") for i in range(800)])
    want = {}
    for r in mixing.mix_report(docs).collect():
        for s in r["shards"]:
            want.setdefault(s, []).append(r["doc_id"])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = mixing.mix_rows(docs).select("doc_id", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    pieces, got = -(-partitions // mixing.SHARDS), {}
    for r in rows:
        got.setdefault(r["p"] // pieces, []).append(r["doc_id"])
    assert {s: sorted(x) for s, x in got.items()} == {s: sorted(x) for s, x in want.items()}
    assert all(x != sorted(x) for x in got.values() if len(set(x)) > 9)


def test_rows_without_an_id_are_told_apart(make_docs):
    """Half of the ids are null, others are repeated: every source is within one document of its target."""
    rows = [(None if i % 2 else i // 4, f"text {i} " + "w " * (i * 7 % 40), f"s{i % 4 // 2}") for i in range(900)]
    docs = make_docs(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    taken = dict.fromkeys(size, 0)
    for r in mixing.mix_rows(docs).collect():
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[s] - t) <= 42 for s, t in targets(size).items())
    assert sum(r["taken"] for r in mixing.mix_report(docs).collect()) == sum(taken.values())


@pytest.mark.parametrize("rows", [
    [(i, f"text number {i} " * (1 + i % 9), "s") for i in range(300)] + [(900 + i, "the same text again", "s") for i in range(30)],
    [(i, f"text number {i} " * (1 + i % 9), "s") for i in range(600)] + [(9000 + i, "the same text again", "s") for i in range(400)],
])
def test_shards_do_not_depend_on_the_layout(make_docs, rows):
    """Groups up to a shard stay whole; those that are cut are cut in the same way however the input is partitioned."""
    docs = make_docs(rows)
    first = sorted(map(tuple, sharding.shard_documents(docs.repartition(1)).collect()))
    assert first == sorted(map(tuple, sharding.shard_documents(docs.repartition(6)).collect())) == sorted(map(tuple, sharding.shard_documents(docs.orderBy("n_chars")).collect()))
    same = [r for r in first if r[0] >= 900 and r[1] == 20]
    assert len({r[4] for r in same}) == 1 if len(same) * 8 <= len(rows) else len({r[4] for r in same}) > 1


def test_a_hot_id_is_spread(make_docs):
    """Half of the rows are one document."""
    got = sharding.shard_documents(make_docs([(i, f"text {i}", "s") for i in range(400)] + [(7777, "hot", "s")] * 400)).collect()
    count = [sum(r["shard"] == s for r in got) for s in range(8)]
    assert max(count) - min(count) <= 12
