"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

A group (documents of equal text) stays in one shard unless it alone would take more than a whole shard; such
a group is cut into cells by a hash of its documents' ids (of ids and row marks where one id has more than an eighth of a shard's share of its rows), so that hot groups spread. Nothing
else depends on how the input is partitioned: only rows equal in id and text may change places. Small groups are gathered by a hash of their text into a fixed number
of bundles. By pigeonhole at most 3 * LARGE groups hold more than a LARGE-th of the bytes, the tokens or the rows, so
the packer places a bounded number of items whatever the input: heaviest first, each into the shard where the dot
product of its size vector with the shard's residual capacity is highest.

Law ``bytes``: the shards' byte sums are near equal (within one item), and so are their tokens and rows.
Defined results: null text counts as empty (size 1); null document ids are rows like others; ties in a shard's order are broken by the row
mark; repeated rows are separate rows of one group; texts of any length are whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.words import n_words
from voxlake.session import stash

BUNDLES, LARGE = 4096, 1024


def place(items: list[tuple], shards: int) -> dict:
    """items: (key, bytes, tokens, rows). Key to shard; deterministic."""
    total = [max(1.0, float(sum(x[i] for x in items))) for i in (1, 2, 3)]
    vectors = sorted(((tuple(x[i + 1] * shards / total[i] for i in range(3)), x[0]) for x in items), key=lambda v: (-max(v[0]), -sum(v[0]), str(v[1])))
    left = [[1.0, 1.0, 1.0] for _ in range(shards)]
    out = {}
    for v, key in vectors:
        fits = [s for s in range(shards) if all(left[s][i] + 1e-9 >= v[i] for i in range(3))] or range(shards)
        best = max(fits, key=lambda s: (sum(a * b for a, b in zip(v, left[s], strict=True)), -s))
        for i in range(3):
            left[best][i] -= v[i]
        out[key] = best
    return out


def shard_documents(docs: DataFrame, shards: int = 8, bundles: int = BUNDLES, large: int = LARGE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("`text`"), F.lit(""))
    rows = docs.select(
        F.col("`doc_id`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        n_words(text).alias("tokens"), F.xxhash64(text).alias("group"), F.monotonically_increasing_id().alias("mark"),
    )
    rows = stash(rows, "shard-rows")
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "tokens")], F.count("*").alias("n")).first()
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    share = F.greatest(*[F.col(c) / F.lit(float(max(1, total[c]))) for c in ("size", "tokens", "n")])
    largest = [(r["group"], max(1, -(-r["n"] * bundles // max(1, total["n"]))), bool(r["share"] * shards > 1)) for r in groups.withColumn("share", share).filter(F.col("share") * large > 1).collect()]  # at most 3 * large
    repeated = set()
    if split := [(g,) for g, _, s in largest if s]:  # at most 3 * shards
        counts = rows.join(F.broadcast(spark.createDataFrame(split, "group long")), "group").groupBy("group", F.xxhash64("doc_id")).agg(F.count("*").alias("n"))
        repeated = {r["group"] for r in counts.groupBy("group").agg(F.max("n").alias("most"), F.sum("n").alias("n")).filter(F.col("most") * 8 * shards > F.col("n")).filter("most > 1").collect()}
    big = F.broadcast(spark.createDataFrame([(*x, x[0] in repeated) for x in largest], "group long, cells int, split boolean, repeated boolean"))
    rows = rows.join(big, "group", "left")
    alone = F.col("cells").isNotNull()
    by = F.when(F.col("repeated"), F.xxhash64("doc_id", "mark")).otherwise(F.xxhash64("doc_id"))
    rows = rows.withColumns({
        "part": F.when(alone, F.pmod(by, F.col("cells"))).otherwise(F.pmod(F.xxhash64(F.lit(5), "group"), F.lit(bundles))).cast("int"),
        "owner": F.when(alone, F.col("group")).otherwise(F.lit(0)), "alone": alone,
    })
    cell = ["alone", "owner", "part"]
    cells = rows.groupBy(*cell).agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.max("split").alias("split"))
    held = sorted(tuple(r) for r in cells.select(*cell, "size", "tokens", "n", F.coalesce("split", F.lit(False))).collect())  # bounded: bundles + 3 * large groups' cells
    items: dict = {}
    for a, o, p, size, tokens, n, split in held:
        key = (a, o, p if split or not a else -1)
        was = items.get(key, (0, 0, 0))
        items[key] = (was[0] + size, was[1] + tokens, was[2] + n)
    where = place([(k, *v) for k, v in items.items()], shards)
    filled, plan = [0] * shards, []
    for a, o, p, _, _, n, split in held:
        s = where[a, o, p if split or not a else -1]
        plan.append((a, o, p, s, filled[s]))
        filled[s] += n
    plan = F.broadcast(spark.createDataFrame(plan, "alone boolean, owner long, part int, shard int, base long"))
    order = Window.partitionBy(*cell).orderBy("doc_id", "text_crc32", "group", "mark")
    out = rows.withColumn("nth", F.row_number().over(order) - 1).join(plan, cell)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
