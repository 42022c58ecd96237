"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only).

Every source is cut into about sqrt(documents / sources) / 4 blocks by a hash of the document's id and text, so neither the number of blocks that one
task ranks nor the number of documents in a block exceeds the order of sqrt(documents * sources), whatever one source holds.
A source's target fixes its quota of blocks: whole passes over it, then a prefix of its permuted blocks, the last
of them cut between two documents. The quotas are split down a binary tree over the output shards: a node with t
blocks gives its left child a fixed number of them, and which sources they come from is an exact multivariate
hypergeometric draw (an urn emptied one block at a time with hashed, so repeatable, uniforms). A leaf owns disjoint
ranges of permuted blocks, whose documents are shuffled locally.

Defined results: null text has size 0; a very long text is one document, hashed and counted inside JVM code; a null source is a source of its own, last in order; rows
that share a document id (null included) are told apart by their texts, and only rows equal in id, text and source are taken together; sources without words have target 0
and no document of theirs is taken; an empty table gives an empty mix; extra columns are kept by ``mix_rows``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.words import n_words
from voxlake.session import stash

SRC, SHARDS = ["__null", "__src"], 16
TWO53 = float(1 << 53)


def mark(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def _keyed(docs: DataFrame, blocks: int, doc: Column, source_col: str, seed: int) -> DataFrame:
    """doc: what tells documents apart."""
    return docs.withColumns({
        "__null": F.col(f"`{source_col}`").isNull(),
        "__src": F.coalesce(F.col(f"`{source_col}`"), F.lit("")),
        "__block": F.pmod(F.xxhash64(F.lit(seed), doc), F.lit(blocks)).cast("int"),
        "__key": F.xxhash64(F.lit(seed + 1), doc),
    })


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """From one row per source (SRC, source_size): adds target. Water filling: the level at which the sources that
    stop at max_epochs times their size leave exactly the total for the rest. One row per source is ranked."""
    by_name, by_ratio = Window.orderBy(*SRC), Window.orderBy("__ratio", *SRC)
    everyone = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    out = sizes.withColumn("__w", w).withColumn("__cap", F.lit(float(max_epochs)) * F.col("source_size"))
    out = out.withColumn("__ratio", F.col("__cap") / F.col("__w")).withColumn("__all", F.sum("source_size").over(everyone).cast("double"))
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumn("__level", (F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(onward))
    fits = F.when(F.col("__level") <= F.col("__ratio") * (1 + 1e-12), F.col("__level"))
    out = out.withColumn("__level", F.coalesce(F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)))
    return out.withColumn("target", F.least("__cap", F.col("__level") * F.col("__w"))).select(*SRC, "source_size", "target")


def _urn(node: Column, state: Column, item: Column, seed: int) -> Column:
    """Draws how many of item's blocks go left, one block at a time; state carries what the urn still holds."""
    def one(s: Column, i: Column) -> Column:
        u = F.expr("0").cast("double") + F.xxhash64(F.lit(seed), node, item["__null"], item["__src"], i).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(TWO53)
        hit = F.when(u * s["rest"] < s["left"], F.lit(1)).otherwise(F.lit(0)).cast("long")
        return F.struct((s["hits"] + hit).alias("hits"), (s["rest"] - 1).alias("rest"), (s["left"] - hit).alias("left"))

    start = F.struct(F.lit(0).cast("long").alias("hits"), state["rest"].alias("rest"), state["left"].alias("left"))
    steps = F.when(item["n"] > 0, F.sequence(F.lit(1).cast("long"), item["n"])).otherwise(F.array().cast("array<bigint>"))
    got = F.aggregate(steps, start, one)
    row = F.struct(item["__null"].alias("__null"), item["__src"].alias("__src"), item["lo"].alias("lo"), item["n"].alias("n"), got["hits"].alias("hits"))
    return F.struct(got["rest"].alias("rest"), got["left"].alias("left"), F.concat(state["out"], F.array(row)).alias("out"))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """From (SRC, n blocks) to leaves (SRC, shard, lo, n): disjoint ranges of each source's drawn blocks."""
    tree = quotas.select(F.lit(0).alias("a"), F.lit(shards).alias("b"), *SRC, F.lit(0).cast("long").alias("lo"), F.col("n").cast("long").alias("n"))
    kind = "array<struct<__null:boolean,__src:string,lo:bigint,n:bigint,hits:bigint>>"
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        items = F.array_sort(F.collect_list(F.struct(*SRC, "lo", "n")))
        nodes = tree.groupBy("a", "b").agg(items.alias("items"), F.sum("n").alias("rest"))
        half = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        nodes = nodes.withColumn("mid", F.when(F.col("b") - F.col("a") <= 1, F.col("b")).otherwise(half))  # a single shard keeps everything on its left
        share = F.floor(F.col("rest") * (F.col("mid") - F.col("a")) / (F.col("b") - F.col("a")) + F.lit(0.5)).cast("long")
        start = F.struct(F.col("rest").alias("rest"), share.alias("left"), F.array().cast(kind).alias("out"))
        drawn = F.aggregate("items", start, lambda s, x: _urn(F.concat_ws("-", "a", "b"), s, x, seed))
        rows = nodes.select("a", "mid", "b", F.explode(drawn["out"]).alias("x"))
        left = F.struct(F.col("a"), F.col("mid").alias("b"), F.col("x.lo").alias("lo"), F.col("x.hits").alias("n"))
        right = F.struct(F.col("mid").alias("a"), F.col("b"), (F.col("x.lo") + F.col("x.hits")).alias("lo"), (F.col("x.n") - F.col("x.hits")).alias("n"))
        both = rows.select("x.__null", "x.__src", F.explode(F.array(left, right)).alias("c"))
        tree = both.select("c.a", "c.b", *SRC, "c.lo", "c.n").filter("n > 0")
    return tree.filter("n > 0").select(*SRC, F.col("a").alias("shard"), "lo", "n")


def plan_mix(sized: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, shards: int = SHARDS, seed: int = 17,
             mark_col: str = "mark", source_col: str = "source", size_col: str = "size") -> tuple[DataFrame, int]:
    """One row per (source, block): source_size, target, the shards of its passes, and, in the block where a source's
    quota ends, the last document key of the final pass and the few keys beyond it that fill the rest of the quota. Also the number of blocks."""
    seen = sized.agg(F.count("*").alias("n"), F.approx_count_distinct(F.coalesce(F.col(f"`{source_col}`"), F.lit(""))).alias("sources")).first()
    blocks = max(1, math.ceil(math.sqrt(seen["n"] / max(1, seen["sources"])) / 4))
    rows = _keyed(sized, blocks, F.col(f"`{mark_col}`"), source_col, seed).select(*SRC, "__block", "__key", F.col(f"`{size_col}`").alias("__size"))
    block = rows.groupBy(*SRC, "__block").agg(F.sum("__size").alias("__words"))
    block = stash(block, "mix-blocks")
    targets = source_targets(block.groupBy(*SRC).agg(F.sum("__words").alias("source_size")), weights, max_epochs)
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("__full", full).withColumn("__room", F.greatest(F.lit(0.0), F.col("target") - F.col("__full") * F.col("source_size")))
    order = Window.partitionBy(*SRC).orderBy(F.xxhash64(F.lit(seed + 2), *SRC, "__block"), "__block")
    block = block.join(targets, SRC).withColumns({
        "__rank": (F.row_number().over(order) - 1).cast("long"),
        "__of": F.count("*").over(Window.partitionBy(*SRC)),
        "__end": F.sum("__words").over(order.rowsBetween(Window.unboundedPreceding, 0)),
    })
    begin = F.col("__end") - F.col("__words")
    edge = (F.col("__end") > F.col("__room")) & (begin < F.col("__room"))
    block = block.withColumns({"__edge": edge, "__last": (F.col("__end") <= F.col("__room")) & (F.col("__room") > 0) | edge, "__left": F.col("__room") - begin})
    block = stash(block, "mix-plan")

    edges = block.filter("__edge").select(*SRC, "__block", "__left")
    upto = Window.partitionBy(*SRC).orderBy("__key").rangeBetween(Window.unboundedPreceding, 0)
    inside = rows.join(edges, [*SRC, "__block"]).groupBy(*SRC, "__left", "__key").agg(F.sum("__size").alias("__size"))
    inside = inside.withColumn("__sum", F.sum("__size").over(upto))
    fits = F.col("__sum") <= F.col("__left")
    entry = F.struct((-F.col("__size")).alias("s"), F.col("__key").alias("k"))
    cut = inside.groupBy(*SRC, "__left").agg(F.max(F.when(fits, F.col("__key"))).alias("__cut"), F.coalesce(F.max(F.when(fits, F.col("__sum"))), F.lit(0)).alias("__had"), F.array_sort(F.collect_list(F.when(~fits, entry))).alias("__rest"))
    # what the cut leaves open is filled from the rest of the block, largest first, then by one document that brings the source nearer to its target
    none = F.array().cast("array<bigint>")
    start = F.struct((F.col("__left") - F.col("__had")).cast("double").alias("gap"), none.alias("keys"))

    def fill(state: Column, doc: Column) -> Column:
        size = -doc["s"]
        return F.when((size > 0) & (size <= state["gap"]), F.struct((state["gap"] - size).cast("double").alias("gap"), F.concat(state["keys"], F.array(doc["k"])).alias("keys"))).otherwise(state)

    cut = cut.withColumn("__fill", F.aggregate("__rest", start, fill))
    gap, keys = F.col("__fill.gap"), F.col("__fill.keys")
    over = F.array_min(F.transform(F.filter("__rest", lambda x: ~F.array_contains(keys, x["k"]) & (F.abs(gap + x["s"]) < gap)), lambda x: F.struct(F.abs(gap + x["s"]).alias("d"), x["k"].alias("k"))))
    cut = cut.select(*SRC, "__cut", F.when(over.isNull(), keys).otherwise(F.concat(keys, F.array(over["k"]))).alias("__extra"))

    passes = F.col("__full") + F.col("__last").cast("long")
    unit = block.filter(passes > 0).select(*SRC, "__block", "__rank", "__of", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)).alias("__pass"))
    unit = unit.withColumn("__unit", F.col("__pass") * F.col("__of") + F.col("__rank"))
    leaves = split_quotas(unit.groupBy(*SRC).agg(F.count("*").alias("n")), shards, seed + 3)
    owned = leaves.select(*SRC, "shard", F.explode(F.sequence("lo", F.col("lo") + F.col("n") - 1)).alias("__unit"))
    copies = unit.join(owned, [*SRC, "__unit"]).groupBy(*SRC, "__block").agg(F.array_sort(F.collect_list(F.struct("__pass", "shard"))).alias("__c"))
    copies = copies.select(*SRC, "__block", F.transform("__c", lambda c: c["shard"]).alias("__copies"))
    out = block.join(copies, [*SRC, "__block"], "left").join(cut, SRC, "left")
    none = F.array().cast("array<int>")
    out = out.select(*SRC, "__block", "source_size", "target", F.col("__full").cast("int").alias("__full"), "__edge", "__cut", "__extra", F.coalesce("__copies", none).alias("__copies"))
    return stash(out, "mix-shards"), blocks


def assign(docs: DataFrame, plan: DataFrame, blocks: int, doc: Column, *, seed: int = 17, source_col: str = "source") -> DataFrame:
    """docs with __copies (the shards that get the document, one entry a copy), source_size and target."""
    out = _keyed(docs, blocks, doc, source_col, seed).join(plan, [*SRC, "__block"])
    beyond = F.col("__edge") & (F.col("__cut").isNull() | (F.col("__key") > F.col("__cut"))) & ~F.coalesce(F.array_contains("__extra", F.col("__key")), F.lit(False))
    return out.withColumn("__copies", F.when(beyond, F.slice("__copies", F.lit(1), F.col("__full"))).otherwise(F.col("__copies")))


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    columns = [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"), mark(id_col, text_col).alias("mark")]
    return stash(docs.select(*columns), "mix-sizes")


def mix_rows(docs: DataFrame, *, shards: int = SHARDS, **options) -> DataFrame:
    """The mix itself: docs' columns, one row for each copy taken. Rows are dealt out by shard: each shard is a run of partitions of its own,
    as many as fill the session's shuffle partitions, over which its rows are shuffled as a whole."""
    names = docs.columns
    plan, blocks = plan_mix(sized_documents(docs), shards=shards, **options)
    out = assign(docs, plan, blocks, mark("doc_id", "text"))
    out = out.select(*[F.col(f"`{c}`") for c in names], F.posexplode("__copies").alias("__copy", "__shard"))
    out = out.withColumn("__place", F.xxhash64(F.lit(29), mark("doc_id", "text"), "__copy"))
    pieces = max(1, -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    piece = F.pmod(F.xxhash64(F.lit(31), "__place"), F.lit(pieces))
    out = out.repartitionById(shards * pieces, (F.col("__shard") * pieces + piece).cast("int"))
    return out.sortWithinPartitions("__place").select(*[F.col(f"`{c}`") for c in names])


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, shards."""
    sized = sized_documents(docs)
    plan, blocks = plan_mix(sized, **options)
    out = assign(sized, plan, blocks, F.col("mark"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("__copies")).alias("taken"), F.col("__copies").alias("shards"))
