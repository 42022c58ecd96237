"""Family A: algebra of keyed tables. Every function takes and returns DataFrames; row order is always an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- filters and semi joins ----------------------------------------------------------------------------------


def filter_keys(rows: DataFrame, ids: DataFrame, key: str, id_col: str | None = None, *, exclude: bool = False) -> DataFrame:
    """Rows whose key is (not) in the id list."""
    return rows.join(ids.select(F.col(id_col or key).alias(key)), key, "left_anti" if exclude else "left_semi")


def route_to_jobs(rows: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """Each row to every job whose list (key, job) has its key."""
    return rows.join(lists.select(key, "job").distinct(), key)


def route_coverage(rows: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """Per key, the number of jobs that take it: 0 is uncovered, more than 1 multiply covered."""
    n = lists.select(key, "job").distinct().groupBy(key).agg(F.count("*").alias("n"))
    return rows.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n_jobs"))


def drop_arcs_with(arcs: DataFrame, bad: DataFrame, fields: list[str], word: str) -> DataFrame:
    """Arcs none of whose fields holds a listed word."""
    for f in fields:
        arcs = arcs.join(bad.select(F.col(word).alias(f)).distinct(), f, "left_anti")
    return arcs


def tokens_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token) for blank-separated text."""
    parts = F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda t: t != "")
    return rows.select(key, F.posexplode(parts).alias("pos", "token"))


def join_tokens(rows: DataFrame, key: str, value: Column, alias: str = "text") -> DataFrame:
    """Tokens of (key, pos, value) put together in order."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))), lambda s: s["v"]), " ").alias(alias))


def replace_oov(rows: DataFrame, vocabulary: DataFrame, key: str, text: str, unk: str = "<UNK>") -> DataFrame:
    t = tokens_of(rows, key, text).join(vocabulary.select("token", F.lit(True).alias("known")).distinct(), "token", "left")
    return join_tokens(t, key, F.when(F.col("known"), F.col("token")).otherwise(F.lit(unk)))


def map_tokens(rows: DataFrame, mapping: DataFrame, key: str, text: str, *, permissive: bool = True) -> DataFrame:
    """Token to token sequence through (token, image); without an image it stays, or is an error in strict mode."""
    t = tokens_of(rows, key, text).join(mapping.select("token", "image"), "token", "left")
    missing = F.col("token") if permissive else F.raise_error(F.concat(F.lit("no image for "), F.col("token"))).cast("string")
    return join_tokens(t, key, F.coalesce("image", missing))


# --- encodings -------------------------------------------------------------------------------------------------


def dense_ids(rows: DataFrame, label: str, *order: str) -> DataFrame:
    """label with id: numbered from 0 in order of first appearance."""
    first = rows.groupBy(label).agg(F.min(F.struct(*order)).alias("o"))
    return running_sum(slices(first, "o", label), F.lit(1), "id", "o", label).select(label, F.col("id").cast("long").alias("id"))


def relabel_by_appearance(rows: DataFrame, group: list[str], label: str, order: str) -> DataFrame:
    """Adds new_label: labels of a group numbered from 0 by their first row. Only one row per (group, label) is ranked."""
    first = rows.groupBy(*group, label).agg(F.min(order).alias("__first"))
    rank = first.withColumn("new_label", (F.row_number().over(Window.partitionBy(*group).orderBy("__first", label)) - 1).cast("long"))
    return rows.join(rank.drop("__first"), [*group, label])


def relabel_by_value(rows: DataFrame, group: list[str], label: str) -> DataFrame:
    first = rows.select(*group, label).distinct()
    return rows.join(first.withColumn("new_label", (F.row_number().over(Window.partitionBy(*group).orderBy(label)) - 1).cast("long")), [*group, label])


def add_disambiguation(symbols: DataFrame, n: int) -> DataFrame:
    """(symbol, id) with #1..#n after the last id."""
    last = symbols.agg(F.max("id").alias("m"))
    extra = last.select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"), "m").select(F.concat(F.lit("#"), F.col("i").cast("string")).alias("symbol"), (F.col("m") + F.col("i")).cast("long").alias("id"))
    return symbols.select("symbol", F.col("id").cast("long").alias("id")).unionByName(extra)


# --- grouping -----------------------------------------------------------------------------------------------------


def group_list(rows: DataFrame, key: str, value: str, order: str, alias: str = "members") -> DataFrame:
    """Order-preserving key to list of values."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("__v")))), lambda s: s["__v"]).alias(alias))


def ungroup_list(rows: DataFrame, key: str, members: str, value: str) -> DataFrame:
    return rows.select(key, F.posexplode(members).alias("pos", value))


def segment_stats(rows: DataFrame, key: str, dur: str) -> DataFrame:
    """One row: total, mean, longest and shortest with their keys (ties to the least key)."""
    least = F.min_by(key, F.struct(dur, key))
    most = F.min_by(key, F.struct((-F.col(dur)).alias("d"), key))
    return rows.agg(F.sum(dur).alias("total"), F.avg(dur).alias("mean"), F.max(dur).alias("longest"), most.alias("longest_key"), F.min(dur).alias("shortest"), least.alias("shortest_key"))


def speakers_per_recording(rows: DataFrame, reco: str, spk: str, *, approximate: bool = False) -> DataFrame:
    return rows.groupBy(reco).agg((F.approx_count_distinct(spk) if approximate else F.countDistinct(spk)).alias("n_speakers"))


def coverage_range(rows: DataFrame, dur: str, percent: float) -> DataFrame:
    """Smallest and largest duration whose cumulative share (from below and from above) exceeds percent of the total. Equal
    durations are pre-summed, so the running sums see one row per distinct value."""
    by = rows.groupBy(F.col(dur).alias("d")).agg(F.sum(dur).alias("s"))
    up, down = Window.orderBy("d"), Window.orderBy(F.desc("d"))
    t = by.withColumns({"u": F.sum("s").over(up), "v": F.sum("s").over(down), "t": F.sum("s").over(Window.partitionBy())})
    bar = F.col("t") * percent / 100
    return t.agg(F.min(F.when(F.col("u") > bar, F.col("d"))).alias("lo"), F.max(F.when(F.col("v") > bar, F.col("d"))).alias("hi"))


def duration_ladder(lo: float, hi: float, factor: float, *, frame_ms: float = 25.0, shift_ms: float = 10.0, subsampling: int = 3, least_ms: float = 300.0) -> list[tuple[float, int]]:
    """(duration in ms, length in frames) of the allowed durations from lo (but not below least_ms) to below hi, each `factor` times the one before, snapped to a length that subsampling divides (down, or up by less than half a shift).
    Their number is the logarithm of hi / lo."""
    out, x = [], max(float(lo), least_ms)
    if factor <= 1:
        raise ValueError("durations grow by a factor over 1")
    while x < hi:
        length = int(x - frame_ms) / shift_ms + 1
        if length % subsampling:
            length = subsampling * (length // subsampling)
            x = shift_ms * (length - 1) + frame_ms + shift_ms / 2
        if out and x <= out[-1][0]:
            raise ValueError("the factor is too small for the snapping")
        out.append((x, int(length)))
        x *= factor
    return out


def allowed_variants(rows: DataFrame, utt: str, dur: str, ladder: list[float], factor: float) -> DataFrame:
    """(utt, variant, dur_ms, speed): an utterance's copies of allowed durations. pv1: played at the next lower one, pv2 at the next higher, pv3: filled up with silence to that (speed 1; none where it is that long already).
    An utterance whose next lower duration is more than `factor` away has none at all, one whose next higher is has pv1 only. The steps of the ladder are met by an equi join on the logarithm's bucket."""
    spark, ends = rows.sparkSession, sorted(ladder)
    if not ends:
        return rows.select(F.col(utt).alias("utt"), F.lit("").alias("variant"), F.lit(0.0).alias("dur_ms"), F.lit(0.0).alias("speed")).limit(0)
    steps = [(None, ends[0]), *zip(ends, ends[1:], strict=False), (ends[-1], None)]
    bucket = lambda c: F.floor(F.log(c) / F.log(F.lit(1.5)))
    t = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(steps)], "k int, lo double, hi double")
    bounds = rows.agg(F.min(dur).cast("double").alias("least"), F.max(dur).cast("double").alias("most"))  # one row
    t = t.join(F.broadcast(bounds)).withColumn("b", F.explode(F.sequence(bucket(F.greatest(F.coalesce("lo", "least"), F.lit(1e-3))), bucket(F.greatest(F.coalesce("hi", "most"), F.coalesce("lo", "least"), F.lit(1e-3))))))
    d = F.col("d")
    met = rows.filter(F.col(dur) > 0).select(F.col(utt).alias("utt"), F.col(dur).cast("double").alias("d")).withColumn("b", bucket(d)).join(F.broadcast(t), "b")  # a few rows a step
    inside = F.when(F.col("k") == 0, d < F.col("hi")).when(F.col("k") == len(ends), d > F.col("lo")).otherwise((d > F.col("lo")) | ((F.col("k") == 1) & (d == F.col("lo")))) & (F.col("hi").isNull() | (d <= F.col("hi")))
    if len(ends) == 1:
        inside = F.when(F.col("k") == 0, d < F.col("hi")).otherwise(d >= F.col("lo"))
    met = met.filter(inside)
    near = lambda c: F.greatest(d / F.col(c), F.col(c) / d) <= factor
    low, high = F.col("lo").isNotNull(), F.col("hi").isNotNull()
    go = ~low | near("lo")
    up = go & high & near("hi")
    one = lambda ok, name, to, speed: F.when(ok, F.struct(F.lit(name).alias("variant"), to.alias("dur_ms"), speed.alias("speed")))
    copies = F.array(one(low & near("lo"), "pv1", F.col("lo"), d / F.col("lo")), one(up, "pv2", F.col("hi"), d / F.col("hi")), one(up & (F.col("hi") - d > 0.1), "pv3", F.col("hi"), F.lit(1.0)))
    return met.select("utt", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("c")).select("utt", "c.*")


def pronunciation_probs(rows: DataFrame, word: str, pron: str, *, max_normalize: bool = False) -> DataFrame:
    """Add-one smoothed share of each pronunciation of a word, or its ratio to the word's commonest."""
    n = rows.groupBy(word, pron).agg((F.count("*") + 1).alias("n"))
    w = Window.partitionBy(word)
    over = F.max("n").over(w) if max_normalize else F.sum("n").over(w)
    return n.select(word, pron, F.round(F.col("n") / over, 6).alias("prob"))


def histogram(rows: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    return rows.groupBy(F.width_bucket(value, F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


# --- sets and integrity -------------------------------------------------------------------------------------------


def first_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the least by order. An aggregate, so copies combine before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def restrict_together(tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Keyed sibling tables cut down to the keys that all of them have."""
    keys = None
    for df, k in tables.values():
        own = df.select(F.col(k).alias("__k"))
        keys = own.distinct() if keys is None else keys.intersect(own)
    return {n: df.join(keys.withColumnRenamed("__k", k), k, "left_semi") for n, (df, k) in tables.items()}


def violations(*checks: tuple[str, DataFrame, str]) -> DataFrame:
    """(check, key) for every offending row of every check."""
    out = None
    for name, df, key in checks:
        part = df.select(F.lit(name).alias("check"), F.col(key).cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def text_faults(text: Column) -> Column:
    """Name of the first fault of a transcript line, or null."""
    return (
        F.when(text.contains("\r"), "carriage return").when(text.rlike("[\\x{00a0}\\x{2000}-\\x{200b}\\x{3000}]"), "odd blank")
        .when(text.rlike("^\\s|\\s$"), "outer blank").when(text.rlike("[<>#]"), "reserved symbol")
    )


#: Multiplier and modulus of the draws that limit repeated transcripts.
DRAW_STEP, DRAW_MODULUS = 103349, 71147


def cap_repeats(rows: DataFrame, text: str, order: str, most: int) -> DataFrame:
    """Keeps rows whose text occurs less than most times, and of others those whose draw falls below most / count. The k-th
    draw, in order over the rows that need one, is k * STEP mod MODULUS / MODULUS."""
    n = rows.groupBy(text).agg(F.count("*").alias("__n"))
    r = rows.join(n, text)
    need = r.filter(F.col("__n") >= most)
    drawn = with_rank(need, order).withColumn("__u", F.pmod((F.col("__rank") + 1) * DRAW_STEP, F.lit(DRAW_MODULUS)) / F.lit(float(DRAW_MODULUS)))
    return r.filter(F.col("__n") < most).select(*rows.columns).unionByName(drawn.filter(F.col("__u") < F.lit(most) / F.col("__n")).select(*rows.columns))


# --- sampling, splitting ---------------------------------------------------------------------------------------------


def first_n(rows: DataFrame, n: int, *order: str, last: bool = False) -> DataFrame:
    return rows.orderBy(*[F.desc(c) if last else F.asc(c) for c in order]).limit(n)


def shortest_n(rows: DataFrame, n: int, length: str, tie: str) -> DataFrame:
    return rows.orderBy(length, tie).limit(n)


def stride_per_group(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """n rows per group at the largest stride that leaves n: places 0, s, 2s, ..; all of a smaller group."""
    w = Window.partitionBy(group)
    t = rows.withColumns({"__c": F.count("*").over(w), "__p": F.row_number().over(w.orderBy(order)) - 1})
    s = F.greatest(F.lit(1), F.floor(F.col("__c") / n))
    return t.filter((F.pmod(F.col("__p"), s) == 0) & (F.col("__p") < s * n)).drop("__c", "__p")


def groups_until(rows: DataFrame, group: str, n: int) -> DataFrame:
    """Whole groups, in order of their key, until n rows are reached. Group sizes, not rows, are summed in order."""
    size = rows.groupBy(group).agg(F.count("*").alias("__n"))
    before = running_sum(slices(size, group), F.col("__n"), "__b", group)
    return rows.join(before.filter(F.col("__b") < n).select(group), group, "left_semi")


def block_split(rows: DataFrame, parts: int, order: str) -> DataFrame:
    """Adds job: contiguous blocks in order, sizes at most one apart. The rank comes from counts of hash-free range
    slices and ranks inside them, so no task sorts everything."""
    total = rows.count()
    ranked = with_rank(rows, order)
    big, rest = -(-total // parts), total % parts or parts
    small = max(1, total // parts)
    r = F.col("__rank")
    job = F.when(r < rest * big, F.floor(r / big)).otherwise(rest + F.floor((r - rest * big) / small))
    return ranked.withColumn("job", (job + 1).cast("int")).drop("__rank")


def slices(rows: DataFrame, *order: str) -> DataFrame:
    """rows in range slices (__slice) of the order, written once: what needs all rows in order comes from slices and one row of each."""
    from voxlake.session import stash

    return stash(rows.repartitionByRange(*order).withColumn("__slice", F.spark_partition_id()), "slices")


def running_sum(sliced: DataFrame, value: Column, alias: str, *order: str) -> DataFrame:
    """Adds the sum of value over the rows before, in order, of all slices."""
    ahead = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # over one row a slice
    base = sliced.groupBy("__slice").agg(F.sum(value).alias("__n")).select("__slice", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__base"))
    own = F.sum(value).over(Window.partitionBy("__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return sliced.join(F.broadcast(base), "__slice").withColumn(alias, F.col("__base") + F.coalesce(own, F.lit(0))).drop("__base")


def previous(sliced: DataFrame, column: str, alias: str, *order: str) -> DataFrame:
    """Adds the column of the row before, in order, of all slices."""
    ends = sliced.groupBy("__slice").agg(F.max_by(column, F.struct(*order)).alias("__end"))
    ends = ends.select("__slice", F.lag("__end").over(Window.orderBy("__slice")).alias("__end"))  # over one row a slice
    w = Window.partitionBy("__slice").orderBy(*order)
    before = F.when(F.row_number().over(w) == 1, F.col("__end")).otherwise(F.lag(column).over(w))
    return sliced.join(F.broadcast(ends), "__slice").withColumn(alias, before).drop("__end")


def with_rank(rows: DataFrame, order: str) -> DataFrame:
    """Adds __rank (from 0, distinct) by a unique order column."""
    return running_sum(slices(rows, order), F.lit(1), "__rank", order).drop("__slice")


def out_of_order(rows: DataFrame, place: str, key: str) -> DataFrame:
    """Rows, in order of place (unique), whose key is below the one before."""
    t = previous(slices(rows, place), key, "__was", place)
    return t.filter(F.col(key) < F.col("__was")).drop("__was", "__slice")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n")


def position_phones(word: Column) -> Column:
    """Letters of a word with the mark of their place: begin, inside, end, or single."""
    n = F.length(word)
    mark = lambda i: F.when(n == 1, "_S").when(i == 1, "_B").when(i == n, "_E").otherwise("_I")
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(word.substr(i, F.lit(1)), mark(i)))


def position_free(phones: DataFrame) -> DataFrame:
    """(id, phone) to (id, phone, base_id, base): marks of place taken off, bases numbered from 0 by their first phone."""
    t = phones.withColumn("base", F.regexp_replace("phone", "_[BESI]$", ""))
    return t.join(dense_ids(t, "base", "id").withColumnRenamed("id", "base_id"), "base").select("id", "phone", "base_id", "base")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds place (from 0): rows in order of a digest of seed and key, compared as text. The same order in every run and layout."""
    t = rows.withColumn("__draw", F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))))
    return running_sum(slices(t, "__draw", key), F.lit(1), "place", "__draw", key).drop("__slice", "__draw")


def pseudo_speakers(rows: DataFrame, spk: str, utt: str, most: int) -> DataFrame:
    """Speakers cut into pseudo-speakers of at most so many utterances."""
    n = F.row_number().over(Window.partitionBy(spk).orderBy(utt)) - 1
    return rows.select(utt, spk, F.concat(F.col(spk).cast("string"), F.lit("-"), F.floor(n / most).cast("string")).alias("pseudo"))


def perturb_speed(rows: DataFrame, utt: str, dur: str, factors: list[float]) -> DataFrame:
    """One copy per factor: duration divided, id prefixed (factor 1 keeps the id)."""
    f = F.explode(F.array(*[F.lit(x) for x in factors])).alias("factor")
    t = rows.select(F.col(utt).cast("string").alias("utt"), F.col(dur).alias("dur"), f)
    return t.select(F.when(F.col("factor") == 1.0, F.col("utt")).otherwise(F.concat(F.lit("sp"), F.col("factor").cast("string"), F.lit("-"), F.col("utt"))).alias("utt"), F.round(F.col("dur") / F.col("factor"), 6).alias("dur"), "factor")


def map_field(col: Column, table: dict[str, str]) -> Column:
    """Constant rewrite of a field."""
    out = None
    for k, v in table.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(col)
