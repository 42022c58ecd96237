"""Family B: interval algebra on half-open intervals of integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "onset_ms", "offset_ms"


def valid(rows: DataFrame, begin: str = BEGIN, end: str = END) -> DataFrame:
    return rows.filter((F.col(begin) >= 0) & (F.col(begin) < F.col(end)))


def merge(rows: DataFrame, keys: list[str], begin: str = BEGIN, end: str = END, *, touching: bool = False, gap: int = 0) -> DataFrame:
    """Union of the intervals of each key. touching: also join intervals that only meet (or lie up to gap apart)."""
    w = Window.partitionBy(*keys).orderBy(begin, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col(begin) - gap > reach) if touching or gap else (F.col(begin) >= reach)
    t = rows.withColumn("__new", F.when(reach.isNull() | apart, 1).otherwise(0)).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(*keys, "__g").agg(F.min(begin).alias(begin), F.max(end).alias(end)).drop("__g")


def extent(*tables: DataFrame, keys: list[str], begin: str = BEGIN, end: str = END) -> DataFrame:
    """Least onset and greatest offset per key over all tables."""
    out = None
    for t in tables:
        part = t.select(*keys, begin, end)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys).agg(F.min(begin).alias(begin), F.max(end).alias(end))


def bucketed(rows: DataFrame, width: int, begin: str = BEGIN, end: str = END) -> DataFrame:
    """One row per time bucket that an interval touches: makes an overlap join an equi join of bounded buckets."""
    last = F.greatest(F.floor(F.col(begin) / width), F.floor((F.col(end) - 1) / width))
    return rows.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(begin) / width), last)))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], *, width: int = 600_000, how: str = "inner") -> DataFrame:
    """Pairs of rows of equal keys that overlap; b's interval arrives as b_begin, b_end. A pair is kept in the first bucket that
    both touch, so it occurs once."""
    left = bucketed(a, width)
    right = bucketed(b.withColumnsRenamed({BEGIN: "b_begin", END: "b_end"}), width, "b_begin", "b_end")
    out = left.join(right, [*keys, "__bucket"])
    out = out.filter((F.col(BEGIN) < F.col("b_end")) & (F.col("b_begin") < F.col(END)))
    out = out.filter(F.col("__bucket") == F.floor(F.greatest(BEGIN, "b_begin") / width)).drop("__bucket")
    if how == "left":
        return a.join(out, a.columns, "left")
    return out


def clip(rows: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Intersection with merged regions; rows of keys without a region go, one row may become several."""
    out = overlap_join(rows, merge(regions, keys), keys)
    return out.withColumns({BEGIN: F.greatest(BEGIN, "b_begin"), END: F.least(END, "b_end")}).drop("b_begin", "b_end")


def subtract(regions: DataFrame, holes: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of (merged) regions outside every hole: a sweep over boundaries with two running counters."""
    def marks(t: DataFrame, r: int, h: int) -> DataFrame:
        both = F.explode(F.array(F.struct(F.col(BEGIN).alias("t"), F.lit(r).alias("r"), F.lit(h).alias("h")), F.struct(F.col(END).alias("t"), F.lit(-r).alias("r"), F.lit(-h).alias("h"))))
        return t.select(*keys, both.alias("m")).select(*keys, "m.*")

    m = marks(regions, 1, 0).unionByName(marks(holes, 0, 1)).groupBy(*keys, "t").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    w = Window.partitionBy(*keys).orderBy("t")
    m = m.withColumns({"r": F.sum("r").over(w), "h": F.sum("h").over(w), "next": F.lead("t").over(w)})
    out = m.filter((F.col("r") > 0) & (F.col("h") == 0) & F.col("next").isNotNull()).select(*keys, F.col("t").alias(BEGIN), F.col("next").alias(END))
    return merge(out, keys, touching=True)


def collar_regions(uem: DataFrame, turns: DataFrame, keys: list[str], collar: int) -> DataFrame:
    """Regions without the collar around every boundary of the turns."""
    at = F.explode(F.array(BEGIN, END)).alias("t")
    holes = turns.select(*keys, at).select(*keys, (F.col("t") - collar).alias(BEGIN), (F.col("t") + collar).alias(END)).distinct()
    return subtract(uem, holes, keys)


def extended_zones(zones: DataFrame, words: DataFrame, segments: DataFrame, keys: list[str], extend: int, bucket: int = 600_000) -> DataFrame:
    """Exclusion zones, each extended on both sides by up to `extend`, but not over a word, nor over a begin or end of a segment. A zone that begins (ends) inside a word is not extended there; zones whose gap
    has neither and is at most twice the extension become one; the last zone of a key, with no word or boundary behind it, lasts for good (its end is null). Zones, words and segments of no length do not count.

    The nearest word end or boundary on each side is sought among those of one time bucket and its edges, so a key is many tasks, whatever its length."""
    some = lambda t: t.filter(F.col(END) > F.col(BEGIN)).select(*keys, BEGIN, END)
    z, w = merge(some(zones), keys, touching=True), merge(some(words), keys, touching=True)
    bounds = some(segments).select(*keys, F.explode(F.array(BEGIN, END)).alias("t"))
    stops = {"left": bounds.unionByName(w.select(*keys, F.col(END).alias("t"))), "right": bounds.unionByName(w.select(*keys, F.col(BEGIN).alias("t")))}
    width = max(bucket, 2 * extend + 1)

    def reach(side: str) -> DataFrame:
        """(keys, at, reach): how far the zones' begins or ends may go."""
        sign = -1 if side == "left" else 1
        ends = z.select(*keys, F.col(BEGIN if side == "left" else END).alias("at"))
        span = F.array_distinct(F.array(F.floor(F.col("t") / width), F.floor((F.col("t") - sign * extend) / width)))  # a stop counts for zones up to `extend` away
        near = stops[side].withColumn("b", F.explode(span)).select(*keys, "b", "t", F.lit(None).cast("long").alias("at"))
        both = near.unionByName(ends.select(*keys, F.floor(F.col("at") / width).alias("b"), F.col("at").alias("t"), "at"))
        order = (F.col("t") * (-sign)).asc(), F.col("at").isNotNull().asc()
        seen = Window.partitionBy(*keys, "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        stop = F.last(F.when(F.col("at").isNull(), F.col("t")), ignorenulls=True).over(seen)
        far = F.col("at") + sign * extend
        r = both.withColumn("stop", stop).filter("at is not null").select(*keys, "at", F.coalesce(F.greatest(far, "stop") if side == "left" else F.least(far, "stop"), far).alias("reach"))
        # A word that runs over the place: from before it, for ends; from it or before, for begins.
        lo = 0 if side == "left" else 1
        point = ends.select(*keys, (F.col("at") - lo).alias(BEGIN), (F.col("at") + 1).alias(END), "at")
        inside = overlap_join(point, w, keys, width=width).filter((F.col("b_begin") <= F.col(BEGIN)) & (F.col("b_end") >= F.col(END))).select(*keys, "at", F.lit(True).alias("inside")).distinct()
        return r.join(inside, [*keys, "at"], "left").select(*keys, F.col("at").alias(side), F.when(F.col("inside"), F.col("at")).otherwise(F.col("reach")).alias(f"{side}_reach"))

    out = z.withColumnsRenamed({BEGIN: "left", END: "right"}).join(reach("left"), [*keys, "left"]).join(reach("right"), [*keys, "right"])
    # What comes last in a key: a stop, or the end of a word (inside which a zone may end).
    last = stops["right"].unionByName(w.select(*keys, (F.col(END) - 1).alias("t"))).groupBy(*keys).agg(F.max("t").alias("last_stop"))
    final = z.groupBy(*keys).agg(F.max(END).alias("last_zone"))
    out = out.join(last, keys, "left").join(final, keys)
    open_ = (F.col("right") == F.col("last_zone")) & (F.coalesce(F.col("last_stop"), F.lit(-1)) < F.col("right"))
    return out.select(*keys, F.col("left_reach").alias(BEGIN), F.when(~open_, F.col("right_reach")).alias(END))


def without_zones(regions: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """Regions less zones, of which one without an end lasts for good."""
    return subtract(regions, zones.withColumn(END, F.coalesce(F.col(END), F.lit((1 << 62)))).filter(F.col(END) > F.col(BEGIN)), keys)


def crowded(turns: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Where at least so many turns run at once."""
    both = F.explode(F.array(F.struct(F.col(BEGIN).alias("t"), F.lit(1).alias("d")), F.struct(F.col(END).alias("t"), F.lit(-1).alias("d"))))
    m = turns.select(*keys, both.alias("m")).select(*keys, "m.*").groupBy(*keys, "t").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("t")
    m = m.withColumns({"n": F.sum("d").over(w), "next": F.lead("t").over(w)}).filter(F.col("n") >= least)
    return merge(m.select(*keys, F.col("t").alias(BEGIN), F.col("next").alias(END)), keys, touching=True)


def exclude_overlap(uem: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    return subtract(uem, crowded(turns, keys), keys)


def atoms(tracks: dict[str, DataFrame], uem: DataFrame, keys: list[str], who: str = "speaker_id") -> DataFrame:
    """Elementary segments inside the regions: between two neighbouring boundaries, the number of active turns of each track
    (n_<track>). Counters run along the boundaries, so no join of atoms with turns is needed."""
    names = list(tracks)

    def marks(t: DataFrame, name: str) -> DataFrame:
        unit = [F.lit(1 if n == name else 0).alias(f"n_{n}") for n in [*names, "uem"]]
        back = [F.lit(-1 if n == name else 0).alias(f"n_{n}") for n in [*names, "uem"]]
        both = F.explode(F.array(F.struct(F.col(BEGIN).alias("t"), *unit), F.struct(F.col(END).alias("t"), *back)))
        return t.select(*keys, both.alias("m")).select(*keys, "m.*")

    m = marks(uem, "uem")
    for n, t in tracks.items():
        m = m.unionByName(marks(t, n))
    every = [f"n_{n}" for n in [*names, "uem"]]
    m = m.groupBy(*keys, "t").agg(*[F.sum(c).alias(c) for c in every])
    w = Window.partitionBy(*keys).orderBy("t")
    m = m.withColumns({**{c: F.sum(c).over(w) for c in every}, "next": F.lead("t").over(w)})
    return m.filter((F.col("n_uem") > 0) & F.col("next").isNotNull()).select(*keys, F.col("t").alias(BEGIN), F.col("next").alias(END), *[f"n_{n}" for n in names])


def frame_counts(turns: DataFrame, keys: list[str], step: int = 10) -> DataFrame:
    """First frame and number of frames of each interval: frame i is on iff begin <= i * step < end."""
    first, after = F.ceil(F.col(BEGIN) / step), F.ceil(F.col(END) / step)
    return turns.withColumns({"first_frame": first.cast("long"), "n_frames": (after - first).cast("long")})


def frame_labels(turns: DataFrame, keys: list[str], step: int = 10) -> DataFrame:
    """(keys, frame): one row per frame that an interval covers."""
    t = frame_counts(turns, keys, step).filter("n_frames > 0")
    return t.select(*keys, F.explode(F.sequence("first_frame", F.col("first_frame") + F.col("n_frames") - 1)).alias("frame")).distinct()


def powerset(frames: DataFrame, keys: list[str], index: Column) -> DataFrame:
    """Per frame the sum of 2 ** index over its labels."""
    return frames.groupBy(*keys, "frame").agg(F.sum(F.expr("1L") * F.pow(F.lit(2), index).cast("long")).alias("code"))


def flatten_midpoint(rows: DataFrame, key: str, order: str, begin: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Overlapping neighbours share their overlap at its middle (doubled milliseconds stay whole)."""
    w = Window.partitionBy(key).orderBy(order)
    before, after = F.lag(end).over(w), F.lead(begin).over(w)
    lo = F.when(before > F.col(begin), (before + F.col(begin)) / 2).otherwise(F.col(begin).cast("double"))
    hi = F.when(after < F.col(end), (after + F.col(end)) / 2).otherwise(F.col(end).cast("double"))
    return rows.withColumns({"flat_begin": lo, "flat_end": hi})


def flatten_shift(rows: DataFrame, key: str, order: str, begin: str = "start_ms", end: str = "end_ms") -> DataFrame:
    after = F.lead(begin).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("flat_end", F.least(F.col(end), F.coalesce(after, F.col(end))))


def merge_labels(rows: DataFrame, key: str, label: str, begin: str, end: str) -> DataFrame:
    """Neighbours that touch and have one label become one."""
    w = Window.partitionBy(key).orderBy(begin)
    new = F.when((F.lag(label).over(w) == F.col(label)) & (F.lag(end).over(w) == F.col(begin)), 0).otherwise(1)
    t = rows.withColumn("__new", new).withColumn("__g", F.sum("__new").over(w))
    return t.groupBy(key, label, "__g").agg(F.min(begin).alias(begin), F.max(end).alias(end)).drop("__g")


def speech_activity(turns: DataFrame, extents: DataFrame, key: str, step: int = 10, tol: int = 50) -> DataFrame:
    """Frames with any turn, gaps of at most tol frames closed, the last run carried to the end if it lies within tol of it."""
    f = frame_counts(turns, [key], step).filter("n_frames > 0").select(key, F.col("first_frame").alias("b"), (F.col("first_frame") + F.col("n_frames")).alias("e"))
    m = merge(f, [key], "b", "e", touching=True, gap=tol)
    n = extents.select(key, F.ceil(F.col(END) / step).cast("long").alias("n"))
    m = m.join(n, key)
    last = F.max("b").over(Window.partitionBy(key)) == F.col("b")
    return m.select(key, F.col("b").alias("first_frame"), F.when(last & (F.col("e") + tol >= F.col("n")), F.col("n")).otherwise(F.col("e")).alias("end_frame"))


def best_overlap(segments: DataFrame, turns: DataFrame, keys: list[str], segment: list[str], who: str = "speaker_id") -> DataFrame:
    """Per segment the label with the most overlap (ties to the least label); segments without overlap have '0'."""
    over = overlap_join(segments, turns.select(*keys, who, BEGIN, END), keys)
    dur = F.least(END, "b_end") - F.greatest(BEGIN, "b_begin")
    n = over.groupBy(*keys, *segment, who).agg(F.sum(dur).alias("o"))
    best = n.groupBy(*keys, *segment).agg(F.max(F.struct("o", who)).alias("top"), F.min(F.struct((-F.col("o")).alias("o"), F.col(who).alias("w"))).alias("b"))
    best = best.select(*keys, *segment, F.col("b.w").alias("label"), (-F.col("b.o")).alias("overlap_ms"))
    return segments.select(*keys, *segment).join(best, [*keys, *segment], "left").select(*keys, *segment, F.coalesce("label", F.lit("0")).alias("label"), F.coalesce("overlap_ms", F.lit(0)).cast("long").alias("overlap_ms"))


def overlap_labels(segments: DataFrame, turns: DataFrame, keys: list[str], segment: list[str], threshold: int, who: str = "speaker_id") -> DataFrame:
    """All labels that overlap a segment by its length or by the threshold, whichever is less."""
    over = overlap_join(segments, turns.select(*keys, who, BEGIN, END), keys)
    dur = F.least(END, "b_end") - F.greatest(BEGIN, "b_begin")
    return over.filter(dur >= F.least(F.col(END) - F.col(BEGIN), F.lit(threshold))).select(*keys, *segment, who).distinct()


def uniform_subsegments(rows: DataFrame, keys: list[str], longest: int = 30_000, overlap: int = 5_000, remainder: int = 10_000) -> DataFrame:
    """Windows of longest ms every (longest - overlap) ms; a remainder shorter than the given one joins the last window."""
    step, dur = longest - overlap, F.col(END) - F.col(BEGIN)
    # a window starts while more than longest + remainder ms are left behind its start
    n = F.greatest(F.lit(0), F.ceil((dur - longest - remainder) / step)).cast("long")
    t = rows.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n"))))
    lo = F.col(BEGIN) + F.col("__i") * step
    return t.select(*keys, F.col("__i").alias("part"), lo.alias("sub_begin"), F.when(F.col("__i") < F.col("__n"), lo + longest).otherwise(F.col(END)).alias("sub_end"))


def sliding(rows: DataFrame, keys: list[str], window: int = 1500, period: int = 750) -> DataFrame:
    """Windows every period ms; the last one ends at the interval's end, a shorter interval is one window."""
    dur = F.col(END) - F.col(BEGIN)
    n = F.greatest(F.lit(0), F.ceil((dur - window) / period)).cast("long")
    t = rows.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n"))))
    lo = F.greatest(F.col(BEGIN), F.least(F.col(BEGIN) + F.col("__i") * period, F.col(END) - window))
    return t.select(*keys, F.col("__i").alias("part"), lo.alias("sub_begin"), F.least(lo + window, F.col(END)).alias("sub_end"))


def pad_and_resolve(rows: DataFrame, key: str, order: str, pad: int, begin: str = BEGIN, end: str = END) -> DataFrame:
    """Intervals padded on both sides; an overlap that padding makes is cut at its middle."""
    t = rows.withColumns({"__b": F.greatest(F.lit(0), F.col(begin) - pad), "__e": F.col(end) + pad})
    w = Window.partitionBy(key).orderBy(order)
    before, after = F.lag("__e").over(w), F.lead("__b").over(w)
    lo = F.when(before > F.col("__b"), (before + F.col("__b")) / 2).otherwise(F.col("__b").cast("double"))
    hi = F.when(after < F.col("__e"), (after + F.col("__e")) / 2).otherwise(F.col("__e").cast("double"))
    return t.withColumns({"pad_begin": lo, "pad_end": hi}).drop("__b", "__e")


def shift_to_recording(words: DataFrame, segments: DataFrame, utt: str, start: str) -> DataFrame:
    """Times relative to an utterance become relative to its recording."""
    return words.join(segments.select(utt, "reco", F.col(start).alias("__s")), utt).withColumn("start_ms", F.col("start_ms") + F.col("__s")).drop("__s")


def contained_in(points: DataFrame, regions: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Points that lie in a region."""
    p = points.withColumns({BEGIN: F.col(at), END: F.col(at) + 1})
    hit = overlap_join(p, regions.select(*keys, BEGIN, END), keys)
    return hit.select(*points.columns).distinct()


def resolve_word_overlaps(words: DataFrame, utterances: DataFrame) -> DataFrame:
    """words (utt, pos, start_ms from the utterance's begin, dur_ms, ..) less those that overlapping neighbours also hold; utterances: (reco, utt, start_ms, end_ms), in order of start (ties: utt) within a recording;
    those without words do not count. Of two neighbours the former keeps its words before the first whose middle lies behind the middle of their overlap, the latter those from the first such word on.
    A latter utterance that ends inside the former is emptied and leaves it whole; one without such a word is emptied too. What was emptied cuts nothing.

    Whether an utterance was emptied depends on whether the one before was. That alternates along runs of utterances that would be emptied by a live neighbour, so parity within a run tells, without a fold."""
    held = words.select("utt").distinct()
    u = utterances.join(held, "utt", "left_semi").select("reco", "utt", "start_ms", "end_ms")
    w = Window.partitionBy("reco").orderBy("start_ms", "utt")
    before = F.lag("end_ms").over(w) - F.col("start_ms")  # overlap with the one before; not positive where there is none
    u = u.select("*", before.alias("own"), (F.lag("end_ms").over(w) >= F.col("end_ms")).alias("ends_inside"), (F.col("end_ms") - F.lead("start_ms").over(w)).alias("ahead"), (F.lead("end_ms").over(w) <= F.col("end_ms")).alias("holds_next"))
    middle = 2 * F.col("w.start_ms") + F.col("w.dur_ms")
    first = words.alias("w").join(u.select("utt", "own"), "utt").groupBy("utt").agg(F.min(F.when(middle > F.col("own"), F.col("pos"))).alias("from_pos"))
    u = u.join(first, "utt")
    dies = F.coalesce(((F.col("own") > 0) & F.col("ends_inside")) | F.col("from_pos").isNull(), F.lit(False)) & F.col("own").isNotNull()
    u = u.withColumn("dies", dies).withColumn("run", F.sum(F.when(F.col("dies"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    u = u.withColumn("empty", F.sum(F.col("dies").cast("int")).over(Window.partitionBy("reco", "run").orderBy("start_ms", "utt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) % 2 == 1)
    u = u.withColumn("cut_before", F.coalesce(~F.lag("empty").over(w), F.lit(False)))
    live = u.filter("not empty").select(
        "utt", F.when(F.col("cut_before"), F.col("from_pos")).alias("from_pos"),
        F.when(F.col("ahead").isNotNull() & ~F.coalesce((F.col("ahead") > 0) & F.col("holds_next"), F.lit(False)), 2 * (F.col("end_ms") - F.col("start_ms")) - F.col("ahead")).alias("until"),
    )
    kept = words.alias("w").join(live, "utt").filter(F.col("from_pos").isNull() | (F.col("pos") >= F.col("from_pos")))
    stop = kept.groupBy("utt").agg(F.min(F.when(middle > F.col("until"), F.col("pos"))).alias("stop"))
    return kept.join(stop, "utt").filter(F.col("stop").isNull() | (F.col("pos") < F.col("stop"))).select(*words.columns)
