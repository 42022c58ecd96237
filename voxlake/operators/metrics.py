"""Family D: clustering, segmentation and detection metrics. Everything large is a grouped aggregate; what is left at the end is one
row per file, label pair or threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators.components import connected_components
from voxlake.session import stash


def contingency(rows: DataFrame, keys: list[str], ref: str, sys: str) -> DataFrame:
    """(keys, ref, sys, n)."""
    return rows.groupBy(*keys, F.col(ref).alias("ref"), F.col(sys).alias("sys")).agg(F.count("*").alias("n"))


def frame_contingency(ref: DataFrame, sys: DataFrame, key: str, who: str, step: int) -> DataFrame:
    """(key, ref, sys, n): frames that a speaker of either side covers. The hint keeps frames from being broadcast: Spark takes them to be as few as the turns that they come from."""
    from voxlake.operators.intervals import frame_labels

    frames = lambda t, c: frame_labels(t, [key, who], step).withColumnRenamed(who, c)
    return contingency(frames(ref, "ref").join(frames(sys, "sys").hint("merge"), [key, "frame"]), [key], "ref", "sys")


def with_margins(c: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "ref"), Window.partitionBy(*keys, "sys"), Window.partitionBy(*keys)
    return c.withColumns({"nr": F.sum("n").over(w[0]), "ns": F.sum("n").over(w[1]), "nn": F.sum("n").over(w[2])})


def _f(p, r):
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def pairwise(c: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F over pairs of items of one cluster."""
    def pairs(by: list[str], name: str) -> DataFrame:
        n = c.groupBy(*keys, *by).agg(F.sum("n").alias("n"))
        return n.groupBy(*keys).agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1)).alias(name))

    t = pairs(["ref", "sys"], "both").join(pairs(["ref"], "r"), keys).join(pairs(["sys"], "s"), keys)
    p, r = F.coalesce(F.try_divide(F.col("both"), F.col("s")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("both"), F.col("r")), F.lit(0.0))
    return t.select(*keys, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(_f(p, r), 6).alias("f"))


def bcubed(c: DataFrame, keys: list[str]) -> DataFrame:
    m = with_margins(c, keys)
    n2 = F.col("n").cast("double") * F.col("n")
    t = m.groupBy(*keys).agg((F.sum(n2 / F.col("ns")) / F.max("nn")).alias("p"), (F.sum(n2 / F.col("nr")) / F.max("nn")).alias("r"))
    return t.select(*keys, F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(_f(F.col("p"), F.col("r")), 6).alias("f"))


def _entropies(c: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: h_ref, h_sys, mi in bits, and the numbers of classes."""
    m = with_margins(c, keys)
    n, nn = F.col("n").cast("double"), F.col("nn")
    mi = F.sum(n / nn * F.log2(n * nn / (F.col("nr").cast("double") * F.col("ns"))))

    # each margin's term is spread over its cells in proportion, so one pass does
    h = lambda x: -F.sum(n / nn * F.log2(F.col(x) / nn))
    return m.groupBy(*keys).agg(h("nr").alias("h_ref"), h("ns").alias("h_sys"), mi.alias("mi"), F.countDistinct("ref").alias("k_ref"), F.countDistinct("sys").alias("k_sys"))


def _information() -> list:
    one = (F.col("k_ref") == 1) & (F.col("k_sys") == 1)

    def nmi(d):
        return F.round(F.when(one, 1.0).when((F.col("k_ref") == 1) | (F.col("k_sys") == 1), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("mi")) / d), 6)

    a, b = F.col("h_ref"), F.col("h_sys")
    return [F.round("mi", 6).alias("mi"), nmi(F.least(a, b)).alias("nmi_min"), nmi((a + b) / 2).alias("nmi_sum"), nmi(F.sqrt(a * b)).alias("nmi_sqrt"), nmi(F.greatest(a, b)).alias("nmi_max")]


def mutual_information(c: DataFrame, keys: list[str]) -> DataFrame:
    """mi (bits) and nmi by min, sum, sqrt and max; two single classes agree fully, one single class not at all."""
    return _entropies(c, keys).select(*keys, *_information())


def _conditional() -> list:
    up = lambda x: F.round(F.greatest(F.lit(0.0), x), 6)
    return [up(F.col("h_ref") - F.col("mi")).alias("h_ref_given_sys"), up(F.col("h_sys") - F.col("mi")).alias("h_sys_given_ref")]


def conditional_entropy(c: DataFrame, keys: list[str]) -> DataFrame:
    return _entropies(c, keys).select(*keys, *_conditional())


def _tau() -> list:
    tau = lambda inside, own, k: F.round(F.when(F.col(k) == 1, 1.0).otherwise((F.col(inside) - F.col(own)) / (1 - F.col(own))), 6)
    return [tau("in_ref", "ss", "k_sys").alias("tau_sys_given_ref"), tau("in_sys", "rr", "k_ref").alias("tau_ref_given_sys")]


def goodman_kruskal(c: DataFrame, keys: list[str]) -> DataFrame:
    """tau of predicting sys from ref and ref from sys; 1 where the predicted side has one class."""
    m = with_margins(c, keys)
    n, nn = F.col("n").cast("double"), F.col("nn").cast("double")
    v = m.groupBy(*keys).agg(
        F.sum(n * n / (F.col("nr") * nn)).alias("in_ref"), F.sum(n * n / (F.col("ns") * nn)).alias("in_sys"),
        F.sum(n * F.col("ns") / (nn * nn)).alias("ss"), F.sum(n * F.col("nr") / (nn * nn)).alias("rr"), F.countDistinct("ref").alias("k_ref"), F.countDistinct("sys").alias("k_sys"),
    )
    return v.select(*keys, *_tau())


def cluster_scores(c: DataFrame, keys: list[str]) -> DataFrame:
    """bcubed(), mutual_information(), conditional_entropy() and goodman_kruskal() side by side (B-cubed as b3_*), from one pass over the cells: four plans that are joined hold the margins four times."""
    k = [F.col(x) for x in keys]
    one = with_margins(c, keys).select(F.struct(*k).alias("k"), "ref", "sys", "n", "nr", "ns", "nn")
    n, nn, nr, ns = (F.col(x).cast("double") for x in ("n", "nn", "nr", "ns"))
    h = lambda x: -F.sum(n / nn * F.log2(x / nn))
    t = one.groupBy("k").agg(
        (F.sum(n * n / ns) / F.max("nn")).alias("p"), (F.sum(n * n / nr) / F.max("nn")).alias("r"), h(nr).alias("h_ref"), h(ns).alias("h_sys"), F.sum(n / nn * F.log2(n * nn / (nr * ns))).alias("mi"),
        F.countDistinct("ref").alias("k_ref"), F.countDistinct("sys").alias("k_sys"),
        F.sum(n * n / (nr * nn)).alias("in_ref"), F.sum(n * n / (ns * nn)).alias("in_sys"), F.sum(n * ns / (nn * nn)).alias("ss"), F.sum(n * nr / (nn * nn)).alias("rr"),
    )
    b3 = [F.round("p", 6).alias("b3_precision"), F.round("r", 6).alias("b3_recall"), F.round(_f(F.col("p"), F.col("r")), 6).alias("b3_f")]
    return t.select("k.*", *b3, *_information(), *_conditional(), *_tau())


def v_measure(c: DataFrame, keys: list[str]) -> DataFrame:
    """Homogeneity, completeness, their harmonic mean, and Fowlkes-Mallows."""
    t = _entropies(c, keys)
    ratio = lambda h: F.when(h == 0, 1.0).otherwise(F.col("mi") / h)
    v = t.select(*keys, ratio(F.col("h_ref")).alias("h"), ratio(F.col("h_sys")).alias("c"))
    def pairs(by: list[str], name: str) -> DataFrame:
        return c.groupBy(*keys, *by).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1)).alias(name))

    p = pairs(["ref", "sys"], "tp").join(pairs(["ref"], "r"), keys).join(pairs(["sys"], "s"), keys)
    fm = F.coalesce(F.try_divide(F.col("tp"), F.sqrt(F.col("r") * F.col("s"))), F.lit(0.0))
    return v.join(p, keys).select(*keys, F.round("h", 6).alias("homogeneity"), F.round("c", 6).alias("completeness"), F.round(_f(F.col("h"), F.col("c")), 6).alias("v_measure"), F.round(fm, 6).alias("fowlkes_mallows"))


def binary_scores(rows: DataFrame, truth: str, said: str) -> DataFrame:
    t, s = F.col(truth).cast("int"), F.col(said).cast("int")
    tp = F.sum(t * s)
    return rows.agg(F.round(F.avg((t == s).cast("double")), 6).alias("accuracy"), F.round(F.try_divide(tp, F.sum(s)), 6).alias("precision"), F.round(F.try_divide(tp, F.sum(t)), 6).alias("recall"))


def overlap_matrix(ref: DataFrame, sys: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ref, sys, ms): common time of each pair of speakers."""
    from voxlake.operators.intervals import overlap_join

    a = ref.withColumnRenamed("speaker_id", "ref")
    both = overlap_join(a, sys.withColumnRenamed("speaker_id", "sys"), keys)
    return both.groupBy(*keys, "ref", "sys").agg(F.sum(F.least("offset_ms", "b_end") - F.greatest("onset_ms", "b_begin")).alias("ms"))


def hungarian(cost):
    """Least-cost assignment of rows to columns (rows <= columns): column per row. Shortest augmenting paths with potentials."""
    import numpy as np

    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row = match[j]
            free = ~used
            free[0] = False
            reduced = cost[row - 1] - u[row] - v[1:]
            better = free[1:] & (reduced < low[1:])
            low[1:][better] = reduced[better]
            way[1:][better] = j
            k = 1 + int(np.argmin(np.where(free[1:], low[1:], np.inf)))
            step = low[k]
            u[match[used]] += step
            v[used] -= step
            low[free] -= step
            j = k
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def sparse_matching(edges: list[list[tuple[int, float]]]) -> list[int]:
    """Matching of greatest total weight, both sides free to stay unmatched: each row's column, or -1. edges: per row its (column, weight), weights above 0; absent pairs cost no memory.
    Rows join one after another along the cheapest alternating path, found by reduced costs in order of distance; every row also has a column of its own that is worth nothing."""
    import heapq

    potential: dict[int, float] = {}
    height = [-max((w for _, w in e), default=0) for e in edges]
    owner: dict[int, int] = {}
    match = [-1] * len(edges)
    for start in range(len(edges)):
        dist: dict[int, float] = {}
        back: dict[int, int] = {}
        settled: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        row, base = start, 0
        while True:
            for column, w in (*edges[row], (-1 - row, 0)):
                if column not in settled:
                    d = base - w - height[row] - potential.get(column, 0)
                    if column not in dist or d < dist[column]:
                        dist[column], back[column] = d, row
                        heapq.heappush(heap, (d, column))
            d, column = heapq.heappop(heap)
            while column in settled or d > dist[column]:
                d, column = heapq.heappop(heap)
            if column not in owner:
                break
            settled[column] = d
            row, base = owner[column], d
        for c, at in settled.items():
            potential[c] = potential.get(c, 0) + at - d
            height[owner[c]] += d - at
        height[start] += d
        while True:
            row = back[column]
            owner[column], column, match[row] = row, match[row], column
            if row == start:
                break
    return [c if c >= 0 else -1 for c in match]


#: Pairs of one task's connected parts, about.
PAIRS = 20_000


def best_mapping(matrix: DataFrame, key: str, weight: str, *, by_component: bool = False) -> DataFrame:
    """One-to-one mapping of ref to sys of greatest total weight per key: (key, ref, sys, weight), pairs of weight > 0, of which only those given are held. A group is one recording's pairs or, by component, some connected
    parts of all, so that a recording of very many speakers or events is many tasks."""
    import pandas as pd

    of = dict(matrix.dtypes)
    rows = matrix.select(key, "ref", "sys", weight).filter(F.col(weight) > 0)
    group = key
    if by_component:
        rows = stash(rows.withColumns({"a": F.xxhash64(key, F.lit("ref"), "ref"), "b": F.xxhash64(key, F.lit("sys"), "sys")}), "matching")  # a collision only joins two parts
        parts = rows.count() // PAIRS + 1
        rows = rows.join(connected_components(rows, "a", "b").withColumnRenamed("node", "a"), "a").withColumn("part", F.pmod(F.xxhash64("component"), F.lit(parts))).drop("a", "b", "component")
        group = "part"

    def solve(t: pd.DataFrame) -> pd.DataFrame:
        t = t.drop_duplicates([key, "ref", "sys"]).sort_values([key, "ref", "sys"], ignore_index=True)
        ref = pd.factorize(pd.MultiIndex.from_frame(t[[key, "ref"]]))[0]
        sys = pd.factorize(pd.MultiIndex.from_frame(t[[key, "sys"]]))[0]
        edges: list[list[tuple[int, float]]] = [[] for _ in range(ref.max() + 1)]
        place = {}
        for k, (i, j, w) in enumerate(zip(ref.tolist(), sys.tolist(), t[weight].tolist(), strict=True)):
            edges[i].append((j, w))
            place[i, j] = k
        return t.loc[[place[i, j] for i, j in enumerate(sparse_matching(edges)) if j >= 0], [key, "ref", "sys", weight]]

    return rows.groupBy(group).applyInPandas(solve, f"{key} {of[key]}, ref {of['ref']}, sys {of['sys']}, {weight} {of[weight]}")


#: Turns of one task's spans, about.
TURNS = 20_000


#: Pairs of a span that are held as objects, at most; those of a denser span are made from its times whenever they are read.
HELD = 1_000_000


class SpanEdges(Sequence):
    """Edges for sparse_matching() of a span's turns (turn, onset_ms, offset_ms): ref and sys are the turns of its rows and columns that have common time, in order of turns and of their first pairs."""

    def __init__(self, r, s, held: int = HELD):
        import numpy as np

        r, s = r.sort_values("turn"), s.sort_values("onset_ms")
        (self._b, self._e, x), (self._sb, self._se, self._y) = ((t.onset_ms.to_numpy(), t.offset_ms.to_numpy(), t.turn.to_numpy()) for t in (r, s))
        self._lo, self._hi = np.searchsorted(np.maximum.accumulate(self._se), self._b, "right"), np.searchsorted(self._sb, self._e)  # those that begin before its end, from the first that reaches over its begin
        self._number, self._kept, rows, columns = np.full(len(s), -1), None, [], []
        for i in range(len(r)):
            at, _ = self._met(i)
            if len(at):
                rows.append(i)
                new = at[self._number[at] < 0]
                self._number[new] = np.arange(len(columns), len(columns) + len(new))
                columns += new.tolist()
        self._rows, self.ref, self.sys = rows, x[np.array(rows, int)], self._y[np.array(columns, int)]
        if np.maximum(self._hi - self._lo, 0).sum() <= held:
            self._kept = [self[k] for k in range(len(rows))]

    def _met(self, i: int):
        """Places and common times of the turns that row i meets, in order of turns."""
        import numpy as np

        near = slice(self._lo[i], max(self._lo[i], self._hi[i]))
        ms = np.minimum(self._e[i], self._se[near]) - np.maximum(self._b[i], self._sb[near])
        at = np.flatnonzero(ms > 0)
        at = at[np.argsort(self._y[near][at], kind="stable")]
        return at + self._lo[i], ms[at]

    def __len__(self) -> int:
        return len(self._rows)

    def __getitem__(self, k: int) -> list[tuple[int, int]]:
        if self._kept is not None:
            return self._kept[k]
        at, ms = self._met(self._rows[k])
        return list(zip(self._number[at].tolist(), ms.tolist(), strict=True))


def match_turns(ref: DataFrame, sys: DataFrame, key: str, turn: str = "turn_id") -> DataFrame:
    """(key, ref, sys, ms): turns of both sides matched one to one by greatest total common time; turn tells the turns of a key and side apart. As best_mapping() of overlap_matrix() by component, but pairs are made in the
    task that matches them and are neither written nor shuffled: turns of different spans, stretches of a key without a pause on both sides, have no time in common. A span is in one task, which holds its turns and, where they are few, its pairs."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    side = lambda t, n: t.filter("offset_ms > onset_ms").select(key, F.lit(n).alias("side"), F.col(turn).alias("turn"), "onset_ms", "offset_ms")
    w = Window.partitionBy(key).orderBy("onset_ms", "offset_ms", "side", "turn")
    reach = F.max("offset_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = side(ref, 0).unionByName(side(sys, 1)).withColumn("span", F.when(F.col("onset_ms") >= reach, 1).otherwise(0))
    rows = rows.withColumn("span", F.sum("span").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = (ref.count() + sys.count()) // TURNS + 1
    of = {f.name: f.dataType for f in rows.schema}

    def solve(t: pd.DataFrame) -> pd.DataFrame:
        keys, refs, syss, common = [], [], [], []
        for (k, _), span in t.groupby([key, "span"]):
            edges = SpanEdges(span[span.side == 0], span[span.side == 1])
            best = [(a, b) for a, b in enumerate(sparse_matching(edges)) if b >= 0]
            keys += [k] * len(best)
            refs += edges.ref[[a for a, _ in best]].tolist()
            syss += edges.sys[[b for _, b in best]].tolist()
            common += [next(w for c, w in edges[a] if c == b) for a, b in best]
        return pd.DataFrame({key: pd.Series(keys, dtype=object), "ref": pd.Series(refs, dtype=object), "sys": pd.Series(syss, dtype=object), "ms": pd.Series(common, dtype=np.int64)})

    schema = T.StructType([T.StructField(key, of[key]), T.StructField("ref", of["turn"]), T.StructField("sys", of["turn"]), T.StructField("ms", T.LongType())])
    return rows.withColumn("part", F.pmod(F.xxhash64(key, "span"), F.lit(parts))).groupBy("part").applyInPandas(solve, schema)


def der(atoms: DataFrame, mapped: DataFrame, uem: DataFrame) -> DataFrame:
    """Per file: scored, missed, false alarm and confused time, and the error rate in percent. mapped: (file_id, ms), the scored time in which a
    reference speaker and its image speak together."""
    dur = F.col("offset_ms") - F.col("onset_ms")
    r, s = F.col("n_ref"), F.col("n_sys")
    a = atoms.groupBy("file_id").agg(
        F.sum(dur * r).alias("scored"), F.sum(dur * F.greatest(r - s, F.lit(0))).alias("miss"), F.sum(dur * F.greatest(s - r, F.lit(0))).alias("fa"), F.sum(dur * F.least(r, s)).alias("common")
    )
    z = F.lit(0).cast("long")
    t = uem.select("file_id").distinct().join(a, "file_id", "left").join(mapped, "file_id", "left")
    t = t.select("file_id", *[F.coalesce(c, z).alias(c) for c in ("scored", "miss", "fa", "common")], F.coalesce("ms", z).alias("ms")).withColumn("error", F.col("common") - F.col("ms"))
    return t.select("file_id", "scored", "miss", "fa", "error", error_rate().alias("der"))


def error_rate():
    wrong = F.col("miss") + F.col("fa") + F.col("error")
    return F.round(F.when(F.col("scored") == 0, F.when(wrong == 0, 0.0).otherwise(100.0)).otherwise(100.0 * wrong / F.when(F.col("scored") > 0, F.col("scored"))), 6)


def jaccard_error(matrix: DataFrame, ref_total: DataFrame, sys_total: DataFrame) -> DataFrame:
    """Per file the mean over reference speakers of 1 - intersection / union under the best one-to-one mapping, in percent.
    matrix: (file_id, ref, sys, ms); totals: (file_id, ref | sys, ms)."""
    m = matrix.join(ref_total.withColumnRenamed("ms", "a"), ["file_id", "ref"]).join(sys_total.withColumnRenamed("ms", "b"), ["file_id", "sys"])
    m = m.withColumn("j", F.col("ms") / (F.col("a") + F.col("b") - F.col("ms")))
    best = best_mapping(m, "file_id", "j")
    t = ref_total.select("file_id", "ref").join(best.select("file_id", "ref", "j"), ["file_id", "ref"], "left")
    return t.groupBy("file_id").agg(F.round(100 * F.avg(1 - F.coalesce("j", F.lit(0.0))), 6).alias("jer"))


def roc_auc(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """Area under ROC (ties count half), average precision, recall at 0.5. Scores are grouped first: ranks run over distinct values."""
    g = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.sum(1 - F.col(truth).cast("long")).alias("q"))
    up, down = Window.orderBy("s"), Window.orderBy(F.desc("s"))
    t = g.withColumns({"q_below": F.sum("q").over(up) - F.col("q"), "p_above": F.sum("p").over(down), "q_above": F.sum("q").over(down)})
    auc = F.sum(F.col("p") * (F.col("q_below") + F.col("q") / 2)) / (F.sum("p").cast("double") * F.sum("q"))
    ap = F.sum(F.col("p") * F.col("p_above") / (F.col("p_above") + F.col("q_above"))) / F.sum("p")
    return t.agg(F.round(auc, 6).alias("auc"), F.round(ap, 6).alias("average_precision"), F.round(F.sum(F.when(F.col("s") >= 0.5, F.col("p")).otherwise(0)) / F.sum("p"), 6).alias("recall_at_half"))


def detection_costs(atoms: DataFrame, keys: list[str], miss: float = 0.75, fa: float = 0.25, *, ieee: bool = False) -> DataFrame:
    """Speech activity: DCF, detection error, accuracy and rates in percent from atoms with n_ref and n_sys. Rates of no time at all are 0 or, with ieee, what floating-point division gives: not a number, or infinite."""
    dur = (F.col("offset_ms") - F.col("onset_ms")).cast("double")
    r, s = F.col("n_ref") > 0, F.col("n_sys") > 0
    part = lambda c: F.sum(F.when(c, dur).otherwise(0.0))
    t = atoms.groupBy(*keys).agg(part(r & s).alias("tp"), part(r & ~s).alias("fn"), part(~r & s).alias("fp"), part(~r & ~s).alias("tn"))
    by_zero = lambda a: F.when(a > 0, float("inf")).otherwise(float("nan")) if ieee else F.lit(0.0)
    z = lambda a, b: F.coalesce(F.try_divide(a, b), by_zero(a))
    fnr, fpr = z(F.col("fn"), F.col("tp") + F.col("fn")), z(F.col("fp"), F.col("fp") + F.col("tn"))
    return t.select(
        *keys, F.round(100 * (miss * fnr + fa * fpr), 6).alias("dcf"), F.round(100 * z(F.col("fn") + F.col("fp"), F.col("tp") + F.col("fn")), 6).alias("der"),
        F.round(100 * z(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 6).alias("accuracy"), F.round(100 * fnr, 6).alias("miss_rate"), F.round(100 * fpr, 6).alias("fa_rate"),
    )


def wer_ops(pairs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp", eps: str = "<eps>") -> DataFrame:
    """C, S, I, D counts of aligned word pairs, words and errors."""
    op = F.when(F.col(ref) == F.col(hyp), "C").when(F.col(ref) == eps, "I").when(F.col(hyp) == eps, "D").otherwise("S")
    n = lambda x: F.sum(F.when(op == x, 1).otherwise(0)).cast("long")
    t = pairs.filter((F.col(ref) != eps) | (F.col(hyp) != eps)).groupBy(*keys).agg(n("C").alias("c"), n("S").alias("s"), n("I").alias("i"), n("D").alias("d"))
    return t.withColumns({"words": F.col("c") + F.col("s") + F.col("d"), "errors": F.col("s") + F.col("i") + F.col("d")})


def wer_rollup(ops: DataFrame, speaker: str) -> DataFrame:
    """Per speaker and SUM: counts, words, errors and the rate in percent."""
    s = ["c", "s", "i", "d", "words", "errors"]
    t = ops.rollup(speaker).agg(*[F.sum(c).alias(c) for c in s])
    return t.select(F.coalesce(F.col(speaker).cast("string"), F.lit("SUM")).alias("speaker"), *s, F.round(F.coalesce(F.try_divide(100.0 * F.col("errors"), F.col("words")), F.lit(0.0)), 6).alias("wer"))


def score_lines(scores: DataFrame) -> DataFrame:
    """(file_id, line): a line of error rates per file and one over all files: totals for DER, the mean over files for JER. scores: file_id, scored, miss, fa, error, der, jer."""
    name = "*** OVERALL ***"
    total = scores.agg((100.0 * F.sum(F.col("miss") + F.col("fa") + F.col("error")) / F.sum("scored")).alias("der"), F.avg("jer").alias("jer"))
    rows = scores.select("file_id", "der", "jer").unionByName(total.select(F.lit(name).alias("file_id"), "der", "jer"))
    return rows.select("file_id", F.format_string("%-12s %8.2f %8.2f", "file_id", "der", "jer").alias("line"))


def type_confusion(pairs: DataFrame) -> DataFrame:
    """(ref_type, sys_type, pairs, ms, percent): confusion of speaker types by number of speaker pairs and by their time, with the share of the reference type's time. pairs: ref_type, sys_type, ms."""
    t = pairs.groupBy("ref_type", "sys_type").agg(F.count("*").alias("pairs"), F.sum("ms").alias("ms"))
    return t.withColumn("percent", F.round(100.0 * F.col("ms") / F.sum("ms").over(Window.partitionBy("ref_type")), 4))
