"""Operators that are ordered folds, dynamic programs or fits: grouped kernels over one speaker, recording or utterance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators.tables import previous, running_sum, slices, with_rank
from voxlake.session import stash


def pseudo_by_seconds(rows: DataFrame, spk: str, utt: str, dur: str, most: float) -> DataFrame:
    """Speakers cut into parts whose summed duration restarts when it would pass most. (spk, utt, part)."""
    kinds = dict(rows.dtypes)

    def fold(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(utt)
        part, total, out = 0, 0.0, []
        for v in t[dur]:
            if total and total + v > most:
                part, total = part + 1, 0.0
            total += v
            out.append(part)
        return pd.DataFrame({spk: t[spk], utt: t[utt], "part": out})

    return rows.select(spk, utt, dur).groupBy(spk).applyInPandas(fold, f"{spk} {kinds[spk]}, {utt} {kinds[utt]}, part long")


def even_subset(rows: DataFrame, order: str, n: int) -> DataFrame:
    """n rows spread evenly by halving ranges of places. A row is in if it begins a range that needs one: each place follows its own halvings, so no list
    of places is made."""
    total = rows.count()
    t = with_rank(rows, order)
    lo, hi, need = F.lit(0).cast("long"), F.lit(total).cast("long"), F.lit(n).cast("long")
    state = F.struct(lo.alias("lo"), hi.alias("hi"), need.alias("need"))

    def halve(s, _):
        mid = s["lo"] + F.floor((s["hi"] - s["lo"]) / 2).cast("long")
        few = F.floor(s["need"] / 2).cast("long")
        down = F.col("__rank") < mid
        half = F.struct(F.when(down, s["lo"]).otherwise(mid).alias("lo"), F.when(down, mid).otherwise(s["hi"]).alias("hi"), F.when(down, few).otherwise(s["need"] - few).alias("need"))
        return F.when(s["need"] > 1, half).otherwise(s)

    end = F.aggregate(F.array_repeat(F.lit(0), max(1, n.bit_length() + 1)), state, halve)
    return t.withColumn("__end", end).filter((F.col("__end.need") == 1) & (F.col("__end.lo") == F.col("__rank"))).drop("__rank", "__end")


def settle_edges(sizes: list[int], edges: list[int], count_at) -> list[int]:
    """Moves speakers over the edges of neighbouring parts while that brings their sizes closer. Part p holds places edges[p] to edges[p + 1] - 1; its last speaker is
    offered to the next part, then its first to the one before, part by part until a whole round changes nothing."""
    parts, moved = len(sizes), True
    while moved:
        moved = False
        for p in range(parts):
            for other, edge, step in ((p + 1, p + 1, -1), (p - 1, p, 1)):
                if not 0 <= other < parts or edges[p] == edges[p + 1]:
                    continue
                n = count_at(edges[edge] - 1 if step < 0 else edges[edge])
                if abs(sizes[other] - sizes[p] + 2 * n) < abs(sizes[other] - sizes[p]):
                    sizes[p], sizes[other], moved = sizes[p] - n, sizes[other] + n, True
                    edges[edge] += step
    return edges


def balanced_split(rows: DataFrame, spk: str, parts: int, chunk: int = 4096) -> DataFrame:
    """(spk, n, part): contiguous runs of speakers: as many speakers each, then speakers at the edges move while sizes come closer. The driver
    sees one size a part and the counts of the chunks of speakers that edges run through."""
    t = with_rank(rows.groupBy(spk).agg(F.count("*").alias("n")), spk)
    t = stash(t.withColumn("__chunk", F.floor(F.col("__rank") / chunk)), "speakers")
    total = t.count()
    if total < parts:
        raise ValueError(f"{total} speakers are fewer than {parts} parts")
    edges = [-(-p * total // parts) for p in range(parts + 1)]
    first = F.floor(F.col("__rank") * parts / total)
    size = {r["p"]: r["s"] for r in t.groupBy(first.alias("p")).agg(F.sum("n").alias("s")).collect()}  # one row a part
    known: dict[int, dict[int, int]] = {}

    def count_at(place: int) -> int:
        c = place // chunk
        if c not in known:
            known[c] = {r["__rank"]: r["n"] for r in t.filter(F.col("__chunk") == c).select("__rank", "n").collect()}
        return known[c][place]

    for p in range(1, parts):
        count_at(min(edges[p], total - 1))
    edges = settle_edges([size.get(p, 0) for p in range(parts)], edges, count_at)
    part = sum((F.col("__rank") >= e).cast("int") for e in edges[1:-1]) if parts > 1 else F.lit(0)
    return t.select(spk, "n", part.alias("part"))


#: Fixed value: durations closer than this are equal.
SLACK = 1.0e-5
#: Islands that one call folds.
ISLANDS = 1000


def join_short(durations, least: float) -> list[int]:
    """For each item the first item of its group. Short groups, the last first, join a neighbour until none is short or one is left: the only neighbour that makes
    them long enough, the shorter one if both do (right if they are equal), else the right one."""
    n = len(durations)
    size, stop, first, gone = [float(d) for d in durations], list(range(1, n + 1)), list(range(n)), [False] * n  # first: by the last item of a group

    def short(x: float) -> bool:
        return x < least - SLACK

    def absorb(a: int, b: int) -> None:
        size[a] += size[b]
        stop[a], gone[b] = stop[b], True
        first[stop[a] - 1] = a

    todo = [i for i in range(n) if short(size[i])]
    while todo:
        i = todo.pop()
        if gone[i] or not short(size[i]):
            continue
        left, right = first[i - 1] if i else None, stop[i] if stop[i] < n else None
        if left is None and right is None:
            break
        if right is None or (left is not None and not short(size[left] + size[i]) and (short(size[right] + size[i]) or size[left] < size[right] - SLACK)):
            absorb(left, i)
        else:
            absorb(i, right)
            if short(size[i]):
                todo.append(i)
    out = []
    for i in range(n):
        out.append(i if not gone[i] else out[-1])
    return out


def join_islands(rows: DataFrame, island: list[str], order: list[str], dur: str, least: float) -> DataFrame:
    """rows with __first, the order columns of the first row of their group. Groups never reach over two neighbours that are both long enough, so rows are cut there
    beforehand (island columns) and every stretch between cuts is folded on its own."""

    def fold(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(order).reset_index(drop=True)
        at = join_short(t[dur].tolist(), least)
        for c in order:
            t[f"__first_{c}"] = t[c].to_numpy()[at]
        return t

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + "".join(f", `__first_{c}` {kinds[c]}" for c in order)
    return rows.groupBy(*island).applyInPandas(fold, schema)


def combine_short(rows: DataFrame, spk: str, utt: str, dur: str, least: float, *, across: bool = True) -> DataFrame:
    """(spk, utt, first, n, speaker): utterances in order, first inside a speaker, then (across) over speakers, joined until groups have the least duration. A group is known by its first
    utterance; its speaker is the one with most of its duration, the least if tied."""
    long_ = F.col(dur) >= least - SLACK
    w = Window.partitionBy(spk).orderBy(utt)
    t = rows.select(spk, utt, dur).withColumn("__cut", (long_ & F.lag(long_).over(w)).cast("int"))
    t = t.withColumn("__island", F.floor(F.sum(F.coalesce("__cut", F.lit(0))).over(w) / ISLANDS)).drop("__cut")
    t = stash(join_islands(t, [spk, "__island"], [utt], dur, least).drop("__island"), "combined")
    if across:
        g = t.groupBy(spk, f"__first_{utt}").agg(F.sum(dur).alias("__d")).withColumnRenamed(f"__first_{utt}", "__u")
        s = slices(g.withColumn("__long", F.col("__d") >= least - SLACK), spk, "__u")
        s = previous(s, "__long", "__was", spk, "__u").withColumn("__cut", (F.col("__long") & F.coalesce("__was", F.lit(False))).cast("int"))
        s = running_sum(s, F.col("__cut"), "__i", spk, "__u").select(spk, "__u", "__d", F.floor((F.col("__i") + F.col("__cut")) / ISLANDS).alias("__island"))
        s = join_islands(s, ["__island"], [spk, "__u"], "__d", least)
        t = t.join(s.select(spk, F.col("__u").alias(f"__first_{utt}"), F.col("__first___u").alias("first")), [spk, f"__first_{utt}"])
    else:
        t = t.withColumnRenamed(f"__first_{utt}", "first")
    own = t.groupBy("first", spk).agg(F.sum(dur).alias("__d"), F.count("*").alias("__n"))
    own = own.groupBy("first").agg(F.sum("__n").alias("n"), F.min_by(spk, F.struct(-F.round(F.col("__d") / SLACK), F.col(spk))).alias("speaker"))
    return t.join(own, "first").select(spk, utt, "first", "n", "speaker")


def frame_segments(classes: np.ndarray, *, proportion: float, longest: int, hard: int) -> list[tuple[int, int]]:
    """Segments [begin, end) of frames (0 silence, 1 noise, 2 speech): runs without silence; grown frame by frame in turns into silence until it makes up the proportion;
    touching ones joined, least silence at their border first, while no longer than longest; cut evenly over hard; those without speech dropped."""
    n = len(classes)
    busy = np.concatenate([[False], classes != 0, [False]])
    turn = np.flatnonzero(busy[1:] != busy[:-1])
    begin, end = turn[::2].tolist(), turn[1::2].tolist()
    loud = int((classes != 0).sum())
    missing = int(loud / (1 - proportion)) - loud
    grew = bool(begin)
    while missing > 0 and grew:
        grew = False
        for i in range(len(begin)):
            if missing and begin[i] > 0 and (i == 0 or end[i - 1] < begin[i]):
                begin[i], missing, grew = begin[i] - 1, missing - 1, True
            if missing and end[i] < n and (i + 1 == len(begin) or end[i] < begin[i + 1]):
                end[i], missing, grew = end[i] + 1, missing - 1, True
    # frames of silence around each place: back to the last busy frame and on to the next
    where = np.flatnonzero(classes != 0)
    border = [i for i in range(1, len(begin)) if end[i - 1] == begin[i]]
    at = np.searchsorted(where, [begin[i] for i in border])
    silence = where[at] - where[at - 1] - 1 if border else np.empty(0, np.int64)
    head, tail = list(range(len(begin))), list(range(len(begin)))  # by the last, by the first segment of a joined run
    for k in np.argsort(silence, kind="stable"):
        i = border[k]
        a, b = head[i - 1], tail[i]
        if end[b] - begin[a] <= longest:
            head[b], tail[a] = a, b
    out, i = [], 0
    while i < len(begin):
        a, z = begin[i], end[tail[i]]
        i = tail[i] + 1
        pieces = max(1, int((z - a) / hard + 0.99999)) if z - a > hard else 1
        step = (z - a) // pieces
        edges = [*[a + k * step for k in range(pieces)], z]
        out += [(x, y) for x, y in zip(edges, edges[1:], strict=False) if (classes[x:y] == 2).any()]
    return out


def segment_frames(rows: DataFrame, key: str, frame: str, kind: str, *, proportion: float = 0.2, longest: int = 1500, hard: int = 3000) -> DataFrame:
    """(key, segment, begin, end) in frames, by frame_segments over each recording's frames in order; kind holds the classes."""

    def fold(t: pd.DataFrame) -> pd.DataFrame:
        found = frame_segments(t.sort_values(frame)[kind].to_numpy(), proportion=proportion, longest=longest, hard=hard)
        return pd.DataFrame([(t[key].iloc[0], i, a, z) for i, (a, z) in enumerate(found)], columns=[key, "segment", "begin", "end"])

    return rows.select(key, frame, kind).groupBy(key).applyInPandas(fold, f"{key} {dict(rows.dtypes)[key]}, segment long, begin long, end long")


def align_words(a: list[str], b: list[str], beam: int) -> list[tuple[int, int]]:
    """Pairs of places (-1: none) of a least-cost alignment with insertions, deletions and substitutions of cost one, within beam cells of the diagonal (a beam as wide as the longer
    text is exact). Only the band is held."""
    n, m = len(a), len(b)
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in t], np.int64) for t in (a, b))
    width = max(beam, abs(n - m) + 1)
    big = n + m + 2
    lo = np.maximum(0, np.arange(n + 1) - width)
    hi = np.minimum(m, np.arange(n + 1) + width)
    cost = [np.arange(hi[0] + 1)]
    for i in range(1, n + 1):
        up = np.full(hi[i] - lo[i] + 2, big)  # the row above from column lo[i] - 1 on
        p, q = max(lo[i] - 1, lo[i - 1]), min(hi[i], hi[i - 1])
        up[p - lo[i] + 1 : q - lo[i] + 2] = cost[-1][p - lo[i - 1] : q - lo[i - 1] + 1]
        j = np.arange(lo[i], hi[i] + 1)
        differ = np.ones(len(j), np.int64)
        differ[j > 0] = x[i - 1] != y[j[j > 0] - 1]
        best = np.minimum(up[1:] + 1, np.where(j > 0, up[:-1] + differ, big))
        cost.append(np.minimum.accumulate(best - j) + j)
    at = lambda i, j: cost[i][j - lo[i]] if lo[i] <= j <= hi[i] else big
    out, i, j = [], n, m
    while i or j:
        here = at(i, j)
        if i and j and here == at(i - 1, j - 1) + (x[i - 1] != y[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and here == at(i - 1, j) + 1:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


#: Aligned words that a task holds before it hands them on, and rows whose texts it takes at once.
ALIGNED, TEXTS = 16_384, 256


def aligned_batches(batches: Iterator[pa.RecordBatch], keys: list[str], ref: str, hyp: str, eps: str, beam: int) -> Iterator[pa.RecordBatch]:
    """Batches (keys, pos, ref, hyp) of the alignments of rows, of about ALIGNED words however many rows arrive at once. Keys are repeated by their place, texts are taken a few rows at a time."""
    for whole in batches:
        for lo in range(0, whole.num_rows, TEXTS):
            b = whole.slice(lo, TEXTS)
            own, n, x, y = [], [], [], []

            def ready() -> pa.RecordBatch:
                at = pa.array(np.repeat(own, n))  # noqa: B023
                pos = np.concatenate([np.arange(m) for m in n])  # noqa: B023
                return pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in keys), pa.array(pos, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], [*keys, "pos", "ref", "hyp"])  # noqa: B023

            for row, (r, h) in enumerate(zip(b.column(ref).to_pylist(), b.column(hyp).to_pylist(), strict=True)):
                p, q = (r or "").split(), (h or "").split()
                found = align_words(p, q, beam)
                if not found:
                    continue
                own.append(row)
                n.append(len(found))
                x += [p[i] if i >= 0 else eps for i, _ in found]
                y += [q[j] if j >= 0 else eps for _, j in found]
                if len(x) >= ALIGNED:
                    yield ready()
                    own, n, x, y = [], [], [], []
            if x:
                yield ready()


def align(rows: DataFrame, keys: list[str], ref: str, hyp: str, eps: str = "<eps>", beam: int = 200) -> DataFrame:
    """(keys, pos, ref, hyp): word alignment of each row within a beam around the diagonal."""
    kinds = dict(rows.dtypes)
    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "pos long, ref string, hyp string"
    return rows.select(*keys, ref, hyp).mapInArrow(lambda batches: aligned_batches(batches, keys, ref, hyp, eps, beam), schema)


def best_path(score: np.ndarray, deleted: np.ndarray, inserted: np.ndarray, beam: float = np.inf) -> list[int]:
    """For each row of score (reference events by system events, NaN: no match) the system event that it is mapped to, or -1: the order-keeping mapping of the highest sum of
    matches, deletions and insertions. A path that, with all its later insertions, is beam or more behind the best one is not carried past a deletion."""
    n, m = score.shape
    upto = np.concatenate([[0.0], np.cumsum(inserted)])  # of the first k system events
    path = np.full(m + 1, -np.inf)  # by the number of system events used up
    path[0] = 0.0
    took, back = np.full((n, m + 1), -1, np.int64), np.zeros((n, m + 1), np.int64)
    for i in range(n):
        whole = path + upto[m] - upto
        new = np.where(whole > whole.max() - beam, path + deleted[i], -np.inf)
        back[i] = np.arange(m + 1)
        ahead = path - upto
        top = np.maximum.accumulate(ahead)
        where = np.maximum.accumulate(np.where(np.concatenate([[True], ahead[1:] > top[:-1]]), np.arange(m + 1), 0))
        match = score[i] + top[:m] + upto[:m]
        better = np.flatnonzero(match > new[1:])
        new[better + 1], took[i, better + 1], back[i, better + 1] = match[better], better, where[better]
        path = new
    out = [-1] * n
    at = int(np.argmax(path + upto[m] - upto)) if n else 0
    for i in range(n - 1, -1, -1):
        out[i], at = int(took[i, at]), int(back[i, at])
    return out


def sparse_path(n: int, m: int, i: np.ndarray, j: np.ndarray, score: np.ndarray, deleted: float, inserted: float) -> list[int]:
    """sparse_rows over pairs (i, j) with their scores, sorted by i and j."""
    cuts = np.flatnonzero(np.diff(i)) + 1
    ends = zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)], strict=True) if len(i) else ()
    return sparse_rows(n, m, ((int(i[lo]), j[lo:hi], score[lo:hi]) for lo, hi in ends), deleted, inserted)


def sparse_rows(n: int, m: int, rows: Iterable[tuple[int, np.ndarray, np.ndarray]], deleted: float, inserted: float) -> list[int]:
    """best_path without a beam where few of n times m events may match: rows in order, each a reference event with the system events that it may match, in order, and their scores. Rows are read once and not kept; memory
    is that of the matches that bettered what was known. A row's work is on the system events between its first change and the last one reached so far."""
    best = np.full(m + 1, -np.inf)  # by the last system event used up: gain over mapping nothing
    top, where = np.zeros(m + 1), np.zeros(m + 1, np.int64)  # greatest gain so far from the left, and the first place that has it
    best[0], reached = 0.0, 0  # top is filled in up to reached and the same beyond
    link = np.full(m + 1, -1, np.int64)  # step that led here
    row, column, before, steps = [], [], [], 0
    for i, at, score in rows:
        left = np.minimum(at, reached)
        found = score - deleted - inserted + top[left]
        better = np.flatnonzero(found > best[at + 1])
        if not len(better):
            continue
        to = at[better] + 1
        row.append(np.full(len(to), i, np.int32))
        column.append(at[better].astype(np.int32))
        before.append(link[where[left[better]]])
        best[to], link[to] = found[better], np.arange(steps, steps + len(to))
        steps += len(to)
        first, reached = int(to[0]), max(reached, int(to[-1]))
        start = min(first, reached)
        fill = min(first - 1, int(left[better[0]]))
        some = best[start : reached + 1]
        run = np.maximum.accumulate(np.concatenate([[top[fill]], some]))
        new = some > run[:-1]
        top[start : reached + 1] = run[1:]
        where[start : reached + 1] = np.maximum.accumulate(np.where(new, np.arange(start, reached + 1), where[fill]))
        if fill < first - 1:
            top[fill + 1 : first], where[fill + 1 : first] = top[fill], where[fill]
    out = [-1] * n
    if steps:
        row, column, before = (np.concatenate(c) for c in (row, column, before))
        step = int(link[where[reached]])
        while step >= 0:
            out[int(row[step])] = int(column[step])
            step = int(before[step])
    return out


def fit_logistic(rows: DataFrame, features: list[str], truth: str, *, epochs: int = 20, rate: float = 1.0, momentum: float = 0.9, average_from: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by full-batch gradient descent with momentum and a cosine rate, after the last step and averaged over the steps from average_from on. rows are
    read once an epoch, so the caller writes what is dear to compute; every gradient is one aggregate, and nothing but sums reaches the driver."""
    k = len(features)
    w, v, seen = np.zeros(k + 1), np.zeros(k + 1), []
    for epoch in range(epochs):
        z = F.lit(float(w[k]))
        for i, f in enumerate(features):
            z = z + F.lit(float(w[i])) * F.col(f)
        err = 1 / (1 + F.exp(-z)) - F.col(truth).cast("double")
        *g, n = rows.agg(*[F.sum(err * F.col(f)) for f in features], F.sum(err), F.count("*")).first()
        v = momentum * v - rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) * np.array([x or 0.0 for x in g]) / max(1, n)
        w = w + v
        if epoch >= (epochs - 1 if average_from is None else average_from):
            seen.append(w)
    return w, np.mean(seen, axis=0)
