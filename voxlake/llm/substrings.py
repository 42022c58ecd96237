"""Exact removal of repeated substrings of WINDOW bytes by column-wise suffix ordering of many short documents.

Ordering every suffix of the corpus one symbol per document and round takes as many rounds as the longest document has bytes, each over everything;
so the suffixes are first parted into collections that can hold a repeat. Every window has one anchor: the least hash, leftmost on ties, of its
GRAM-byte strings. Equal windows have equal anchors at equal places, so a repeat lies within the occurrences of one anchor, aligned there.
Consecutive windows of one anchor form a run; equal runs are counted by hash, and only anchors whose runs differ need their bytes.

The bytes around such an anchor are the short documents of a collection; they arrive through the sorted external files of a shuffle. It is built column by
column from the right: in each round one symbol of every document is inserted in front, which updates the order of the suffixes (the symbols
in front of them, in that order, are the collection's Burrows-Wheeler transform) and the common prefixes of neighbours. A window of a size is repeated
where a neighbour shares that many symbols, so one construction answers for several sizes. The number of rounds is below the sum of the least and the greatest
size, whatever the documents' lengths, and a block of columns holds at most twice CROWD documents.

Hot groups: an anchor that many runs have is dealt out by a salt (there are at most HEAVY such anchors, broadcast with their number of parts). An anchor with over CROWD unlike
contexts is not ordered in one task: its runs are cut into cells of CELL window starts, cells whose common core occurs once are out, and the windows
of the others are counted by hash with map-side combining.

Runs and copies are counted with map-side combining, texts are known by a 128-bit hash, and equal texts have equal spans. Matches never
cross documents. Defined results: null text is empty; texts below WINDOW bytes lose nothing; repeated rows and ids repeat each other's texts; null
ids are rows like others; an empty table gives no rows; extra columns are kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.tiles import groups
from voxlake.session import stash, text_batches

WINDOW, GRAM, CHUNK = 400, 64, 1 << 20
#: A passage of fifty words is longer than this; the anchors of its windows.
PASSAGE, PASSAGE_GRAM = 200, 40
HEAVY, CROWD, CELL = 2000, 8192, 16
KEY = ["__k1", "__k2"]
RUN = ["anchor", "lo", "hi", "upto", "content"]  # lo, hi: first and last window start, upto: end of the bytes, relative to the anchor
_BASE = 0x9E3779B97F4A7C15
_BITS = np.uint64(24)


def text_keys(text: Column) -> dict[str, Column]:
    whole = F.coalesce(text, F.lit(""))
    return dict(zip(KEY, (F.xxhash64(whole), F.xxhash64(F.lit(1), whole)), strict=True))


class Roller:
    """Hashes of substrings of one buffer from prefix sums modulo 2**64."""

    def __init__(self) -> None:
        self.table = np.random.default_rng(23).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.size = 0

    def powers(self, n: int) -> None:
        if n > self.size:
            self.size = n = max(n, 2 * CHUNK)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))

    def load(self, data: np.ndarray) -> None:
        n = len(data)
        self.powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=self.sums[1:])

    def hashes(self, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        h = (self.sums[end] - self.sums[begin]) * self.down[: len(self.sums)][begin]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = len(v)
    whole = -(-n // width) * width
    padded = np.full(whole, np.iinfo(v.dtype).max, v.dtype)
    padded[:n] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(roller: Roller, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, window: int, gram: int, reach: int) -> tuple[np.ndarray, ...]:
    """Of documents data[begin:end] and their first starts windows: (document, anchor place, anchor hash, lo, hi, upto, content hash) per run of windows;
    its content goes on to reach bytes from its last start, as far as the document does."""
    roller.load(data)
    n = len(data)
    h = roller.hashes(slice(0, n - gram + 1), slice(gram, n + 1))
    packed = (h & ~np.uint64((1 << int(_BITS)) - 1)) | np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_min(packed, window - gram + 1) & np.uint64((1 << int(_BITS)) - 1)).astype(np.int64)
    step = np.zeros(len(anchor) + 1, np.int32)
    starts = np.minimum(starts, ends - begins - window + 1)
    long_ = starts > 0
    step[begins[long_]] += 1
    step[(begins + starts)[long_]] -= 1
    valid = np.cumsum(step[:-1]) > 0
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    lo = np.flatnonzero(fresh)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    hi = np.flatnonzero(stop)
    place = anchor[lo]
    doc = np.searchsorted(begins, lo, side="right") - 1
    upto = np.minimum(hi + reach, ends[doc])
    content = roller.hashes(lo, upto)
    return doc, place - begins[doc], h[place].view(np.int64), lo - place, hi - place, upto - place, content.view(np.int64)


def find_runs(window: int, gram: int, reach: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for b in batches:
            k1, k2 = (b.column(k).to_numpy() for k in KEY)
            held: list[tuple[int, int, bytes]] = []  # row, place of the part in its text, bytes
            size = 0

            def emit() -> Iterator[pa.RecordBatch]:
                if not held:
                    return
                lengths = np.array([len(x) for _, _, x in held])
                ends = np.cumsum(lengths)
                data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
                doc, place, *run_ = runs_of(roller, data, ends - lengths, ends, np.full(len(held), 8 * CHUNK), window, gram, reach)
                row, at = (np.array(c, np.int64) for c in list(zip(*held, strict=True))[:2])
                columns = [k1[row[doc]], k2[row[doc]], place + at[doc], *run_]
                yield from pa.table([pa.array(c.astype(np.int64)) for c in columns], [*KEY, "place", *RUN]).to_batches(max_chunksize=50_000)

            for i, x in enumerate(b.column("text")):
                raw = (x.as_py() or "").encode("utf-8", "surrogatepass")
                for at in range(0, max(1, len(raw) - window + 1), 8 * CHUNK):  # windows that start in one part of a very long text
                    part = raw[at : at + 8 * CHUNK + reach - 1]
                    if len(part) < window:
                        continue
                    held.append((i, at, part))
                    size += len(part)
                    if size >= CHUNK:
                        yield from emit()
                        held.clear()
                        size = 0
            yield from emit()

    return run


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with lists of wanted runs to the runs' bytes."""
    for b in batches:
        for lo_ in range(0, b.num_rows, 64):
            out: list[tuple] = []
            part = b.slice(lo_, 64)
            for text, wanted in zip(part.column("text"), part.column("__wanted").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for w in wanted:
                    out.append((*[w[c] for c in RUN], raw[w["place"] + w["lo"] : w["place"] + w["upto"]]))
            if out:
                *numbers, data = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in numbers], pa.array(data, pa.binary())], [*RUN, "bytes"])


def repeated_ranges(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, texts: list[bytes], sizes: tuple[int, ...], first: int) -> Iterator[tuple[int, int, int, int]]:
    """(document, from, to, size): ranges of starts, relative to the anchor, of windows of a size that another document of its group shares.
    Documents are sorted by group; document i holds the bytes from lo[i] on; first is the least lo."""
    n, width = len(texts), max(sizes) - first
    columns = np.full((width, n), -1, np.int16)
    for at in range(0, n, 1024):
        block = np.full((len(texts[at : at + 1024]), width), -1, np.int16)
        for i, t in enumerate(texts[at : at + 1024]):
            block[i, lo[at + i] - first : lo[at + i] - first + len(t)] = np.frombuffer(t, np.uint8)
        columns[:, at : at + 1024] = block.T
    order, common = np.arange(n), np.zeros(n + 1, np.int32)  # common[i]: of neighbours i - 1 and i in order
    shared_before, until = np.zeros((len(sizes), n), bool), np.zeros((len(sizes), n), np.int64)
    for c in range(width - 1, -1, -1):
        symbol = columns[c][order].astype(np.int64)
        key = group[order] * 512 + symbol + 1
        moved = np.argsort(key, kind="stable")
        key, symbol = key[moved], symbol[moved]
        new = np.zeros(n + 1, np.int32)
        same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[1:] >= 0)) + 1
        a, b = moved[same - 1], moved[same]
        near = b == a + 1
        new[same[near]] = common[b[near]] + 1
        if not near.all():
            far = same[~near]
            bounds = np.stack([moved[far - 1] + 1, moved[far] + 1], 1).reshape(-1)
            new[far] = np.minimum.reduceat(common, bounds)[::2] + 1
        order, common = order[moved], new
        start = c + first
        if start > 0:
            continue
        best = np.zeros(n, np.int32)
        best[order] = np.maximum(common[:-1], common[1:])
        best[(lo > start) | (start > hi)] = 0
        for k, size in enumerate(sizes):
            shared = best >= size
            until[k, shared & ~shared_before[k]] = start
            for i in np.flatnonzero(shared_before[k] & ~shared):
                yield int(i), start + 1, int(until[k, i]), size
            shared_before[k] = shared
    for k, size in enumerate(sizes):
        for i in np.flatnonzero(shared_before[k]):
            yield int(i), first, int(until[k, i]), size


def resolve(sizes: tuple[int, ...], gram: int, most: int = CROWD) -> object:
    """Contexts in order of their anchors to ranges of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ready(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held)
            group = np.repeat(np.arange(len(held)), [x.num_rows for x in held])
            lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
            out = list(repeated_ranges(group, lo, hi, t.column("bytes").to_pylist(), sizes, gram - min(sizes)))
            if out:
                i, a, z, size = (np.array(c, np.int64) for c in zip(*out, strict=True))
                t = t.select(RUN).take(pa.array(i))
                for name, c in (("from", a), ("to", z), ("size", size)):
                    t = t.append_column(name, pa.array(c))
                yield from t.to_batches(max_chunksize=50_000)

        held: list[pa.Table] = []
        rows = 0
        for _, t in groups(batches, ["anchor"]):
            if t.num_rows < 2:
                continue
            held.append(t)
            rows += t.num_rows
            if rows >= most:
                yield from ready(held)
                held, rows = [], 0
        if held:
            yield from ready(held)

    return run


def core_hashes(window: int) -> object:
    """Texts with lists of wanted runs to (run, cell, core): a cell is CELL window starts in a row, its core the bytes that all windows of the cell hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_contexts(batches):
            row, cell, core = [], [], []
            for i, (lo, hi, t) in enumerate(zip(*(b.column(c).to_pylist() for c in ("lo", "hi", "bytes")), strict=True)):
                for c in range(lo // CELL, hi // CELL + 1):
                    row.append(i)
                    cell.append(c)
                    core.append(xxhash.xxh64_intdigest(t[max(0, c * CELL + CELL - 1 - lo) : c * CELL + window - lo]) >> 1)
            yield from pa.table([*[b.column(c).take(pa.array(row, pa.int64())) for c in RUN], pa.array(cell, pa.int64()), pa.array(core, pa.int64())], [*RUN, "cell", "core"]).to_batches(max_chunksize=50_000)

    return run


def window_hashes(sizes: tuple[int, ...]) -> object:
    """Texts with lists of wanted runs and their cells to (run, from, size, hash) of the windows in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for b in batches:
            for text, wanted in zip(b.column("text"), b.column("__wanted").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                out = []
                for w in wanted:
                    lo, hi, upto = w["lo"], w["hi"], w["upto"]
                    roller.load(np.frombuffer(raw[w["place"] + lo : w["place"] + upto], np.uint8))
                    at = np.unique(np.concatenate([np.arange(max(lo, c * CELL), min(hi, c * CELL + CELL - 1) + 1) for c in w["cells"]]))
                    for size in sizes:
                        fits = at[at + size <= upto]
                        own = [np.full(len(fits), w[c]) for c in RUN]
                        out.append([*own, fits, np.full(len(fits), size), roller.hashes(fits - lo, fits - lo + size).view(np.int64)])
                if out:
                    yield from pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], [*RUN, "from", "size", "h"]).to_batches(max_chunksize=50_000)

    return run


def salted_join(left: DataFrame, right: DataFrame, key: str, n: str, salt: list[str]) -> DataFrame:
    """Inner join with right (one row a key, n rows of left each): a key with more than one in HEAVY of all rows is dealt out by a hash of the salt
    columns. There are fewer than HEAVY such keys."""
    share = right.agg(F.coalesce(F.sum(n), F.lit(0)).alias("s")).first()["s"] // HEAVY + 1000
    heavy = F.broadcast(right.filter(F.col(n) > share).select(key, F.ceil(F.col(n) / share).alias("__parts")))
    part = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*salt), F.col("__parts"))).cast("long").alias("__salt")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__parts").cast("long"), F.lit(1)) - 1)).alias("__salt")
    a = left.join(heavy, key, "left").select(*left.columns, part)
    b = right.join(heavy, key, "left").select(*right.columns, parts)
    return a.join(b.hint("merge"), [key, "__salt"])


def crowded_ranges(rows: DataFrame, wanted: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Ranges of repeated windows, of one start each, of runs of anchors with many contexts. wanted: RUN and at, the text that stands for the run."""
    longs = ", ".join(f"{c} long" for c in RUN)
    cores = meet(rows, wanted, RUN).mapInArrow(core_hashes(min(sizes)), f"{longs}, cell long, core long")
    core = ["anchor", "cell", "core"]
    alive = cores.groupBy(*core).agg(F.count("*").alias("n")).filter("n > 1").select(*core)
    cells = cores.join(alive.hint("merge"), core, "left_semi").groupBy(*RUN).agg(F.collect_set("cell").alias("cells"))  # at most a run's cells
    windows = meet(rows, wanted.join(cells.hint("merge"), RUN), [*RUN, "cells"]).mapInArrow(window_hashes(sizes), f"{longs}, from long, size long, h long")
    key = ["anchor", "from", "size", "h"]
    twice = windows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key)
    return windows.join(twice.hint("merge"), key, "left_semi").select(*RUN, "from", F.col("from").alias("to"), "size")


def meet(rows: DataFrame, wanted: DataFrame, carry: list[str]) -> DataFrame:
    """Texts with __wanted, the runs that are wanted of them. All uses deal the texts out in one shape, so that Spark does it once."""
    lists = wanted.groupBy(*[F.col(f"at.{k}").alias(k) for k in KEY]).agg(F.collect_list(F.struct(*carry, "at.place")).alias("__wanted"))
    return rows.join(lists.hint("merge"), KEY, "left").filter("__wanted is not null")


def repeated_spans(rows: DataFrame, sizes: tuple[int, ...] = (WINDOW,), gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """KEY and __spans (array of begin, last, upto, size, for spans_of; they may overlap) of the texts with bytes in repeats of one of the sizes. rows: text,
    KEY and whatever the caller goes on with."""
    text_batches(rows.sparkSession)
    window, reach = min(sizes), max(sizes)
    texts = rows.select("text", *KEY)
    runs = texts.mapInArrow(find_runs(window, gram, reach), ", ".join(f"{c} long" for c in (*KEY, "place", *RUN)))
    several = stash(runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "substring-anchors")
    runs = salted_join(runs, several, "anchor", "n", [*KEY, "place"])
    # equal texts are one; their runs lie in one partition of the join already
    own = stash(runs.groupBy("__salt", *KEY, "place", *RUN).agg(F.count("*").alias("copies")).drop("__salt"), "substring-shared")
    distinct = stash(own.groupBy(*RUN).agg(F.sum("copies").alias("n"), F.min(F.struct(*KEY, "place")).alias("at")), "substring-distinct")
    unlike = stash(distinct.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1"), "substring-unlike")
    wanted = salted_join(distinct.select(*RUN, "at"), unlike, "anchor", "m", RUN)
    contexts = meet(rows, wanted.filter(F.col("m") <= crowd), RUN).mapInArrow(cut_contexts, ", ".join(f"{c} long" for c in RUN) + ", bytes binary")
    contexts = contexts.repartition("anchor").sortWithinPartitions("anchor")
    partly = contexts.mapInArrow(resolve(sizes, gram), ", ".join(f"{c} long" for c in (*RUN, "from", "to", "size")))
    if unlike.filter(F.col("m") > crowd).limit(1).count():
        partly = partly.unionByName(crowded_ranges(rows, wanted.filter(F.col("m") > crowd).select(*RUN, "at"), sizes))
    # size 0: all windows from the first start to the last that end by upto
    twice = distinct.filter("n > 1").select(*RUN, "n", F.col("lo").alias("from"), F.col("hi").alias("to"), F.lit(0).cast("long").alias("size"))
    share = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()["s"] // HEAVY + 1000
    hot = F.broadcast(twice.filter(F.col("n") > share).drop("n"))  # runs that many texts hold are fewer than HEAVY
    ranges = twice.filter(F.col("n") <= share).drop("n").unionByName(partly.join(distinct.filter("n = 1").select(*RUN).hint("merge"), RUN, "left_semi"))
    spans = own.join(hot.select(*RUN), RUN, "left_anti").join(ranges.hint("merge"), RUN).unionByName(own.join(hot, RUN))
    span = F.struct((F.col("place") + F.col("from")).alias("begin"), (F.col("place") + F.col("to")).alias("last"), (F.col("place") + F.col("upto")).alias("upto"), "size")
    return spans.groupBy(*KEY).agg(F.collect_list(span).alias("__spans"))


def spans_of(found: list[dict] | None, size: int) -> list[dict]:
    """Bytes of the repeats of a size."""
    out = []
    for s in found or ():
        last = s["last"] if s["size"] else min(s["last"], s["upto"] - size)
        if s["size"] in (0, size) and last >= s["begin"]:
            out.append({"begin": s["begin"], "end": last + size})
    return out


def kept_parts(raw: bytes, spans: list[dict] | None) -> tuple[list[bytes], int]:
    """What is left, and the number of maximal removed runs."""
    parts, at, n, end = [], 0, 0, -1
    for s in sorted((s["begin"], s["end"]) for s in spans or ()):
        if s[0] > end:
            n += 1
            parts.append(raw[at : s[0]])
        end = at = max(end, s[1])
    parts.append(raw[at:])
    return parts, n


def repeat_report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; then n_passage_bytes, the bytes covered by strings of passage bytes (at most window;
    none given: window) that also start elsewhere, and has_passage."""
    passage = passage or window
    rows = docs.select("doc_id", "text").withColumns(text_keys(F.col("`text`")))
    rows = rows.join(repeated_spans(rows, tuple(sorted({passage, window})), gram).hint("merge"), KEY, "left").select("doc_id", "text", "__spans")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, spans in zip(b.column("text"), b.column("__spans"), strict=True):
                raw, found = (x.as_py() or "").encode("utf-8", "surrogatepass"), spans.as_py() or []
                parts, n = kept_parts(raw, spans_of(found, window))
                h = hashlib.sha256()
                for p in parts:
                    h.update(p)
                left = sum(map(len, kept_parts(raw, spans_of(found, passage))[0]))
                out.append((len(raw), len(raw) - sum(map(len, parts)), n, h.hexdigest(), len(raw) - left, left < len(raw)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "has_passage"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, has_passage boolean")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with the repeated bytes taken out of text (characters that a cut splits go too); n_chars, if there, follows."""
    names = docs.columns
    rows = docs.withColumns(text_keys(F.col("`text`")))
    rows = rows.join(repeated_spans(rows, (window,), gram).hint("merge"), KEY, "left").select(*[F.col(f"`{c}`") for c in names], "__spans")
    where, schema = names.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for x, spans in zip(b.column(where), b.column(len(names)), strict=True):
                s = spans_of(spans.as_py(), window)
                texts.append(x.as_py() if not s else b"".join(kept_parts(x.as_py().encode("utf-8", "surrogatepass"), s)[0]).decode("utf-8", "ignore"))
            columns = b.columns[: len(names)]
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    out = rows.mapInArrow(run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(schema["n_chars"].dataType))
    return out
