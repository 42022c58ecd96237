"""Hierarchical residual packing of tokenized documents into sequences.

Each input partition tokenizes its documents, cuts longer ones into pieces and packs the pieces best-fit, longest
first. Sequences with at most ``slack`` free places are final; the others, as items of their filled length, go up a tree: each round
packs the items of FAN_IN times as many tasks best-fit again. A round has one task for every TASK_ITEMS items at least,
so no task's work grows with the input, and at most one sequence per task of the last round is left badly filled.
Only (sequence, length) pairs travel between rounds; pieces learn their final place in one join.

Defined results: null text counts as empty and is one end id; null or repeated document ids are packed like others, since a
piece is known by its first sequence and place; ties go to the lower sequence; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.session import stash, text_batches

CAPACITY, FAN_IN, TASK_ITEMS = 4096, 8, 200_000
#: Distinct chunks whose ids a worker remembers at most, and how many of the first it keeps when it starts afresh.
REMEMBERED, KEPT = 650_000, 300_000
#: Letters of Latin-1, then ASCII marks (an apostrophe may belong to the letters).
STEM = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. The tokenizer drops blanks and joins nothing across them, so a
    text's ids are those of its blank-separated chunks in a row, and each distinct chunk is encoded once. It also lower-cases, and
    parts letters from marks: chunks of Latin letters, less the marks behind them, are encoded many at a time, where each ends
    at the one id that closes a word."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.first: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _one(self, chunk: bytes) -> bytes:
        return np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def split(self, text: str | None) -> list[bytes]:
        raw = (text or "").encode()
        return (raw if b"<|" in raw else raw.lower()).split()  # lower case could make a special token out of another string

    def learn(self, texts: list[list[bytes]]) -> None:
        known = self.known
        if len(known) > KEPT and not self.first:
            self.first = known.copy()
        if len(known) > REMEMBERED:
            known.clear()
            known.update(self.first)
        stems: dict[bytes, None] = {}
        marked = []
        new = list(set().union(*texts) - known.keys())
        for w, u in zip(new, b" ".join(new).decode().split(" "), strict=False):
            m = STEM(u)
            if not m:
                known[w] = self._one(w)
            elif m[2]:
                stem = w[: -len(m[2])]
                marked.append((w, stem, m[2]))
                if stem not in known:
                    stems[stem] = None
            else:
                stems[w] = None
        todo = list(stems)
        for i in range(0, len(todo), 4000):
            part = todo[i : i + 4000]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                known.update((w, self._one(w)) for w in part)
                continue
            raw, lo = ids.tobytes(), 0
            for w, hi in zip(part, (4 * ends).tolist(), strict=True):
                known[w] = raw[lo:hi]
                lo = hi
        marks = self.marks
        for w, stem, mark in marked:
            if mark not in marks:
                if len(marks) > 10_000:
                    marks.clear()
                marks[mark] = self._one(mark.encode())
            known[w] = known[stem] + marks[mark]

    def ids(self, words: list[bytes], end: int = 1) -> bytes:
        return b"".join(map(self.known.__getitem__, words)) + end.to_bytes(4, "little")


@cache
def encoder_for(path: str) -> Encoder:
    """One encoder per worker process, so that what one task learnt serves the next."""
    return Encoder(path)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Longest first, each into the fullest open sequence that takes it. Per item its sequence and offset; fills."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        above = mask >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            s = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            s, room = len(fills), capacity
            fills.append(0)
        where[i], offset[i] = s, fills[s]
        fills[s] += n
        if room > n:
            free[room - n].append(s)
            mask |= 1 << (room - n)
    return where, offset, fills


def _unique(base: int, n: int) -> int:
    return (base << 34) + n


def tokenize_and_pack(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = encoder_for(path), TaskContext.get().partitionId()
        docs, rows, done = [], [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                words = [encoder.split(x.as_py()) for x in part.column("text")]
                encoder.learn(words)
                docs.append(part.column("doc_id"))
                for k, w in enumerate(words, done):
                    ids = encoder.ids(w)
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        rows.append((k, piece, start // 4, len(own) // 4, zlib.crc32(own)))
                done += len(words)
        if not rows:
            return
        of, piece, start, length, crc = zip(*rows, strict=True)
        where, offset, fills = best_fit(list(length), capacity)
        ids = pa.chunked_array(docs).combine_chunks() if len(docs) > 1 else docs[0]
        out = pa.table({
            "doc_id": ids.take(pa.array(of, pa.int64())), "piece": pa.array(piece, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            "bin": pa.array([_unique(base, s) for s in where], pa.int64()), "offset": pa.array(offset, pa.int64()), "fill": pa.array([fills[s] for s in where], pa.int64()),
        })
        yield from out.to_batches(max_chunksize=50_000)

    return run


def pack_items(capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bin, fill) to (bin, into, base, total): into is the first of the bins that were put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((x for b in batches for x in zip(b.column("bin").to_pylist(), b.column("fill").to_pylist(), strict=True)))
        if not held:
            return
        where, offset, fills = best_fit([n for _, n in held], capacity)
        first: dict[int, int] = {}
        for (bin_, _), s, o in zip(held, where, offset, strict=True):
            if o == 0:
                first[s] = bin_
        yield from pa.table({
            "bin": pa.array([x for x, _ in held], pa.int64()), "into": pa.array([first[s] for s in where], pa.int64()),
            "base": pa.array(offset, pa.int64()), "total": pa.array([fills[s] for s in where], pa.int64()),
        }).to_batches(max_chunksize=50_000)

    return run


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, slack: int = 8, fan_in: int = FAN_IN, task_items: int = TASK_ITEMS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    text_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in ("piece", "start", "length", "ids_crc32", "bin", "offset", "fill"))
    pieces = stash(source.mapInArrow(tokenize_and_pack(tokenizer or default_tokenizer(), capacity), f"doc_id {kind}, {longs}"), "pack-pieces")
    open_ = pieces.filter(F.col("fill") < capacity - slack).select("bin", "fill").distinct()
    moved = None
    tasks = pieces.select(F.shiftright('bin', 34).alias('t')).distinct().count()
    while True:
        n = open_.count()
        if not n:
            break
        least = max(1, -(-n // task_items))
        tasks = max(least, min(tasks, -(-n // 2)) // fan_in, 1)
        dealt = open_.repartition(tasks, F.xxhash64("bin", F.lit(tasks))) if tasks > 1 else open_.coalesce(1)
        step = stash(dealt.mapInArrow(pack_items(capacity), "bin long, into long, base long, total long"), "pack-round")
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("bin").alias("into"), F.col("into").alias("then"), F.col("base").alias("more"), F.col("total").alias("now"))
            moved = moved.join(later, "into", "left").select("bin", F.coalesce("then", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"), F.coalesce("now", "total").alias("total"))
        if tasks <= least:
            break
        open_ = step.filter((F.col("total") < capacity - slack) & (F.col("bin") == F.col("into"))).select("bin", F.col("total").alias("fill"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moved is None:
        return pieces.select(*names[:1], F.col("piece").cast("int").alias("piece"), *names[2:], F.col("bin").alias("sequence_id"), "offset")
    out = pieces.join(moved, "bin", "left")
    return out.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")
    )
