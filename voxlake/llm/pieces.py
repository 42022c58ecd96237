"""SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a run of whitespace markers with the text up to the next marker. Where no piece of the model has a marker behind another
character, no merge reaches over a chunk's edge, so a text's ids are those of its chunks in a row and a chunk's ids depend on it alone.
`chunk_table` counts the distinct chunks of all texts (combined in each task before the shuffle) and segments each of the frequent ones once.
`encode` sends that table to every task, as it has at most TABLE_ROWS rows of at most LONGEST characters, splits each text into chunks and takes the ids
of each by its position. A chunk beyond the table is segmented by the task that meets it, once while the task remembers it. Texts never leave their task, so nothing is shuffled but
distinct chunks. `decode` gives ids to the library a block of rows at a time: measured, that is four times as fast as cutting ids into runs and joining their texts.

Models whose pieces cross markers, or that normalise texts, are applied to whole texts instead (`Pieces.by_chunk` is False).

Defined results: null text counts as empty and has no ids; null ids decode to null; ids outside the model are an error; texts of any length are whole; repeated rows, null ids of documents and ties stay as they are;
an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.session import stash, text_batches

MARK = "▁"
#: Rows of the table that every task gets, and characters of its longest chunk (so at most some 100 MB of a worker).
TABLE_ROWS, LONGEST = 200_000, 64
#: Chunks that a worker remembers besides the table, and distinct chunks that a counting task holds before it hands them on.
REMEMBERED, COUNTED = 300_000, 400_000
#: Texts that are split at a time.
BLOCK = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model, and whether its texts may be taken chunk by chunk."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        kinds = proto.ModelProto.SentencePiece.Type
        n = spec.normalizer_spec
        plain = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap and not spec.trainer_spec.treat_whitespace_as_suffix
        crosses = any(MARK in p.piece.lstrip(MARK) for p in spec.pieces) or any(p.type == kinds.USER_DEFINED for p in spec.pieces)
        self.mark = self.model.piece_to_id(MARK)
        self.by_chunk = bool(plain and not crosses and self.mark != self.model.unk_id() and spec.trainer_spec.model_type in (1, 2))
        self.size = len(spec.pieces)
        self.ids: dict[str, bytes] = {}

    split = staticmethod(re.compile(f"{MARK}+[^{MARK}]*").findall)

    def chunks(self, text: str | None) -> list[str]:
        """Chunks of a text, each without its first marker. The model puts one marker before a text."""
        if not text:
            return []
        if text[0] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        return [c[1:] for c in self.split(MARK + text.replace(" ", MARK))]

    def segment(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks as little-endian 32-bit bytes. The model adds the first marker itself; a marker alone is its own piece."""
        return [np.array(ids, "<i4").tobytes() if c else self.mark.to_bytes(4, "little") for c, ids in zip(chunks, self.model.encode(chunks, num_threads=1), strict=True)]

    def encode(self, texts: list[str | None], table: dict[str, bytes]) -> list[bytes]:
        if not self.by_chunk:
            return [np.array(ids, "<i4").tobytes() for ids in self.model.encode([t or "" for t in texts], num_threads=1)]
        if len(self.ids) > len(table) + REMEMBERED or not self.ids:
            self.ids = dict(table)
        known, once = self.ids, {}
        parts = [self.chunks(t) for t in texts]
        found = [list(map(known.get, p)) for p in parts]
        lacks = [i for i, f in enumerate(found) if None in f]
        new = list({c for i in lacks for c, ids in zip(parts[i], found[i], strict=True) if ids is None})
        for c, ids in zip(new, self.segment(new), strict=True):
            (known if len(c) <= LONGEST else once)[c] = ids
        for i in lacks:
            found[i] = [known[c] if c in known else once[c] for c in parts[i]]
        return [b"".join(f) for f in found]

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        for ids in rows:
            if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
                raise ValueError(f"id outside the model's {self.size} pieces")
        return self.model.decode([ids.tolist() for ids in rows], num_threads=1) if rows else []


@cache
def pieces_for(path: str) -> Pieces:
    """One model per worker process, so that what one task learnt serves the next."""
    return Pieces(path)


def count_chunks(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def ready(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["chunk", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = pieces_for(path), Counter()
        for b in batches:
            for x in b.column(0):
                held.update(pieces.chunks(x.as_py()))
                if len(held) > COUNTED:
                    yield ready(held)
                    held.clear()
        yield ready(held)

    return run


def chunk_table(docs: DataFrame, model: str | None = None, text_col: str = "text", rows: int = TABLE_ROWS) -> DataFrame:
    """chunk (without its first marker), n (occurrences in all texts), ids: the most frequent distinct chunks, at most `rows`, each segmented once.
    The least count is the lowest step of a scale of eighths of a power of two at which they are not more than that."""
    path = model or default_model()
    text_batches(docs.sparkSession)
    counted = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count_chunks(path), "chunk string, n long").filter(F.length("chunk") <= LONGEST).groupBy("chunk").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = stash(counted.withColumn("step", F.floor(8 * F.log2("n")).cast("int")), "piece-chunks")
    steps = {r["step"]: r["count"] for r in counts.groupBy("step").count().collect()}  # at most 8 * 63 steps
    least, held = 8 * 64, 0
    for s in sorted(steps, reverse=True):
        if (held := held + steps[s]) > rows:
            break
        least = s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_for(path)
        for b in batches:
            ids = [np.frombuffer(x, "<i4") for x in pieces.segment(b.column("chunk").to_pylist())] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["chunk", "n", "ids"])

    return counts.filter(F.col("step") >= least).select("chunk", "n").mapInArrow(run, "chunk string, n long, ids array<int>")


def _lists(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
    if ends[-1] >= 2**31:
        raise ValueError("one block of texts has over 2**31 ids")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32()))


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, ids (array of int): one row for each row of docs."""
    path, spark = model or default_model(), docs.sparkSession
    text_batches(spark)
    table: dict[str, bytes] = {}
    if pieces_for(path).by_chunk:
        table = {r["chunk"]: np.array(r["ids"], "<i4").tobytes() for r in chunk_table(docs, path, text_col, table_rows).toLocalIterator()}
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_for(path)
        for b in batches:
            for lo in range(0, max(1, b.num_rows), BLOCK):
                part = b.slice(lo, BLOCK)
                ids = pieces.encode([x.as_py() for x in part.column("text")], shared.value) if part.num_rows else []
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with one more column (or with that column replaced): the text of their ids."""
    path = model or default_model()
    where = encoded.columns.index(ids_col)
    kept = [i for i, c in enumerate(encoded.columns) if c != into]
    names = [*(encoded.columns[i] for i in kept), into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_for(path)
        for b in batches:
            for lo in range(0, max(1, b.num_rows), BLOCK):
                part = b.slice(lo, BLOCK)
                c = part.column(where).cast(pa.list_(pa.int32()))
                flat, ends, valid = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy(), c.is_valid().to_pylist()
                rows = [i for i, v in enumerate(valid) if v]
                got = dict(zip(rows, pieces.decode([flat[ends[i] : ends[i + 1]] for i in rows]), strict=True))
                text = pa.array([got.get(i) for i in range(part.num_rows)], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], text], names)

    fields = ", ".join(f"`{encoded.columns[i]}` {encoded.schema[i].dataType.simpleString()}" for i in kept)
    return encoded.mapInArrow(run, f"{fields}, `{into}` string")


def digest(ids: Column) -> Column:
    """Hex sha256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def round_trip(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = decode(encode(docs, model, id_col, text_col, table_rows), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
