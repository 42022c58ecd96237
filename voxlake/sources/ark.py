"""Archives of keyed vectors, matrices, posteriors and bin times, as a Spark data source ("ark") that reads in splits and writes with a commit.

Formats: int vectors; tokens FV / DV (float and double vectors), FM / DM (matrices), CM (matrices of one byte per value, decoded through four
percentiles a column); bracketed text; posteriors (records of a number and a value for each frame) and bin times.

Reading: ``spark.read.format("ark").load(path)`` of a file, a folder or an index. An archive beside which there is an index (same name, ending in .scp: key, archive:offset of each value) is cut into splits of about
`split_bytes` at records; one that is gzipped, or that has no index, is one split. Option ``type``: numeric (default), posterior or bins. ``read_at_offsets`` fetches the values that an index names, each file's in one task's order.

Writing: ``df.write.format("ark").mode("append").save(folder)`` with option ``kind``: float, double, int, compressed, text, posterior or bins. Each task writes a draft of an archive and of its index; the commit gives
all of them their names, so a task that is run again or a job that fails leaves nothing that a reader sees. Mode overwrite removes the earlier archives at the commit.

Files are opened by the workers through Arrow's file systems, so a path may be local to a shared mount or in any store that Arrow knows by its scheme. Commands in place of files are not run.

Values: a vector has no number of rows (null), a matrix has; a null value is written as an empty vector; keys are not empty and hold no blanks (an error else); an empty table gives a folder without archives.
"""

from __future__ import annotations

import gzip
import io
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Percentile codes at which the two bends of a compressed column lie.
BENDS = (0, 64, 192, 255)
SPLIT_BYTES = 64 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def open_at(path: str, offset: int = 0) -> io.BufferedIOBase:
    where, name = store(path)
    if name.endswith(".gz"):
        return gzip.GzipFile(fileobj=where.open_input_stream(name, compression=None))
    f = where.open_input_file(name)
    f.seek(offset)
    return io.BufferedReader(f, 1 << 16)


# --- values ------------------------------------------------------------------------------------------------------------


def read_key(f: io.BufferedIOBase) -> str | None:
    key = b""
    while (c := f.read(1)) not in (b"", b" "):
        key += c
    return key.decode().strip() or None


def _int(f: io.BufferedIOBase) -> int:
    if f.read(1) != b"\4":
        raise ValueError("a number without its size")
    return struct.unpack("<i", f.read(4))[0]


def _text(f: io.BufferedIOBase, first: bytes) -> np.ndarray:
    line = first + f.readline()
    if b"[" not in line:
        return np.array(line.split(), float)
    whole = line
    while b"]" not in line and (line := f.readline()):
        whole += line
    inner = whole.decode().replace("[", " ").split("]")[0]
    rows = [np.array(r.split(), float) for r in inner.split("\n") if r.strip()]
    return (rows[0] if rows else np.empty(0)) if len(rows) < 2 and "\n" not in inner else np.array(rows)


def decode_compressed(head: tuple[float, float], columns: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """columns: (cols, 4) 16-bit percentiles; codes: (cols, rows) bytes: piecewise linear between the percentiles."""
    low, span = head
    p = low + span * columns.astype(float) / 65535
    out = np.empty(codes.shape[::-1])
    for i, c in enumerate(codes):
        out[:, i] = np.interp(c, BENDS, p[i])
    return out


def encode_compressed(m: np.ndarray) -> tuple[tuple[float, float], np.ndarray, np.ndarray]:
    """What decode_compressed takes: the bends of a column are its quartiles."""
    low = float(m.min()) if m.size else 0.0
    span = float(m.max() - low) if m.size else 0.0
    head = np.float32(low), np.float32(span if span > 0 else 1.0)
    at = np.quantile(m, [0, 0.25, 0.75, 1], axis=0).T if m.size else np.zeros((m.shape[1], 4))
    columns = np.clip(np.rint((at - head[0]) / head[1] * 65535), 0, 65535).astype("<u2")
    codes = np.empty(m.shape[::-1], np.uint8)
    for i, c in enumerate(m.T):
        p = head[0] + head[1] * columns[i].astype(float) / 65535
        codes[i] = np.clip(np.rint(np.interp(c, p, BENDS)), 0, 255)
    return (float(head[0]), float(head[1])), columns, codes


def read_value(f: io.BufferedIOBase) -> np.ndarray:
    first = f.read(1)
    if first != b"\0":
        return _text(f, first)
    f.read(1)  # B
    kind = f.read(1)
    if kind == b"\4":
        n = struct.unpack("<i", f.read(4))[0]
        return np.frombuffer(f.read(5 * n), np.dtype([("size", "i1"), ("value", "<i4")]))["value"].astype(float)
    kind += f.read(2)
    if kind in (b"FV ", b"DV "):
        dtype = np.dtype("<f4" if kind[:1] == b"F" else "<f8")
        n = _int(f)
        return np.frombuffer(f.read(n * dtype.itemsize), dtype).astype(float)
    if kind in (b"FM ", b"DM "):
        dtype = np.dtype("<f4" if kind[:1] == b"F" else "<f8")
        n, m = _int(f), _int(f)
        return np.frombuffer(f.read(n * m * dtype.itemsize), dtype).astype(float).reshape(n, m)
    if kind == b"CM ":
        low, span, n, m = struct.unpack("<ffii", f.read(16))
        columns = np.frombuffer(f.read(8 * m), "<u2").reshape(m, 4)
        return decode_compressed((low, span), columns, np.frombuffer(f.read(n * m), np.uint8).reshape(m, n))
    raise ValueError(f"unknown archive token {kind!r}")


def _sized(n: int) -> bytes:
    return b"\4" + struct.pack("<i", n)


def value_bytes(v: np.ndarray, kind: str) -> bytes:
    if kind == "text":
        rows = v.reshape(1, -1) if v.ndim == 1 else v
        lines = [" ".join(repr(float(a)) for a in r) for r in rows]
        return f" [ {lines[0]} ]\n".encode() if v.ndim == 1 else ("[\n" + "\n".join(lines) + " ]\n").encode()
    if kind == "int":
        a = np.empty(v.size, [("size", "i1"), ("value", "<i4")])
        a["size"], a["value"] = 4, v.reshape(-1)
        return b"\0B" + _sized(v.size) + a.tobytes()
    if kind == "compressed" and v.ndim == 2:
        (low, span), columns, codes = encode_compressed(v)
        return b"\0BCM " + struct.pack("<ffii", low, span, *v.shape) + columns.tobytes() + codes.tobytes()
    letter, dtype = ("D", "<f8") if kind == "double" else ("F", "<f4")
    return b"\0B" + f"{letter}{'V' if v.ndim == 1 else 'M'} ".encode() + b"".join(map(_sized, v.shape)) + v.astype(dtype).tobytes()


#: A record of a posterior archive: a number and a value, each with its size in front; and one of bin times.
_POSTERIOR = np.dtype([("size", "i1"), ("index", "<i4"), ("size2", "i1"), ("value", "<f4")])
_SPAN = np.dtype([("size", "i1"), ("begin", "<f4"), ("size2", "i1"), ("end", "<f4")])


def _records(f: io.BufferedIOBase, kind: np.dtype) -> np.ndarray:
    n = _int(f)
    return np.frombuffer(f.read(n * kind.itemsize), kind)


def _record_bytes(a: np.ndarray, b: np.ndarray, kind: np.dtype) -> bytes:
    out = np.empty(len(a), kind)
    out["size"] = out["size2"] = 4
    out[kind.names[1]], out[kind.names[3]] = a, b
    return _sized(len(out)) + out.tobytes()


def _begin(f: io.BufferedIOBase) -> None:
    if f.read(2) != b"\0B":
        raise ValueError("not a binary record")


def read_posterior(f: io.BufferedIOBase) -> list[np.ndarray]:
    _begin(f)
    return [_records(f, _POSTERIOR) for _ in range(_int(f))]


def read_spans(f: io.BufferedIOBase) -> np.ndarray:
    _begin(f)
    return _records(f, _SPAN)


# --- rows --------------------------------------------------------------------------------------------------------------

SCHEMAS = {
    "numeric": "key string, rows int, cols int, data array<double>",
    "posterior": "key string, frame int, index int, value float",
    "bins": "key string, bin int, begin float, end float",
}


def _columns(type_: str) -> list[tuple[str, pa.DataType]]:
    if type_ == "numeric":
        return [("key", pa.string()), ("rows", pa.int32()), ("cols", pa.int32()), ("data", pa.list_(pa.float64()))]
    if type_ == "posterior":
        return [("key", pa.string()), ("frame", pa.int32()), ("index", pa.int32()), ("value", pa.float32())]
    return [("key", pa.string()), ("bin", pa.int32()), ("begin", pa.float32()), ("end", pa.float32())]


def _one(key: str, f: io.BufferedIOBase, type_: str) -> tuple[list, int]:
    """Columns of one record, and its numbers."""
    if type_ == "numeric":
        v = read_value(f)
        return [[key], [v.shape[0] if v.ndim == 2 else None], [v.shape[-1]], [v.reshape(-1)]], v.size
    if type_ == "posterior":
        frames = read_posterior(f)
        a = np.concatenate(frames) if frames else np.empty(0, _POSTERIOR)
        return [[key] * len(a), np.repeat(np.arange(len(frames)), [len(x) for x in frames]), a["index"], a["value"]], len(a)
    a = read_spans(f)
    return [[key] * len(a), np.arange(len(a)), a["begin"], a["end"]], len(a)


def batches(records: Iterator[tuple[str, io.BufferedIOBase]], type_: str, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about `most` numbers. A short record takes some hundred bytes beside its numbers until its batch is made, so the bound is one on memory too."""
    fields = _columns(type_)
    held: list[list] = [[] for _ in fields]
    n = 0

    def ready() -> pa.RecordBatch:
        arrays = []
        for (_, kind), parts in zip(fields, held, strict=True):
            if pa.types.is_list(kind):
                values = [v for p in parts for v in p]
                ends = np.cumsum([0, *map(len, values)])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), pa.float64())))
            else:
                arrays.append(pa.chunked_array([pa.array(p, kind) for p in parts], kind).combine_chunks() if parts else pa.array([], kind))
        return pa.RecordBatch.from_arrays([a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays], [c for c, _ in fields])

    for key, f in records:
        columns, size = _one(key, f, type_)
        for h, c in zip(held, columns, strict=True):
            h.append(c)
        n += size + 1
        if n >= most:
            yield ready()
            held, n = [[] for _ in fields], 0
    if n:
        yield ready()


def records(path: str, begin: int = 0, end: int | None = None) -> Iterator[tuple[str, io.BufferedIOBase]]:
    """Keys from `begin` on, the file standing at the key's value, which the caller reads before the next."""
    with open_at(path, begin) as f:
        while (end is None or f.tell() < end) and (key := read_key(f)):
            yield key, f


def read_archive(path: str) -> Iterator[tuple[str, np.ndarray]]:
    for key, f in records(path):
        yield key, read_value(f)


def read_at(location: str) -> np.ndarray:
    """'archive:offset' to the value there."""
    path, _, offset = location.rpartition(":")
    with open_at(path, int(offset)) as f:
        return read_value(f)


def write_archive(path: str, rows: Iterator[tuple[str, np.ndarray]], kind: str = "float") -> list[tuple[str, int]]:
    """One archive; keys with the offsets of their values."""
    out, (where, name) = [], store(path)
    with where.open_output_stream(name) as f:
        for key, v in rows:
            f.write(f"{key} ".encode())
            out.append((key, f.tell()))
            f.write(value_bytes(np.asarray(v, float), kind))
    return out


def write_matrices(rows: DataFrame, key: str, order: str, vector: str, path: str) -> None:
    """One archive per key, with the key's vectors as the rows of a matrix, in order."""

    def write(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        name, (where, folder) = t.column(key)[0].as_py(), store(path)
        where.create_dir(folder, recursive=True)
        draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
        values = t.column(vector).combine_chunks()
        write_archive(f"{path}/{draft.rpartition('/')[2]}", iter([(name, values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1))]))
        where.move(draft, f"{folder}/{name}.ark")  # a task that is run again leaves one whole file
        return pa.table({"key": [name]})

    some = rows.select(F.col(key).cast("string").alias(key), order, vector)
    some.groupBy(key).applyInArrow(write, "key string").write.format("noop").mode("overwrite").save()


def read_at_offsets(index: DataFrame, type_: str = "numeric") -> DataFrame:
    """Values that an index (key, location: 'archive:offset') names, by seeking. An archive's values are read in order of offset, in slices of about 256 MB of it, each a task's run."""
    at = F.regexp_extract("location", ":([0-9]+)$", 1).cast("long")
    rows = index.select("key", F.regexp_replace("location", ":[0-9]+$", "").alias("file"), at.alias("at")).withColumn("slice", F.shiftright("at", 28))
    dealt = rows.repartition("file", "slice").sortWithinPartitions("file", "at").select("key", "file", "at")

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk() -> Iterator[tuple[str, io.BufferedIOBase]]:
            name, f = None, None
            try:
                for b in got:
                    for key, file, at in zip(*(b.column(c).to_pylist() for c in ("key", "file", "at")), strict=True):
                        if file != name:
                            if f:
                                f.close()
                            name, f = file, open_at(file)
                        f.seek(at)
                        yield key, f
            finally:
                if f:
                    f.close()

        yield from batches(walk(), type_)

    return dealt.mapInArrow(run, SCHEMAS[type_])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(key, location) of index files: a file or a folder of them."""
    t = spark.read.option("pathGlobFilter", "*.scp").text(path).filter("trim(value) <> ''")
    return t.select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("key"), F.regexp_extract("value", r"^\s*\S+\s+(.*?)\s*$", 1).alias("location"))


# --- the source --------------------------------------------------------------------------------------------------------


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArkSource)


class ArkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ark"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("type", "numeric")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArkReader(self.options["path"], self.options.get("type", "numeric"), int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArkWriter(self.options["path"], self.options.get("kind", "float"), schema.fieldNames(), overwrite)


@dataclass
class Split(InputPartition):
    path: str
    begin: int
    end: int | None

    def __init__(self, path: str, begin: int = 0, end: int | None = None):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end = path, begin, end


class ArkReader(DataSourceReader):
    def __init__(self, path: str, type_: str, split_bytes: int):
        self.path, self.type_, self.split_bytes = path, type_, split_bytes

    def _cut(self, path: str) -> list[Split]:
        """Splits of an archive by its index, of which only the places of the cuts are held."""
        where, name = store(path)
        index = name.removesuffix(".ark") + ".scp"
        if not name.endswith(".ark") or where.get_file_info(index).type != fs.FileType.File:
            return [Split(path)]
        cuts = [0]
        with where.open_input_stream(index) as raw:
            for line in io.BufferedReader(raw, 1 << 16):
                key, _, location = line.decode().strip().partition(" ")
                offset = location.rpartition(":")[2]
                if offset.isdigit() and int(offset) - cuts[-1] >= self.split_bytes:
                    cuts.append(int(offset) - len(key.encode()) - 1)
        return [Split(path, lo, hi) for lo, hi in zip(cuts, [*cuts[1:], None], strict=True)]

    def partitions(self) -> list[Split]:
        where, name = store(self.path)
        info = where.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return self._cut(self.path.removesuffix(".scp") + ".ark" if name.endswith(".scp") else self.path)
        files = sorted(i.base_name for i in where.get_file_info(fs.FileSelector(name)) if i.base_name.endswith((".ark", ".ark.gz")) and not i.base_name.startswith((".", "_")))
        return [s for f in files for s in self._cut(f"{self.path.rstrip('/')}/{f}")]

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # a folder without archives
            path, begin, end = partition.value
            yield from batches(records(path, begin, end), self.type_)


@dataclass
class Written(WriterCommitMessage):
    draft: str
    rows: int


class ArkWriter(DataSourceArrowWriter):
    """Rows in, for kinds of values: key, data, and rows where there are matrices. For posteriors and bins the rows of a key are neighbours: partition and sort them by key (and frame or bin)."""

    def __init__(self, path: str, kind: str, names: list[str], overwrite: bool):
        if kind not in ("float", "double", "int", "compressed", "text", "posterior", "bins"):
            raise ValueError(f"unknown kind of archive {kind}")
        self.path, self.kind, self.names, self.overwrite, self.job = path.rstrip("/"), kind, names, overwrite, uuid.uuid4().hex

    def _values(self, got: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for b in got:
            data = b.column(self.names.index("data")).cast(pa.list_(pa.float64()))
            flat, ends = data.values.to_numpy(zero_copy_only=False), data.offsets.to_numpy()
            rows = b.column(self.names.index("rows")).to_pylist() if "rows" in self.names else [None] * b.num_rows
            for i, (key, n, valid) in enumerate(zip(b.column(self.names.index("key")).to_pylist(), rows, data.is_valid().to_pylist(), strict=True)):
                v = flat[ends[i] : ends[i + 1]] if valid else np.empty(0)
                yield key, value_bytes(v if n is None else v.reshape(n, -1) if v.size or n else np.empty((0, 0)), self.kind)

    def _groups(self, got: Iterator[pa.RecordBatch], of: tuple[str, ...], ready: Callable[[list[np.ndarray]], bytes]) -> Iterator[tuple[str, bytes]]:
        """Runs of one key."""
        last, held = None, []
        for b in got:
            keys = b.column(self.names.index("key")).to_pylist()
            columns = [b.column(self.names.index(c)).to_numpy(zero_copy_only=False) for c in of]
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and keys[lo] != last:
                    yield last, ready([np.concatenate(c) for c in zip(*held, strict=True)])
                    held = []
                last = keys[lo]
                held.append([c[lo:hi] for c in columns])
        if held:
            yield last, ready([np.concatenate(c) for c in zip(*held, strict=True)])

    def _records(self, got: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        if self.kind == "posterior":

            def frames(c: list[np.ndarray]) -> bytes:
                n = int(c[0].max()) + 1  # frames without a record are empty
                cuts = np.searchsorted(c[0], np.arange(n + 1))
                return b"\0B" + _sized(n) + b"".join(_record_bytes(c[1][lo:hi], c[2][lo:hi], _POSTERIOR) for lo, hi in zip(cuts, cuts[1:], strict=False))

            return self._groups(got, ("frame", "index", "value"), frames)
        if self.kind == "bins":
            return self._groups(got, ("begin", "end"), lambda c: b"\0B" + _record_bytes(c[0], c[1], _SPAN))
        return self._values(got)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, folder = store(self.path)
        name, n = f".{self.job}-{uuid.uuid4().hex}", 0
        where.create_dir(folder, recursive=True)
        with where.open_output_stream(f"{folder}/{name}.ark") as f, where.open_output_stream(f"{folder}/{name}.scp") as index:
            final = f"{self.path}/{self._final(name)}.ark"
            for key, raw in self._records(iterator):
                if not key or len(key.split()) != 1 or key != key.strip():
                    raise ValueError(f"a key is one word, not {key!r}")
                f.write(f"{key} ".encode())
                index.write(f"{key} {final}:{f.tell()}\n".encode())
                f.write(raw)
                n += 1
        return Written(name, n)

    @staticmethod
    def _final(draft: str) -> str:
        return "part-" + draft.lstrip(".")

    def commit(self, messages: list) -> None:
        where, folder = store(self.path)
        if self.overwrite:
            for i in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if i.base_name.endswith((".ark", ".ark.gz", ".scp")) and not i.base_name.startswith("."):
                    where.delete_file(i.path)
        for m in messages:
            for ending in (".scp", ".ark"):  # an archive that can be seen has its index
                if m is None:
                    continue
                if m.rows:
                    where.move(f"{folder}/{m.draft}{ending}", f"{folder}/{self._final(m.draft)}{ending}")
                else:
                    where.delete_file(f"{folder}/{m.draft}{ending}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        """Drafts of this job, those of failed tasks included."""
        where, folder = store(self.path)
        for i in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if i.base_name.startswith(f".{self.job}-"):
                where.delete_file(i.path)
