"""Fill-in-the-middle: a text is cut at two line ends and its parts are put in another order behind marks.

Texts are scanned by a small automaton, in chunks. A chunk says, for each state in which the automaton may enter it, in which state it leaves and how many lines begin
in it: a function that needs nothing from outside, so chunks are scanned in parallel. Functions compose associatively; their composition over a
document's chunks gives the state and the number of lines at each chunk's entry, the document's number of lines and whether it holds a mark.
A cut is the start of one line, found by the one chunk in which that line begins.

Documents of one chunk need no composition and are finished where they are read. The chunks of longer ones are dealt over all tasks by document and place; only
functions (a few numbers a chunk, at most 2 GB / CHUNK chunks a document) are gathered by document, in two levels. No task holds a long document: what comes out are pieces in order.

Defined results: null text counts as empty and stays plain; a null id draws as an empty one does; a repeated row is a document of its own; texts of any length are whole; an empty table gives no rows;
columns other than id and text are not read. A text that holds a mark stays plain, so the output can always be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.session import stash, text_batches

#: The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = re.compile("<[PSM]>")
SEED, RATE, SPM = 7, 100, 50
#: Characters of a chunk, and functions that are composed at a time.
CHUNK, COMPOSED = 1 << 16, 256

#: States: whether a line begins here (START, or not) and what a mark may come of: nothing, `<`, or `<` and a letter; or SEEN, that a mark was seen, for good.
NOTHING, OPEN, LETTER, SEEN = 0, 1, 2, 3
START, STATES = 4, 8


def scan(text: str) -> tuple[list[int], list[int]]:
    """The function of a chunk (not empty): per entry state the state on leaving it and the number of lines that begin in it."""
    ends = text[-1] == "\n"
    begun = text.count("\n") - ends  # behind a line end of this chunk
    inside = MARKS.search(text) is not None
    pending = LETTER if len(text) > 1 and text[-2] == "<" and text[-1] in "PSM" else OPEN if text[-1] == "<" else NOTHING
    exits, counts = [], []
    for entry in range(STATES):
        starts, before = divmod(entry, START)
        spans = before == LETTER and text[0] == ">" or before == OPEN and re.match("[PSM]>", text) is not None
        after = LETTER if before == OPEN and text in ("P", "S", "M") else pending
        exits.append((SEEN if before == SEEN or inside or spans else after) + START * ends)
        counts.append(begun + starts)
    return exits, counts


def line_start(text: str, k: int, at_start: bool) -> int:
    """Where the k-th line (from 0) that begins in this chunk begins."""
    if at_start and k == 0:
        return 0
    k -= at_start
    found = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10)
    return int(found[k]) + 1


def draws(doc_id: object, seed: int) -> list[int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def choose(doc_id: object, n: int, marked: bool, seed: int, rate: int, spm: int) -> tuple[str, int, int]:
    """Form and the two cuts in lines of a document of n lines."""
    h = draws(doc_id, seed)
    cuts = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return ("plain" if not n or marked or h[2] % 100 >= rate else "spm" if h[3] % 100 < spm else "psm"), *cuts


def put_together(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(form: Column, output: Column) -> Column:
    """The text that a whole output was made of: in a changed document a mark occurs as a mark only."""
    part = F.split(output, MARKS.pattern)
    back = F.when(form == "psm", F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2))).otherwise(F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1)))
    return F.when(form == "plain", output).otherwise(back)


FIELDS = "mark long, n long, form string, prefix_chars long, middle_chars long, piece long, output string"


def transform_short(docs: DataFrame, seed: int, rate: int, spm: int) -> DataFrame:
    """Documents of one chunk: one piece each. mark is null."""

    def one(doc_id: object, text: str) -> tuple:
        if not text:
            return None, 0, "plain", None, None, 0, ""
        exits, counts = scan(text)
        n = counts[START]
        form, lo, hi = choose(doc_id, n, exits[START] % START == SEEN, seed, rate, spm)
        if form == "plain":
            return None, n, form, None, None, 0, text
        a, b = (len(text) if k == n else line_start(text, k, True) for k in (lo, hi))
        return None, n, form, a, b - a, 0, put_together(form, text[:a], text[a:b], text[b:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(i.as_py(), x.as_py() or "") for i, x in zip(b.column("doc_id"), b.column("text"), strict=True)]
            columns = zip(*got, strict=True) if got else [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "mark", "n", "form", "prefix_chars", "middle_chars", "piece", "output"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FIELDS}")


def deal_chunks(docs: DataFrame, chunk: int) -> DataFrame:
    """doc_id, mark (one for each document), at, text: chunks of long documents, dealt over all tasks and written, so that marks stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            for i, x in enumerate(b.column("text")):
                text, own = x.as_py(), b.column("doc_id").slice(i, 1)
                for lo in range(0, len(text), chunk):
                    yield pa.RecordBatch.from_arrays([own, pa.array([base + k], pa.int64()), pa.array([lo // chunk], pa.int64()), pa.array([text[lo : lo + chunk]], pa.string())], ["doc_id", "mark", "at", "text"])
                k += 1

    dealt = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, at long, text string")
    return stash(dealt.repartition("mark", "at"), "infill-chunks")


def scan_chunks(chunks: DataFrame) -> DataFrame:
    """mark, at, chars, f: the function of each chunk as an array of (to, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("to", pa.int32()), ("n", pa.int64())]))
        for b in batches:
            texts = [x.as_py() for x in b.column("text")]
            got = [[{"to": e, "n": c} for e, c in zip(*scan(t), strict=True)] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("mark"), b.column("at"), pa.array(map(len, texts), pa.int64()), pa.array(got, kind)], ["mark", "at", "chars", "f"])

    return chunks.select("mark", "at", "text").mapInArrow(run, "mark long, at long, chars long, f array<struct<to:int,n:long>>")


def compose(f: Column, g: Column) -> Column:
    """First f, then g."""
    return F.transform(f, lambda s: F.struct(F.get(g, s["to"])["to"].alias("to"), (s["n"] + F.get(g, s["to"])["n"]).alias("n")))


IDENTITY = "transform(sequence(0, 7), s -> struct(s AS to, 0L AS n))"


def enter_chunks(scanned: DataFrame) -> DataFrame:
    """mark, at, state, lines, before (characters), and the document's n, chars, marked. Blocks of COMPOSED functions are composed, then a document's blocks, which
    gives each block's entry and from it each chunk's."""
    own = F.struct("at", "chars", "f")
    blocks = scanned.groupBy("mark", F.floor(F.col("at") / COMPOSED).alias("block")).agg(F.array_sort(F.collect_list(own)).alias("chunks"))
    blocks = stash(blocks.withColumn("f", F.aggregate("chunks", F.expr(IDENTITY), lambda f, c: compose(f, c["f"]))).withColumn("chars", F.aggregate("chunks", F.lit(0).cast("long"), lambda s, c: s + c["chars"])), "infill-blocks")

    def entries(parts: str, state_: Column, lines: Column, before: Column) -> Column:
        """Parts in order, each with what holds at its entry."""
        first = F.struct(state_.cast("int").alias("state"), lines.cast("long").alias("lines"), before.cast("long").alias("before"), F.expr("CAST(array() AS array<struct<at:long,state:int,lines:long,before:long>>)").alias("seen"))

        def step(s: Column, c: Column) -> Column:
            to = F.get(c["f"], s["state"])
            seen = F.concat(s["seen"], F.array(F.struct(c["at"].alias("at"), s["state"].alias("state"), s["lines"].alias("lines"), s["before"].alias("before"))))
            return F.struct(to["to"].alias("state"), (s["lines"] + to["n"]).alias("lines"), (s["before"] + c["chars"]).alias("before"), seen.alias("seen"))

        return F.aggregate(parts, first, step)

    documents = blocks.groupBy("mark").agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), "chars", "f"))).alias("blocks"))
    ends = documents.select("mark", entries("blocks", F.lit(START), F.lit(0), F.lit(0)).alias("e")).select("mark", F.col("e.lines").alias("n"), F.col("e.before").alias("chars"), (F.col("e.state") % START == SEEN).alias("marked"), F.explode("e.seen").alias("b"))
    entered = blocks.select("mark", "block", "chunks").join(ends.withColumn("block", F.col("b.at")), ["mark", "block"])
    got = entered.select("mark", "n", "chars", "marked", F.explode(entries("chunks", F.col("b.state"), F.col("b.lines"), F.col("b.before"))["seen"]).alias("c"))
    return got.select("mark", "c.at", "c.state", "c.lines", "c.before", "n", "chars", "marked")


def transform_long(docs: DataFrame, seed: int, rate: int, spm: int, chunk: int) -> DataFrame:
    """Documents of several chunks: pieces in order of the output. Marks are pieces of their own, put in by the first chunk's task."""
    chunks = deal_chunks(docs, chunk)
    kind = docs.schema["doc_id"].dataType.simpleString()
    entered = stash(chunks.drop("text").join(enter_chunks(scan_chunks(chunks)), ["mark", "at"]), "infill-entries")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [choose(i, n, m, seed, rate, spm) for i, n, m in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "marked")), strict=True)]
            columns = zip(*got, strict=True) if got else [()] * 3
            yield pa.RecordBatch.from_arrays([b.column("mark"), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)]], ["mark", "form", "lo", "hi"])

    chosen = entered.filter("at = 0").select("mark", "doc_id", "n", "marked").mapInArrow(plan, "mark long, form string, lo long, hi long")
    known = stash(entered.join(chosen, "mark"), "infill-plans")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            found = [(r["mark"], r[c], r["before"] + line_start(r["text"], r[c] - r["lines"], r["state"] >= START)) for r in rows for c in ("lo", "hi") if r["own_" + c]]
            columns = zip(*found, strict=True) if found else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["mark", "line", "place"])

    # A line's start is in the one chunk whose lines reach over it; line n is the end of the text.
    ahead = known.withColumn("next", F.coalesce(F.lead("lines").over(Window.partitionBy("mark").orderBy("at")), F.col("n")))
    holds = {c: (F.col("form") != "plain") & (F.col("lines") <= F.col(c)) & (F.col(c) < F.col("next")) for c in ("lo", "hi")}
    wanted = ahead.filter(holds["lo"] | holds["hi"]).select("mark", "at", "state", "lines", "before", "lo", "hi", holds["lo"].alias("own_lo"), holds["hi"].alias("own_hi"))
    places = wanted.join(chunks.select("mark", "at", "text"), ["mark", "at"]).mapInArrow(select, "mark long, line long, place long").distinct()
    cut = stash(known.filter("at = 0").select("mark", "lo", "hi", "chars", "form").join(places.groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("line", "place"))).alias("p")), "mark", "left")
                .select("mark", F.coalesce(F.try_element_at("p", F.col("lo")), F.col("chars")).alias("a"), F.coalesce(F.try_element_at("p", F.col("hi")), F.col("chars")).alias("b")), "infill-cuts")
    last = F.floor((F.col("chars") - 1) / chunk) + 1
    full = known.join(cut, "mark").select("mark", "at", "before", "n", "form", "a", "b", last.alias("last")).join(chunks, ["mark", "at"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "mark", "n", "form", "prefix_chars", "middle_chars", "piece", "output"]
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in ("mark", "at", "before", "n", "form", "a", "b", "last", "text")}
                if r["form"] == "plain":
                    out = [(r["at"], r["text"])]
                else:
                    cuts = [min(max(x - r["before"], 0), len(r["text"])) for x in (0, r["a"], r["b"])]
                    order = (0, 2, 1) if r["form"] == "psm" else (1, 2, 0)  # places of prefix, middle, suffix
                    ends = [*cuts[1:], len(r["text"])]
                    width = r["last"] + 1  # a part's pieces: its mark, then at most one from each chunk
                    out = [(p * width + 1 + r["at"], r["text"][lo:hi]) for p, lo, hi in zip(order, cuts, ends, strict=True) if hi > lo]
                    if r["at"] == 0:
                        out += [(p * width, m) for p, m in zip(order, (PREFIX, MIDDLE, SUFFIX), strict=True)]
                own, plain = batch.column("doc_id").slice(k, 1), r["form"] == "plain"
                for piece, text in out:
                    row = [r["mark"], r["n"], r["form"], None if plain else r["a"], None if plain else r["b"] - r["a"], piece, text]
                    yield pa.RecordBatch.from_arrays([own, *[pa.array([v], pa.string() if j in (2, 6) else pa.int64()) for j, v in enumerate(row)]], names)

    return full.mapInArrow(write, f"doc_id {kind}, {FIELDS}")


def fill_in_middle(docs: DataFrame, *, seed: int = SEED, rate: int = RATE, spm: int = SPM, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark, n, form, prefix_chars, middle_chars, piece, output. A document of at most `chunk` characters is one row, whose mark is null; a longer one is the rows
    of its mark, whose outputs in order of piece are its output. rate percent of the documents are changed, spm percent of those begin with the suffix."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    return transform_short(rows.filter(~is_long), seed, rate, spm).unionByName(transform_long(rows.filter(is_long), seed, rate, spm, chunk))


def restore(pieces: DataFrame) -> DataFrame:
    """doc_id, mark, piece, text: the texts that outputs were made of, in order of piece. Documents of one row are taken apart in it; a piece of a longer one belongs to
    the mark before it, and they are put in the order prefix, middle, suffix."""
    short = pieces.filter("mark is null").select("doc_id", "mark", "piece", restored(F.col("form"), F.col("output")).alias("text"))
    long_ = pieces.filter("mark is not null")
    is_mark = F.col("output").isin(PREFIX, MIDDLE, SUFFIX) & (F.col("form") != "plain")
    marks = long_.filter(is_mark).groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("piece", "output"))).alias("marks"))  # three a document
    before = F.try_element_at(F.filter("marks", lambda m: m["piece"] < F.col("piece")), F.lit(-1))["output"]
    part = F.when(before == MIDDLE, 1).when(before == SUFFIX, 2).otherwise(0)
    back = long_.filter(~is_mark).join(marks, "mark", "left").select("doc_id", "mark", (part * F.lit(1 << 40) + F.col("piece")).alias("piece"), F.col("output").alias("text"))
    return short.unionByName(back)


def digest_pieces(pieces: DataFrame, text_col: str) -> DataFrame:
    """mark, sha256 of the pieces of each mark in order. A digest is sequential, so one document is one task's stream, of which it holds a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for b in batches:
            done = []
            for mark, text in zip(b.column("mark").to_pylist(), b.column("text"), strict=True):
                if mark != last:
                    if h is not None:
                        done.append((last, h.hexdigest()))
                    last, h = mark, hashlib.sha256()
                h.update(text.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["mark", "digest"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([h.hexdigest()], pa.string())], ["mark", "digest"])

    rows = pieces.select("mark", "piece", F.col(text_col).alias("text")).repartition("mark").sortWithinPartitions("mark", "piece")
    return rows.mapInArrow(run, "mark long, digest string")


def infill_report(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: one row for each document."""
    pieces = fill_in_middle(docs, **settings)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    short = pieces.filter("mark is null").select(*names, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))
    long_ = stash(pieces.filter("mark is not null"), "infill-pieces")
    made, back = digest_pieces(long_, "output").toDF("mark", "output_sha256"), digest_pieces(restore(long_), "text").toDF("mark", "restored_sha256")
    heads = long_.groupBy("mark").agg(*(F.first(c).alias(c) for c in names))
    return short.unionByName(heads.join(made, "mark").join(back, "mark").select(short.columns))
