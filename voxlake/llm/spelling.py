"""Spelling variants: words that differ by one character, each led to its most frequent form.

Words are counted task by task, then by one shuffle of distinct words. Near words are found by a rare-first prefix filter: the positional
bigrams of a word are ordered by their frequency over all words, rarest first, and only the three rarest take part in the join, since one edit
spoils at most two bigrams. A bigram that two near words share unspoilt has the edit on its left or on its right, so the words are equal from it to the other end: the join
key of a bigram is the word up to and with it (same place), and the word from it on (place at most one off). Candidates of one key meet in tiles of bounded
size, so that a key with a third of all words is many tasks, and are verified there, first by the bits of their bigrams, of which one edit changes at most four; pairs that are not near leave no row.
Forms are followed to the last by pointer doubling: a form is at least ten times as frequent as its word, so chains are shorter than twenty.

Defined results: null texts have no words and a null id counts as an empty one; texts are read whole; a repeated row counts again; ties of forms go to the smallest word in code-point
order; an empty table gives no rows; columns other than id and text are not read. A word has at least FEWEST characters, so three bigrams always exist.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.tiles import deal_tiles
from voxlake.session import stash, text_batches

#: Runs of letters of Latin-1; a fixed value.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
FEWEST, LEAST_SEEN, TIMES_SEEN, SPOILT_ONE_IN = 7, 2, 10, 31
#: Bigrams of a word that take part in the join: one edit spoils two.
RAREST = 3
#: Rows of one side of a tile, and distinct words that a counting task holds before it hands them on.
TILE, COUNTED = 2048, 400_000
#: Rows that a comparing task takes at a time, besides the run that is not at its end.
HELD_ROWS = 32_768


def spoilt(doc_id: object, words: list[str]) -> dict[str, str]:
    """Those of a document's lower-cased runs that lose a character there, with what is left of each."""
    start, out = crc32(f"{'' if doc_id is None else doc_id}:".encode()), {}
    for w, raw in zip(words, " ".join(words).encode().split(b" ") if words else [], strict=True):
        h = crc32(raw, start)
        if not h % SPOILT_ONE_IN:
            out[w] = w[: h % len(w)] + w[h % len(w) + 1 :]
    return out


def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (word, n), combined in the task."""
    held: Counter[str] = Counter()

    def ready() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for b in batches:
        for i, x in zip(b.column("doc_id"), b.column("text"), strict=True):
            text = x.as_py()
            if not text:
                continue
            runs = [w for w in RUN.findall(text.encode().lower().decode()) if len(w) >= FEWEST]  # bytes: lower-cases A-Z only
            own = set(runs)
            less = spoilt(i.as_py(), list(own))
            held.update([less.get(w, w) for w in runs] if less else runs)
            if len(held) > COUNTED:
                yield ready()
    yield ready()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of at least FEWEST characters that occur LEAST_SEEN times or more, over all texts."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    counted = rows.mapInArrow(count_runs, "word string, n long")
    return counted.filter(F.length("word") >= FEWEST).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_SEEN)


def join_keys(words: DataFrame, rarest: int = RAREST) -> DataFrame:
    """word, n_chars, bits, more (128 bits that its bigrams set), key: two keys for each of a word's rarest positional bigrams."""
    bit = lambda salt: F.expr(f"bit_or(shiftleft(1L, pmod(hash(gram, {salt}), 64)))")
    at = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select("word", F.length("word").alias("n_chars"), F.posexplode(F.transform(at, lambda i: F.substring("word", i, F.lit(2)))).alias("at", "gram"))
    seen = grams.groupBy("gram").agg(F.count("*").alias("seen"))  # at most 91 letters squared
    ranked = grams.join(F.broadcast(seen), "gram").groupBy("word", "n_chars").agg(F.array_sort(F.collect_list(F.struct("seen", "gram", "at"))).alias("grams"), bit(1).alias("bits"), bit(2).alias("more"))
    rare = ranked.select("word", "n_chars", "bits", "more", F.explode(F.transform(F.slice("grams", 1, rarest), lambda g: g["at"])).alias("at"))
    left = F.concat(F.lit("<"), F.substring(F.col("word"), F.lit(1), F.col("at") + 2))
    right = F.concat(F.lit(">"), F.substring(F.col("word"), F.col("at") + 1, F.col("n_chars")))
    return rare.select("word", "n_chars", "bits", "more", F.explode(F.array(left, right)).alias("key"))


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    if n == len(b):
        return i < n and a[i + 1 :] == b[i + 1 :]
    return n + 1 == len(b) and a[i:] == b[i + 1 :]


def pairs_of(size: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group, for groups of these sizes one after another, about `most` at a time."""
    end = np.repeat(np.cumsum(size), size)
    row = np.arange(len(end))
    behind = end - row - 1
    cuts = np.flatnonzero(np.diff(np.cumsum(behind) // most)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(row)], strict=True):
        n = behind[lo:hi]
        i = np.repeat(row[lo:hi], n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in sorted runs of (h, u, v) to the pairs of a run that are one edit apart, the lesser first. Pairs are told apart by their bits, many at a time, before any word is looked at.
    A tile that joins two chunks compares one with the other only."""
    names = ["h", "u", "v", "side", "word", "n_chars", "bits", "more"]

    def done(t: pa.Table, size: np.ndarray) -> pa.RecordBatch:
        u, v, side, chars, bits, more = (t.column(c).to_numpy() for c in ("u", "v", "side", "n_chars", "bits", "more"))
        bits, more = bits.view(np.uint64), more.view(np.uint64)  # of signed numbers, the absolute value's bits would be counted
        words, out = t.column("word").to_pylist(), []
        for i, j in pairs_of(size):
            near = np.bitwise_count(bits[i] ^ bits[j]) <= 4
            i, j = i[near], j[near]
            near = (np.bitwise_count(more[i] ^ more[j]) <= 4) & (np.abs(chars[i] - chars[j]) <= 1) & ((u[i] == v[i]) | (side[i] != side[j]))
            out += [(a, b) if a < b else (b, a) for a, b in ((words[x], words[y]) for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True)) if one_edit(a, b)]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], ["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in chain(batches, [None]):
        if b is not None:
            held.append(b.select(names))
            rows += b.num_rows
            if rows < HELD_ROWS:
                continue
        if not rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        keys = [t.column(c).to_numpy() for c in ("h", "u", "v")]
        edges = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        whole = len(t) if b is None else int(edges[-1]) if len(edges) else 0  # the last run may go on in the next batch
        if whole:
            yield done(t.slice(0, whole), np.diff([0, *edges[edges < whole], whole]))
        held, rows = t.slice(whole).to_batches(), len(t) - whole


def meet(keys: DataFrame, tile: int = TILE) -> DataFrame:
    """a, b (a < b): the pairs of words of one key that are one edit apart. A key with more than `tile` words is split into chunks of about that size
    that meet two by two; each pair of words meets in one tile."""
    hashed = keys.select(F.xxhash64("key").alias("h"), "word", "n_chars", "bits", "more")  # keys of one hash only mean more pairs to tell apart
    chunks = hashed.groupBy("h").agg(F.count("*").alias("of")).filter(F.col("of") > 1).select("h", F.ceil(F.col("of") / tile).cast("int").alias("chunks"))
    return deal_tiles(hashed.join(chunks, "h"), ["h"], "chunks", "word", ["n_chars", "bits", "more"]).mapInArrow(compare, "a string, b string").distinct()


def near_words(words: DataFrame, rarest: int = RAREST, tile: int = TILE) -> DataFrame:
    """a, b (a < b): all pairs of words (at least rarest + 1 characters each, no word twice) at edit distance one."""
    return meet(join_keys(words, rarest), tile)


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last, by doubling; a word that has no form is no row."""
    now = stash(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stash(now.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return now


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """word, n, n_near, form, form_n, root."""
    words = stash(count_words(docs, id_col, text_col), "spelling-words")
    pairs = near_words(words, tile=tile)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))
    both = pairs.select(F.explode(ways).alias("p")).select("p.*")
    seen = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = seen.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= TIMES_SEEN * F.col("n")
    out = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")
    )
    out = stash(out, "spelling-forms")
    roots = last_forms(out.filter("form is not null").select("word", "form"))
    return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
